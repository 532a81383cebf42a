import re

import pytest
from pyspark.sql import functions as F

from shelfspark import config
from shelfspark.functions import rules
from shelfspark.functions.patterns import translate

CONFIG = config.Config(categories={"Fiction": ["Nature", "Sailing"], "NonFiction": ["Technology", "Sailing"], "Uncategorized": []}, rules=[config.Rule("author", "Mira Stonefell", "Fiction", "Nature"), config.Rule("filename", "(?i)loom|spindle", "NonFiction", "Technology")])


def categorise(evaluate, rows, cfg=CONFIG):
    got = evaluate(rows, ["p", "t", "a", "s"], rules.categorise(cfg, F.col("p"), F.col("t"), F.col("a"), F.col("s")))
    return [tuple(r) for r in got]


def test_rules_in_order(evaluate):
    rows = [("/x/a.epub", "", " mira STONEFELL ", ""), ("/x/Learning Loom.pdf", "", "", ""), ("/x/loom.pdf", "", "Mira Stonefell", ""), ("/x/a.epub", "", "", "sailing"), ("/x/a.epub", "", "", " sailing"), ("/loom/a.epub", "", "", "")]
    assert categorise(evaluate, rows) == [("Fiction", "Nature", ""), ("NonFiction", "Technology", ""), ("Fiction", "Nature", ""), ("Fiction", "Sailing", ""), ("Uncategorized", "", ""), ("Uncategorized", "", "")]


def test_undeclared_targets(evaluate):
    cfg = config.Config(categories={"Fiction": ["Nature"]}, rules=[config.Rule("title", "^A", "Fiction", "Nope"), config.Rule("title", "^B", "Other", "x"), config.Rule("title", "^C", "Fiction", "NATURE"), config.Rule("title", "(", "Never", ""), config.Rule("publisher", "x", "Never", "")])
    assert categorise(evaluate, [("p", t, "", "") for t in ("A", "B", "C", "(")], cfg) == [
        ("Fiction", "Nope", 'rule matched undeclared subcategory "Nope" under category "Fiction"'), ("Other", "x", 'rule matched undeclared category "Other"'), ("Fiction", "NATURE", ""), ("Uncategorized", "", ""),
    ]


def test_empty_author_rule_matches_missing_author(evaluate):
    cfg = config.Config(rules=[config.Rule("author", "", "None", "")])
    assert categorise(evaluate, [("p", "", "", ""), ("p", "", "x", "")], cfg)[0][0] == "None"


@pytest.mark.parametrize(("pattern", "subject", "matches"), [(r"\b2009", "é2009", True), (r"(?i)É", "é", True), (r"a$", "a\n", False), (r"a\sb", "a\x0bb", False), (r"[[:alpha:]]+\d", "x1", True), (r"^\w+$", "é", False), (r"(?P<n>a)b", "ab", True), (r"[]a]", "]", True), (r"c#|c\+\+", "c++", True), (r"[a&&b]", "&", True)])
def test_patterns(evaluate, pattern, subject, matches):
    assert evaluate([(subject,)], ["s"], F.col("s").rlike(translate(pattern))) == [matches]


@pytest.mark.parametrize("pattern", ["(?=a)", "(?<!a)b", r"(a)\1", "(", "[a", "a\\", "(?>a)"])
def test_patterns_that_never_match(pattern):
    with pytest.raises(re.error):
        translate(pattern)


def test_config_round_trip(tmp_path):
    path = str(tmp_path / "c.yaml")
    pytest.importorskip("yaml")
    config.save(path, CONFIG)
    assert config.load(path) == CONFIG
    assert rules.destinations(CONFIG) == [("Fiction", "Nature"), ("Fiction", "Sailing"), ("NonFiction", "Sailing"), ("NonFiction", "Technology")]
    assert config.rule_warnings(config.Config(rules=[config.Rule("filename", "(", "x"), config.Rule("title", "(", "x")]))[0].startswith('rule 1 (match_value "("): invalid regex')
    assert config.from_mapping({"general": {"library_folder": "/l", "other": 1}, "rules": None}) == config.Config(config.General(library_folder="/l"))

"""Categorisation rules, compiled on the driver into one ordered CASE.

Rules travel inside the plan, so categorising is a projection: no join, no shuffle.  A rule whose pattern cannot be
compiled never matches.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import UNCATEGORIZED, Config, Rule
from . import paths
from .patterns import translate
from .text import strip


def _quoted(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def undeclared(config: Config, category: str, subcategory: str) -> str:
    """What is wrong with a rule's target: '' if it is declared.  Categories are compared exactly, subcategories by fold."""
    if category not in config.categories:
        return f"rule matched undeclared category {_quoted(category)}"
    if not subcategory or subcategory.lower() in {s.lower() for s in config.categories[category]}:
        return ""
    return f"rule matched undeclared subcategory {_quoted(subcategory)} under category {_quoted(category)}"


def compiled(pattern: str) -> str | None:
    """The pattern for Spark; None if it is no pattern."""
    try:
        out = translate(pattern)
    except re.error:
        return None
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(out)
        except Exception:
            return None
    return out


def _matches(rule: Rule, title: Column, author: Column, subject: Column, filename: Column) -> Column | None:
    folded = lambda c: F.lower(strip(c)) == rule.match_value.strip().lower()
    if rule.match_field == "author":
        return folded(author)
    if rule.match_field == "metadata_subject":
        return folded(subject)
    if rule.match_field in ("title", "filename"):
        pattern = compiled(rule.match_value)
        return None if pattern is None else (title if rule.match_field == "title" else filename).rlike(pattern)
    return None


def _target(category: str, subcategory: str, warning: str = "") -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.lit(warning).alias("warning"))


def categorise(config: Config, source_path: Column, title: Column, author: Column, subject: Column) -> Column:
    """struct(category, subcategory, warning): the first rule that matches, else the declared subcategory that the subject
    names (the first declared, if several do), else Uncategorized."""
    filename = paths.base_name(source_path)
    rest = _target(UNCATEGORIZED, "")
    declared: dict[str, tuple[str, str]] = {}
    for category, subs in config.categories.items():
        for sub in subs:
            declared.setdefault(sub.lower(), (category, sub))
    if declared:
        table = F.create_map(*[x for k, v in declared.items() for x in (F.lit(k), _target(*v))])
        rest = F.coalesce(F.when(subject != "", F.try_element_at(table, F.lower(subject))), rest)
    out = None
    for rule in config.rules:
        condition = _matches(rule, title, author, subject, filename)
        if condition is not None:
            value = _target(rule.category, rule.subcategory, undeclared(config, rule.category, rule.subcategory))
            out = F.when(condition, value) if out is None else out.when(condition, value)
    return rest if out is None else out.otherwise(rest)


def destinations(config: Config) -> list[tuple[str, str]]:
    """(category, subcategory) that a row can be sent to by hand, sorted; a category without subcategories has ''."""
    return sorted((c, s) for c, subs in config.categories.items() if c != UNCATEGORIZED for s in (subs or [""]))

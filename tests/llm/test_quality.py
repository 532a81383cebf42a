import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import classifier, common, quality_rules

from .conftest import ODD_TEXTS


def base(text):
    """The base counts as they are defined."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = ["a b c a b c d", "a a a a", "a a a", "x|y <b> 100%\n\n \nx|y <b> 100%\nx|y <b> 100% ", "é ß 日本 x", "", "one", " \t\n", "a b c d\na b c d\na b\tc d"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    data, memory = text.encode(), common.WordHash()
    words = data.split()
    assert quality_rules.base_counts(data, memory.of(words), words) == base(text)


def test_frame(spark, docs, prose):
    texts = [prose(80, k) for k in range(30)] + ["zq%%% " * 3 + " ".join(f"zq{k}%%%" for k in range(60)) for _ in range(30)] + ODD_TEXTS
    frame = docs(texts).withColumn("kept", F.lit("clash"))
    trusted = spark.createDataFrame([(k,) for k in range(30)] + [(None,), (0,)], "doc_id bigint")
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame, trusted).collect()}
    ratio = quality_rules.fit_ratio(frame, trusted)
    raw, good = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    memory = common.WordHash()
    for k, t in enumerate(texts):
        at = quality_rules.ngram_buckets(memory.of((t or "").encode().lower().split()))
        np.add.at(raw, at, 1)
        if k < 30:
            np.add.at(good, at, 1)
    assert np.allclose(ratio, np.log(good / good.sum() / (raw / raw.sum())), atol=1e-5)
    for k, t in enumerate(texts):
        r, words = got[k], (t or "").encode().split()
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t or "") if len(words) < 200 else True
        at = quality_rules.ngram_buckets(memory.of((t or "").encode().lower().split()))
        assert abs(r.llr - (ratio[at].mean() if len(at) else 0)) < 1e-4
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert all(got[k].kept for k in range(30)) and not any(got[k].kept for k in range(30, 60))
    assert quality_rules.quality_rules(frame.where("false"), trusted).count() == 0
    assert not quality_rules.fit_ratio(frame, trusted.where("false")).any()


def corpus(prose, n=240):
    """Good texts, and bad ones that shout or repeat themselves; the label of each."""
    out = []
    for k in range(n):
        t = prose(60, k)
        out.append((t, 1) if k % 3 else (t.upper().replace(" ", "!! ") if k % 2 else (t.split()[0] + " ") * 60, 0))
    return out


def test_classifier(spark, docs, prose):
    rows = corpus(prose)
    frame = docs([t for t, _ in rows] + ODD_TEXTS)
    labels = spark.createDataFrame([(k, y, 0) for k, (_, y) in enumerate(rows)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in classifier.classify(frame, labels).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k in range(len(rows)) if got[k].held_out]
    assert len(held) > 20 and np.mean([got[k].predicted == rows[k][1] for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # labels of held-out rows are not looked at, and neither is the partitioning
    other = labels.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.classify(frame.repartition(7), other).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_classifier_without_contrast(spark, docs):
    labels = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id bigint, quality int")
    frame = docs(["a b", None])
    assert {r.predicted for r in classifier.classify(frame, labels).collect()} == {1}
    assert len({r.score for r in classifier.classify(frame, labels.where("false")).collect()}) == 1
    assert classifier.classify(frame.where("false"), labels).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12) + (100 if k % 2 else 0)).astype(np.int32) for k in range(80)]
    model = classifier.fit(rows, np.arange(80) % 2)
    assert all((model.score(r) > 0.5) == (k % 2 == 1) for k, r in enumerate(rows))


def test_fit_against_plain_solver():
    """The hinge-loss objective of the fit against that of subgradient steps on a dense matrix."""
    rng, rows, labels = np.random.default_rng(4), [], []
    for k in range(80):
        y = k % 2
        chance = np.where(np.arange(40) % 2 == y, 0.45, 0.3)
        rows.append(np.flatnonzero(rng.random(40) < chance).astype(np.int32))
        labels.append(y)
    model = classifier.fit(rows, np.array(labels), rounds=300)
    scale = np.sqrt(model.squares[:40].astype(float))
    x, y = np.zeros((80, 41)), np.where(np.array(labels) > 0, 1.0, -1.0)
    for k, row in enumerate(rows):
        x[k, row] = scale[row] / (np.sqrt((scale[row] ** 2).sum()) or 1)
    x[:, 40] = 1  # the bias

    def objective(w):
        return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()

    known = scale > 0
    fitted = np.zeros(41)
    fitted[:40][known] = model.weights[:40][known] / scale[known]
    fitted[40] = model.bias
    w, mean = np.zeros(41), np.zeros(41)
    for t in range(1, 40_001):
        w = w - (w - x.T @ (y * (y * (x @ w) < 1))) / t
        if t > 20_000:
            mean += w / 20_000
    assert objective(fitted) <= 1.005 * objective(mean)

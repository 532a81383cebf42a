from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing

from .conftest import ODD_TEXTS


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """By giving the excess away again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        left, total = budget - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
    return out


def check(rows, got):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    want = targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    widest = max(largest.values(), default=0)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= widest / 2 + 1
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * widest + 1, s


def rows_of(prose):
    out = []
    for k in range(600):
        source = "hot" if k % 3 == 0 else None if k % 50 == 1 else f"s{k % 7}"
        out.append((k, prose(1 + (k * 7919) % 60, k), source))
    return out + [(1000 + k, t, "odd") for k, t in enumerate(ODD_TEXTS) if t is None or len(t) < 100] + [(2000, "é", "é"), (2001, "x", ""), (2002, "", "empty")]


def test_mix(docs, prose):
    rows = rows_of(prose)
    frame = docs(rows).withColumns({"target": F.lit("clash"), "place": F.lit(1)})
    got = mixing.mix_sources(frame, slice_rows=16).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mixing.mix_sources(frame.repartition(9), slice_rows=64).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def queued(rows, places):
    """Weighted fair queueing, literally: all copies in one list by finish time, taken while more than half of one fits."""
    sizes = {k: len((t or "").encode().split()) for k, t, _ in rows}
    whole, by_source = defaultdict(int), defaultdict(list)
    for k, _, s in rows:
        whole[s] += sizes[k]
        by_source[s].append(k)
    want, copies = targets(whole), []
    for s, ids in by_source.items():
        for copy in range(2):
            sent = copy * whole[s]
            for k in sorted(ids, key=lambda k: (places[k], k)):
                sent += sizes[k]
                if sizes[k]:
                    copies.append((sent / want[s], places[k], k))
    left, out = 1.5 * sum(whole.values()), defaultdict(int)
    for _, _, k in sorted(copies):
        if sizes[k] / 2 > left:
            break
        left -= sizes[k]
        out[k] += sizes[k]
    return {k: out[k] for k in sizes}


def test_taken_as_in_a_queue(docs, prose):
    rows = rows_of(prose)
    frame = docs(rows)
    key = F.xxhash64(F.lit(20), F.col("doc_id"), F.xxhash64("text"))
    places = {r.doc_id: (r.h % 2**64) >> 11 for r in frame.select("doc_id", key.alias("h")).collect()}
    places = {k: x / (1 << 53) for k, x in places.items()}
    got = {r.doc_id: r.taken for r in mixing.mix_sources(frame, slice_rows=16).collect()}
    assert got == queued(rows, places)


def test_cut_by_narrowing(docs, prose, monkeypatch):
    """However few rows may be sorted at once, the same copies are taken."""
    frame = docs(rows_of(prose)[:200])
    whole = {(r.doc_id, r.taken) for r in mixing.mix_sources(frame).collect()}
    monkeypatch.setattr(mixing, "NEAR_ROWS", 3)
    monkeypatch.setattr(mixing, "RANGES", 8)
    assert {(r.doc_id, r.taken) for r in mixing.mix_sources(frame).collect()} == whole


@pytest.mark.parametrize("rows", [[], [(1, "a b c", "x")], [(1, None, None)], [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")]])
def test_small(docs, rows):
    frame = docs(rows or [(1, "", "x")]).where("true" if rows else "false")
    got = mixing.mix_sources(frame).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)


def test_targets_of_extremes(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 10}, {"a": 0, "b": 0}, {None: 5, "z": 5, "Z": 5, "é": 5}, {f"s{k}": (k * 37) % 101 for k in range(40)}):
        frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, n bigint")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        assert got == pytest.approx(targets(sizes)), sizes

"""Substring dedup and the Jaccard join against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import common, jaccard, substrings

from .conftest import ODD_TEXTS


def removed(rows, window):
    """Kept words of each row, in the order of (doc_id, text)."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, (rows[k][1] or "").encode()))
    seen, out = set(), {}
    for k in order:
        words = (rows[k][1] or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[k] = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    return out


def passages(prose, n=120):
    rng, shared, rows = random.Random(5), [prose(m, 900 + m) for m in (19, 20, 25, 60, 200)], []
    for k in range(n):
        parts = [prose(rng.randrange(5, 60), k)]
        for _ in range(rng.randrange(3)):
            words = rng.choice(shared).split()
            cut = rng.randrange(len(words) // 2)
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words[cut:] if rng.random() < 0.5 else words))
        rows.append((k, "\n".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (502, ("again and again " * 30)), (503, "x " * 100)]
    return rows + [(600 + k, t) for k, t in enumerate(ODD_TEXTS)]


@pytest.mark.parametrize(("window", "group", "part"), [(20, 4 << 20, 2_000_000), (20, 2000, 300), (4, 3000, 500)])
def test_substrings(docs, prose, monkeypatch, window, group, part):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "PART_WORDS", part)
    rows = [r for r in passages(prose) if not r[1] or len(r[1]) < 20_000]
    frame = docs(rows).withColumns({"n_words": F.lit("x"), "g": F.lit(1), "payload": F.lit(2)})
    got = substrings.dedup_substrings(frame, window).collect()
    want = removed(rows, window)
    assert sorted((str(r.doc_id), r.kept, r.n_words - r.n_removed) for r in got) == sorted((str(rows[k][0]), t, len(t.encode().split())) for k, t in want.items())


def test_substrings_edges(docs):
    assert substrings.dedup_substrings(docs(["x"]).where("false")).count() == 0
    (r,) = substrings.dedup_substrings(docs(["word " * 30_000])).collect()
    assert (r.n_words, r.n_removed) == (30_000, 29_980 + 19)
    with pytest.raises(ValueError):
        substrings.dedup_substrings(docs(["x"]), 7)


def grams(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def classes(rows, n, num, den):
    sets, up = [grams(t, n) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def families(prose):
    rng, rows = random.Random(8), []
    for f in range(6):
        base = prose(rng.choice([3, 6, 20, 80, 200]), 700 + f).split()
        for _ in range(rng.choice([2, 12, 40])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["changed"], [w[k], "more"]])
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    passage = prose(60, 5)
    rows += [(1000 + k, passage + " " + prose(rng.randrange(1, 40), k)) for k in range(40)] + [(2000 + k, rows[0][1].upper()) for k in range(20)]
    rng.shuffle(rows)
    return rows + [(3000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, "lonely words without an id here")]


@pytest.mark.parametrize(("n", "num", "den", "unit", "part"), [(4, 85, 100, 512, 4_000_000), (4, 85, 100, 3, 400), (5, 80, 100, 4, 1000), (2, 1, 2, 5, 700)])
def test_jaccard(docs, prose, monkeypatch, n, num, den, unit, part):
    monkeypatch.setattr(jaccard, "UNIT_ROWS", unit)
    monkeypatch.setattr(jaccard, "ASKING_ROWS", unit)
    monkeypatch.setattr(jaccard, "PART_WORDS", part)
    rows = families(prose)
    frame = docs(rows).withColumns({"cls": F.lit("x"), "grp": F.lit(1), "rep": F.lit(2), "size": F.lit(3)})
    got = jaccard.jaccard_classes(frame, n, num, den).collect()
    want = [w for w in classes(rows, n, num, den) if w[0] != "None"]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2


def test_jaccard_hot_tokens(docs, prose, monkeypatch):
    """Tokens that the estimate misses are put last once they are counted, and no link is lost."""
    monkeypatch.setattr(jaccard, "REPORTED", 0)
    monkeypatch.setattr(jaccard, "HOT", 200)
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 8)
    phrase, counted = "every page ends with these words", []
    rows = [(k, f"{prose(5, k)} {phrase} {prose(4, 500 + k)}") for k in range(300)] + [(1000 + k, f"{prose(60, k % 4)} {k}") for k in range(30)]
    later = jaccard.Order.later
    monkeypatch.setattr(jaccard.Order, "later", lambda self, times: counted.append(times) or later(self, times))
    got = jaccard.jaccard_classes(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == classes(rows, 4, 85, 100)
    assert counted and min(counted[0].values()) > 200**0.5


def test_meetings_of_a_hot_token_are_held_back():
    many = np.arange(3000, dtype=np.int64)
    sets = [(i, np.sort(np.concatenate([[np.uint64(7)], np.uint64(1000) + np.uint64(20) * np.uint64(i) + np.arange(9, dtype=np.uint64)]))) for i in many.tolist()]
    head = np.array([len(sets), len(sets)], np.int64)
    ids, groups = many, (many + 10).astype(np.uint64)
    payload = b"".join(x.tobytes() for x in (head, ids, groups, np.full(len(sets), 10, np.int64), np.zeros(len(sets), np.int64), np.full(len(sets), 7, np.uint64), np.arange(len(sets), dtype=np.uint32), np.full(len(sets), 10, np.uint32)))
    table = pa.table({"part": [0], "payload": pa.array([payload], pa.binary())})
    held = jaccard._matrix(85, 100, True)(None, table).to_pylist()
    assert [(r["grp"], r["shared"]) for r in held] == [(7, -3000)]


def test_jaccard_empty(docs):
    assert jaccard.jaccard_classes(docs(["x"]).where("false")).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_classes(docs([None, "", "a"])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_first_tokens_meet(prose):
    """Sets with Jaccard t share enough of their first tokens, whatever is counted as heavy."""
    rng, memory = random.Random(2), common.WordHash()
    for trial in range(60):
        base = prose(rng.randrange(4, 120), trial).split()
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(len(other))] = "zz"
        a, b = (jaccard.shingles(" ".join(w).encode(), 4, memory) for w in (base, other))
        heavy = np.unique(np.concatenate([a, b]))[:: rng.randrange(1, 4)]
        order = jaccard.Order(heavy, np.arange(len(heavy)) % 7)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            shared = len(np.intersect1d(order.first(a, 85, 100), order.first(b, 85, 100)))
            assert shared >= min(jaccard.SHARED, -(-85 * len(a) // 100), -(-85 * len(b) // 100))

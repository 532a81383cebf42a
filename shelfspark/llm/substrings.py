"""Substring dedup by fixed-block anchors.

A run of ``window`` words that occurs twice holds, in either occurrence, a whole block of ``window // 2`` words
that starts at a multiple of that length.  So the non-overlapping blocks of every document are the index, and every
rolling run of that length probes it.  Windows around a hit are then compared by a hash of all their words, which
extends hits to maximal exact repeats, and each window that also starts earlier gives up its words.

How it scales: documents are dealt to groups of about GROUP_BYTES of text and never leave them; the one shuffle of
texts serves all three passes.  A group sends each distinct probe once, as four bytes in one blob
for each partition of the hash space, and gets back a bit for each; both sides know the order, so neither
positions nor ids travel.  A passage that a third of all documents share is one probe a group.  The number of groups
and of partitions follows the input, so what one task holds does not.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 20
GROUP_BYTES = 4 << 20
#: Probes of one partition of the hash space, about; a probe for each word.
PART_WORDS = 2_000_000
LOW = (1 << 30) - 1
LAST_ID = np.iinfo(np.int64).max


class Group:
    """The words of a group of documents, in order of doc_id, and the hashes of their runs."""

    def __init__(self, table: pa.Table, window: int, parts: int):
        block = self.block = window // 2
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.words = [ids[i] for i in order], [texts[i].split() for i in order]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.start = (self.ends - sizes)[self.doc] if len(sizes) else np.empty(0, np.int64)
        memory = common.WordHash()
        hashes = np.concatenate([memory.of(w) for w in self.words]) if len(sizes) else np.empty(0, np.uint64)
        self.n = len(hashes)
        runs = common.rolling(hashes, block)
        at = np.arange(len(runs))
        self.at = at[at + block <= self.ends[self.doc[: len(runs)]]] if len(runs) else at
        probes = runs[self.at]
        part = ((probes >> np.uint64(34)) % np.uint64(parts)).astype(np.int64)
        self.key, self.of = np.unique((part << 30) | (probes & np.uint64(LOW)).astype(np.int64), return_inverse=True)
        # windows: two blocks in a row
        whole = at[at + window <= self.ends[self.doc[: len(runs)]]] if len(runs) else at
        self.window, self.whole, self.runs, self.parts = window, whole, runs, parts

    def probes(self):
        """(part, payload): for each distinct probe 30 bits of its hash, whether it is a block, whether it occurs twice here."""
        blocks = np.zeros(len(self.key), bool)
        blocks[self.of[(self.at - self.start[self.at]) % self.block == 0]] = True
        twice = np.bincount(self.of, minlength=len(self.key)) > 1
        value = ((self.key & LOW) | (blocks.astype(np.int64) << 30) | (twice.astype(np.int64) << 31)).astype(np.uint32)
        return _by_part(self.key >> 30, value)

    def candidates(self, hits: np.ndarray):
        """hits: for each distinct probe.  Sets the windows that hold a hit and their distinct sequences, in order of
        (part, hash); first: the place of the first window of each."""
        hit = np.zeros(self.n + 1, np.int64)
        hit[self.at] = hits[self.of]
        before = np.concatenate([[0], np.cumsum(hit)])
        s = self.whole[(before[self.whole + self.window - self.block + 1] - before[self.whole]) > 0]
        a, b = self.runs[s], self.runs[s + self.block]
        c = common.odd_constants(4)
        value, other = common.mixed(a * c[0] + b * c[1]), common.mixed(a * c[2] ^ b * c[3])
        part = (other % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((s, value, part))
        new = np.ones(len(s), bool)
        new[1:] = (value[order][1:] != value[order][:-1]) | (part[order][1:] != part[order][:-1])
        self.seq = np.empty(len(s), np.int64)
        self.seq[order] = np.cumsum(new) - 1
        self.s, self.first = s, s[order[new]]
        self.value, self.part = value[order[new]], part[order[new]]

    def sequences(self):
        ids = np.array([LAST_ID if i is None else i for i in self.ids], np.int64)[self.doc[self.first]] if self.n else np.empty(0, np.int64)
        for (p, v), (_, d) in zip(_by_part(self.part, self.value), _by_part(self.part, ids), strict=True):
            yield p, v + d

    def kept(self, later: np.ndarray):
        """later: for each distinct sequence, whether it starts earlier in another group.  The words to keep."""
        gone = later[self.seq] | (self.first[self.seq] != self.s) if len(self.s) else np.empty(0, bool)
        edge = np.zeros(self.n + self.window + 1, np.int64)
        edge[self.s[gone]] += 1
        edge[self.s[gone] + self.window] -= 1
        return np.cumsum(edge)[: self.n] == 0


def _by_part(part: np.ndarray, value: np.ndarray):
    """(part, bytes of its values), part being sorted."""
    cut = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cut], [*cut, len(part)], strict=True):
        if hi > lo:
            yield int(part[lo]), value[lo:hi].tobytes()


def _rows(rows, g: int) -> pa.Table:
    rows = list(rows)
    return pa.table([pa.array([p for p, _ in rows], pa.int32()), pa.array([g] * len(rows), pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "g", "payload"])


def _probe(window: int, parts: int):
    return lambda key, table: _rows(Group(table, window, parts).probes(), key[0].as_py())


def _bits(answers: pa.Table, kind: int, part: np.ndarray) -> np.ndarray:
    """The answers for sorted parts, in order."""
    got = {p: np.frombuffer(x, np.uint8) for k, p, x in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "payload")), strict=True) if k == kind}
    numbers, counts = np.unique(part, return_counts=True)
    return np.concatenate([np.unpackbits(got[p], count=n) for p, n in zip(numbers.tolist(), counts.tolist(), strict=True)]).astype(bool) if len(numbers) else np.empty(0, bool)


def _ask(window: int, parts: int):
    def run(key, table, answers):
        group = Group(table, window, parts)
        group.candidates(_bits(answers, 1, group.key >> 30))
        return _rows(group.sequences(), key[0].as_py())

    return run


def _answer(kind: int, judge):
    def run(key, table):
        payloads = table.column("payload").to_pylist()
        marks = judge(payloads)
        return pa.table([table.column("g").combine_chunks(), pa.array([kind] * len(payloads), pa.int32()), table.column("part").combine_chunks(), pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())], ["g", "kind", "part", "payload"])

    return run


def _split(marks: np.ndarray, lengths: list[int]):
    return np.split(marks, np.cumsum(lengths)[:-1])


def _hits(payloads: list[bytes]):
    """Probes that equal a block and occur twice or more, in all."""
    lengths = [len(p) // 4 for p in payloads]
    value = np.frombuffer(b"".join(payloads), np.uint32)
    low, of = np.unique(value & np.uint32(LOW), return_inverse=True)
    times = np.bincount(of, minlength=len(low)) + np.bincount(of, weights=value >> np.uint32(31), minlength=len(low))
    blocks = np.bincount(of, weights=(value >> np.uint32(30)) & np.uint32(1), minlength=len(low))
    return _split(((times > 1) & (blocks > 0))[of], lengths)


def _earlier(payloads: list[bytes]):
    """Sequences whose first document here is not the first of all.  A document is in one group only."""
    lengths = [len(p) // 16 for p in payloads]
    value = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, lengths, strict=True)])
    ids = np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in zip(payloads, lengths, strict=True)])
    order = np.lexsort((ids, value))
    new = np.ones(len(order), bool)
    new[1:] = value[order][1:] != value[order][:-1]
    later = np.empty(len(order), bool)
    later[order] = ~new
    return _split(later, lengths)


def _finish(window: int, parts: int):
    def run(key, table, answers):
        group = Group(table, window, parts)
        group.candidates(_bits(answers, 1, group.key >> 30))
        keep = group.kept(_bits(answers, 2, group.part))
        out, at = [], 0
        for i, words in zip(group.ids, group.words, strict=True):
            mask = keep[at : at + len(words)]
            at += len(words)
            left = words if mask.all() else [w for w, k in zip(words, mask.tolist(), strict=True) if k]
            out.append((i, len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "replace")))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id (long), n_words, n_removed, kept (the words that stay, joined by a space) for each row of docs.

    window must be even.  A null text has no words; texts shorter than the window lose nothing.  Rows with equal doc_id are
    ordered by text and count as documents of their own, the later repeating the earlier.  A null doc_id comes last.  An empty
    table gives an empty result.  Columns other than doc_id and text are not read.

    Probes are compared by 30 bits and the number of their partition, which only chooses what is looked at again;
    windows by 64 bits and the number of an independently hashed partition."""
    if window % 2 or window < 2:
        raise ValueError("window must be an even number of words")
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups, parts = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total / 6 / PART_WORDS))
    rows = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    sent, back = "part int, g int, payload binary", "g int, kind int, part int, payload binary"
    first = rows.groupBy("g").applyInArrow(_probe(window, parts), sent)
    hits = first.groupBy("part").applyInArrow(_answer(1, _hits), back)
    second = rows.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(_ask(window, parts), sent)
    later = second.groupBy("part").applyInArrow(_answer(2, _earlier), back)
    answers = hits.unionByName(later)
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(window, parts), "doc_id long, n_words long, n_removed long, kept string")

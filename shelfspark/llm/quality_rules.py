"""Quality rules: counted base rules, then a log-likelihood ratio of hashed n-grams.

Every text's lower-cased words and word pairs fall into BUCKETS buckets.  Two multinomials over the buckets,
one of the trusted documents and one of the whole corpus, are counted over all documents.  A
document's score is the mean over its n-grams of log(p_trusted / p_corpus); it is kept if the score
reaches the threshold.  The threshold is a constant, so a verdict depends on the tables only.

The model is BUCKETS numbers whatever the input, which bounds what is sent to the driver and to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 16
#: Mean log ratio under which a document is dropped.
THRESHOLD = -0.20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


def ngram_buckets(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a text's words and word pairs."""
    shift = np.uint64(48)
    single = common.mixed(hashes) >> shift
    return np.concatenate([single, common.rolling(hashes, 2) >> shift]).astype(np.int64)


def _counter(batches):
    """Per partition: one row for each bucket seen, with its count in the corpus and in trusted texts."""
    words, raw, trusted = common.WordHash(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, flag in zip(common.string_rows(batch.column("text")), batch.column("trusted").to_pylist(), strict=True):
            got = ngram_buckets(words.of(text.lower().split()))
            n = np.bincount(got, minlength=BUCKETS) if len(got) > BUCKETS // 8 else None
            for to in (raw, trusted) if flag else (raw,):
                if n is None:
                    np.add.at(to, got, 1)
                else:
                    to += n
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(raw[seen], pa.int64()), pa.array(trusted[seen], pa.int64())], ["bucket", "raw", "trusted"])


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame) -> np.ndarray:
    """log(p_trusted / p_corpus) by bucket, with one added to each count; zeros if nothing is trusted.

    trusted_ids: doc_id.  It is broadcast up to common.BROADCAST_BYTES bytes, and joined by a shuffle beyond."""
    ids = common.small_side(common.written(trusted_ids.select(F.col("doc_id").alias("t_id")).where("t_id is not null").distinct(), "rules-trusted"))
    rows = docs.select("doc_id", common.text_bytes().alias("text")).join(ids, F.col("doc_id") == F.col("t_id"), "left")
    rows = rows.select("text", F.col("t_id").isNotNull().alias("trusted"))
    counts = rows.mapInArrow(_counter, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    got = counts.toPandas()  # at most BUCKETS rows
    raw, trusted = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[got["bucket"]] += got["raw"]
    trusted[got["bucket"]] += got["trusted"]
    if trusted.sum() == BUCKETS:
        return np.zeros(BUCKETS, np.float32)
    return np.log((trusted / trusted.sum()) / (raw / raw.sum())).astype(np.float32)


def repeat_words(hashes: np.ndarray, n: int = 3) -> int:
    """Words in windows of n words that the text holds twice or more, the first included.

    Words are numbered within the text, so that windows are compared exactly while they fit 63 bits."""
    if len(hashes) <= n:
        return 0
    _, ids = np.unique(hashes, return_inverse=True)
    base = int(ids.max()) + 1
    runs = len(ids) - n + 1
    key = np.zeros(runs, np.int64)
    for i in range(n):
        if base > (1 << 63) // max(int(key.max()) + 1, 1):
            _, key = np.unique(key, return_inverse=True)
        key = key * base + ids[i : i + runs]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = (count > 1)[at]
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:runs] += twice
    edge[n : n + runs] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: bytes, hashes: np.ndarray, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] if b"\n" in text else []
    return chars, symbols, len(lines) - len(set(lines)), repeat_words(hashes)


def _judge(ratio: np.ndarray, threshold: float):
    def run(batches):
        memory = common.WordHash()
        for batch in batches:
            out = [[] for _ in range(8)]
            for text in common.string_rows(batch.column("text")):
                words = text.split()
                chars, symbols, dup, rep = base_counts(text, memory.of(words), words)
                got = ngram_buckets(memory.of(text.lower().split()))
                score = float(ratio[got].mean(dtype=np.float64)) if len(got) else 0.0
                failed = len(words) < MIN_WORDS or 100 * rep > 50 * len(words)
                for to, x in zip(out, (len(words), chars, symbols, dup, rep, failed, not failed and score >= threshold, score), strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", *names])

    return run


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept, llr.

    A null text is empty; a text without words has zero counts, llr 0 and fails the base rules.  Repeated rows
    are judged alike, each in its own row.  An empty table gives an empty result.  Columns other than doc_id and
    text are not read."""
    ratio = fit_ratio(docs, trusted_ids)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"
    return docs.select("doc_id", common.text_bytes().alias("text")).mapInArrow(_judge(ratio, threshold), schema)

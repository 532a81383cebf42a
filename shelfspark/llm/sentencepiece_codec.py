"""SentencePiece encoding and decoding.

Pieces are the patterns of an Aho-Corasick automaton.  One pass over a text visits every piece that ends at
each position (by the automaton's output links) and relaxes the best score of that position; the path back gives
the ids.  Equal scores go to the longer last piece.  A character without a piece of its own may also be spelled with
byte pieces, at a score below that of any piece.

Where no piece goes on past the end of a word (a meta space after another character) or holds a newline, as is
checked when a vocabulary is loaded, a text's best path is that of its words, one after another; a worker then
remembers the ids of at most CACHED words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

META = "▁"
CACHED = 100_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """A fixed-size table, small enough to travel with the tasks."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # n: normal, b: byte, c: control or unknown
    prefix: bool = True
    bytes_of: dict[int, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = model.get_piece_size()
        kinds = ["b" if model.is_byte(i) else "c" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n" for i in range(n)]
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], kinds)


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.byte_id: dict[int, int] = {}
        self.out: list[bytes] = []
        normal = []
        for i, (piece, kind) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if kind == "b":
                self.byte_id[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif kind == "n":
                normal.append(i)
                self.out.append(piece.replace(META, " ").encode())
            else:
                self.out.append(b"")
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary lacks byte pieces, so not every text can be encoded")
        for i in normal:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self.automaton.make_automaton()
        self.single = {v.pieces[i] for i in normal if len(v.pieces[i]) == 1}
        self.unknown = min([v.scores[i] for i in normal], default=0.0) - 10.0
        apart = not any(re.search(f"[^{META}]{META}|\n", v.pieces[i]) for i in normal)
        self.chunks = re.compile(f"\n+|{META}*[^{META}\n]+|{META}+") if apart else re.compile("(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}

    def _spell(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode("utf-8", "replace")]

    def best(self, chunk: str) -> list[int]:
        """The ids of the best path through one chunk."""
        n = len(chunk)
        score, back = [float("-inf")] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        done = 0
        for end, (length, s, i) in self.automaton.iter(chunk):
            while done < end:  # no piece that ends at done is still to come
                done += 1
                if chunk[done - 1] not in self.single and score[done - 1] + self.unknown > score[done]:
                    score[done], back[done] = score[done - 1] + self.unknown, (done - 1, -1)
            s += score[end + 1 - length]
            if s > score[end + 1]:
                score[end + 1], back[end + 1] = s, (end + 1 - length, i)
        while done < n:
            done += 1
            if chunk[done - 1] not in self.single and score[done - 1] + self.unknown > score[done]:
                score[done], back[done] = score[done - 1] + self.unknown, (done - 1, -1)
        out: list[int] = []
        at = n
        while at:
            start, i = back[at]
            out.extend([i] if i >= 0 else reversed(self._spell(chunk[start:at])))
            at = start
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """A meta space stands before the text and for each space.  A meta space of the text itself is spelled in bytes."""
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate(text.split(META)):
            if k:
                out += self._spell(META)
            part = (META if k == 0 and self.v.prefix else "") + part.replace(" ", META)
            for chunk in self.chunks.findall(part):
                ids = self.known.get(chunk)
                if ids is None:
                    ids = tuple(self.best(chunk))
                    if len(chunk) <= 64:
                        if len(self.known) >= CACHED:
                            self.known.clear()
                        self.known[chunk] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """The text that encode() was given."""
        got = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return got[1:] if self.v.prefix and got.startswith(" ") else got


def _encoder(vocabulary: Vocabulary, keep: list[str]):
    def run(batches):
        codec = Codec(vocabulary)
        for batch in common.slices(batches):
            texts = [x or "" for x in batch.column("text_").to_pylist()]
            ids = [codec.encode(t) for t in texts]
            same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            columns = [*(batch.column(k) for k in keep), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "n_ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ids (array of int), n_ids, and round_trip: whether decoding gave the text again.

    A null or empty text has no ids.  Every row is encoded by itself, so repeated rows, null ids and empty tables need
    nothing special.  Columns not in ``keep`` other than text are not read."""
    keep = list(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(*keep, docs["text"].cast("string").alias("text_"))
    return rows.mapInArrow(_encoder(vocabulary, keep), f"{kinds}, ids array<int>, n_ids long, round_trip boolean")


def _decoder(vocabulary: Vocabulary, keep: list[str]):
    def run(batches):
        codec = Codec(vocabulary)
        for batch in common.slices(batches):
            texts = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return run


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text.  Null ids give an empty text."""
    keep = list(keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)
    return encoded.select(*keep, "ids").mapInArrow(_decoder(vocabulary, keep), f"{kinds}, text string")

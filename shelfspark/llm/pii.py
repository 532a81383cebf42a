"""PII: identifiers in texts, also disguised ones, with offsets into the text as it is.

The base pass finds e-mail and IP addresses, card and phone numbers by four patterns.  The method's pass turns
the text into a normalised one by transducers (look-alike characters, spelled digits, "at" and "dot" in words or
brackets), each of which keeps, for every character that it writes, the span of the source that the
character stands for.  The same four detectors run on the normalised text and their spans are mapped back.
A span that a base span of its kind already covers is not repeated.

Only texts that hold something a transducer may change are normalised; that saves time and changes no result.

"X at Y dot Z" without brackets is an address only if Z, or a later label of the host, is one of ENDINGS and Y is not one
of NO_HOSTS: in prose both words are common.  Every pattern is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts within a run of digits: what follows the run decides for all its digits alike.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Characters that look like an ASCII one (Cyrillic, Greek, then signs).
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "З": "3",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ε": "e", "τ": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ⅰ": "i", "ﹺ": ":", "﹫": "@", "․": ".", "。": ".", "｡": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
}
# The names of the digits.
DIGIT_NAMES = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
_NAME = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
# Last labels of hosts that are written out without brackets; labels that are words of prose (it, in, me) are not among them.
ENDINGS = frozenset("com org net edu gov mil int info biz name io ai app dev tv cc uk de fr es nl ch pt eu pl se dk fi cz ru ua jp cn kr br mx ca au nz".split())
# Articles and pronouns, which are no hosts.
NO_HOSTS = frozenset("the a an this that these those my your his her its our their der die das ein eine le la les un une el los las una".split())
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED_DOT = rf"{_OPEN}\s*(?:dot|punto|punkt|point|\.)\s*{_CLOSE}"
#: What a change starts from; blanks around it are looked at from there, so that none is read again and again.
CORE = re.compile(
    rf"(?P<at>{_OPEN}\s*(?:at|arroba|@)\s*{_CLOSE})|(?P<dot>{_BRACKETED_DOT})|\b(?P<plain_at>at)\b|\b(?P<plain_dot>dot)\b|\b(?P<plus>plus)\b"
    rf"|(?P<digits>\b(?:{_NAME})(?:[\s,-]{{1,3}}(?:{_NAME}))*\b)",
    re.IGNORECASE,
)
LABEL = re.compile(r"[A-Za-z0-9-]++")
STOP = re.compile(rf"\.|\s*+{_BRACKETED_DOT}\s*+|\s++dot\s++", re.IGNORECASE)
NUMBER = re.compile(rf"[0-9]|(?:{_NAME})\b", re.IGNORECASE)
ALNUM = re.compile(r"[A-Za-z0-9]")
NAMED = re.compile(_NAME, re.IGNORECASE)
BRACKET = re.compile(r"[\[({<]")
BRACKETED = re.compile(rf"{_OPEN}\s*(?:at|arroba|@|dot|punto|punkt|point|\.)\s*{_CLOSE}", re.IGNORECASE)
#: A word that CORE needs where there is no bracket; "at" needs a dot as well.
TELLING = re.compile(rf"\b(?:dot|plus|{_NAME})\b", re.IGNORECASE)
ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + ZERO_WIDTH + r"！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")


def _emails(text: str):
    """Matches of the base pattern.  No local part holds an @, so each match is found from its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind; matches that fail their test are dropped."""
    out = [(0, *m) for m in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(_at_most_255(x) for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


class Tape:
    """A text and, for each of its characters, the span of the source that it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.end = list(range(1, len(text) + 1)) if end is None else end

    def rewritten(self, changes) -> Tape:
        """changes: (start, end, new text) in order, apart from one another; each new character stands for the whole span."""
        text, start, end, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        return Tape("".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:])


def _plain(c: str) -> str:
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in ZERO_WIDTH:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(unicodedata.digit(c))


def _blanks(text: str, start: int, end: int, floor: int) -> tuple[int, int]:
    """start and end moved outwards over blanks, not before floor."""
    while start > floor and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


class Hosts:
    """Host names that are written out, each read once from the first label that is asked for."""

    def __init__(self, text: str):
        self.text, self.read, self.named = text, -1, -1
        self.stops: list[tuple[int, bool]] = []

    def _chain(self, at: int) -> None:
        """Labels and stops from at on.  named: where the last label of ENDINGS that follows a stop ends."""
        if at <= self.read:
            return
        self.stops, self.named, stop = [], -1, None
        while m := LABEL.match(self.text, at):
            if stop and m.group().lower() in ENDINGS:
                self.named = m.end()
            self.read = at
            if not (stop := STOP.match(self.text, m.end())):
                return
            self.stops.append((m.end(), stop.group() != "."))
            at = stop.end()

    def goes_on(self, at: int) -> bool:
        """Whether the label at ``at`` or a later one ends a host that is named in full."""
        m = LABEL.match(self.text, at)
        if not m:
            return False
        if m.group().lower() in ENDINGS:
            return True
        self._chain(at)
        return at < self.named

    def address(self, at: int) -> bool:
        """Whether a host with a stop in words starts here."""
        m = LABEL.match(self.text, at)
        if not m or m.group().lower() in NO_HOSTS:
            return False
        self.read = -1
        self._chain(at)
        return any(told and end < self.named for end, told in self.stops)


def _words(text: str):
    """Changes for disguises made of words."""
    hosts, floor = Hosts(text), 0
    for m in CORE.finditer(text):
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "digits":
            at = start
            for d in NAMED.finditer(text, start, end):
                # the separator before a digit goes with it, so that digits of one number stand together
                # İ and ſ match i and s
                yield at, d.end(), DIGIT_NAMES[d.group().replace("İ", "i").casefold()]
                at = d.end()
            floor = end
            continue
        a, b = _blanks(text, start, end, floor)
        if kind == "plus":
            if b == end or not NUMBER.match(text, b):
                continue
            a = start
        elif kind == "at":
            label = LABEL.match(text, b)
            stop = label and STOP.match(text, label.end())
            if not stop or not ALNUM.match(text, stop.end()):
                continue
        elif kind == "dot":
            if not ALNUM.match(text, b):
                continue
        elif a == start or b == end:
            continue
        elif kind == "plain_at":
            if not a or not ALNUM.match(text, a - 1) or not hosts.address(b):
                continue
        elif not (NUMBER.match(text, b) or hosts.goes_on(b)):
            continue
        yield a, b, {"at": "@", "dot": ".", "plus": "+"}[kind.removeprefix("plain_")]
        floor = b


def normalise(text: str) -> Tape:
    tape = Tape(text).rewritten((m.start(), m.end(), _plain(m.group())) for m in ODD.finditer(text))
    return tape.rewritten(_words(tape.text))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def hinted(text: str) -> bool:
    """Whether a transducer may have anything to do: true of every text that normalise() changes."""
    if not text.isascii() and ODD.search(text):
        return True
    if BRACKET.search(text) and BRACKETED.search(text):
        return True
    return TELLING.search(text) is not None


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the normalised text shows."""
    if not hinted(text):
        return []
    tape, out = normalise(text), set()
    # base spans of a kind lie apart, in order: only the last that starts at or before a span may cover it
    own = [[x[1:] for x in base if x[0] == kind] for kind in range(len(KINDS))]
    for kind, a, b in detect(tape.text):
        start, end = _trim(text, tape.start[a], tape.end[b - 1])
        at = bisect_right(own[kind], start, key=lambda x: x[0])
        if not at or own[kind][at - 1][1] < end:
            out.add((kind, start, end))
    return sorted(out)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, each (kind, start, end) by start, then kind."""
    base = detect(text)
    order = lambda x: (x[1], x[0], x[2])
    return sorted(base, key=order), sorted(disguised(text, base), key=order)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    base, added = spans_of(text)
    out, at, spans = [], 0, sorted(((a, b, k) for k, a, b in base + added), key=lambda x: (x[0], -x[1]))
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _finder(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, added = spans_of(text)
            n = [sum(x[0] == k for x in base) for k in range(4)]
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base and added), n_added.

    A null text is empty: no spans, and the hash of the empty string.  Offsets are code points, ends exclusive.  Repeated
    rows each have their row; an empty table gives an empty result; columns other than doc_id and text are not read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_finder, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _redactor(batches):
    for batch in batches:
        texts = [None if t is None else redact(t) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind in brackets; other columns stay, whatever their names.

    A null text stays null, an empty one empty.  Repeated rows are each redacted; an empty table gives an empty result."""
    return docs.mapInArrow(_redactor, docs.schema)

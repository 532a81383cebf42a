"""PDF objects.  A small parser turns the text of an object into Python values; a Document finds objects by number.

Values: dict, list, Name, Ref, bytes (strings), int, float, bool, None, and Word for anything else.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

WHITE = b"\x00\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\x0c\r ]+[0-9]{1,10}[\x00\t\n\x0c\r ]+obj")
REST_OF_REF = re.compile(rb"[\x00\t\n\x0c\r ]+[0-9]{1,10}[\x00\t\n\x0c\r ]+R(?![0-9A-Za-z])")
STREAM = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n")
#: How deep arrays and dictionaries may nest.
DEPTH = 100


class Name(str):
    pass


class Word(str):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes

    def filters(self) -> list[str]:
        f = self.info.get("Filter")
        return [str(x) for x in (f if isinstance(f, list) else [f]) if isinstance(x, Name)]

    def inflated(self) -> bytes | None:
        return inflate(self.raw)


def inflate(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data)
    except zlib.error:
        return None


def unescape(body: bytes) -> bytes:
    """A literal string without its escapes."""

    def one(m: re.Match) -> bytes:
        c = m[1]
        if c[:1].isdigit():
            return bytes([int(c, 8) % 256])
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(c, c)

    return re.sub(rb"(?s)\\([0-7]{1,3}|.)", one, body)


def unhex(body: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", body)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def text(raw) -> str:
    """A text string: UTF-16 with its mark, else Latin-1."""
    if not isinstance(raw, bytes):
        return ""
    return raw[2 : 2 + (len(raw) - 2) // 2 * 2].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


class Parser:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c == 0x25:  # a comment
                ends = [e for e in (self.data.find(b"\n", self.at), self.data.find(b"\r", self.at)) if e >= 0]
                self.at = min(ends, default=len(self.data))
            elif c in WHITE:
                self.at += 1
            else:
                return

    def _string(self) -> bytes:
        depth, start, i = 1, self.at + 1, self.at + 1
        while i < len(self.data):
            c = self.data[i]
            if c == 0x5C:
                i += 1
            elif c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
            i += 1
        self.at = i + 1
        return unescape(self.data[start:i])

    def _word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in WHITE and self.data[self.at] not in DELIMITERS:
            self.at += 1
        if self.at == start:
            self.at += 1
        return self.data[start : self.at]

    def value(self, depth: int = 0):
        self.skip()
        two, one = self.data[self.at : self.at + 2], self.data[self.at : self.at + 1]
        if not one or depth > DEPTH:
            return None
        if two == b"<<":
            self.at += 2
            return self._dict(depth)
        if one == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(self.data):
                    return out
                if self.data[self.at] == 0x5D:
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if one == b"(":
            return self._string()
        if one == b"<":
            end = self.data.find(b">", self.at)
            end = len(self.data) if end < 0 else end
            body, self.at = self.data[self.at + 1 : end], end + 1
            return unhex(body)
        if one == b"/":
            self.at += 1
            start = self.at
            if self.at < len(self.data) and (self.data[self.at] in WHITE or self.data[self.at] in DELIMITERS):
                return Name("")
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), self._word()).decode("latin-1")) if start < len(self.data) else Name("")
        word = self._word()
        if re.fullmatch(rb"[0-9]{1,10}", word) and (m := REST_OF_REF.match(self.data, self.at)):
            self.at = m.end()
            return Ref(int(word))
        if re.fullmatch(rb"[+-]?[0-9]{1,18}", word):
            return int(word)
        if re.fullmatch(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Word(word.decode("latin-1")))

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.at >= len(self.data):
                return out
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.value(depth + 1)
            if isinstance(key, Name):
                self.skip()
                if self.data[self.at : self.at + 2] == b">>":
                    continue
                found = self.value(depth + 1)
                out.setdefault(str(key), found)


def parse_body(body: bytes):
    """The value of an object, or its Stream."""
    parser = Parser(body)
    got = parser.value()
    if isinstance(got, dict) and (m := STREAM.match(body, parser.at)):
        start, size = m.end(), got.get("Length")
        if isinstance(size, int) and 0 <= size <= len(body) - start and body[start + size :].strip(WHITE) in (b"endstream", b""):
            return Stream(got, body[start : start + size].removesuffix(b"endstream"))
        end = body.rfind(b"endstream")
        return Stream(got, (body[start:end] if end >= start else body[start:]).rstrip(b"\r\n"))
    return got


class Document:
    """Objects by number: the last one written in the file, else one from an object stream (the last such stream)."""

    def __init__(self, data: bytes):
        self.data = data
        self.spans: dict[int, tuple[int, int]] = {}
        at = 0
        while m := OBJECT.search(data, at):
            end = data.find(b"endobj", m.end())
            if end < 0:
                break
            number = int(m[1])
            self.spans.pop(number, None)  # so that the order is that of the last occurrences
            self.spans[number] = (m.end(), end)
            at = end + 6
        self._values: dict = {}
        self._packed: dict[int, bytes] | None = None

    def _direct(self, number: int):
        if number not in self._values:
            start, end = self.spans[number]
            self._values[number] = parse_body(self.data[start:end])
        return self._values[number]

    def packed(self) -> dict[int, bytes]:
        if self._packed is None:
            self._packed = {}
            for number in self.spans:
                got = self._direct(number)
                if isinstance(got, Stream) and got.info.get("Type") == "ObjStm":
                    self._packed |= self._unpack(got)
        return self._packed

    @staticmethod
    def _unpack(stream: Stream) -> dict[int, bytes]:
        n, first, body = stream.info.get("N"), stream.info.get("First"), stream.inflated()
        if not (isinstance(n, int) and isinstance(first, int) and body is not None and n > 0 and 0 <= first <= len(body)):
            return {}
        head = body[:first].split()
        if len(head) < 2 * n or not all(x.isdigit() and len(x) < 11 for x in head[: 2 * n]):
            return {}
        numbers, starts = [int(x) for x in head[: 2 * n : 2]], [first + int(x) for x in head[1 : 2 * n : 2]]
        return {k: body[a:b] for k, a, b in zip(numbers, starts, [*starts[1:], len(body)], strict=True) if a <= b <= len(body)}

    def get(self, number: int):
        if number in self.spans:
            return self._direct(number)
        if number not in self._values:
            body = self.packed().get(number)
            self._values[number] = None if body is None else parse_body(body)
        return self._values[number]

    def resolve(self, value, most: int = 8):
        while isinstance(value, Ref) and most:
            value, most = self.get(value.number), most - 1
        return None if isinstance(value, Ref) else value

    def info_of(self, value) -> dict:
        """The dictionary of a value, or of a stream; empty if it is neither."""
        got = self.resolve(value)
        return got.info if isinstance(got, Stream) else got if isinstance(got, dict) else {}

    def trailers(self):
        """Dictionaries that may name the information: classic trailers, the last first; else those of cross-reference streams."""
        at, classic = 0, []
        while (at := self.data.find(b"trailer", at)) >= 0:
            at += 7
            parser = Parser(self.data, at)
            parser.skip()
            if self.data[parser.at : parser.at + 2] == b"<<" and isinstance(got := parser.value(), dict):
                classic.append(got)
        named = [d for d in classic if isinstance(d.get("Info"), Ref)]
        yield from reversed(named)
        if not named:
            streams = [v.info for v in map(self._direct, self.spans) if isinstance(v, Stream) and v.info.get("Type") == "XRef"]
            yield from reversed([d for d in streams if isinstance(d.get("Info"), Ref)])

    def information(self) -> dict | None:
        """None if no trailer leads to one."""
        for trailer in self.trailers():
            got = self.resolve(trailer["Info"])
            return got if isinstance(got, dict) else None
        return None

    def catalogue(self) -> dict:
        for number in self.spans:
            if (d := self.info_of(Ref(number))).get("Type") == "Catalog":
                return d
        for number in sorted(self.packed()):
            if number not in self.spans and (d := self.info_of(Ref(number))).get("Type") == "Catalog":
                return d
        return {}

    def pages(self, limit: int) -> list[dict]:
        """The first pages in reading order; a tree that runs in circles ends."""
        out: list[dict] = []
        root = self.catalogue().get("Pages")
        todo, seen = [root] if isinstance(root, Ref) else [], set()
        while todo and len(out) < limit:
            ref = todo.pop()
            if ref.number in seen:
                continue
            seen.add(ref.number)
            node = self.info_of(ref)
            if node.get("Type") == "Page":
                out.append(node)
                continue
            kids = self.resolve(node.get("Kids"))
            todo += [k for k in reversed(kids if isinstance(kids, list) else []) if isinstance(k, Ref)]
        return out

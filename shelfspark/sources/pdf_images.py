"""Images of PDF pages: JPEG as it is, Flate samples as PNG."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .images import png
from .pdf_objects import Document, Name, Ref, Stream, inflate

#: How deep forms may hold forms, and the longest side of an image.
FORM_DEPTH, LONGEST = 4, 1 << 16
TEXT_SHOWN = re.compile(rb"(?<![0-9A-Za-z_])T[jJ](?![0-9A-Za-z_])")
DEVICES = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "DeviceCMYK": 4}


class Colours:
    """Samples of a colour space as RGB; a palette maps its one component first."""

    def __init__(self, components: int, palette: np.ndarray | None = None):
        self.components, self.palette = components, palette

    def rgb(self, samples: np.ndarray) -> np.ndarray:
        if self.palette is not None:
            return self.palette[np.minimum(samples[..., 0], len(self.palette) - 1)]
        if self.components == 1:
            return np.repeat(samples, 3, axis=-1)
        if self.components == 3:
            return samples
        ink = samples.astype(np.float64) / 255
        return (255 * (1 - ink[..., :3]) * (1 - ink[..., 3:])).astype(np.uint8)


def colours(doc: Document, value, resources: dict, depth: int = 0) -> Colours | None:
    value = doc.resolve(value)
    if depth > FORM_DEPTH:
        return None
    if isinstance(value, Name):
        if value in DEVICES:
            return Colours(DEVICES[value])
        named = doc.info_of(resources.get("ColorSpace")).get(str(value))
        return None if named is None else colours(doc, named, {}, depth + 1)
    if not isinstance(value, list) or not value:
        return None
    kind = doc.resolve(value[0])
    if kind == "ICCBased" and len(value) > 1:
        n = doc.info_of(value[1]).get("N")
        return Colours(n) if n in (1, 3, 4) else None
    if kind == "Indexed" and len(value) > 3:
        base, table = colours(doc, value[1], resources, depth + 1), doc.resolve(value[3])
        if isinstance(table, Stream):
            table = table.inflated() if "FlateDecode" in table.filters() else table.raw
        if base is None or base.palette is not None or not isinstance(table, bytes) or len(table) < base.components:
            return None
        rows = np.frombuffer(table[: len(table) // base.components * base.components], np.uint8).reshape(-1, base.components)
        return Colours(1, base.rgb(rows))
    return Colours(DEVICES[kind]) if isinstance(kind, Name) and kind in DEVICES and len(value) == 1 else None


def _whole(info: dict, key: str, default: int = 0) -> int:
    got = info.get(key, default)
    return got if isinstance(got, int) and not isinstance(got, bool) else default


def unpredicted(data: bytes, predictor: int, columns: int, per_pixel: int) -> bytes | None:
    """Rows as they were before prediction; None if the data do not fit."""
    width = columns * per_pixel
    if predictor <= 1:
        return data
    if width <= 0 or per_pixel <= 0:
        return None
    if predictor == 2:
        if len(data) % width:
            return None
        rows = np.frombuffer(data, np.uint8).reshape(-1, columns, per_pixel)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if predictor < 10 or len(data) % (width + 1):
        return None
    rows = np.frombuffer(data, np.uint8).reshape(-1, width + 1)
    if len(rows) and rows[:, 0].max() > 4:
        return None
    out, above = np.empty((len(rows), width), np.uint8), np.zeros(width, np.uint8)
    for n, row in enumerate(rows):
        out[n] = above = _row(int(row[0]), row[1:], above, per_pixel)
    return out.tobytes()


def _row(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        pixels = row.reshape(-1, step) if len(row) % step == 0 else None
        if pixels is not None:
            return np.cumsum(pixels, axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out, up = bytearray(row.tobytes()), above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) >> 1
        else:  # whichever neighbour is nearest to left + up - corner, left first, then up
            aim = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(aim - v))
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def flate_image(doc: Document, stream: Stream, resources: dict) -> bytes | None:
    info = stream.info
    width, height = _whole(info, "Width"), _whole(info, "Height")
    if "FlateDecode" not in stream.filters() or not (0 < width <= LONGEST and 0 < height <= LONGEST) or _whole(info, "BitsPerComponent", 8) != 8:
        return None
    space = colours(doc, info.get("ColorSpace"), resources)
    data = stream.inflated()
    if space is None or data is None:
        return None
    parms = doc.resolve(info.get("DecodeParms"))
    parms = next((p for p in parms if isinstance(p, dict)), {}) if isinstance(parms, list) else parms if isinstance(parms, dict) else {}
    data = unpredicted(data, _whole(parms, "Predictor", 1), _whole(parms, "Columns", width), _whole(parms, "Colors") or space.components)
    size = width * height * space.components
    if data is None or len(data) < size:
        return None
    return png(space.rgb(np.frombuffer(data[:size], np.uint8).reshape(height, width, space.components)))


def image(doc: Document, stream: Stream, resources: dict) -> tuple[bytes, str] | None:
    if "DCTDecode" in stream.filters():
        return (stream.raw, "image/jpeg") if stream.raw else None
    got = flate_image(doc, stream, resources)
    return None if got is None else (got, "image/png")


def _xobjects(doc: Document, resources: dict) -> Iterator[tuple[int, Stream]]:
    for ref in doc.info_of(resources.get("XObject")).values():
        if isinstance(ref, Ref) and isinstance(got := doc.resolve(ref), Stream):
            yield ref.number, got


def streams(doc: Document, resources: dict, depth: int = 0, seen: set | None = None) -> Iterator[tuple[Stream, dict, str]]:
    """(stream, resources around it, subtype) of images and forms, forms before what they hold."""
    seen = set() if seen is None else seen
    for number, got in _xobjects(doc, resources):
        kind = got.info.get("Subtype")
        if kind == "Image":
            yield got, resources, "Image"
        elif kind == "Form" and depth < FORM_DEPTH and number not in seen:
            seen.add(number)
            yield got, resources, "Form"
            yield from streams(doc, doc.info_of(got.info.get("Resources")), depth + 1, seen)


def page_images(doc: Document, page: dict) -> Iterator[tuple[bytes, str]]:
    """Lazily: a caller that wants the first decodes one."""
    for stream, resources, kind in streams(doc, doc.info_of(page.get("Resources"))):
        if kind == "Image" and (got := image(doc, stream, resources)):
            yield got


def undecodable(doc: Document, page: dict) -> bool:
    """Whether the page itself has an image that cannot be decoded."""
    resources = doc.info_of(page.get("Resources"))
    return any(s.info.get("Subtype") == "Image" and image(doc, s, resources) is None for _, s in _xobjects(doc, resources))


def _content(stream: Stream) -> bytes:
    return (inflate(stream.raw) or b"") if "FlateDecode" in stream.filters() else stream.raw


def _contents(page: dict) -> list[Ref]:
    got = page.get("Contents")
    return [r for r in (got if isinstance(got, list) else [got]) if isinstance(r, Ref)]


def blank(doc: Document, page: dict) -> bool:
    """Nothing is drawn: no content, or content that decodes to nothing.  What cannot be decoded is not blank."""
    for ref in _contents(page):
        got = doc.resolve(ref)
        if not isinstance(got, Stream) or ("FlateDecode" in got.filters() and len(got.filters()) > 1) or _content(got):
            return False
    return True


def shows_text(doc: Document, page: dict) -> bool:
    """On the page, or in a form on it."""
    own = (got for got in map(doc.resolve, _contents(page)) if isinstance(got, Stream))
    forms = (s for s, _, kind in streams(doc, doc.info_of(page.get("Resources"))) if kind == "Form")
    return any(TEXT_SHOWN.search(_content(s)) for group in (own, forms) for s in group)


def any_image(doc: Document) -> tuple[bytes, str] | None:
    """The first image of the file that can be decoded, whether or not a page shows it."""
    for number in sorted(doc.spans, key=lambda n: doc.spans[n]):
        got = doc.get(number)
        if isinstance(got, Stream) and got.info.get("Subtype") == "Image" and (found := image(doc, got, {})):
            return found
    return None

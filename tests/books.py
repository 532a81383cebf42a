"""Small ebook files, made here."""

import io
import struct
import zipfile
import zlib

import numpy as np

from shelfspark.sources.images import png

JPEG = b"\xff\xd8\xff\xe0jpeg"
PNG = png(np.zeros((1, 1, 3), np.uint8))


def epub(title="Driftwood", creator="Mira Stonefell", date="1962-05-30", subject="Nature", manifest="", metas="", spine="", files=(), opf="OEBPS/content.opf"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", f'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{opf}"/></rootfiles></container>')
        z.writestr(opf, f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title><dc:title>Second</dc:title><dc:creator>{creator}</dc:creator><dc:date>{date}</dc:date><dc:subject>{subject}</dc:subject>{metas}</metadata><manifest>{manifest}</manifest><spine>{spine}</spine></package>')
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def mobi(records=((100, b"Mira Stonefell"), (105, b"Nature"), (106, b"1962-05-30"), (503, b"Driftwood")), name=b"Full Name", images=(), cut=None):
    exth = b"".join(struct.pack(">II", k, 8 + len(v)) + v for k, v in records)
    block = b"EXTH" + struct.pack(">II", 12 + len(exth), len(records)) + exth
    header = bytearray(232)
    header[0:4] = b"MOBI"
    header[4:8] = struct.pack(">I", 232)
    header[84:88] = struct.pack(">I", 0x40 if records else 0)
    at = 16 + 232 + len(block)
    header[96:104] = struct.pack(">II", at, len(name))
    first = (bytes(16) + bytes(header) + block + name)[:cut]
    parts = [first, *images]
    start = 78 + 8 * len(parts) + 2
    offsets, pos = [], start
    for p in parts:
        offsets.append(pos)
        pos += len(p)
    return bytes(76) + struct.pack(">H", len(parts)) + b"".join(struct.pack(">II", o, 0) for o in offsets) + b"\0\0" + b"".join(parts)


def pdf(objects, trailer="<< /Root 1 0 R >>"):
    """objects: (number, body as bytes)."""
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects)
    return out + b"trailer\n" + trailer.encode() + b"\n%%EOF"


def stream(info: str, data: bytes) -> bytes:
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (info.encode(), len(data), data)


def flate(info: str, data: bytes) -> bytes:
    return stream(info + " /Filter /FlateDecode", zlib.compress(data))

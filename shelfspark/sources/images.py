"""Image bytes: kinds by their first bytes, and a PNG writer for decoded pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# How files of each kind start.
MAGIC = ((b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"))


def sniff(data: bytes) -> str | None:
    return next((kind for start, kind in MAGIC if data.startswith(start)), None)


def png(pixels: np.ndarray) -> bytes:
    """pixels: height x width x 3, uint8."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, width * 3 + 1), np.uint8)
    rows[:, 1:] = pixels.reshape(height, width * 3)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return MAGIC[1][0] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")

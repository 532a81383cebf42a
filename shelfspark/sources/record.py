"""What extraction finds in one file."""

from __future__ import annotations

import re
from dataclasses import dataclass

YEAR = re.compile(r"(?<![0-9A-Za-z_])(?:1[5-9][0-9]{2}|20[0-9]{2})(?![0-9A-Za-z_])")


@dataclass
class Found:
    title: str = ""
    author: str = ""
    year: str = ""
    subject: str = ""
    cover: bytes | None = None
    content_type: str = ""


class Unreadable(ValueError):
    """The file is not what its extension says."""


def year_of(text: str) -> str:
    m = YEAR.search(text or "")
    return m[0] if m else ""


def all_digits(text: str) -> bool:
    return re.fullmatch("[0-9]+", text.strip()) is not None

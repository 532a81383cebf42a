"""PDF metadata and covers."""

from __future__ import annotations

import re
from itertools import islice

from . import pdf_images
from .pdf_objects import Document, text, unescape, unhex
from .record import Found, all_digits, year_of

PAGE_LIMIT = 10
STRAY = re.compile(rb"/(Subject|CreationDate)[\t\n\f\r ]*(?:\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\t\n\f\r ]*)>)", re.DOTALL)

#: A function (data, page number) -> (bytes, content type) that draws a page, or None.  No renderer is installed, so pages
#: that would need one fall through to the next choice.
renderer = None


def _strings(doc: Document) -> dict[str, str]:
    """Strings of the information dictionary; without one, the first subject and date that stand anywhere in the file."""
    info = doc.information()
    if info is not None:
        return {k: text(doc.resolve(info.get(k))) for k in ("Title", "Author", "Subject", "CreationDate")}
    out: dict[str, str] = {}
    found = list(STRAY.finditer(doc.data))
    for m in [m for m in found if m[2] is not None] + [m for m in found if m[3] is not None]:
        out.setdefault(m[1].decode(), text(unescape(m[2]) if m[2] is not None else unhex(m[3])))
    return out


def _drawn(doc: Document, number: int) -> tuple[bytes, str] | None:
    if renderer is None:
        return None
    try:
        return renderer(doc.data, number)
    except Exception:  # a page that cannot be drawn is no cover
        return None


def cover(doc: Document, limit: int = PAGE_LIMIT) -> tuple[bytes, str] | None:
    """A drawing of page one if it has no image but is not blank; else the first image of the first pages, drawn with its
    page if that also shows text or other images; else a drawing of a page whose image cannot be decoded; else any image."""
    pages = doc.pages(limit if limit > 0 else PAGE_LIMIT)
    if pages:
        if not any(True for _ in pdf_images.page_images(doc, pages[0])) and not pdf_images.blank(doc, pages[0]) and (got := _drawn(doc, 1)):
            return got
        for number, page in enumerate(pages, 1):
            images = list(islice(pdf_images.page_images(doc, page), 2))
            if images:
                composite = len(images) > 1 or pdf_images.shows_text(doc, page)
                return (composite and _drawn(doc, number)) or images[0]
        for number, page in enumerate(pages, 1):
            if pdf_images.undecodable(doc, page):
                if got := _drawn(doc, number):
                    return got
                break
    return pdf_images.any_image(doc)


def candidates(data: bytes, limit: int = PAGE_LIMIT) -> list[tuple[int, bytes, str]]:
    """(page, image, content type) of every image of the first pages."""
    doc = Document(data)
    return [(n, *found) for n, page in enumerate(doc.pages(limit if limit > 0 else PAGE_LIMIT), 1) for found in pdf_images.page_images(doc, page)]


def page_cover(data: bytes, number: int) -> tuple[bytes, str] | None:
    """The first image on one page."""
    doc = Document(data)
    pages = doc.pages(number) if number > 0 else []
    return next(pdf_images.page_images(doc, pages[number - 1]), None) if len(pages) == number > 0 else None


def extract(data: bytes, cover_wanted: bool = False, limit: int = PAGE_LIMIT) -> Found:
    doc = Document(data)
    got = _strings(doc)
    title, author, made = got.get("Title", ""), got.get("Author", ""), got.get("CreationDate", "")
    if all_digits(title) or title.strip().lower() == "untitled":
        title = ""
    if author.strip().lower() == "unknown":
        author = ""
    dated = re.search(r"D:([0-9]{4})", made)
    out = Found(title, author, dated[1] if dated else year_of(made), got.get("Subject", ""))
    if cover_wanted and (found := cover(doc, limit)):
        out.cover, out.content_type = found
    return out



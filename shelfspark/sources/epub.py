"""EPUB: a zip whose container names a package document."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from .record import Found, Unreadable, all_digits, year_of

CONTAINER = "META-INF/container.xml"
IMG = re.compile(rb"""<img\b[^>]*?\bsrc\s*=\s*["']([^"']+)["']""", re.IGNORECASE)
TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml"}


def _local(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _named(root, name: str):
    return (e for e in root.iter() if _local(e) == name)


class Package:
    """The package document and the archive around it."""

    def __init__(self, data: bytes):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(data))
            container = ElementTree.fromstring(self.archive.read(CONTAINER))
            self.path = next((r.get("full-path") or "" for r in _named(container, "rootfile")), "")
            self.root = ElementTree.fromstring(self.archive.read(self.path))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, OSError, ValueError) as e:
            raise Unreadable(f"epub: {e}") from e
        self.items = [dict(i.attrib) for i in _named(self.root, "item")]

    def text(self, name: str) -> str:
        """The first element of the name, with the text it starts with."""
        found = next(_named(self.root, name), None)
        return "" if found is None else found.text or ""

    def beside(self, document: str, href: str) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(document), href))

    def read(self, path: str) -> bytes | None:
        try:
            return self.archive.read(path)
        except (KeyError, zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError):
            return None

    def declared_cover(self) -> tuple[str, str] | None:
        """(path, type) of the item with the property, else of the one that a cover meta names."""
        for item in self.items:
            if "cover-image" in item.get("properties", "").split(" "):
                return self.beside(self.path, item.get("href", "")), item.get("media-type", "")
        wanted = next((m.get("content") for m in _named(self.root, "meta") if m.get("name") == "cover"), None)
        for item in self.items:
            if wanted and item.get("id") == wanted:
                return self.beside(self.path, item.get("href", "")), item.get("media-type", "")
        return None

    def first_image(self) -> tuple[str, str] | None:
        """(path, type) of the first image in the first document of the spine."""
        first = next(_named(self.root, "itemref"), None)
        href = next((i.get("href") for i in self.items if first is not None and i.get("id") == first.get("idref")), None)
        if not href:
            return None
        document = self.beside(self.path, href)
        m = IMG.search(self.read(document) or b"")
        if not m:
            return None
        path = self.beside(document, m[1].decode("utf-8", "replace"))
        kind = next((i["media-type"] for i in self.items if i.get("media-type") and self.beside(self.path, i.get("href", "")) == path), None)
        kind = kind or TYPES.get(posixpath.splitext(path)[1].lower())
        return (path, kind) if kind else None


def extract(data: bytes, cover: bool = False) -> Found:
    package = Package(data)
    out = Found(package.text("title"), package.text("creator"), year_of(package.text("date")), package.text("subject"))
    if all_digits(out.title):
        out.title = ""
    if out.author.strip().lower() == "unknown":
        out.author = ""
    if cover and (where := package.declared_cover() or package.first_image()):
        out.cover = package.read(where[0])
        out.content_type = where[1] if out.cover is not None else ""
    return out

"""Paths and file names, as Catalyst expressions.  Separators are slashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, let, strip

# Device names that no file may have.
RESERVED = ("CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
#: Most bytes of a destination path, and how many a title gives up at a time.
MAX_BYTES, CUT_BYTES = 240, 10


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)/*\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last part, dot included; '' if it has none."""
    return F.regexp_extract(path, r"(?s)(\.[^./]*)\z", 1)


def file_format(path: Column) -> Column:
    return F.substr(F.lower(extension(path)), F.lit(2))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?s)\.[^./]*\z", "")


def display_stem(path: Column) -> Column:
    """Like stem, but a name that only starts with a dot stays whole."""
    return F.regexp_replace(base_name(path), r"(?s)(?<=.)\.[^./]*\z", "")


def scan_order(path: Column) -> Column:
    """Sorts paths as a walk in depth-first, lexical order meets them."""
    return F.split(path, "/", -1)


def _folded(path: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        pop = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when((part == "..") & back, pop).when((part == "..") & rooted, done).otherwise(F.concat(done, F.array(part)))

    out = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/", -1), none, step), "/"))
    return F.regexp_replace(out, r"^\z", ".")


def clean(path: Column) -> Column:
    """Without empty and dot parts, and with '..' taken back where it can be."""
    # most paths have nothing to clean
    return let(path, lambda p: F.when(p.rlike(r"//|(^|/)\.{1,2}(/|\z)|./\z|^\z"), _folded(p)).otherwise(p))


def join(*parts: Column) -> Column:
    """The non-empty parts, joined and cleaned; '' if there are none."""
    return let(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/"), lambda j: F.when(j == "", "").otherwise(clean(j)))


def sanitize(name: Column) -> Column:
    s = F.rtrim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', ""), F.lit(" ."))
    return let(s, lambda x: F.when(F.upper(x).isin(*RESERVED), F.concat(F.lit("_"), x)).when(x == "", "Untitled").otherwise(x))


def render(template: str, title: Column, year: Column, author: Column) -> Column:
    """The template with its three fields filled in at once, without what empty fields leave behind."""
    fields = {"{title}": title, "{year}": year, "{author}": author}
    pieces = [p for p in re.split(r"(\{title\}|\{year\}|\{author\})", template) if p]
    s = F.concat(*[fields.get(p, F.lit(p)) for p in pieces]) if pieces else F.lit("")
    s = F.regexp_replace(F.regexp_replace(s, rf"\({SPACE}*\)", ""), f"{SPACE}+", " ")
    edge = r"[\t\n\f\r \-\x{2013}\x{2014}]+"
    s = let(s, lambda x: F.when(title == "", F.regexp_replace(x, f"^{edge}", "")).otherwise(x))
    return strip(let(s, lambda x: F.when(author == "", F.regexp_replace(x, rf"{edge}\z", "")).otherwise(x)))


def byte_prefix(c: Column, n: Column) -> Column:
    """The longest prefix of whole characters within n bytes."""
    raw = F.encode(c, "UTF-8")
    cuts = F.transform(F.array(*[F.lit(d) for d in range(4)]), lambda d: F.try_validate_utf8(F.substr(raw, F.lit(1), F.greatest(n - d, F.lit(0))).cast("string")))
    return F.coalesce(F.get(F.filter(cuts, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def destination(source_path: Column, title: Column, year: Column, author: Column, category: Column, subcategory: Column, library: str, template: str) -> Column:
    """library/category/subcategory/name.  Beyond MAX_BYTES the author goes first, then the end of the title."""
    named = F.when(title == "", "Untitled").otherwise(title)
    folder = let(join(F.lit(library), category, subcategory), lambda d: F.when(d.isin("", "/"), d).otherwise(F.concat(d, F.lit("/"))))
    ext = extension(source_path)
    fits = lambda p: F.octet_length(p) <= MAX_BYTES

    def with_title(t: Column, d: Column) -> Column:
        # a sanitised name has no slash, so the path is clean as its folder is
        path = lambda t, a: F.concat(d, sanitize(render(template, t, year, a)), ext)
        size, none = F.octet_length(t), F.lit("")
        cut = lambda k: path(byte_prefix(t, size - k * CUT_BYTES), none)
        steps = F.ceil(size / CUT_BYTES).cast("int")

        def halved(x: Column, _: Column) -> Column:
            low, high = x["low"], x["high"]
            middle = F.floor((low + high) / 2).cast("int")
            # a name that is all cut away is replaced by a longer one: no later step is shorter
            done = lambda p: fits(p) | p.rlike(r"/Untitled(\.[^./]*)?\z") | (middle == steps)
            shorter = lambda p: F.struct(low.alias("low"), (middle - 1).alias("high"), p.alias("path"))
            longer = F.struct((middle + 1).alias("low"), high.alias("high"), x["path"].alias("path"))
            return F.when(low > high, x).otherwise(let(cut(middle), lambda p: F.when(done(p), shorter(p)).otherwise(longer)))

        # the first step that fits, or the last, by halving: paths get shorter with each step
        start = F.struct(F.lit(1).alias("low"), steps.alias("high"), none.alias("path"))
        shortest = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halved)["path"]
        nameless = let(path(t, none), lambda p: F.when(fits(p), p).otherwise(shortest))
        return let(path(t, author), lambda p: F.when(fits(p), p).otherwise(nameless))

    return let(named, lambda t: let(folder, lambda d: with_title(t, d)))


def numbered(path: Column, n: Column) -> Column:
    """The path, with ' (n)' before its extension from the second on."""
    ext = extension(path)
    name = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    return F.when(n > 1, F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"), ext)).otherwise(path)


def library_folders(path: Column, library: str) -> Column:
    """struct(category, subcategory): the first two folders below the library."""
    root = library.rstrip("/") + "/"
    below = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    parts = F.split(below, "/", -1)
    part = lambda i: F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i))).otherwise("")
    return F.struct(part(0).alias("category"), part(1).alias("subcategory"))


def split_destination(path: Column, category: Column, subcategory: Column) -> Column:
    """struct(prefix, folder, name) for display: the category folders are named by the categories themselves."""
    parts = F.filter(F.split(path, r"[\\/]+"), lambda p: p != "")
    depth = F.when(subcategory != "", 2).when(category != "", 1).otherwise(0)
    prefix = F.slice(parts, 1, F.greatest(F.size(parts) - 1 - depth, F.lit(0)))
    folder = F.when(subcategory != "", F.concat(category, F.lit("/"), subcategory)).otherwise(category)
    return F.struct(F.array_join(prefix, "/").alias("prefix"), folder.alias("folder"), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")).alias("name"))

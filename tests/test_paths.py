import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import paths

TEMPLATE = "{title} ({year}) - {author}"


@pytest.fixture(scope="module")
def destination(evaluate):
    names = ["p", "t", "y", "a", "c", "s"]
    return lambda rows, library="/library": evaluate(rows, names, paths.destination(F.col("p"), F.col("t"), F.col("y"), F.col("a"), F.col("c"), F.col("s"), library, TEMPLATE))


def test_destinations(destination):
    rows = [
        ("/in/a.epub", "Driftwood", "1962", "Mira Stonefell", "Fiction", "Nature"),
        ("/in/a.epub", "Mystery Book", "", "", "Uncategorized", ""),
        ("/in/a.epub", "Mystery Book", "2024", "", "Uncategorized", ""),
        ("/in/a.epub", "Mystery Book", "", "Agatha Christie", "Uncategorized", ""),
        ("/in/a.epub", "-Leading Dash Title", "2020", "Jane Doe", "Uncategorized", ""),
        ("/in/a.EPUB", "", "", "", "Uncategorized", ""),
        ("/in/a.epub", 'CON: a/b\\c? "x" <y>|*', "", "", "Uncategorized", ""),
        ("/in/a.epub", "CON", "", "", "X", ""),
        ("/in/a.epub", "{author}", "", "me", "X", ""),
    ]
    assert destination(rows) == [
        "/library/Fiction/Nature/Driftwood (1962) - Mira Stonefell.epub",
        "/library/Uncategorized/Mystery Book.epub",
        "/library/Uncategorized/Mystery Book (2024).epub",
        "/library/Uncategorized/Mystery Book - Agatha Christie.epub",
        "/library/Uncategorized/-Leading Dash Title (2020) - Jane Doe.epub",
        "/library/Uncategorized/Untitled.EPUB",
        "/library/Uncategorized/CON abc x y.epub",
        "/library/X/_CON.epub",
        "/library/X/{author} - me.epub",
    ]


def test_long_titles(destination):
    row = ("/in/a.epub", "T" * 340, "2024", "Somebody", "C", "")
    (got,) = destination([row], "/" + "l" * 99)
    assert len(got) <= 240 and "Somebody" not in got and got.endswith(" (2024).epub")
    (got,) = destination([row], "/" + "l" * 225)
    assert got.endswith("/(2024).epub")


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(title=st.text(st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1, max_size=150))
def test_any_title_fits(destination, title):
    (got,) = destination([("/in/a.epub", title, "2024", "A B", "C", "D")])
    assert len(got.encode()) <= 240 and got.startswith("/library/C/D/") and "/" not in got[len("/library/C/D/") :]


def test_cleaning(evaluate):
    rows = {"/a//b/./c/../d": "/a/b/d", "a/b/": "a/b", "/..": "/", "../x": "../x", "": ".", "/": "/", "a/../..": "..", "/a/b": "/a/b"}
    assert dict(zip(rows, evaluate([(r,) for r in rows], ["p"], paths.clean(F.col("p"))), strict=True)) == rows


def test_parts(evaluate):
    rows = [("/a.b/Name.Tar.GZ",), ("x",), ("/a/.hidden",), ("/a/b.",)]
    assert evaluate(rows, ["p"], paths.extension(F.col("p"))) == [".GZ", "", ".hidden", "."]
    assert evaluate(rows, ["p"], paths.file_format(F.col("p"))) == ["gz", "", "hidden", ""]
    assert evaluate(rows, ["p"], paths.stem(F.col("p"))) == ["Name.Tar", "x", "", "b"]
    assert evaluate(rows, ["p"], paths.display_stem(F.col("p"))) == ["Name.Tar", "x", ".hidden", "b"]
    assert evaluate([("/lib/Fiction/Nature/x.epub",), ("/lib/x.epub",), ("/lib/Fiction/x.epub",), ("/lib/a/b/c/x.pdf",)], ["p"], F.to_json(paths.library_folders(F.col("p"), "/lib"))) == [
        '{"category":"Fiction","subcategory":"Nature"}', '{"category":"","subcategory":""}', '{"category":"Fiction","subcategory":""}', '{"category":"a","subcategory":"b"}',
    ]


def test_scan_order(spark):
    rows = spark.createDataFrame([("a.pdf",), ("a-b/z.pdf",), ("a/x.pdf",)], "p string")
    assert [r.p for r in rows.orderBy(paths.scan_order(F.col("p"))).collect()] == ["a/x.pdf", "a-b/z.pdf", "a.pdf"]


def test_display_split(evaluate):
    got = evaluate([("/lib/F/S/x.epub", "F", "S"), ("/lib/F/x.epub", "F", ""), ("x.epub", "", ""), ("", "", "")], ["p", "c", "s"], paths.split_destination(F.col("p"), F.col("c"), F.col("s")))
    assert [tuple(r) for r in got] == [("lib", "F/S", "x.epub"), ("lib", "F", "x.epub"), ("", "", "x.epub"), ("", "", "")]

import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.config import Config, General, Rule
from shelfspark.operators import dedupe, library, oplog, resolve, views
from shelfspark.plans import review

BOOK = "id int, title string, author string, format string, size_bytes bigint"


def statuses(spark, rows):
    got = dedupe.duplicates(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], BOOK)).orderBy("id").collect()
    return [r["duplicate_status"].removesuffix("Duplicate") for r in got], [r["duplicate_group_id"] for r in got]


@pytest.mark.parametrize(
    ("rows", "expected", "groups"),
    [
        ([("Driftwood", "Mira Stonefell", "epub", 1_000_000), ("driftwood", "  mira stonefell ", "epub", 1_005_000)], ["Likely", "Likely"], 1),
        ([("F", "A", "epub", 1_000_000), ("F", "A", "pdf", 5_000_000)], ["Possible", "Possible"], 1),
        ([("Driftwood", "Stonefell", "epub", 1), ("Kelp", "Olga Brandt", "epub", 1)], ["Not", "Not"], 0),
        ([("F", "A", "epub", 1_000_000), ("F", "A", "epub", 1_005_000), ("F", "A", "pdf", 9_000_000)], ["Likely", "Likely", "Possible"], 1),
        ([("Cien", "García Márquez", "epub", 5000), ("cien", "  GARCÍA MÁRQUEZ ", "epub", 5000)], ["Likely", "Likely"], 1),
        ([("", "", "epub", 1), ("", "", "epub", 1)], ["Not", "Not"], 0),
        ([("T", "", "epub", 1), ("t", "", "epub", 2)], ["Likely", "Likely"], 1),
    ],
)
def test_duplicates(spark, rows, expected, groups):
    got, ids = statuses(spark, rows)
    assert got == expected and len(set(ids) - {""}) == groups


def test_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["x", ""]), rng.choice(["epub", "pdf"]), rng.choice([0, 0, rng.randrange(5000), rng.randrange(90_000, 110_000)])) for _ in range(300)]

    def close(a, b):
        return a == b if 0 in (a, b) else abs(a - b) <= max(max(a, b) // 100, 1024)

    likely = {i for i, j in itertools.permutations(range(len(rows)), 2) if rows[i][:3] == rows[j][:3] and close(rows[i][3], rows[j][3])}
    assert {k for k, s in enumerate(statuses(spark, rows)[0]) if s == "Likely"} == likely


def test_distinct_destinations(spark):
    rows = spark.createDataFrame([(3, "/l/a.epub"), (1, "/l/a.epub"), (2, "/l/b.epub"), (4, ""), (5, ""), (6, "/l/a.epub")], "scan_ord int, dest_path string")
    got = {r.scan_ord: r.dest_path for r in dedupe.distinct_destinations(rows).collect()}
    assert got == {1: "/l/a.epub", 3: "/l/a (2).epub", 6: "/l/a (3).epub", 2: "/l/b.epub", 4: "", 5: ""}


def files(spark, rows):
    return spark.createDataFrame(rows, "source_path string, size_bytes bigint, scan_ord int, m_title string, m_author string, m_year string, subject string")


CONFIG = Config(General(library_folder="/library"), ["OceanofPDF.com"], [], {"Fiction": ["Nature"]}, [Rule("author", "Mira Stonefell", "Fiction", "Nature")])


def test_review(spark):
    rows = [
        ("/in/Driftwood - Mira Stonefell.epub", 1000, 0, "Driftwood", "Mira Stonefell", "1962", ""),
        ("/in/Driftwood - Mira Stonefell [signed edition].epub", 1000, 1, "Driftwood", "Mira Stonefell", "1962", ""),
        ("/in/OceanofPDF.com.pdf", 5, 2, "", "", "", None),
        ("/in/Kelp - Olga Brandt.pdf", 7, 3, None, "", "", ""),
    ]
    got = review.review(files(spark, rows), CONFIG).orderBy("scan_ord").collect()
    assert [r.status for r in got] == ["Metadata", "Metadata", "Unresolved", "Partial"]
    assert [r.dest_path for r in got][:2] == ["/library/Fiction/Nature/Driftwood (1962) - Mira Stonefell.epub", "/library/Fiction/Nature/Driftwood (1962) - Mira Stonefell (2).epub"]
    assert [r.duplicate_status for r in got] == ["LikelyDuplicate", "LikelyDuplicate", "NotDuplicate", "NotDuplicate"]
    assert (got[3].title.value, got[3].title.source, got[3].author.value) == ("Kelp", "Heuristic", "Olga Brandt")
    assert got[0].old_filename == "Driftwood - Mira Stonefell.epub" and got[0].id == got[0].source_path
    seen = review.review(files(spark, rows), CONFIG)
    assert views.visible(seen, "duplicates").count() == 2 and views.visible(seen, "All", "BRANDT").count() == 1 and views.visible(seen, "All", "  ").count() == 4 and views.visible(seen, "uncategorized").count() == 2
    ready, skipped = views.to_apply(seen)
    assert (ready.count(), skipped.count()) == (3, 1)
    back = views.books_from_views(seen)
    assert "status" not in back.columns and back.count() == 4


@pytest.mark.parametrize(("sources", "manual", "expected"), [("MMM", False, "Metadata"), ("MHM", False, "Heuristic"), ("MMU", False, "Partial"), ("UHM", False, "Unresolved"), ("MEM", False, "Edited"), ("MMM", True, "Edited"), ("MUM", True, "Partial")])
def test_status(evaluate, sources, manual, expected):
    names = {"M": "Metadata", "H": "Heuristic", "U": "Unresolved", "E": "Edited"}
    f = [resolve.sourced(F.lit(""), names[s]) for s in sources]
    assert evaluate([("x",)], ["x"], resolve.status(*f, F.lit(manual))) == [expected]


def test_edits(spark):
    rows = files(spark, [("/in/x.epub", 1, 0, "dune", "mira stonefell", "1965", "")])
    books = resolve.categorised(resolve.with_fields(rows, []), CONFIG)
    (r,) = resolve.recomputed(resolve.edited(books, "title", F.lit("the_new-title of x")), CONFIG).collect()
    assert (r.title.value, r.title.source, r.status, r.category) == ("The New Title of X", "Edited", "Edited", "Fiction")
    (r,) = resolve.swapped(books).collect()
    assert (r.title.value, r.author.value) == ("mira stonefell", "dune")
    (r,) = resolve.categorised(books.withColumns({"category_manual": F.lit(True), "category": F.lit("Mine")}), CONFIG).collect()
    assert r.category == "Mine"


LOG = "log_ord bigint, batch_id string, timestamp timestamp, op_type string, old_path string, new_path string, undone boolean"


def log(spark, rows):
    return spark.createDataFrame([(k, b, None, "move", o, n, u) for k, (b, o, n, u) in enumerate(rows)], LOG)


def test_batches(spark):
    table = log(spark, [("b1", "/a", "/b", False), ("b1", "/c", "/d", False), ("b2", "/e", "/f", True)])
    assert [(r.batch_id, r.entry_count, r.undone_count) for r in oplog.batches(table).orderBy("first_ord").collect()] == [("b1", 2, 0), ("b2", 1, 1)]
    assert [(r.batch_id, [e.old_path for e in r.entries]) for r in oplog.batch_views(table).collect()] == [("b2", ["/e"]), ("b1", ["/a", "/c"])]


@pytest.mark.parametrize(("ids", "expected"), [([], "20260710-1"), (["20260710-1", "20260710-2"], "20260710-3"), (["20260709-9", "manual-test"], "20260710-1"), (["20260710-x", "20260710- 5", "20260710-+4"], "20260710-5"), (["20260710-99999999999999999999"], "20260710-1")])
def test_next_batch(spark, ids, expected):
    assert oplog.next_batch_id(log(spark, [(i, "", "", False) for i in ids]), "20260710").first()[0] == expected


def test_fold(spark):
    table = log(spark, [("b1", "/a", "/b", False), ("b1", "/c", "/d", False), ("b2", "/e", "/f", False)])
    events = spark.createDataFrame([(1, "b1", True, "/a", "/b"), (2, "b1", False, "/a", "/b"), (3, "b2", True, None, None), (4, "b9", True, "/a", "/b"), (5, "b1", True, None, None), (6, "b1", False, "/c", "/d")], "log_ord bigint, batch_id string, undone boolean, old_path string, new_path string")
    assert [r.undone for r in oplog.folded(table, events).orderBy("log_ord").collect()] == [True, False, True]
    assert [r.old_path for r in oplog.to_undo(oplog.folded(table, events), "b1").collect()] == ["/c"]
    assert [r.old_path for r in oplog.to_redo(oplog.folded(table, events), "b1").collect()] == ["/a"]


SHELF = "source_path string, title string, author string, year string, category string, subcategory string"


def test_shelves(spark):
    books = spark.createDataFrame([("1", "b", "Z", "2000", "F", "S"), ("2", "É", "A", "1999", "F", "S"), ("3", "a", "M", "2001", "N", ""), ("4", "B", "B", "1990", "F", "a")], SHELF)
    assert [(r.shelf, r.title) for r in library.shelves(books).collect()] == [("(No subcategory)", "a"), ("a", "B"), ("S", "b"), ("S", "É")]
    assert [r.title for r in library.shelves(books, "author").where("shelf = 'S'").orderBy("place").collect()] == ["É", "b"]
    assert [r.category for r in library.categories(books).collect()] == ["F", "N"]
    assert [r.subcategory for r in library.subcategories(books).collect()] == ["a", "S"]
    assert library.search(books, " b ").count() == 2 and library.search(books, "", "F", "S").count() == 2
    assert {r.shelf: r.books for r in library.shelf_counts(books).collect()} == {"(No subcategory)": 1, "a": 1, "S": 2}


def test_selection(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "id string")
    on = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [views.all_checked(s, c).first()[0] for s, c in ((seen, on("a", "b", "b")), (seen, on("a")), (seen.where("false"), on("a")))] == [True, False, False]

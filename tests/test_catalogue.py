import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.actions import moves
from shelfspark.actions.moves import Ledger, Move, MoveFailed
from shelfspark.plans.catalogue import Catalogue
from shelfspark.sources import covers, listing, state
from shelfspark.streaming import oplog as streaming

from . import books

yaml = pytest.importorskip("yaml")


@pytest.fixture
def place(tmp_path):
    for d in ("in", "lib", "log", "state"):
        (tmp_path / d).mkdir()
    (tmp_path / "config.yaml").write_text(yaml.safe_dump({"general": {"working_folder": str(tmp_path / "in"), "library_folder": str(tmp_path / "lib"), "log_folder": str(tmp_path / "log"), "filename_format": "{title} ({year}) - {author}"}, "heuristics": {"known_junk_tags": ["OceanofPDF.com"]}, "categories": {"Fiction": {"subcategories": ["Nature"]}}, "rules": [{"match_field": "title", "match_value": "^Odd", "category": "Nowhere"}]}))
    return tmp_path


def test_scan_apply_undo(spark, place):
    (place / "in/a.epub").write_bytes(books.epub())
    (place / "in/b.epub").write_bytes(books.epub(title="odd one", subject=""))
    (place / "in/OceanofPDF.com.pdf").write_bytes(b"x")
    seen = []
    app = Catalogue(spark, str(place / "config.yaml"), str(place / "state"), lambda *x: seen.append(x))
    rows = app.scan()
    assert [(r.status, r.category) for r in rows.collect()] == [("Unresolved", "Uncategorized"), ("Metadata", "Fiction"), ("Metadata", "Nowhere")]
    assert seen == [(0, 3), (3, 3)] and app.category_warnings().count() == 1
    out = app.apply(rows)
    assert [(r["skipped"], r["ok"]) for r in out] == [(True, False), (False, True), (False, True)]
    moved = place / "lib/Fiction/Nature/Driftwood (1962) - Mira Stonefell.epub"
    assert moved.exists() and not (place / "in/a.epub").exists()
    (batch,) = app.operation_batches().collect()
    assert (batch.entry_count, batch.undone_count, batch.remaining_count) == (2, 0, 2) and batch.batch_id.endswith("-1")
    assert app.next_batch_id().endswith("-2")
    assert app.undo_batch(batch.batch_id) == 2 and (place / "in/a.epub").exists() and app.undo_batch(batch.batch_id) == 0
    assert app.operation_batches().first().undone_count == 2
    assert app.redo_batch(batch.batch_id) == 2 and moved.exists() and app.operation_batches().first().undone_count == 0
    assert [tuple(r) for r in app.categories().collect()] == [("Fiction", "Nature")]
    assert app.config_status()["ok"] and not Catalogue(spark, str(place / "none.yaml"), "x").config_status()["ok"]


def test_library_and_cache(spark, place):
    shelf = place / "lib/Fiction/Nature"
    shelf.mkdir(parents=True)
    (shelf / "Driftwood.epub").write_bytes(books.epub(manifest='<item id="i" href="c.jpg" media-type="image/jpeg" properties="cover-image"/>', files=[("OEBPS/c.jpg", books.JPEG)]))
    (shelf / "Kelp - Olga Brandt.mobi").write_bytes(b"broken")
    app = Catalogue(spark, str(place / "config.yaml"), str(place / "state"))
    first = [tuple(r) for r in app.library().drop("scan_ord").collect()]
    by = {os.path.basename(r[0]): r for r in first}
    assert by["Kelp - Olga Brandt.mobi"][1:3] == ("Kelp", "Olga Brandt") and by["Driftwood.epub"][4:6] == ("Fiction", "Nature")
    address = by["Driftwood.epub"][6]
    assert address.startswith("/covers/") and (place / "state/covers" / address.split("/")[2].split("?")[0]).read_bytes() == books.JPEG
    cached = app.cache.load().collect()
    assert [os.path.basename(r.source_path) for r in cached] == ["Driftwood.epub"]  # failures are not cached
    assert [tuple(r) for r in app.library().drop("scan_ord").collect()] == first
    path = str(shelf / "Driftwood.epub")
    custom = app.set_cover_image(path, books.PNG, "image/png")
    assert app.cache.load().count() == 0
    got = {os.path.basename(r.source_path): r for r in app.library().collect()}["Driftwood.epub"]
    assert (got.cover_path, got.cover_overridden) == (custom, True)
    app.clear_cover(path)
    assert not {os.path.basename(r.source_path): r for r in app.library().collect()}["Driftwood.epub"].cover_overridden
    os.unlink(path)
    assert app.library().count() == 1 and app.cache.load().count() == 0
    app.reset_covers()
    assert app.cache.load().count() == 0


def test_pdf_cover_choice(spark, place):
    page = b"<< /Type /Page /Resources << /XObject << /X %d 0 R >> >> >>"
    image = lambda x: books.stream("/Subtype /Image /Filter /DCTDecode", books.JPEG + x)
    path = place / "lib/x.pdf"
    path.write_bytes(books.pdf([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R 4 0 R] >>"), (3, page % 20), (4, page % 21), (20, image(b"1")), (21, image(b"2"))]))
    app = Catalogue(spark, str(place / "config.yaml"), str(place / "state"))
    assert [c["page"] for c in app.cover_candidates(str(path))] == [1, 2]
    chosen = app.set_cover_page(str(path), 2)
    (row,) = app.library().collect()
    assert (row.cover_path, row.cover_overridden) == (chosen, True)
    with pytest.raises(ValueError):
        app.set_cover_page(str(path), 3)
    app.set_scan_concurrency(3)
    assert app.scan_concurrency() == 3


def test_folders(tmp_path):
    (tmp_path / "w").mkdir()
    assert listing.check_folders(str(tmp_path / "w"), str(tmp_path / "l"), str(tmp_path / "g")) == [] and (tmp_path / "l").is_dir()
    assert len(listing.check_folders(str(tmp_path / "none"), "", str(tmp_path / "g"))) == 2


def test_failed_batch_is_taken_back(tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    (tmp_path / "taken").write_text("t")
    ledger = Ledger(str(tmp_path / "log/ops.jsonl"))
    with pytest.raises(MoveFailed):
        ledger.execute("1", [Move(str(tmp_path / "a"), str(tmp_path / "x/a")), Move(str(tmp_path / "b"), str(tmp_path / "taken"))])
    assert (tmp_path / "a").read_text() == "a" and (tmp_path / "taken").read_text() == "t" and ledger.entries() == []
    (tmp_path / "blocked").write_text("")
    with pytest.raises(OSError):
        Ledger(str(tmp_path / "blocked/ops.jsonl")).execute("1", [Move(str(tmp_path / "a"), str(tmp_path / "y"))])
    assert (tmp_path / "a").exists()


def test_undo_goes_on_after_an_error(tmp_path):
    for n in "ab":
        (tmp_path / n).write_text(n)
    ledger = Ledger(str(tmp_path / "ops.jsonl"))
    ledger.execute("1", [Move(str(tmp_path / n), str(tmp_path / f"new/{n}")) for n in "ab"])
    (tmp_path / "a").write_text("in the way")
    with pytest.raises(MoveFailed):
        ledger.undo("1")
    assert [e["undone"] for e in ledger.entries()] == [False, True]
    (tmp_path / "a").unlink()
    assert ledger.undo("1") == 1 and ledger.undo("1") == 0 and ledger.undo("none") == 0
    assert (tmp_path / "a").read_text() == "a"


def test_move_across_devices(tmp_path, monkeypatch):
    def refuse(a, b):
        raise OSError(18, "cross-device")

    monkeypatch.setattr(moves, "rename", refuse)
    (tmp_path / "a").write_text("a")
    moves.move(str(tmp_path / "a"), str(tmp_path / "d/b"))
    assert (tmp_path / "d/b").read_text() == "a" and not (tmp_path / "a").exists()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["undo", "redo"]), max_size=6))
def test_undo_and_redo_agree(tmp_path_factory, actions):
    base = tmp_path_factory.mktemp("moves")
    for n in "abc":
        (base / n).write_text(n)
    ledger = Ledger(str(base / "ops.jsonl"))
    ledger.execute("1", [Move(str(base / n), str(base / f"new-{n}")) for n in "abc"])
    for a in actions:
        getattr(ledger, a)("1")
    undone = bool(actions) and actions[-1] == "undo"
    assert all((base / n).exists() == undone for n in "abc") and all(e["undone"] == undone for e in ledger.entries())


def test_logs(spark, tmp_path):
    path = tmp_path / "ops.jsonl"
    assert state.op_log(spark, str(path)).count() == 0
    path.write_text('{"batch_id":"b1","timestamp":"2026-07-10T09:00:00.123456789Z","op_type":"move","old_path":"/a","new_path":"/b","undone":false}\n\n{"batch_id":"b2","timestamp":"2026-07-10T12:00:00+02:00"}\n')
    rows = state.op_log(spark, str(path)).orderBy("log_ord").collect()
    assert [(r.log_ord, r.batch_id, r.timestamp.isoformat(), r.old_path) for r in rows] == [(0, "b1", "2026-07-10T09:00:00.123456", "/a"), (1, "b2", "2026-07-10T10:00:00", "")]
    path.write_text("{broken\n")
    with pytest.raises(state.BadLog):
        state.op_log(spark, str(path))
    none = spark.createDataFrame([], "timestamp timestamp, source_path string, category string, subcategory string, warning string")
    assert state.append_warnings(none, "") == 0


def test_overrides(spark, tmp_path):
    o = state.Overrides(str(tmp_path / "o.json"))
    o.embedded("/a", 3)
    o.custom("/b", "/img")
    o.clear("/none")
    assert o.get("/a") == {"type": "embedded", "page": 3} and [tuple(r) for r in o.table(spark).orderBy("source_path").collect()] == [("/a", "embedded", 3, ""), ("/b", "custom", None, "/img")]
    o.clear("/a")
    assert json.loads((tmp_path / "o.json").read_text()) == {"/b": {"type": "custom", "imagePath": "/img"}}
    (tmp_path / "o.json").write_text("{")
    with pytest.raises(ValueError):
        o.load()


def test_cover_files(tmp_path):
    first = covers.write(str(tmp_path), "/a", b"1", "image/png")
    assert covers.ensure(str(tmp_path), "/a", b"2", "image/png") != first and (tmp_path / covers.file_name("/a", "image/png")).read_bytes() == b"1"
    assert covers.file_name("/a", "x/y").endswith(".img")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"batch_id":"b1","timestamp":"2026-07-10T09:00:00Z","old_path":"/a","new_path":"/b","undone":false}\n{"batch_id":"b1","timestamp":"2026-07-10T09:30:00Z","undone":true}\n')
    moves_ = streaming.read_log(spark, str(tmp_path / "in"))
    for name, df in (("totals", streaming.batch_totals(moves_)), ("hours", streaming.moves_by_hour(moves_))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.batch_id, r.entry_count, r.undone_count) for r in spark.table("totals").collect()] == [("b1", 2, 1)]
    assert [r.moves for r in spark.table("hours").collect()] == [2]

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelfspark.sources import epub, extract, images, listing, mobi, pdf, pdf_images, pdf_objects, samples
from shelfspark.sources.record import Unreadable

from . import books


def fields(found):
    return found.title, found.author, found.year, found.subject


def test_epub():
    assert fields(epub.extract(books.epub())) == ("Driftwood", "Mira Stonefell", "1962", "Nature")
    assert fields(epub.extract(books.epub("0123", "Unknown", "", "")))[:2] == ("", "")
    assert epub.extract(books.epub(title="untitled")).title == "untitled"
    for bad in (b"", b"PK nonsense", books.epub()[:60]):
        with pytest.raises(Unreadable):
            epub.extract(bad)


@pytest.mark.parametrize(
    ("manifest", "metas", "spine", "files", "expected"),
    [
        ('<item id="i" href="img/c.jpg" media-type="image/jpeg" properties="svg cover-image"/>', "", "", [("OEBPS/img/c.jpg", books.JPEG)], "image/jpeg"),
        ('<item id="c" href="c.png" media-type="image/png"/>', '<meta name="cover" content="c"/>', "", [("OEBPS/c.png", books.PNG)], "image/png"),
        ('<item id="p" href="text/p.xhtml" media-type="application/xhtml+xml"/>', "", '<itemref idref="p"/>', [("OEBPS/text/p.xhtml", b"<img alt='' src='../x/c.gif'>"), ("OEBPS/x/c.gif", b"GIF89a")], "image/gif"),
        ('<item id="c" href="gone.png" media-type="image/png"/>', '<meta name="cover" content="c"/>', "", [], ""),
    ],
)
def test_epub_covers(manifest, metas, spine, files, expected):
    data = books.epub(manifest=manifest, metas=metas, spine=spine, files=files)
    got = epub.extract(data, cover=True)
    assert got.content_type == expected and bool(got.cover) == bool(expected)
    assert epub.extract(data).cover is None


def test_mobi():
    assert fields(mobi.extract(books.mobi())) == ("Driftwood", "Mira Stonefell", "1962", "Nature")
    assert fields(mobi.extract(books.mobi(records=()))) == ("Full Name", "", "", "")
    assert mobi.extract(books.mobi(records=((100, b"A"), (100, b"B")))).author == "B"
    got = mobi.extract(books.mobi(images=[b"text", books.JPEG, books.PNG]), cover=True)
    assert (got.cover, got.content_type) == (books.JPEG, "image/jpeg")
    cut = mobi.extract(books.mobi(cut=16 + 232 + 12 + 8 + len("Mira Stonefell") + 3))
    assert (cut.title, cut.author, cut.subject) == ("", "Mira Stonefell", "")
    for bad in (b"", bytes(100), books.mobi()[:150]):
        with pytest.raises(Unreadable):
            mobi.extract(bad)


INFO = "<< /Root 1 0 R /Info 9 0 R >>"


def info(body: bytes, trailer=INFO):
    return fields(pdf.extract(books.pdf([(1, b"<< /Type /Catalog >>"), (9, body)], trailer)))


def test_pdf_information():
    assert info(b"<< /Title (Driftwood) /Author (Mira Stonefell \\(revised\\)) /CreationDate (D:19620101) /Subject (Nature) >>") == ("Driftwood", "Mira Stonefell (revised)", "1962", "Nature")
    assert info(b"<< /Title <FEFF0046 00f6> /Author (A\\351\\n) >>") == ("Fö", "Aé\n", "", "")
    assert info(b"<< /Title <414> /Author (unknown) >>")[:2] == ("A@", "")
    assert info(b"<< /Title (Untitled) >>")[0] == "" and info(b"<< /Title (12345) >>")[0] == ""
    # without a trailer that names it, only subject and date are looked for
    assert info(b"<< /Title (X) /Subject (S) /CreationDate (a 1999 b) >>", "<< /Root 1 0 R >>") == ("", "", "1999", "S")
    # the last update wins
    twice = books.pdf([(9, b"<< /Title (Old) >>"), (9, b"<< /Title (New) >>")], INFO)
    assert pdf.extract(twice).title == "New"


def packed(numbers_and_bodies):
    head, body = "", b""
    for n, b in numbers_and_bodies:
        head += f"{n} {len(body)} "
        body += b + b" "
    return books.flate(f"/Type /ObjStm /N {len(numbers_and_bodies)} /First {len(head)}", head.encode() + body)


def test_pdf_objects_in_streams():
    data = books.pdf([(5, packed([(9, b"<< /Title (Packed) >>"), (1, b"<< /Type /Catalog >>")])), (7, books.stream("/Type /XRef /Info 9 0 R", b"x"))], "nothing")
    assert pdf.extract(data).title == "Packed"
    data = books.pdf([(5, packed([(9, b"<< /Title (Packed) >>")])), (9, b"<< /Title (Direct) >>")], INFO)
    assert pdf.extract(data).title == "Direct"
    data = books.pdf([(5, packed([(9, b"<< /Title (A) >>")])), (6, packed([(9, b"<< /Title (B) >>")]))], INFO)
    assert pdf.extract(data).title == "B"


PAGE = b"<< /Type /Page /Resources << /XObject << /X 20 0 R >> >> /Contents 30 0 R >>"


def document(*objects, kids=b"[ 3 0 R ]"):
    base = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids " + kids + b" >>"), (3, PAGE), (30, books.stream("", b"q"))]
    return books.pdf(base + list(objects))


RGB = "/Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8"


def pixels(data: bytes) -> list:
    at, out = 8, b""
    width = struct.unpack(">I", data[16:20])[0]
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        out += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(out), np.uint8).reshape(-1, 1 + 3 * width)[:, 1:].tolist()


@pytest.mark.parametrize(
    ("space", "samples", "parms", "expected"),
    [
        ("/DeviceRGB", b"\1\2\3\4\5\6", "", [[1, 2, 3, 4, 5, 6]]),
        ("/DeviceGray", b"\7\x08", "", [[7, 7, 7, 8, 8, 8]]),
        ("/DeviceCMYK", b"\0\0\0\0\xff\0\0\0", "", [[255, 255, 255, 0, 255, 255]]),
        ("[/ICCBased 40 0 R]", b"\1\2\3\4\5\6", "", [[1, 2, 3, 4, 5, 6]]),
        ("[/Indexed /DeviceRGB 1 (\\001\\002\\003\\004\\005\\006)]", b"\1\0", "", [[4, 5, 6, 1, 2, 3]]),
        ("/DeviceRGB", b"\1\2\3\1\1\1", "/DecodeParms << /Predictor 2 /Colors 3 /Columns 2 >>", [[1, 2, 3, 2, 3, 4]]),
        ("/DeviceRGB", b"\1\1\2\3\1\1\1", "/DecodeParms << /Predictor 15 /Colors 3 /Columns 2 >>", [[1, 2, 3, 2, 3, 4]]),
        ("/DeviceRGB", b"\4\1\2\3\1\1\1", "/DecodeParms << /Predictor 15 /Colors 3 /Columns 2 >>", [[1, 2, 3, 2, 3, 4]]),
        ("/DeviceRGB", b"\3\2\2\2\1\1\1", "/DecodeParms << /Predictor 15 /Colors 3 /Columns 2 >>", [[2, 2, 2, 2, 2, 2]]),
        ("/DeviceRGB", b"\1\2\3", "", None),
        ("/DeviceRGB", b"\x09\1\2\3\1\1\1", "/DecodeParms << /Predictor 15 /Colors 3 /Columns 2 >>", None),
        ("/Pattern", b"\1\2\3\4\5\6", "", None),
    ],
)
def test_flate_images(space, samples, parms, expected):
    raster = books.flate(RGB.replace("/DeviceRGB", space) + " " + parms, samples)
    data = document((20, raster), (40, books.stream("/N 3", b"profile")))
    got = pdf.candidates(data)
    assert [pixels(x[1]) for x in got] == ([expected] if expected else [])


def test_png_rows_with_several_lines():
    rows = b"\0\1\2\2\1\1\3\1\1\4\1\1"  # none, up, average, Paeth; one gray component
    got = pdf_images.unpredicted(rows, 12, 2, 1)
    assert list(got) == [1, 2, 2, 3, 2, 3, 3, 4]
    assert pdf_images.unpredicted(b"", 12, 2, 1) == b"" and pdf_images.unpredicted(b"xx", 12, 2, 1) is None


def test_pdf_covers():
    jpeg = books.stream("/Subtype /Image /Filter /DCTDecode", books.JPEG)
    assert pdf.extract(document((20, jpeg)), True).cover == books.JPEG
    form = books.stream("/Subtype /Form /Resources << /XObject << /Y 21 0 R >> >>", b"")
    assert pdf.extract(document((20, form), (21, jpeg)), True).cover == books.JPEG
    circle = books.stream("/Subtype /Form /Resources << /XObject << /Y 20 0 R >> >>", b"")
    assert pdf.extract(document((20, circle)), True).cover is None
    huge = books.flate(RGB.replace("/Width 2", "/Width 70000"), b"x")
    assert pdf.extract(document((20, huge)), True).cover is None
    # an image that no page shows is the last resort
    assert pdf.extract(books.pdf([(20, jpeg)]), True).cover == books.JPEG


def test_pdf_pages():
    loop = document(kids=b"[ 2 0 R 3 0 R 3 0 R ]")
    assert len(pdf_objects.Document(loop).pages(10)) == 1
    many = books.pdf([(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids 8 0 R >>"), (8, b"[ 10 0 R 11 0 R 12 0 R ]"), *[(n, b"<< /Type /Page >>") for n in (10, 11, 12)]])
    assert len(pdf_objects.Document(many).pages(10)) == 3 and len(pdf_objects.Document(many).pages(2)) == 2
    jpeg = books.stream("/Subtype /Image /Filter /DCTDecode", books.JPEG)
    assert pdf.page_cover(document((20, jpeg)), 1) == (books.JPEG, "image/jpeg") and pdf.page_cover(document((20, jpeg)), 2) is None


def test_renderer_is_asked_where_a_page_is_composite(monkeypatch):
    asked = []
    monkeypatch.setattr(pdf, "renderer", lambda data, n: asked.append(n) or (b"drawn", "image/png"))
    jpeg = books.stream("/Subtype /Image /Filter /DCTDecode", books.JPEG)
    assert pdf.extract(document((20, jpeg)), True).cover == books.JPEG and not asked
    assert pdf.extract(document((20, jpeg), (30, books.flate("", b"BT (x) Tj ET"))), True).cover == b"drawn"
    assert pdf.extract(document((20, books.stream("/Subtype /Image /Filter /JPXDecode", b"x"))), True).cover == b"drawn"
    blank = document((20, books.stream("/Subtype /Image /Filter /JPXDecode", b"x")), (30, books.stream("", b"")))
    assert pdf.extract(blank, True).cover == b"drawn" and asked == [1, 1, 1]


def test_broken_pdf_never_raises():
    whole = document((20, books.flate(RGB, b"\1\2\3\4\5\6")))
    for cut in range(0, len(whole), 7):
        pdf.extract(whole[:cut], True)
        pdf.extract(whole[cut:], True)


def test_listing_and_extraction(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"_OceanofPDF.com_Kelp_-_Frank_Herbert.epub": b"broken", "book.EPUB": books.epub(title="driftwood_and_empire.", creator="A ;B"), "sub/b.azw3": books.mobi(), ".h.mobi": books.mobi(), "notes.txt": b"x", "c.cbz": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    files = listing.listing(spark, str(tmp_path))
    assert [r.source_path[len(str(tmp_path)) + 1 :] for r in files.orderBy("scan_ord").collect()] == [".h.mobi", "_OceanofPDF.com_Kelp_-_Frank_Herbert.epub", "book.EPUB", "sub/b.azw3"]
    got = {r.source_path.rpartition("/")[2]: r for r in extract.extracted(files, cover=True).collect()}
    assert (got["book.EPUB"].title, got["book.EPUB"].author, got["book.EPUB"].ok) == ("Driftwood and Empire", "A, B", True)
    bad = got["_OceanofPDF.com_Kelp_-_Frank_Herbert.epub"]
    assert (bad.ok, bad.title, bad.cover) == (False, "", None) and "Unreadable" in bad.error
    with pytest.raises(OSError):
        list(listing.walk(str(tmp_path / "missing")))
    content = spark.createDataFrame([("s3://far/x.azw3", bytearray(books.mobi()))], "source_path string, content binary")
    assert extract.extracted(content).first().title == "Driftwood"


def test_sniff():
    assert [images.sniff(x) for x in (books.JPEG, books.PNG, b"GIF87a", b"text")] == ["image/jpeg", "image/png", "image/gif", None]


def test_results_are_handed_over_together(spark):
    """Not a batch for each file, and with covers no more than BYTES or so at once."""
    names = [("source_path", pa.string()), ("cover", pa.binary())]
    rows = pa.record_batch({"source_path": [f"/{k}.epub" for k in range(2500)]})
    got = list(extract._each([rows], lambda r: [(r["source_path"], None)], names))
    assert [b.num_rows for b in got] == [1000, 1000, 500]
    assert pa.Table.from_batches(got).column("source_path").to_pylist() == rows.column("source_path").to_pylist()
    got = list(extract._each([rows.slice(0, 8)], lambda r: [(r["source_path"], bytes(extract.BYTES // 2))] * 2, names))
    assert [b.num_rows for b in got] == [2] * 8
    assert list(extract._each([rows], lambda r: [], names)) == []


def test_samples_are_dealt_out(spark):
    """One partition of rows that name books becomes as many tasks as shuffles have."""
    books = spark.createDataFrame([(f"/in/{k}.epub", "epub", f"t{k}", "a", "2001-05-30", "s") for k in range(400)], "source_path string, format string, title string, author string, date string, subject string").coalesce(1)
    made = samples.files(books)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = extract.extracted(made).orderBy("source_path").collect()
    assert sorted((r.source_path, r.title) for r in got) == sorted((f"/in/{k}.epub", f"T{k}") for k in range(400)) and all(r.ok for r in got)

"""The smallest ebooks that hold given metadata, for queries over tables without ebooks."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame


def epub(title: str, author: str, date: str, subject: str) -> bytes:
    dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in (("title", title), ("creator", author), ("date", date), ("subject", subject)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>')
        z.writestr("book.opf", f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{dc}</metadata></package>')
    return out.getvalue()


def mobi(title: str, author: str, date: str, subject: str) -> bytes:
    """One record: a header of 232 bytes whose flags announce EXTH records, these, and the full name."""
    values = ((100, author), (105, subject), (106, date), (503, title))
    records = b"".join(struct.pack(">II", k, 8 + len(v.encode())) + v.encode() for k, v in values)
    exth = b"EXTH" + struct.pack(">II", 12 + len(records), len(values)) + records
    header = bytearray(b"MOBI" + struct.pack(">I", 232) + bytes(224))
    header[84:88] = struct.pack(">I", 0x40)
    header[96:104] = struct.pack(">II", 248 + len(exth), len(title.encode()))
    return bytes(76) + struct.pack(">HII", 1, 88, 0) + bytes(2) + bytes(16) + bytes(header) + exth + title.encode()


def pdf(title: str, author: str, date: str, subject: str) -> bytes:
    text = lambda s: "(" + s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"
    info = f"<< /Title {text(title)} /Author {text(author)} /CreationDate (D:{date.replace('-', '')}) /Subject {text(subject)} >>"
    return f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n9 0 obj\n{info}\nendobj\ntrailer\n<< /Root 1 0 R /Info 9 0 R >>\n%%EOF".encode()


MAKERS = {"epub": epub, "mobi": mobi, "azw3": mobi, "pdf": pdf}


def _make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        content = [MAKERS[r["format"]](r["title"], r["author"], r["date"], r["subject"]) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("source_path"), pa.array(content, pa.binary())], ["source_path", "content"])


def files(books: DataFrame) -> DataFrame:
    """source_path, content.  books: source_path, format, title, author, date (yyyy-mm-dd), subject, none of them null.

    Their rows are dealt out first: a file of a few megabytes, which is one task, may name a million books."""
    rows = books.select("source_path", "format", "title", "author", "date", "subject")
    return rows.repartition(int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_make, "source_path string, content binary")

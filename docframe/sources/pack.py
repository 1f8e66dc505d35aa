"""Rows to files: the inverse of the readers, used to hand tables on as PDF files and to prove round trips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from . import writer
from .syntax import Name, Ref, Stream


def pack(rows: DataFrame, build: Callable[[dict], bytes]) -> DataFrame:
    """files(path, content) of rows(path, ...): one file a row, made where the row lies; rows with a null path are passed on."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a file is handed on when it is made, so that a batch of long texts is never held twice
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), pa.array([build(row)], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def text_file(row: dict) -> bytes:
    """A row's text as pages of 50 lines; a null text is an empty one."""
    return writer.text_file(row["text"] or "")


def protected(method: str, password: str) -> Callable[[dict], bytes]:
    return lambda row: writer.text_file(row["text"] or "", encrypt=method, user_password=password.encode())


def one_page(content: bytes, page: dict | None = None, more: dict[int, object] | None = None, info: dict | None = None) -> bytes:
    objects: dict[int, object] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)},
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 1000, 1000]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0)} | (page or {}),
        4: Stream({}, content),
    }
    objects |= more or {}
    if info:
        objects[5] = info
    return writer.write(objects, info=5 if info else None)


def attachment_file(row: dict) -> bytes:
    """A web page as an attachment of an empty page, with a link to its address."""
    notes = [
        {"Subtype": Name("FileAttachment"), "FS": {"UF": b"\xfe\xff" + f"site/{row['path']}.html".encode("utf-16-be"), "EF": {"UF": Ref(6, 0)}}},
        {"Subtype": Name("Link"), "Rect": [10, 20, 110, 40], "A": {"S": Name("URI"), "URI": (row["url"] or "").encode()}},
    ]
    return one_page(b"", {"Annots": notes}, {6: writer.flate({"Type": Name("EmbeddedFile")}, (row["html"] or "").encode())})


def drawing_file(row: dict) -> bytes:
    """A rectangle of a row's size and shade, drawn on a grid of half units."""
    content = f"q 0.5 0 0 0.5 100 100 cm {row['shade']} 0 0 rg 10 20 {row['w']} {row['h']} re f Q 0 0 m {row['w']} {row['h']} l S"
    return one_page(content.encode())


def titled_file(row: dict) -> bytes:
    return one_page(b"", info={"Title": b"\xfe\xff" + (row["title"] or "").encode("utf-16-be"), "Author": (row["author"] or "").encode("latin-1", "replace")})


def damaged_file(row: dict) -> bytes:
    """A row's text as a file that is, by its path's number modulo 5: whole, without cross references, without a header, locked, with an unknown filter."""
    kind = int(row["path"]) % 5
    whole = writer.text_file(row["text"] or "", encrypt="AESV2" if kind == 3 else None, user_password=b"secret")
    if kind == 1:
        return whole[: whole.rindex(b"\nxref")]
    return whole.replace(b"%PDF-", b"%TXT-", 1) if kind == 2 else whole.replace(b"/FlateDecode", b"/OtherDecode") if kind == 4 else whole

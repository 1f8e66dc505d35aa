"""PDF files to rows: objects and pages of each file, read in Arrow batches of one file per row.

A damaged file never fails a task: it gives the rows that could be read, and one row of the kind ``files`` tells its status.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import security
from .filters import FilterError, decode
from .syntax import END, Keyword, Name, Reader, Ref, Stream

_HEADER = re.compile(rb"%PDF-([12]\.\d)")
_STARTXREF = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})[ \t\r\n\f\0]+(\d{1,5})[ \t\r\n\f\0]+obj(?![A-Za-z])")
_SECTION = re.compile(rb"\s*(\d+)[ \t]+(\d+)[ \t]*[\r\n]+")
_ENTRY = re.compile(rb"\s*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
_INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
DEPTH = 64
#: Rows that are handed on at a time.
BATCH = 256


def _items(value) -> list:
    return value if isinstance(value, list) else []


class Document:
    """The objects of one file, by number; the newest definition wins. A file whose password is wrong is ``locked``: its strings and streams stay as they are."""

    def __init__(self, data: bytes, password: bytes = b"") -> None:
        head = _HEADER.search(data[:1024])
        if not head:
            raise ValueError("no PDF header")
        self.version, self.data = head[1].decode(), data[head.start() :]
        self.places: dict[int, tuple] = {}  # number: (offset,) or (container, index)
        self.trailer: dict = {}
        self.recovered = False
        self._objects: dict[int, object] = {}
        self._containers: dict[int, list] = {}
        self.security: security.Security | None = None
        self.locked = False
        if not self._chain():
            self._recover()
        if "Encrypt" in self.trailer:
            self._unlock(password)

    def _unlock(self, password: bytes) -> None:
        reference, ids = self.trailer["Encrypt"], self.deref(self.trailer.get("ID"))
        entries = self.resolved(reference)
        first = self.deref(ids[0]) if isinstance(ids, list) and ids else b""
        opened = security.unlock(entries, first if isinstance(first, bytes) else b"", password) if isinstance(entries, dict) else None
        self._clear = reference.number if isinstance(reference, Ref) else -1
        self.security, self.locked = opened, opened is None
        self._objects, self._containers = {}, {}  # what was read so far was read without the key

    # cross references

    def _chain(self) -> bool:
        found = _STARTXREF.findall(self.data[-1024:])
        at, seen = int(found[-1]) if found else -1, set()
        while 0 <= at < len(self.data) and at not in seen:
            seen.add(at)
            trailer = self._table(at) if re.match(rb"\s*xref\b", self.data[at : at + 32]) else self._xref_stream(at)
            if trailer is None:
                return False
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            at = trailer.get("Prev", None)
            if not isinstance(at, int):
                return isinstance(self.deref(self.trailer.get("Root")), dict)
        return False

    def _table(self, at: int) -> dict | None:
        at = self.data.index(b"xref", at) + 4
        while m := _SECTION.match(self.data, at):
            first, count, at = int(m[1]), int(m[2]), m.end()
            for i in range(count):
                if not (entry := _ENTRY.match(self.data, at)):
                    break
                at = entry.end()
                if entry[3] == b"n":
                    self.places.setdefault(first + i, (int(entry[1]),))
                else:
                    self.places.setdefault(first + i, ())
        reader = Reader(self.data, at)
        trailer = reader.value() if reader.value() == Keyword("trailer") else None
        return trailer if isinstance(trailer, dict) else None

    def _xref_stream(self, at: int) -> dict | None:
        m = _OBJECT.match(self.data, at + len(re.match(rb"\s*", self.data[at : at + 32]).group()))
        value = self._parse(m.end()) if m else None
        if not isinstance(value, Stream):
            return None
        widths = value.entries.get("W", [])
        try:
            rows, n = self.decoded(value), sum(widths)
        except (FilterError, TypeError):
            return None
        index = value.entries.get("Index") or [0, len(rows) // max(n, 1)]
        numbers = (first + i for first, count in zip(index[::2], index[1::2]) for i in range(count))
        for number, k in zip(numbers, range(0, len(rows) - n + 1, max(n, 1))):
            fields, start = [], k
            for w in widths:
                fields.append(int.from_bytes(rows[start : start + w], "big"))
                start += w
            kind = fields[0] if widths[0] else 1
            self.places.setdefault(number, (fields[1],) if kind == 1 else (fields[1], fields[2]) if kind == 2 else ())
        return value.entries

    def _recover(self) -> None:
        """Places by a scan for object headers (the last of a number wins), the trailer by the last one with a root."""
        self.places, self._objects, self.recovered = {}, {}, True
        for m in _OBJECT.finditer(self.data):
            self.places[int(m[1])] = (m.start(),)
        for m in re.finditer(rb"trailer", self.data):
            found = Reader(self.data, m.end()).value()
            if isinstance(found, dict) and "Root" in found:
                self.trailer = found
        for number in list(self.places):
            value = self.object(number)
            if isinstance(value, Stream) and value.entries.get("Type") == "XRef" and "Root" in value.entries and "Root" not in self.trailer:
                self.trailer = value.entries
            if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
                for i, (inner, _) in enumerate(self._container(number)):
                    self.places.setdefault(inner, (number, i))
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(number, 0))

    # objects

    def _parse(self, at: int):
        reader = Reader(self.data, at)
        value = reader.value()
        m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, reader.at)
        if not (isinstance(value, dict) and m):
            return None if isinstance(value, Keyword) or value is END else value
        length = self.deref(value.get("Length"))
        stop = m.end() + length if isinstance(length, int) and length >= 0 else -1
        if stop < 0 or not re.match(rb"\s*endstream", self.data[stop : stop + 16]):
            stop = self.data.find(b"endstream", m.end())
            stop = len(self.data) if stop < 0 else stop - (2 if self.data[stop - 2 : stop] == b"\r\n" else 1 if self.data[stop - 1 : stop] in (b"\n", b"\r") else 0)
        return Stream(value, self.data[m.end() : stop])

    def _container(self, number: int) -> list[tuple[int, object]]:
        if number not in self._containers:
            self._containers[number] = []
            stream = self.object(number)
            if isinstance(stream, Stream):
                body, first = self.decoded(stream), stream.entries.get("First", 0)
                head = [int(x) for x in body[:first].split() if x.isdigit()]
                self._containers[number] = [(n, Reader(body, first + at).value()) for n, at in zip(head[::2], head[1::2])]
        return self._containers[number]

    def object(self, number: int):
        if number not in self._objects:
            self._objects[number] = None  # a reference to itself reads as null
            place = self.places.get(number, ())
            if len(place) == 1 and (m := _OBJECT.match(self.data, place[0])) and int(m[1]) == number:
                value = self._parse(m.end())
                if self.security and number != self._clear:
                    value = self.security.decrypt(value, number, int(m[2]))
                self._objects[number] = value
            elif len(place) == 2 and place[0] != number:
                self._objects[number] = dict(self._container(place[0])).get(number)
        return self._objects[number]

    def deref(self, value):
        for _ in range(DEPTH):
            if not isinstance(value, Ref):
                return value
            value = self.object(value.number)
        return None

    def resolved(self, value, depth: int = 0):
        """A value with the references inside of it resolved too, down to a few levels."""
        value = self.deref(value)
        if depth < 6 and isinstance(value, dict):
            return {k: self.resolved(v, depth + 1) for k, v in value.items()}
        return [self.resolved(v, depth + 1) for v in value] if depth < 6 and isinstance(value, list) else value

    def get(self, entries, *path):
        """The value at a path of names, references resolved; None if a step is missing."""
        value = self.deref(entries)
        for key in path:
            value = value.entries if isinstance(value, Stream) else value
            value = self.deref(value.get(key)) if isinstance(value, dict) else None
        return value

    def decoded(self, stream: Stream) -> bytes:
        names, parameters = (self.deref(stream.entries.get(k)) for k in ("Filter", "DecodeParms"))
        names = [names] if isinstance(names, Name) else [self.deref(x) for x in _items(names)]
        parameters = [self.deref(x) for x in parameters] if isinstance(parameters, list) else [parameters]
        try:
            return decode(stream.data, names, [x if isinstance(x, dict) else None for x in parameters])
        except FilterError:
            raise
        except Exception as e:  # parameters of the wrong kind, say
            raise FilterError(f"damaged stream: {type(e).__name__}") from e

    def items(self, value) -> list:
        """The elements of an array; none if it is something else."""
        return _items(self.deref(value))

    # pages

    def pages(self) -> Iterator[tuple[int, dict]]:
        """(object number, entries with inherited attributes) depth first; nodes met twice and other types are passed over."""
        seen: set[int] = set()

        def walk(node, inherited: dict, depth: int) -> Iterator[tuple[int, dict]]:
            if isinstance(node, Ref):
                if node.number in seen or depth > DEPTH:
                    return
                seen.add(node.number)
            entries = self.deref(node)
            if isinstance(entries, dict):
                own = inherited | {k: entries[k] for k in _INHERITED if k in entries}
                if entries.get("Type") == "Pages":
                    for kid in self.items(entries.get("Kids")):
                        yield from walk(kid, own, depth + 1)
                elif entries.get("Type") == "Page":
                    yield node.number if isinstance(node, Ref) else -1, entries | own

        root = self.get(self.trailer, "Root")
        yield from walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0)

    def contents(self, page: dict) -> bytes:
        value = self.deref(page.get("Contents"))
        streams = [self.deref(x) for x in value] if isinstance(value, list) else [value]
        return b"".join(self.decoded(s) for s in streams if isinstance(s, Stream))

    def info(self) -> dict[str, str | None]:
        found = self.get(self.trailer, "Info")
        found = found if isinstance(found, dict) else {}
        return {k: text(v) if isinstance(v := self.deref(found.get(k)), bytes) else None for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")}


def text(raw: bytes) -> str:
    """A text string by its byte order mark, else as Latin text."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def as_json(value) -> str:
    """An object's value as JSON: references as {"$ref": [number, generation]}, bytes as Latin text, streams by their entries."""

    def plain(v):
        if isinstance(v, Ref):
            return {"$ref": [v.number, v.generation]}
        if isinstance(v, Stream):
            return plain(v.entries)
        if isinstance(v, bytes):
            return v.decode("latin-1")
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else None if isinstance(v, Keyword) else v

    return json.dumps(plain(value))


def _object_rows(doc: Document) -> Iterator[tuple]:
    for number, place in sorted(doc.places.items()):
        if place:
            value = doc.object(number)
            yield number, len(place) == 2, as_json(value), value.data if isinstance(value, Stream) else None


def _page_rows(doc: Document) -> Iterator[tuple]:
    for i, (number, page) in enumerate(doc.pages()):
        box = [doc.deref(x) for x in doc.items(page.get("MediaBox"))]
        box = [float(x) for x in box] if len(box) == 4 and all(isinstance(x, int | float) for x in box) else [0.0, 0.0, 595.0, 842.0]
        turn = doc.deref(page.get("Rotate"))
        try:
            content, status = (b"", "password required") if doc.locked else (doc.contents(page), None)
        except FilterError as e:
            content, status = b"", str(e)
        yield i + 1, number, box, int(turn) % 360 if isinstance(turn, int | float) else 0, content, status


def _document_rows(doc: Document) -> Iterator[tuple]:
    info = doc.info()
    mask = doc.get(doc.trailer, "Encrypt", "P")
    mask = int(mask) if isinstance(mask, int) and -(1 << 31) <= mask < 1 << 31 else None
    yield doc.version, "Encrypt" in doc.trailer, doc.locked, mask, bool(doc.security and doc.security.is_owner), doc.recovered, sum(1 for _ in doc.pages()), info["Title"], info["Author"], info["CreationDate"]


def _file_rows(doc: Document) -> Iterator[tuple]:
    """One row: ok, recovered (the cross references were rebuilt), damaged (a page's content can't be read), empty or password required."""
    n, broken = 0, None
    if doc.locked:
        yield "password required", None, None, doc.recovered
        return
    for _, page in doc.pages():
        n += 1
        try:
            doc.contents(page)
        except FilterError as e:
            broken = broken or f"page {n}: {e}"
    yield "damaged" if broken else "empty" if not n else "recovered" if doc.recovered else "ok", n, broken, doc.recovered


def _failed(error: Exception) -> tuple:
    return "unreadable", None, str(error) or type(error).__name__, None


_KINDS = {
    "files": (_file_rows, "status string, n_pages int, error string, is_recovered boolean"),
    "objects": (_object_rows, "num int, is_compressed boolean, value string, stream binary"),
    "pages": (_page_rows, "page_no int, num int, media_box array<double>, rotate int, content binary, status string"),
    "documents": (_document_rows, "pdf_version string, is_encrypted boolean, is_locked boolean, permissions int, is_owner boolean, is_recovered boolean, n_pages int, title string, author string, created string"),
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def read(files: DataFrame, kind: str, password: str = "") -> DataFrame:
    """Rows of a kind of files(path, content), opened with a password; a file that is no PDF gives no rows but in the kind ``files``, which has one for each."""
    rows, ddl = _KINDS[kind]
    return scan(files, rows, ddl, password, _failed if kind == "files" else None)


def file_rows(content: bytes, rows, password: str = "", failed=None) -> Iterator[tuple]:
    """The rows of one file, up to where it can't be read further; failed(error), if it is given, makes a last row then."""
    try:
        yield from rows(Document(content, password.encode("utf-8")))
    except Exception as e:  # whatever a damaged file leads to concerns this file alone
        if failed:
            yield failed(e)


def scan(files: DataFrame, rows, ddl: str, password: str = "", failed=None) -> DataFrame:
    """One row for each tuple that rows(document) yields, after the file's path; handed on in batches of bounded length."""
    ship(files.sparkSession)
    fields = [x.split(" ") for x in ddl.split(", ")]
    names, types = ["path", *(n for n, _ in fields)], [pa.string(), *(_ARROW[t] for _, t in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = file_rows(content.as_py() or b"", rows, password, failed)
                while part := [(path, *r) for r in islice(found, BATCH)]:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], names)

    return files.select("path", "content").mapInArrow(run, f"path string, {ddl}")


def load(spark: SparkSession, path: str, kind: str, password: str = "") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return read(files, kind, password)


def references(objects: DataFrame) -> DataFrame:
    """References between objects: (path, num, target, is_dangling)."""
    target = F.explode(F.transform(F.regexp_extract_all("value", F.lit(r'"\$ref": \[(\d+)'), F.lit(1)), lambda x: x.cast("int")))
    edges = objects.select("path", "num", target.alias("target")).distinct()
    known = objects.select("path", F.col("num").alias("target"), F.lit(True).alias("known"))
    return edges.join(known, ["path", "target"], "left").select("path", "num", "target", F.col("known").isNull().alias("is_dangling"))

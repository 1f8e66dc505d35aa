"""Content operations of pages, and the text that a fold over them shows.

One page is one unit of work: its operations are a sequence whose state (matrices, a stack of graphics
states) cannot be cut, so the fold runs in the scan that decodes the page; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from ..sources.syntax import Name, operations

Matrix = tuple[float, float, float, float, float, float]
_IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: Matrix, n: Matrix) -> Matrix:
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


class TextFold:
    """State of the text operators; operands that are missing or of another type make an operator do nothing."""

    def __init__(self) -> None:
        self.state = {"ctm": _IDENTITY, "font": None, "size": 0.0, "leading": 0.0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0, "mode": 0}
        self.stack: list[dict] = []
        self.line = self.text = _IDENTITY
        self.shown: list[tuple] = []

    def run(self, content: bytes) -> list[tuple]:
        for op, operands in operations(content):
            handler = _HANDLERS.get(op)
            numbers = [float(x) for x in operands if isinstance(x, (int, float)) and not isinstance(x, bool)]
            if handler:
                try:
                    handler(self, operands, numbers)
                except (IndexError, TypeError, ValueError):
                    continue
        return self.shown

    def move(self, x: float, y: float) -> None:
        self.line = self.text = product((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def show(self, raw: bytes) -> None:
        if not isinstance(raw, bytes):
            raise TypeError("a string is shown")
        at = product(self.text, self.state["ctm"])
        self.shown.append((raw.decode("cp1252", "replace"), at[4], at[5] + self.state["rise"], self.state["size"], self.state["font"], self.state["mode"] != 3))

    def push(self) -> None:
        self.stack.append(dict(self.state))

    def pop(self) -> None:
        if self.stack:
            self.state = self.stack.pop()

    def matrix(self, n: list[float]) -> None:
        self.line = self.text = tuple(n[:6]) if len(n) >= 6 else _raise()

    def concat(self, n: list[float]) -> None:
        self.state["ctm"] = product(tuple(n[:6]) if len(n) >= 6 else _raise(), self.state["ctm"])

    def begin(self) -> None:
        self.line = self.text = _IDENTITY

    def font(self, operands: list) -> None:
        name, size = operands[0], operands[1]
        if isinstance(name, Name):
            self.state.update(font=str(name), size=float(size))

    def array(self, items: list) -> None:
        for x in items:
            if isinstance(x, bytes):
                self.show(x)
            else:
                self.text = product((1.0, 0.0, 0.0, 1.0, -float(x) / 1000 * self.state["size"] * self.state["scale"], 0.0), self.text)

    def leading_move(self, n: list[float]) -> None:
        self.state["leading"] = -n[1]
        self.move(n[0], n[1])

    def next_line(self) -> None:
        self.move(0.0, -self.state["leading"])


def _raise():
    raise IndexError("missing operands")


def _set(key: str, factor: float = 1.0):
    return lambda fold, operands, n: fold.state.__setitem__(key, n[0] * factor)


_HANDLERS = {
    "q": lambda fold, operands, n: fold.push(),
    "Q": lambda fold, operands, n: fold.pop(),
    "cm": lambda fold, operands, n: fold.concat(n),
    "BT": lambda fold, operands, n: fold.begin(),
    "Tm": lambda fold, operands, n: fold.matrix(n),
    "Td": lambda fold, operands, n: fold.move(n[0], n[1]),
    "TD": lambda fold, operands, n: fold.leading_move(n),
    "T*": lambda fold, operands, n: fold.next_line(),
    "Tf": lambda fold, operands, n: fold.font(operands),
    "TL": _set("leading"),
    "Tc": _set("char"),
    "Tw": _set("word"),
    "Tz": _set("scale", 0.01),
    "Ts": _set("rise"),
    "Tr": _set("mode"),
    "Tj": lambda fold, operands, n: fold.show(operands[0]),
    "TJ": lambda fold, operands, n: fold.array(operands[0]),
    "'": lambda fold, operands, n: (fold.next_line(), fold.show(operands[0])),
    '"': lambda fold, operands, n: (fold.state.update(word=n[0], char=n[1]), fold.next_line(), fold.show(operands[2])),
}


def _scan(rows, names: list[str], types: list[pa.DataType]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, page, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = [(path, page, seq, *r) for seq, r in enumerate(rows(content or b""))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)

    return scan


def content_operations(pages: DataFrame) -> DataFrame:
    """(path, page_no, seq, op, n_operands) of pages(path, page_no, content)."""
    ship(pages.sparkSession)
    names, types = ["path", "page_no", "seq", "op", "n_operands"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
    rows = lambda content: [(op, len(operands)) for op, operands in operations(content)]
    return pages.select("path", "page_no", "content").mapInArrow(_scan(rows, names, types), "path string, page_no int, seq int, op string, n_operands int")


def text_spans(pages: DataFrame) -> DataFrame:
    """(path, page_no, seq, text, x, y, size, font, visible) of pages(path, page_no, content), in the order shown."""
    ship(pages.sparkSession)
    names = ["path", "page_no", "seq", "text", "x", "y", "size", "font", "visible"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
    rows = lambda content: TextFold().run(content)
    return pages.select("path", "page_no", "content").mapInArrow(_scan(rows, names, types), "path string, page_no int, seq int, text string, x double, y double, size double, font string, visible boolean")

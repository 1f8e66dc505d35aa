"""Object syntax of PDF files: a tokenizer by one regular expression, and a value reader on top of it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(
    rb"(?P<skip>[\0\t\n\f\r ]+|%[^\r\n]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<name>/[^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<hex><[^>]*>?)|(?P<text>\()|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\0\t\n\f\r ()<>\[\]{}/%]|$))|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+|[{})>])"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_REFERENCE = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![A-Za-z0-9])")


class Name(str):
    """A name; equal to the string of its characters."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass(frozen=True)
class Keyword:
    word: str


@dataclass
class Stream:
    entries: dict
    data: bytes = field(repr=False, default=b"")


END = object()


class Reader:
    """Reads values from a buffer; ``at`` is the place after the last one."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True) -> None:
        self.data, self.at, self.references = data, at, references

    def value(self, depth: int = 0):
        """The next value, Keyword or closing mark; END after the last. Nesting ends at 100 levels."""
        while m := _TOKEN.match(self.data, self.at):
            self.at, kind = m.end(), m.lastgroup
            if kind == "skip":
                continue
            token = m.group()
            if kind == "number":
                return self._number(token)
            if kind == "name":
                return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), token[1:]).decode("latin-1"))
            if kind == "hex":
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", token)
                return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            if kind == "text":
                return self._text()
            if kind == "open":
                return self._items(token, depth + 1)
            if kind == "close":
                return Keyword(token.decode())
            word = token.decode("latin-1")
            return {"true": True, "false": False, "null": None}[word] if word in ("true", "false", "null") else Keyword(word)
        return END

    def _number(self, token: bytes):
        if b"." in token:
            return float(token)
        number = int(token)
        if self.references and number >= 0 and (m := _REFERENCE.match(self.data, self.at)):
            self.at = m.end()
            return Ref(number, int(m[1]))
        return number if -(1 << 31) <= number < 1 << 31 else float(number)

    def _text(self) -> bytes:
        out, level = bytearray(), 1
        for m in re.compile(rb"\\([0-7]{1,3})|\\(\r\n|.)|([()])|\r\n?|[^\\()\r]+", re.S).finditer(self.data, self.at):
            self.at = m.end()
            if m[1]:
                out.append(int(m[1], 8) & 255)
            elif m[2]:
                out += b"" if m[2] in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(m[2], m[2])
            elif m[3]:
                level += 1 if m[3] == b"(" else -1
                if not level:
                    return bytes(out)
                out += m[3]
            else:
                out += b"\n" if m.group()[:1] == b"\r" else m.group()
        return bytes(out)

    def _items(self, opening: bytes, depth: int):
        items: list = []
        while (item := self.value(depth) if depth < 100 else END) is not END and item not in (Keyword(">>"), Keyword("]")):
            if not isinstance(item, Keyword):
                items.append(item)
        if opening == b"[":
            return items
        # a key given twice keeps its first place and its last value
        return {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, Name)}


def operations(content: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) of a content stream; an inline image is one operation BI with its entries and bytes."""
    reader, operands = Reader(content, references=False), []
    while (item := reader.value()) is not END:
        if not isinstance(item, Keyword):
            operands.append(item)
            continue
        if item.word == "BI":
            entries: list = []
            while (x := reader.value()) is not END and x != Keyword("ID"):
                entries.append(x)
            end = re.compile(rb"[\0\t\n\f\r ]EI(?=[\0\t\n\f\r ]|$)").search(content, reader.at + 1)
            stop = end.start() if end else len(content)
            operands = [dict(zip(entries[::2], entries[1::2])), content[reader.at + 1 : stop]]
            reader.at = end.end() if end else len(content)
        yield item.word, operands
        operands = []

"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that every match must hold. A
block of documents gets an inverted index over those trigrams (case folded, from the bytes), the query's
postings are intersected and united, and only the candidates are verified with the expression. A rule
without mandatory trigrams, such as a run of hex digits, is verified on every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship
from . import _text


@dataclass(frozen=True)
class Rule:
    """kind, expression (ASCII classes only) and the least length of a group, 0 being the whole match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which they are listed, then the added ones.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("session", r"ASIA[A-Z0-9]+", 0, 18),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = 3
#: Alternatives of an exact string set beyond which it is no longer followed.
_MOST = 64


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any_of(strings: set[str]) -> tuple | None:
    """The query that one of the strings occurs: None (always) if one of them is shorter than a trigram."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    parts = {_grams(s) for s in strings}
    return ("or", *sorted((("and", *sorted(p)) for p in parts), key=repr))


def _both(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else ("and", a, b)


def _walk(items) -> tuple[set[str] | None, tuple | None]:
    """Of a parsed sequence: the exact set of its (case folded) strings, if small, and its trigram query otherwise."""
    exact: set[str] | None = {""}
    query: tuple | None = None
    for op, arg in items:
        own, sub = _item(op, arg)
        if own is not None and exact is not None and len(own) * len(exact) <= _MOST:
            exact = {a + b for a in exact for b in own}
        else:
            query = _both(_both(query, _any_of(exact) if exact is not None else None), sub)
            exact = own
            if own is None:
                exact = {""}
                query = _both(query, ("cut",))
        query = _both(query, sub) if own is not None else query
    if query is not None:
        return None, _both(query, _any_of(exact))
    return exact, None


def _item(op, arg) -> tuple[set[str] | None, tuple | None]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, what in arg:
            if kind is sre.LITERAL:
                chars.add(chr(what).lower())
            elif kind is sre.RANGE and what[1] - what[0] < 8:
                chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and len(union := set().union(*(e for e, _ in found))) <= _MOST:
            return union, None
        queries = [q if e is None else _any_of(e) for e, q in found]
        return None, None if any(q is None for q in queries) else ("or", *queries)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, what = arg
        own, sub = _walk(what)
        if (least, most) == (0, 1) and own is not None:
            return own | {""}, None
        if least == most == 1:
            return own, sub
        if least:
            return None, sub if own is None else _any_of(own)
    return None, None


def _tidy(query: tuple | None) -> tuple | str | None:
    """Nested and/or of trigrams, without the marks where an exact string was cut."""
    if query is None or query == ("cut",):
        return None
    if isinstance(query, str):
        return query
    parts = [_tidy(x) for x in query[1:]]
    if query[0] == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (query[0], *parts)


def trigram_query(pattern: str) -> tuple | str | None:
    """A Boolean query of case folded trigrams that every text with a match satisfies; None if there is none."""
    exact, query = _walk(sre_parser.parse(pattern))
    return _tidy(query if exact is None else _any_of(exact))


def _leaves(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(_leaves(x) for x in query[1:]))


def _rows(query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows (a mask) that satisfy the query, from the postings."""
    if isinstance(query, str):
        mask = np.zeros(n, bool)
        mask[index[query]] = True
        return mask
    found = [_rows(x, index, n) for x in query[1:]]
    return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*map(_leaves, self.queries)))
        self.slot = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.grams):
            a, b, c = g.encode()
            self.slot[a << 16 | b << 8 | c] = i + 1
        # matches and their lengths are the same over bytes and code points: all classes are ASCII
        self.compiled = [re.compile(self._longer(r).encode()) for r in rules]

    @staticmethod
    def _longer(rule: Rule) -> str:
        """A run of one class with a least length is searched for with that length: its matches are whole runs either way."""
        run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        return f"{run[1]}{{{rule.least},}}" if run and rule.least and not rule.group else rule.pattern

    def index(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Postings (sorted rows) of each query trigram in a block."""
        if len(data) < 3:
            return {g: np.zeros(0, np.int64) for g in self.grams}
        low = _text.ASCII_LOWER[data].astype(np.uint32)
        slots = self.slot[low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]]
        at = np.flatnonzero(slots)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        keys = np.unique(slots[at[inside]].astype(np.int64) << 32 | row[inside])
        cuts = np.searchsorted(keys, np.arange(1, len(self.grams) + 2, dtype=np.int64) << 32)
        return {g: keys[cuts[i] : cuts[i + 1]] & 0xFFFFFFFF for i, g in enumerate(self.grams)}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row its spans (start, rule, end) in code points, sorted."""
        n = len(offsets) - 1
        index = self.index(data, offsets)
        raw, out = data.tobytes(), [[] for _ in range(n)]
        for k, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self.compiled)):
            for r in range(n) if query is None else np.flatnonzero(_rows(query, index, n)):
                for m in compiled.finditer(raw, offsets[r], offsets[r + 1]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[r].append((m.start() - int(offsets[r]), k, m.end() - int(offsets[r])))
        for r in np.flatnonzero([bool(x) for x in out]):
            text = raw[offsets[r] : offsets[r + 1]]
            found = sorted(out[r])
            if not text.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
            out[r] = found
        return out


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], chunk: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        data, offsets = _text.utf8(batch.column(1))
        found: list[list[dict]] = []
        for lo, hi in _text.blocks(offsets, chunk):
            rows = scanner.scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            found += [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in row] for row in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for each row of docs(doc_id, text): spans array<struct<kind, start, end>> in code points, end exclusive.

    Sorted by start, then by the rules' order. Matches are leftmost and do not overlap within a kind; those
    whose group is shorter than the rule's least length are dropped after matching. Null and empty texts
    have none. Repeated rows are scanned each; other columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, rules=rules), schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the joined spans, as the digest column has it (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()

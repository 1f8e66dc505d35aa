"""Queries over glyph programs: each operator in a small program whose operands come from a row, against its outline in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charstrings
from ..shipping import ship
from .catalogue import Read, _query

#: name: (kind of program, what stands in it, the outline). a and b are a row's operands; in outlines {..} is SQL over a and b.
CASES: dict[str, tuple[int, list, str]] = {
    "rmoveto": (2, ["a", "b", "rmoveto", 1, 1, "rlineto"], "M{a} {b} L{a+1} {b+1} Z"),
    "hmoveto": (2, ["a", "hmoveto", 1, "hlineto"], "M{a} 0 L{a+1} 0 Z"),
    "vmoveto": (2, ["b", "vmoveto", 1, "hlineto"], "M0 {b} L1 {b} Z"),
    "rlineto": (2, [1, 2, "rmoveto", "a", "b", 3, 4, "rlineto"], "M1 2 L{a+1} {b+2} L{a+4} {b+6} Z"),
    "hlineto": (2, [0, "hmoveto", "a", "b", 2, "hlineto"], "M0 0 L{a} 0 L{a} {b} L{a+2} {b} Z"),
    "vlineto": (2, [0, "hmoveto", "a", "b", "vlineto"], "M0 0 L0 {a} L{b} {a} Z"),
    "rrcurveto": (2, [0, "hmoveto", "a", 1, 2, "b", 3, 4, "rrcurveto"], "M0 0 C{a} 1 {a+2} {b+1} {a+5} {b+5} Z"),
    "hhcurveto": (2, [0, "hmoveto", 9, "a", 2, "b", 4, "hhcurveto"], "M0 0 C{a} 9 {a+2} {b+9} {a+6} {b+9} Z"),
    "vvcurveto": (2, [0, "hmoveto", 9, "a", 2, "b", 4, "vvcurveto"], "M0 0 C9 {a} 11 {a+b} 11 {a+b+4} Z"),
    "hvcurveto": (2, [0, "hmoveto", "a", 2, "b", 4, 5, "hvcurveto"], "M0 0 C{a} 0 {a+2} {b} {a+7} {b+4} Z"),
    "vhcurveto": (2, [0, "hmoveto", "a", 2, "b", 4, 5, "vhcurveto"], "M0 0 C0 {a} 2 {a+b} 6 {a+b+5} Z"),
    "rcurveline": (2, [0, "hmoveto", "a", 1, 1, "b", 1, 1, 2, 3, "rcurveline"], "M0 0 C{a} 1 {a+1} {b+1} {a+2} {b+2} L{a+4} {b+5} Z"),
    "rlinecurve": (2, [0, "hmoveto", "a", "b", 1, 2, 3, 4, 5, 6, "rlinecurve"], "M0 0 L{a} {b} C{a+1} {b+2} {a+4} {b+6} {a+9} {b+12} Z"),
    "flex": (2, [0, "hmoveto", "a", 1, 1, "b", 1, 1, 1, 1, 1, 1, 1, 1, 50, "flex"], "M0 0 C{a} 1 {a+1} {b+1} {a+2} {b+2} C{a+3} {b+3} {a+4} {b+4} {a+5} {b+5} Z"),
    "hflex": (2, [0, "hmoveto", "a", 2, "b", 4, 5, 6, 7, "hflex"], "M0 0 C{a} 0 {a+2} {b} {a+6} {b} C{a+11} {b} {a+17} 0 {a+24} 0 Z"),
    "hflex1": (2, [0, "hmoveto", "a", 1, 1, "b", 1, 1, 1, 2, 1, "hflex1"], "M0 0 C{a} 1 {a+1} {b+1} {a+2} {b+1} C{a+3} {b+1} {a+4} {b+3} {a+5} 0 Z"),
    "flex1": (2, [0, "hmoveto", "a", 0, "a", 0, "a", 0, "a", 0, "a", 1, "b", "flex1"], "M0 0 C{a} 0 {2*a} 0 {3*a} 0 C{4*a} 0 {5*a} 1 {5*a+b} 0 Z"),
    "endchar": (2, ["a", "hmoveto", "b", "hlineto", "endchar", 5, 5, "rlineto"], "M{a} 0 L{a+b} 0 Z"),
    "hstem": (2, ["a", "b", "hstem", 1, "hmoveto"], "h {a} {b} | M1 0 Z"),
    "vstem": (2, ["a", "b", 3, 4, "vstem", 1, "hmoveto"], "v {a} {b} | v {a+b+3} 4 | M1 0 Z"),
    "hstemhm": (2, ["a", "b", "hstemhm", 1, "hmoveto"], "h {a} {b} | M1 0 Z"),
    "vstemhm": (2, ["a", "b", "vstemhm", 1, "hmoveto"], "v {a} {b} | M1 0 Z"),
    "hintmask": (2, ["a", "b", "hstemhm", 1, 2, "hintmask", b"\x80", 5, "hmoveto"], "h {a} {b} | v 1 2 | M5 0 Z"),
    "cntrmask": (2, ["a", "b", "hstemhm", "cntrmask", b"\xc0", 5, "hmoveto"], "h {a} {b} | M5 0 Z"),
    "abs": (2, [0, "a", "sub", "abs", "hmoveto"], "M{a} 0 Z"),
    "add": (2, ["a", "b", "add", "hmoveto"], "M{a+b} 0 Z"),
    "sub": (2, ["a", "b", "sub", "hmoveto"], "M{a-b} 0 Z"),
    "div": (2, ["a", 4, "div", 4, "mul", "hmoveto"], "M{a} 0 Z"),
    "neg": (2, ["a", "neg", "hmoveto"], "M{-a} 0 Z"),
    "random": (2, ["a", 0, "random", 1, "ifelse", "hmoveto"], "M{a} 0 Z"),
    "mul": (2, ["a", "b", "mul", "hmoveto"], "M{a*b} 0 Z"),
    "sqrt": (2, ["a", "a", "mul", "sqrt", "hmoveto"], "M{a} 0 Z"),
    "drop": (2, ["a", "b", 1, "drop", "hmoveto"], "M{a} 0 Z"),
    "exch": (2, ["a", "b", "exch", "rmoveto"], "M{b} {a} Z"),
    "index": (2, ["a", "b", 1, "index", "exch", 1, "drop", "rmoveto"], "M{a} {a} Z"),
    "roll": (2, ["a", "b", 7, 3, 1, "roll", 1, "drop", "rmoveto"], "M7 {a} Z"),
    "dup": (2, ["a", "dup", "rmoveto"], "M{a} {a} Z"),
    "put": (2, ["a", 5, "put", "b", 5, "get", "rmoveto"], "M{b} {a} Z"),
    "get": (2, ["a", 0, "put", 0, "get", "hmoveto"], "M{a} 0 Z"),
    "and": (2, ["a", "b", "and", 0, "b", "and", "rmoveto"], "M1 0 Z"),
    "or": (2, [0, "b", "or", 0, 0, "or", "rmoveto"], "M1 0 Z"),
    "not": (2, ["a", "not", 0, "not", "rmoveto"], "M0 1 Z"),
    "eq": (2, ["a", "a", "eq", "a", "b", "eq", "rmoveto"], "M1 {CASE WHEN a = b THEN 1 ELSE 0 END} Z"),
    "ifelse": (2, ["a", "b", "a", "b", "ifelse", "hmoveto"], "M{CASE WHEN a <= b THEN a ELSE b END} 0 Z"),
    "callsubr": (2, ["a", -107, "callsubr"], "M{a} 0 Z"),
    "callgsubr": (2, ["a", "b", -107, "callgsubr"], "M{a} {b} Z"),
    "return": (2, ["a", -107, "callsubr", "b", "hlineto"], "M{a} 0 L{a+b} 0 Z"),
    "dotsection": (1, [0, 500, "hsbw", "a", "hmoveto", "dotsection", "b", "hlineto"], "M{a} 0 L{a+b} 0 Z"),
    "vstem3": (1, [0, 500, "hsbw", "a", 1, "b", 2, 9, 3, "vstem3", 1, "hmoveto"], "v {a} 1 | v {b} 2 | v 9 3 | M1 0 Z"),
    "hstem3": (1, [0, 500, "hsbw", "a", 1, "b", 2, 9, 3, "hstem3", 1, "hmoveto"], "h {a} 1 | h {b} 2 | h 9 3 | M1 0 Z"),
    "pop": (1, [0, 500, "hsbw", "a", 1, 9, "callothersubr", "pop", "hmoveto"], "M{a} 0 Z"),
    "hsbw": (1, ["a", "b", "hsbw", 0, "hmoveto"], "M{a} 0 Z"),
    "sbw": (1, ["a", "b", 5, 0, "sbw", 0, "hmoveto"], "M{a} {b} Z"),
    "seac": (1, [0, 500, "hsbw", 0, "a", "b", 65, 66, "seac"], "accent {a} {b} 65 66"),
    "callothersubr": (1, [0, 500, "hsbw", "a", "b", 2, 9, "callothersubr", "pop", "pop", "rmoveto"], "M{a} {b} Z"),
    "closepath": (1, [0, 500, "hsbw", "a", "hmoveto", "b", "hlineto", "closepath", 1, "hmoveto"], "M{a} 0 L{a+b} 0 Z M{a+b+1} 0 Z"),
    "setcurrentpoint": (1, [0, 500, "hsbw", 0, "hmoveto", "a", "b", "setcurrentpoint"], "M0 0 L{a} {b} Z"),
}
#: Subroutines: one that moves and returns, and one that moves.
_LOCAL, _SHARED = ["hmoveto", "return", 9, 9, "rlineto"], ["rmoveto"]


def _program(kind: int, values: list, a: int, b: int) -> bytes:
    out = b""
    for v in values:
        out += v if isinstance(v, bytes) else charstrings.encode([{"a": a, "b": b}.get(v, v)], kind)
    return out


def _shown(kind: int, values: list, a: int, b: int) -> str:
    """Hints, then the accent or the outline."""
    subrs = ([charstrings.encode(_LOCAL)], [charstrings.encode(_SHARED)])
    glyph = charstrings.Machine(kind, *subrs).run(_program(kind, values, a, b))
    hints = [f"{axis} {at:g} {size:g} | " for axis, at, size in glyph.hints]
    return "".join(hints) + ("accent {:g} {:g} {} {}".format(*glyph.seac) if glyph.seac else glyph.path())


def outlines(rows: DataFrame) -> DataFrame:
    """rows(key, a, b) with (op, shown) for each glyph operator."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, op, _shown(kind, values, a, b)) for k, a, b in zip(*(c.to_pylist() for c in batch.columns)) for op, (kind, values, _) in CASES.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.string())], ["key", "op", "shown"])

    return rows.mapInArrow(run, "key long, op string, shown string")


def template_sql(outline: str) -> str:
    """SQL for a text in which {..} is SQL."""
    parts = [f"({part})" if i % 2 else f"'{part}'" for i, part in enumerate(outline.replace("}", "{").split("{"))]
    return "concat(" + ", ".join(p for p in parts if p != "''") + ")"


def _sql() -> str:
    each = " UNION ALL ".join(f"SELECT key, '{op}' AS op, {template_sql(outline)} AS shown FROM k" for op, (_, _, outline) in CASES.items())
    return f"WITH k AS (SELECT CAST(p_partkey AS BIGINT) AS key, CAST(p_size AS BIGINT) AS a, CAST(p_partkey % 97 + 1 AS BIGINT) AS b FROM part) {each}"


@_query(_sql())
def q_glyph_operators(read: Read) -> DataFrame:
    """All 57 glyph operators, each in a program of its own for each row."""
    rows = read("part").select(F.col("p_partkey").cast("long").alias("key"), F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 97 + 1).cast("long").alias("b"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return outlines(rows.repartition(cores) if len(rows.inputFiles()) < cores else rows)

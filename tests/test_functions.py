import math

import pytest
from pyspark.sql import functions as F

from docframe.functions import calculator as calc
from docframe.functions import geometry, localfonts, scalar, strings
from docframe.operators import relational as rel
from docframe.plans import catalogue


def value(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


@pytest.mark.parametrize(
    "program, expected",
    [("100 ln", 4.605170185988092), ("3 4 add", 7.0), ("7 2 idiv", 3), ("-7 2 idiv", -3), ("-7 3 mod", -1), ("2.5 round", 2.0), ("1 0 atan", 90.0), ("-1 0 atan", 270.0),
     ("1 2 3 3 1 roll pop pop", 3), ("1 1.0 eq", False), ("1 1 eq", True), ("true { 1 } { 2 } ifelse", 1), ("5 3 bitshift", 40), ("-16 -2 bitshift", -4), ("1 0 div", math.inf), ("0 ln", -math.inf),
     ("3.7 cvi", 3), ("-3.7 truncate", -3.0), ("1 2 1 index exch pop exch pop", 1), ("12 10 and", 8), ("5 not", -6), ("9 sqrt", 3.0)],
)
def test_calculator(spark, program, expected):
    found = value(spark, calc.run(program, [])[-1].column)[0]
    assert found == expected or found == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("program", ["{ 1", "add", "1 unknown", "1 { 2 }", "1 2 copy"])
def test_calculator_errors(program):
    with pytest.raises(calc.ProgramError):
        calc.run(program, [])


def test_exponential_and_result_count(spark):
    assert value(spark, *calc.exponential(F.lit(0.5), (-1.0, 0.5), (0.0, 10.0))) == (-0.5, 5.25)
    with pytest.raises(calc.ProgramError):
        calc.calculator("dup", [F.lit(1.0)], (0, 1), (0, 1))


@pytest.mark.parametrize(
    "text, expected",
    [("D:2021", "2021-01-01 00:00:00"), ("D:20210203040506Z", "2021-02-03 04:05:06"), ("D:20210203040506+01'30'", "2021-02-03 02:35:06"), ("D:20210203040506-01'00", "2021-02-03 05:05:06"), ("2021", None), ("D:20211301", None), ("D:20210101000000Zx", None), (None, None)],
)
def test_dates(spark, text, expected):
    utc, _ = strings.parse_date(F.lit(text).cast("string"))
    assert value(spark, F.date_format(utc, "yyyy-MM-dd HH:mm:ss"))[0] == expected


@pytest.mark.parametrize("spec, total, pages", [("7.., 8, 2", 10, [2, 7, 8, 9, 10]), ("..0", 10, []), ("3", 2, []), ("1..2", 5, [1, 2]), ("x", 5, None), ("..2", 5, [1, 2])])
def test_page_ranges(spark, spec, total, pages):
    assert value(spark, strings.page_numbers(F.lit(spec), F.lit(total)))[0] == pages


def test_matrix_and_bounds(spark):
    m = geometry.matrix(0, 2, -1, 0, 5, 6)
    box = geometry.bounds(m, geometry.rectangle(*map(F.lit, (0.0, 0.0, 1.0, 3.0))))
    assert value(spark, *box.values()) == (2.0, 6.0, 5.0, 8.0)
    assert value(spark, *geometry.bezier_bounds([F.lit(x) for x in (0.0, -3.0, 2.0, 1.0)]))[0] < 0


def test_islands_of_equal_neighbours(spark):
    rows = [(1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, "A"), (6, "C"), (7, "C"), (8, "C")]
    df = spark.createDataFrame(rows, "id int, grp string").withColumn("all", F.lit(1))
    found = rel.islands(df, ("all",), ("id",), F.col("grp")).groupBy("island").agg(F.array_sort(F.collect_list("id")).alias("ids")).orderBy("island")
    assert [r.ids for r in found.collect()] == [[1, 2], [3], [4, 5], [6, 7, 8]]


def test_tree_with_cycle_ends(spark):
    nodes = spark.createDataFrame([("a", None, 0, "x"), ("b", "a", 0, None), ("c", "b", 0, "y"), ("p", "q", 0, None), ("q", "p", 0, None)], "id string, parent string, ordinal int, box string")
    assert [(r.id, r.box) for r in rel.flatten_tree(nodes, ("box",)).orderBy("path").collect()] == [("a", "x"), ("b", "x"), ("c", "y")]


def test_stable_id_is_seven_characters(spark):
    assert len(value(spark, strings.stable_id("cl", F.lit("abc")))[0]) == 7


def test_local_fonts_in_both_forms(spark):
    names = [*catalogue._FONT_NAMES, "", "a-b,c", "X-Thin Italic", "Ob-ItOb", "Foo,Bd", "Foo-BlIt", "ITALIC", "a" * 30 + "-it"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    n = F.col("n")
    found = [(r.f, r.w, r.s) for r in rows.select("i", localfonts.family(n).alias("f"), localfonts.weight(n).alias("w"), localfonts.style(n).alias("s")).orderBy("i").collect()]
    assert found == [localfonts.resolve(x) for x in names] and found[: len(catalogue._FONT_NAMES)] == list(catalogue._FONT_NAMES.values())


def test_deep_trees_and_limits(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0, "x" if i == 3 else None) for i in range(12)], "id int, parent int, ordinal int, box string")
    assert {r.id: r.box for r in rel.flatten_tree(nodes, ("box",)).collect()} == {i: "x" if i >= 3 else None for i in range(12)}
    assert rel.flatten_tree(nodes, ("box",), depth=5).count() == 5


def test_ranges_of_any_length(spark):
    rows = spark.createDataFrame([(1, 5, 5), (2, 0, 9999), (3, 7, 6), (4, None, 3), (5, -4, 120)], "k int, a long, b long")
    found = {r.k: (r.n, r.lo, r.hi) for r in rel.expand_ranges(rows, "a", "b", "c").groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).collect()}
    assert found == {1: (1, 5, 5), 2: (10000, 0, 9999), 5: (125, -4, 120)}
    short, long = rel.short_and_long(rows, "a", "b")
    assert [r.k for r in short.orderBy("k").collect()] == [1, 3] and [r.k for r in long.orderBy("k").collect()] == [2, 5]


def test_reachable_over_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "a int, b int")
    found = {(r.start, r.node): r.depth for r in rel.reachable(edges, spark.createDataFrame([(1,), (5,)], "start int")).collect()}
    assert found == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (5, 5): 0}


PROGRAMS = "add sub mul div idiv mod atan exp eq ne gt ge lt le".split(), "neg abs ceiling floor round truncate sqrt sin cos ln log cvi cvr".split(), "and or xor bitshift".split()


def test_both_forms_of_the_calculator_agree(spark):
    """Operand by operand: the column form on literals, the scalar form on the same numbers."""
    numbers = [0, 1, -1, 2, 7, -7, 0.5, 2.5, -2.5, 3.5, 1e-3, 90, 30.25]
    programs = [f"{a} {op}" for a in numbers for op in PROGRAMS[1]]
    programs += [f"{a} {b} {op}" for a in numbers for b in numbers for op in PROGRAMS[0] if not (op in ("idiv", "mod") and abs(b) < 1)]
    programs += [f"{a} {b} {op}" for a in (0, 1, -1, 5, 12) for b in (0, 3, -2, 31) for op in PROGRAMS[2]] + [f"{a} {b} {op}" for a in ("true", "false") for b in ("true", "false") for op in PROGRAMS[2][:3]]
    columns = [calc.run(p, [])[0].column.cast("double") for p in programs]
    found = []
    for i in range(0, len(columns), 400):
        found += list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns[i : i + 400]))).first())
    wrong = []
    for program, column in zip(programs, found):
        stack = []
        scalar._execute([x if not isinstance(x, str) else x for x in _words(program)], stack)
        own = float(stack[0])
        if not (own == column or math.isnan(own) and math.isnan(column) or math.isclose(own, column, rel_tol=1e-12, abs_tol=1e-15)):
            wrong.append((program, own, column))
    assert not wrong


def _words(program):
    out = []
    for w in program.split():
        out.append({"true": True, "false": False}[w] if w in ("true", "false") else w if w.isalpha() else float(w) if "." in w or "e" in w else int(w))
    return out

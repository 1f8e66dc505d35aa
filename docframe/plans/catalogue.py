"""The registered queries of the engine and their SQL counterparts (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calculator as calc
from ..functions import color, geometry, localfonts, strings
from ..operators import relational as rel

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

Read = Callable[[str], DataFrame]


def _query(sql: str | None = None):
    """Registers a query; it gets a function that reads a table by name."""

    def wrap(f: Callable[[Read], DataFrame]) -> Callable[[Read], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_KEY = ("l_orderkey", "l_linenumber")


def _micro(c: Column) -> Column:
    """A real as a whole number of millionths, so that results compare as integers."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def _m(sql: str) -> str:
    return f"CAST(floor(({sql}) * 1e6 + 0.5) AS BIGINT)"


def _line(extra: dict[str, str], table: str = "lineitem", keys=_KEY) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'{v} AS {k}' for k, v in extra.items())} FROM {table}"


# colour ------------------------------------------------------------------------------------------

_INK = {"c": "l_discount * 10", "m": "l_tax * 10", "y": "l_quantity / 50", "k": "0.25"}
_POLY = {ch: "1.0 + " + " + ".join(f"({f}) * " + " * ".join(f"({_INK[i]})" for i in p) for p, f in terms.items()) for ch, terms in color.CMYK.items()}


@_query(
    "SELECT red, green, blue, count(*) AS n FROM (SELECT "
    + ", ".join(f"CAST(least(greatest(floor(({e}) * 255 + 0.5), 0), 255) AS INTEGER) AS {ch}" for ch, e in _POLY.items())
    + " FROM lineitem) GROUP BY 1, 2, 3"
)
def q_cmyk_to_rgb(read: Read) -> DataFrame:
    rgb = color.cmyk_to_rgb(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.25))
    return read("lineitem").select(*(color.clamp(F.floor(v * 255 + 0.5), 0, 255).cast("int").alias(ch) for ch, v in rgb.items())).groupBy("red", "green", "blue").agg(F.count("*").alias("n"))


def _srgb(x: str) -> str:
    return f"(CASE WHEN ({x}) <= 0.0031308 THEN 12.92 * ({x}) ELSE 1.055 * pow(greatest(({x}), 0), 1 / 2.4) - 0.055 END)"


@_query(_line({"gray": _m(_srgb("pow(l_discount * 10, 2.2)"))}))
def q_cal_gray(read: Read) -> DataFrame:
    return read("lineitem").select(*_KEY, _micro(color.cal_gray(F.col("l_discount") * 10, 2.2)).alias("gray"))


_WHITE, _MATRIX = (0.9505, 1.0, 1.089), ((0.4497, 0.3163, 0.1845), (0.2446, 0.672, 0.0833), (0.0252, 0.1412, 0.9227))
_PARTS = ("l_discount * 10", "l_tax * 12.5", "l_quantity / 50")


def _rows(matrix, parts) -> list[str]:
    return [" + ".join(f"({float(f)!r}) * ({p})" for f, p in zip(row, parts)) for row in matrix]


_CAL = color.np.array(color.XYZ_TO_RGB) @ color.bradford(_WHITE) @ color.np.array(_MATRIX)


@_query(_line({ch: _m(_srgb(e)) for ch, e in zip(("red", "green", "blue"), _rows(_CAL, [f"pow({p}, 1.8)" for p in _PARTS]))}))
def q_cal_rgb_bradford(read: Read) -> DataFrame:
    rgb = color.cal_rgb([F.expr(p) for p in _PARTS], (1.8, 1.8, 1.8), _MATRIX, _WHITE)
    return read("lineitem").select(*_KEY, *(_micro(v).alias(k) for k, v in rgb.items()))


def _unfold(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 6 / 29.0 THEN ({x}) * ({x}) * ({x}) ELSE 108 / 841.0 * (({x}) - 4 / 29.0) END)"


_LAB = ["(p_size * 2.0 + 16) / 116", "least(greatest(p_size - 25.0, -100), 100)", "least(greatest(p_retailprice / 10 - 90, -100), 100)"]
_LAB_XYZ = [_unfold(f"{_LAB[0]} + ({_LAB[1]}) / 500"), _unfold(_LAB[0]), _unfold(f"{_LAB[0]} - ({_LAB[2]}) / 200")]


@_query("SELECT p_partkey, " + ", ".join(f"{_m(_srgb(e))} AS {ch}" for ch, e in zip(("red", "green", "blue"), _rows(color.lab_matrix(_WHITE), _LAB_XYZ))) + " FROM part")
def q_lab_to_rgb(read: Read) -> DataFrame:
    rgb = color.lab(F.col("p_size") * 2.0, F.col("p_size") - 25.0, F.col("p_retailprice") / 10 - 90, _WHITE)
    return read("part").select("p_partkey", *(_micro(v).alias(k) for k, v in rgb.items()))


_PALETTE = [16711680, 65280, 255, 16776960, 65535, 16711935]


@_query(f"SELECT p_partkey, CASE WHEN p_size % 8 < {len(_PALETTE)} THEN {_PALETTE}[p_size % 8 + 1] ELSE 0 END AS rgb FROM part")
def q_indexed_lookup(read: Read) -> DataFrame:
    return read("part").select("p_partkey", color.indexed((F.col("p_size") % 8).cast("double"), _PALETTE).alias("rgb"))


@_query("SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN 'DeviceGray' WHEN 4 THEN 'DeviceCMYK' ELSE 'DeviceRGB' END AS space FROM nation")
def q_icc_fallback(read: Read) -> DataFrame:
    return read("nation").select("n_nationkey", color.icc_space(F.col("n_regionkey")).alias("space"))


@_query(_line({"value": _m("-1.0 + l_linenumber * 3.0 / 15")}))
def q_decode_array(read: Read) -> DataFrame:
    return read("lineitem").select(*_KEY, _micro(color.decode(F.col("l_linenumber"), 4, -1, 2)).alias("value"))


_HEX = {"red": "p_size / 50.0", "green": "(p_partkey % 16) / 15.0", "blue": "(p_partkey % 256) / 255.0"}


@_query(
    "SELECT p_partkey, CASE WHEN r[1] = r[2] AND g[1] = g[2] AND b[1] = b[2] THEN '#' || r[1] || g[1] || b[1] ELSE '#' || r || g || b END AS hex FROM (SELECT p_partkey, "
    + ", ".join(f"printf('%02x', CAST(trunc(({e}) * 255) AS INTEGER)) AS {ch[0]}" for ch, e in _HEX.items())
    + " FROM part)"
)
def q_hex_color(read: Read) -> DataFrame:
    parts = (F.col("p_size") / 50.0, (F.col("p_partkey") % 16) / 15.0, (F.col("p_partkey") % 256) / 255.0)
    return read("part").select("p_partkey", color.to_hex(*parts).alias("hex"))


@_query("SELECT p_partkey, CAST(least(greatest(trunc(p_size / 50.0 * 255 + 0.5), 0), 255) AS INTEGER) AS rounded, CAST(trunc(p_size / 50.0 * 255) AS INTEGER) AS truncated FROM part")
def q_round_vs_trunc8(read: Read) -> DataFrame:
    v = F.col("p_size") / 50.0
    return read("part").select("p_partkey", color.to_8bit(v).alias("rounded"), (v * 255).cast("int").alias("truncated"))


_YCC = "l_quantity * 5"


@_query(_line({"red": _m(f"{_YCC} + 1.402 * (l_tax * 1000 - 128)"), "blue": _m(f"{_YCC} + 1.772 * (l_discount * 1000 - 128)")}))
def q_ycc_to_rgb(read: Read) -> DataFrame:
    rgb = color.ycc_to_rgb(F.col("l_quantity") * 5, F.col("l_discount") * 1000, F.col("l_tax") * 1000)
    return read("lineitem").select(*_KEY, *(_micro(rgb[k]).alias(k) for k in ("red", "blue")))


# functions ---------------------------------------------------------------------------------------


@_query(_line({"v0": _m("0.1 + pow(l_discount * 10, 1.5) * 0.8"), "v1": _m("1.0 + pow(l_discount * 10, 1.5) * -1.0")}))
def q_fn_exponential(read: Read) -> DataFrame:
    out = calc.exponential(F.col("l_discount") * 10, (0.1, 1.0), (0.9, 0.0), 1.5, (0, 1))
    return read("lineitem").select(*_KEY, *(_micro(v).alias(f"v{i}") for i, v in enumerate(out)))


_X = "least(greatest(o_totalprice / 499979, 0), 1)"


@_query(f"SELECT o_orderkey, {_m(f'CASE WHEN {_X} < 0.2 THEN {_X} / 0.2 WHEN {_X} < 0.6 THEN 1 - pow(({_X} - 0.2) / 0.4, 2) ELSE 0.5 * (1 - ({_X} - 0.6) / 0.4) END')} AS v FROM orders")
def q_fn_stitching(read: Read) -> DataFrame:
    parts = [lambda x: calc.exponential(x), lambda x: calc.exponential(x, (1.0,), (0.0,), 2), lambda x: calc.exponential(x, (0.0,), (0.5,))]
    v = calc.stitching(F.col("o_totalprice") / 499979, parts, (0.2, 0.6), (0, 1, 0, 1, 1, 0), (0, 1))[0]
    return read("orders").select("o_orderkey", _micro(v).alias("v"))


_S1 = [0.0, 0.3, 0.9, 0.4, 1.0]
_T = "(l_tax * 12.5 * 4)"
_I = f"least(CAST(floor({_T}) AS INTEGER), 3)"


@_query(_line({"v": _m(f"{_S1}[{_I} + 1] * (1 - ({_T} - {_I})) + {_S1}[{_I} + 2] * ({_T} - {_I})")}))
def q_fn_sampled_1d(read: Read) -> DataFrame:
    return read("lineitem").select(*_KEY, _micro(calc.sampled([F.col("l_tax") * 12.5], (5,), _S1, (0, 1))[0]).alias("v"))


_S2 = [0.0, 1.0, 0.5, 0.25, 0.75, 0.1]
_U, _V = "(l_discount * 10 * 2)", "(l_tax * 12.5)"
_UI = f"least(CAST(floor({_U}) AS INTEGER), 1)"
_CORNERS = " + ".join(f"{'(' + _U + ' - ' + _UI + ')' if a else '(1 - (' + _U + ' - ' + _UI + '))'} * {_V if b else '(1 - ' + _V + ')'} * {_S2}[{_UI} + {a + 3 * b} + 1]" for a in (0, 1) for b in (0, 1))


@_query(_line({"v": _m(_CORNERS)}))
def q_fn_sampled_2d(read: Read) -> DataFrame:
    v = calc.sampled([F.col("l_discount") * 10, F.col("l_tax") * 12.5], (3, 2), _S2, (0, 1, 0, 1))[0]
    return read("lineitem").select(*_KEY, _micro(v).alias("v"))


def _program(program: str, *inputs: tuple[str, str]) -> list[Column]:
    """Results of a program; the stack's booleans and integers keep their type."""
    return [v.column for v in calc.run(program, [calc.Value(F.expr(c), kind) for c, kind in inputs])]


def _int_col(c: str) -> str:
    return f"CAST({c} AS INT)"


@_query(_line({"v": _m("(abs(-(l_quantity + l_tax - l_discount)) * 2) / (l_linenumber + 1.0)"), "q": "CAST(trunc(trunc(l_quantity) / l_linenumber) AS INTEGER)", "r": "CAST(l_orderkey % 7 AS INTEGER)"}))
def q_ps_arith(read: Read) -> DataFrame:
    v = _program("{ 4 1 roll exch add exch sub neg abs 2 mul exch 1 add div }", ("l_discount", "real"), ("l_tax", "real"), ("l_quantity", "real"), ("CAST(l_linenumber AS DOUBLE)", "real"))
    q = _program("idiv", ("l_quantity", "real"), ("l_linenumber", "int"))
    r = _program("7 mod", (_int_col("l_orderkey"), "int"))
    return read("lineitem").select(*_KEY, _micro(v[0]).alias("v"), q[0].alias("q"), r[0].alias("r"))


@_query(_line({k: f"CAST({f} AS BIGINT)" for k, f in {"up": "ceil(l_extendedprice / 7)", "down": "floor(l_extendedprice / 7)", "near": "round_even(l_quantity / 2, 0)", "cut": "trunc(-l_extendedprice / 7)"}.items()}))
def q_ps_round(read: Read) -> DataFrame:
    price, half = ("l_extendedprice / 7", "real"), ("l_quantity / 2", "real")
    out = {"up": _program("ceiling", price), "down": _program("floor", price), "near": _program("round", half), "cut": _program("neg truncate", price)}
    return read("lineitem").select(*_KEY, *(v[0].cast("long").alias(k) for k, v in out.items()))


@_query(_line({"s": _m("sin(radians(l_quantity * 7))"), "c": _m("cos(radians(l_quantity * 7))"), "root": _m("sqrt(l_extendedprice)")}))
def q_ps_trig(read: Read) -> DataFrame:
    angle = ("l_quantity * 7", "real")
    return read("lineitem").select(*_KEY, _micro(_program("sin", angle)[0]).alias("s"), _micro(_program("cos", angle)[0]).alias("c"), _micro(_program("sqrt", ("l_extendedprice", "real"))[0]).alias("root"))


_ATAN = "degrees(atan((l_quantity - 25) / (l_linenumber - 4.0)))"


@_query(_line({"angle": f"CASE WHEN l_linenumber = 4 THEN (CASE WHEN l_quantity = 25 THEN NULL WHEN l_quantity > 25 THEN 90000000 ELSE 270000000 END) WHEN {_ATAN} < 0 THEN {_m(_ATAN + ' + 360')} ELSE {_m(_ATAN)} END"}))
def q_ps_atan(read: Read) -> DataFrame:
    v = _program("atan", ("l_quantity - 25", "real"), ("l_linenumber - 4.0D", "real"))[0]
    return read("lineitem").select(*_KEY, F.when(~F.isnan(v), _micro(v)).alias("angle"))


@_query(_line({"e": _m("ln(l_quantity)"), "ten": _m("log10(l_extendedprice)"), "p": _m("pow(l_tax * 10, l_linenumber)"), "zero": "CASE WHEN l_discount = 0 THEN TRUE ELSE FALSE END"}))
def q_ps_log(read: Read) -> DataFrame:
    zero = _program("ln", ("l_discount", "real"))[0] == F.lit(float("-inf"))
    return read("lineitem").select(*_KEY, _micro(_program("ln", ("l_quantity", "real"))[0]).alias("e"), _micro(_program("log", ("l_extendedprice", "real"))[0]).alias("ten"), _micro(_program("exp", ("l_tax * 10", "real"), ("l_linenumber", "int"))[0]).alias("p"), zero.alias("zero"))


@_query(_line({"a": "CAST(l_partkey & 12345 AS INTEGER)", "o": "CAST(l_partkey | 77 AS INTEGER)", "x": "CAST(xor(l_partkey, 255) AS INTEGER)", "n": "CAST(-l_partkey - 1 AS INTEGER)", "b": "(l_quantity > 25) <> (l_linenumber < 4)"}))
def q_ps_bitwise(read: Read) -> DataFrame:
    key = (_int_col("l_partkey"), "int")
    out = {"a": "12345 and", "o": "77 or", "x": "255 xor", "n": "not"}
    b = _program("4 lt exch 25 gt xor", ("l_quantity", "real"), ("l_linenumber", "int"))[0]
    return read("lineitem").select(*_KEY, *(_program(p, key)[0].alias(k) for k, p in out.items()), b.alias("b"))


@_query(_line({"up": "CAST(l_suppkey * 8 AS INTEGER)", "down": "CAST(l_partkey >> 2 AS INTEGER)"}))
def q_ps_shift(read: Read) -> DataFrame:
    up, down = _program("3 bitshift", (_int_col("l_suppkey"), "int"))[0], _program("-2 bitshift", (_int_col("l_partkey"), "int"))[0]
    return read("lineitem").select(*_KEY, up.alias("up"), down.alias("down"))


@_query(_line({"v": _m("CASE WHEN l_quantity >= 25 THEN l_quantity - 25 ELSE 2 * l_quantity END"), "w": _m("CASE WHEN l_linenumber = 3 THEN 1.5 + l_tax ELSE l_tax END"), "t": "NOT (l_linenumber <> 2 OR l_quantity <= 10)"}))
def q_ps_cond(read: Read) -> DataFrame:
    v = _program("dup 25 ge { 25 sub } { 2 mul } ifelse", ("l_quantity", "real"))[0]
    w = _program("3 eq { 1.5 add } if", ("l_tax", "real"), ("l_linenumber", "int"))[0]
    t = _program("2 ne exch 10 le or false or not true and", ("l_quantity", "real"), ("l_linenumber", "int"))[0]
    return read("lineitem").select(*_KEY, _micro(v).alias("v"), _micro(w).alias("w"), t.alias("t"))


@_query(_line({"v": _m("(l_tax * 2 - l_discount) + l_quantity * 3"), "i": "CAST(trunc(l_extendedprice / 10) AS INTEGER)"}))
def q_ps_stack(read: Read) -> DataFrame:
    # discount tax quantity -> copies, picks and turns
    v = _program("3 1 roll 2 copy pop pop dup 2 mul 2 index sub exch pop exch pop exch 3 mul add", ("l_discount", "real"), ("l_tax", "real"), ("l_quantity", "real"))
    i = _program("10 div cvi cvr cvi", ("l_extendedprice", "real"))
    return read("lineitem").select(*_KEY, _micro(v[-1]).alias("v"), i[0].alias("i"))


@_query(f"SELECT c_custkey, {_m('least(greatest(c_acctbal, -100), 5000)')} AS clipped, {_m('10 + (c_acctbal - -1000) * 90 / 11000')} AS mapped FROM customer")
def q_clip_interpolate(read: Read) -> DataFrame:
    bal = F.col("c_acctbal")
    return read("customer").select("c_custkey", _micro(calc.clip([bal], (-100, 5000))[0]).alias("clipped"), _micro(calc.interpolate(bal, -1000, 10000, 10, 100)).alias("mapped"))


@_query("SELECT p_partkey, CAST((p_size + 7) >> 3 AS INTEGER) AS size_bytes, CAST(floor(log2(p_partkey)) AS INTEGER) AS log2, CAST(floor((p_size - 25) / 4.0) AS INTEGER) AS quotient FROM (SELECT * REPLACE (p_partkey + 1 AS p_partkey) FROM part)")
def q_integer_helpers(read: Read) -> DataFrame:
    size = F.col("p_size")
    return read("part").withColumn("p_partkey", F.col("p_partkey") + 1).select("p_partkey", calc.bits_to_bytes(size).alias("size_bytes"), calc.int_log2(F.col("p_partkey")).alias("log2"), calc.floor_div(size - 25, F.lit(4)).alias("quotient"))


# geometry ----------------------------------------------------------------------------------------


@_query(f"SELECT p_partkey, {_m('2 * p_size + 0.5 * p_retailprice + 10')} AS x, {_m('-1 * p_size + 3 * p_retailprice + 20')} AS y, {_m('6.5 * 4')} AS det FROM part")
def q_matrix_affine(read: Read) -> DataFrame:
    m = geometry.multiply(geometry.matrix(2, -1, 0.5, 3, 0, 0), geometry.translate(F.lit(10.0), F.lit(20.0), geometry.matrix(*geometry.IDENTITY)))
    x, y = geometry.apply(m, F.col("p_size"), F.col("p_retailprice"))
    det = geometry.determinant(geometry.scale(F.lit(2.0), F.lit(2.0), m))
    return read("part").select("p_partkey", _micro(x).alias("x"), _micro(y).alias("y"), _micro(det).alias("det"))


@_query(f"SELECT p_partkey, {_m('p_size * 1.0')} AS x, {_m('p_retailprice')} AS y FROM part")
def q_matrix_inverse(read: Read) -> DataFrame:
    m = geometry.matrix(2, -1, 0.5, 3, 7, 9)
    x, y = geometry.apply(geometry.invert(m), *geometry.apply(m, F.col("p_size"), F.col("p_retailprice")))
    return read("part").select("p_partkey", _micro(x).alias("x"), _micro(y).alias("y"))


@_query(_line({"x1": _m("greatest(l_linenumber, 2.0)"), "y1": _m("greatest(l_quantity, 10.0)"), "x2": _m("greatest(greatest(l_linenumber, 2.0), least(l_linenumber + 3, 6.0))"), "y2": _m("greatest(greatest(l_quantity, 10.0), least(l_quantity + 5, 40.0))")}))
def q_rect_intersection(read: Read) -> DataFrame:
    line, quantity = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    box = geometry.intersect(geometry.rectangle(line + 3, quantity + 5, line, quantity), geometry.rectangle(*map(F.lit, (2.0, 10.0, 6.0, 40.0))))
    return read("lineitem").select(*_KEY, *(_micro(v).alias(k) for k, v in box.items()))


@_query(f"SELECT l_orderkey, {_m('min(l_quantity)')} AS x1, {_m('max(l_quantity)')} AS x2, {_m('min(l_extendedprice)')} AS y1, {_m('max(l_extendedprice)')} AS y2 FROM lineitem GROUP BY l_orderkey")
def q_rect_bounds(read: Read) -> DataFrame:
    sides = {"x1": F.min("l_quantity"), "x2": F.max("l_quantity"), "y1": F.min("l_extendedprice"), "y2": F.max("l_extendedprice")}
    return read("lineitem").groupBy("l_orderkey").agg(*(_micro(v).alias(k) for k, v in sides.items()))


_BT = "(l_discount * 10)"


@_query(_line({"v": _m(f"pow(1 - {_BT}, 3) * l_quantity + 3 * pow(1 - {_BT}, 2) * {_BT} * 10 + 3 * (1 - {_BT}) * pow({_BT}, 2) * 90 + pow({_BT}, 3) * l_linenumber")}))
def q_bezier_point(read: Read) -> DataFrame:
    points = (F.col("l_quantity"), F.lit(10.0), F.lit(90.0), F.col("l_linenumber").cast("double"))
    return read("lineitem").select(*_KEY, _micro(geometry.bezier(points, F.col("l_discount") * 10)).alias("v"))


# strings, dates, flags ---------------------------------------------------------------------------


#: The remainders of a byte's eight shifts are folded out: the reflected polynomial, bit by bit.
_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def _crc_byte(c: str) -> str:
    for _ in range(8):
        c = f"list_transform([{c}], lambda c: {_CRC_BIT})[1]"
    return c


@_query(f"SELECT p_partkey, xor(4294967295, list_reduce(list_transform(string_split(p_name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {_crc_byte('xor(c, b)')}, CAST(4294967295 AS BIGINT))) AS crc FROM part")
def q_crc32(read: Read) -> DataFrame:
    return read("part").select("p_partkey", F.crc32(F.col("p_name").cast("binary")).alias("crc"))


_B62 = strings.BASE62


@_query(
    "SELECT doc_id, 'im' || "
    + " || ".join(f"substr('{_B62}', 1 + CAST('0x' || substr(h, {2 * i + 1}, 2) AS INTEGER) % 62, 1)" for i in range(2, 7))
    + " AS id FROM (SELECT doc_id, sha1(text || chr(1)) AS h FROM documents)"
)
def q_stable_id(read: Read) -> DataFrame:
    return read("documents").select("doc_id", strings.stable_id("im", F.concat("text", F.lit("\u0001")), "UTF-8").alias("id"))


@_query("SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP) - to_minutes(CAST(90 AS BIGINT))) AS us, 90 AS off FROM orders")
def q_date_parse(read: Read) -> DataFrame:
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+01'30'"))
    utc, offset = strings.parse_date(text)
    return read("orders").select("o_orderkey", F.unix_micros(utc.cast("timestamp")).alias("us"), offset.alias("off"))


@_query("SELECT doc_id, text AS utf16, text AS utf8 FROM documents")
def q_bom_decode(read: Read) -> DataFrame:
    raw = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode("text", charset))
    return read("documents").select("doc_id", strings.decode_text(raw("FEFF", "UTF-16BE")).alias("utf16"), strings.decode_text(raw("EFBBBF", "UTF-8")).alias("utf8"))


@_query("SELECT doc_id, replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', chr(65533), 'g'), chr(173), '-') || chr(65533) || 'x-y' || chr(10) AS clean FROM documents")
def q_invalid_chars(read: Read) -> DataFrame:
    return read("documents").select("doc_id", strings.replace_invalid(F.concat("text", F.lit("\u0007x­y\n"))).alias("clean"))


@_query("SELECT doc_id, doc_id % 3 = 0 AS rtl, doc_id % 5 = 0 AS control FROM documents")
def q_rtl_flag(read: Read) -> DataFrame:
    marked = F.concat("text", F.when(F.col("doc_id") % 3 == 0, "א").otherwise("a"), F.when(F.col("doc_id") % 5 == 0, "‫").otherwise("b"))
    return read("documents").select("doc_id", strings.might_be_rtl(marked).alias("rtl"), strings.has_bidi_control(marked).alias("control"))


_BITS = {"modify": 4, "extract": 5, "annotate": 6, "fill_forms": 9, "accessibility": 10, "assemble": 11}


@_query(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"(l_partkey & {1 << (b - 1)}) <> 0 AS {k}" for k, b in _BITS.items())
    + ", (l_partkey & 4) <> 0 OR (l_partkey & 2048) <> 0 AS print_low, CASE WHEN l_linenumber < 3 THEN (l_partkey & 4) <> 0 ELSE (l_partkey & 2048) <> 0 END AS print_full FROM lineitem"
)
def q_perm_bits(read: Read) -> DataFrame:
    out = strings.permissions(F.col("l_partkey").cast("int"), F.col("l_linenumber"))
    return read("lineitem").select(*_KEY, *(v.alias(k) for k, v in out.items()))


#: Font names and what they mean: family, weight, style.
_FONT_NAMES = {
    "Arial-Bold": ("Arial,sans-serif", 700, None), "ArialBlack": ("'Arial Black',Arial,sans-serif", 900, None), "Times New Roman": ("'Times New Roman',serif", 400, None), "MyCourier": ("'Courier New',Courier,monospace", None, None),
    "Foo Sans": ("sans-serif", None, None), "Bookman": ("serif", None, None), "Plain": ("sans-serif", None, None), "Helvetica-BoldOblique": ("Helvetica,Arial,sans-serif", 700, "oblique"), "Verdana,Italic": ("Verdana,sans-serif", None, "italic"),
    "Segoe-Lt": ("'Segoe UI',sans-serif", 300, None), "Cambria-BdIt": ("Cambria,serif", 700, "italic"), "YuGothic-DemiBold": ("'Yu Gothic',sans-serif", 600, None), "Palatino-Roman": ("'Palatino Linotype',Palatino,serif", 400, None),
    "SourceCodePro-Light": ("monospace", 300, None), "MS Gothic": ("'MS Gothic',sans-serif", None, None), "MicrosoftYaHei": ("'Microsoft YaHei',sans-serif", None, None), "HeiseiMincho": ("serif", None, None), "-It": ("sans-serif", None, None),
}
_QUOTED = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@_query(
    f"SELECT p_partkey, n.family, CAST(n.weight AS INTEGER) AS weight, n.style FROM part JOIN (VALUES {', '.join('(' + ', '.join(map(_QUOTED, (i, *v))) + ')' for i, v in enumerate(_FONT_NAMES.values()))}) n(i, family, weight, style) ON p_partkey % {len(_FONT_NAMES)} = n.i"
)
def q_local_font(read: Read) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _FONT_NAMES)), (F.col("p_partkey") % len(_FONT_NAMES) + 1).cast("int"))
    rows = read("part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", localfonts.family(F.col("name")).alias("family"), localfonts.weight(F.col("name")).alias("weight"), localfonts.style(F.col("name")).alias("style"))


@_query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) WHEN p_size < 4 THEN ['.25', '.5', '.75'][p_size] ELSE CAST(p_size // 4 AS VARCHAR) || ['.25', '.5', '.75'][p_size % 4] END AS text FROM part")
def q_number_text(read: Read) -> DataFrame:
    return read("part").select("p_partkey", strings.number_text(F.col("p_size") / 4.0).alias("text"))


@_query("SELECT page_id FROM pages WHERE page_id BETWEEN 1 AND 6 OR page_id >= 20")
def q_page_ranges(read: Read) -> DataFrame:
    pages = read("pages")
    top = pages.agg(F.max("page_id").cast("int").alias("top")).select(F.explode(strings.page_numbers(F.lit("1..5, 4..6, 20.."), F.col("top"))).alias("page_id"))
    return pages.join(top.select(F.col("page_id").cast("long").alias("page_id")), "page_id", "left_semi").select("page_id")


@_query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def q_text_extract(read: Read) -> DataFrame:
    return read("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@_query("SELECT n_nationkey, 'data:image/png;base64,' || base64(encode(n_name)) AS url FROM nation")
def q_data_url(read: Read) -> DataFrame:
    return read("nation").select("n_nationkey", strings.data_url(F.lit("image/png"), F.col("n_name").cast("binary")).alias("url"))


# relational --------------------------------------------------------------------------------------


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def q_first_wins(read: Read) -> DataFrame:
    return rel.first_wins(read("events").select("user_id", "event_type", "ts", "event_id"), ("user_id", "event_type"), ("ts", "event_id")).select("user_id", "event_type", "event_id")


@_query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_last_wins(read: Read) -> DataFrame:
    return rel.last_wins(read("events"), ("user_id", "event_type"), ("ts", "event_id"), ("event_id", "value"))


@_query(
    "SELECT user_id, event_type, run, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM "
    "(SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2, 3"
)
def q_partition_by(read: Read) -> DataFrame:
    runs = rel.islands(read("events").select("user_id", "event_type", "ts", "event_id"), ("user_id",), ("ts", "event_id"), F.col("event_type"), "run")
    return runs.groupBy("user_id", "event_type", F.col("run").cast("decimal(38,0)").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@_query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey")
def q_group_container(read: Read) -> DataFrame:
    return read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"))


@_query(
    "SELECT l_partkey, l_quantity FROM (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag DESC, l_linenumber, l_orderkey, l_quantity) AS n FROM lineitem WHERE l_quantity > 0) WHERE n = 1"
)
def q_ordered_pick(read: Read) -> DataFrame:
    order = (F.desc("l_returnflag"), "l_linenumber", "l_orderkey", "l_quantity")
    return rel.first_wins(read("lineitem").where("l_quantity > 0"), ("l_partkey",), order).select("l_partkey", "l_quantity")


@_query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_acctbal, c_custkey) AS place FROM customer")
def q_multi_sort(read: Read) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), "c_acctbal", "c_custkey")
    return read("customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place"))


@_query("SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def q_lookup_inner(read: Read) -> DataFrame:
    nation = read("nation").withColumnRenamed("n_nationkey", "key")
    return rel.lookup(read("supplier").withColumnRenamed("s_nationkey", "key"), nation, "key").select(F.col("key").alias("n_nationkey"), "n_name", "s_suppkey")


@_query("SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def q_lookup_multi(read: Read) -> DataFrame:
    counts = read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("l_orderkey").alias("n"))
    return read("part").select("p_partkey").join(counts, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@_query("SELECT o_orderkey, o_custkey, c_custkey IS NULL AS is_dangling FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def q_dangling_refs(read: Read) -> DataFrame:
    known = read("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("found"))
    return rel.lookup(read("orders"), known, "o_custkey", "left").select("o_orderkey", "o_custkey", F.col("found").isNull().alias("is_dangling"))


@_query("SELECT s_suppkey AS key, 's' AS side FROM supplier UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def q_merge_anti(read: Read) -> DataFrame:
    first = read("supplier").select(F.col("s_suppkey").alias("key"), F.lit("s").alias("side"))
    return rel.merge_first(first, read("customer").select(F.col("c_custkey").alias("key"), F.lit("c").alias("side")), ("key",))


@_query("SELECT 0 AS part, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer")
def q_concat_ordered(read: Read) -> DataFrame:
    a = read("supplier").select(F.lit(0).alias("part"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return a.unionByName(read("customer").select(F.lit(1).alias("part"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")))


@_query("SELECT l_orderkey, code, count(*) AS n FROM (SELECT l_orderkey, unnest(range(l_linenumber, l_linenumber + 3)) AS code FROM lineitem UNION ALL SELECT p_partkey, unnest(range(p_partkey, p_partkey + 5 * p_size)) FROM part) GROUP BY 1, 2")
def q_flat_map_ranges(read: Read) -> DataFrame:
    ranges = read("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("low"), (F.col("l_linenumber") + 2).cast("long").alias("high"))
    part = F.col("p_partkey").cast("long")
    ranges = ranges.unionByName(read("part").select(F.col("p_partkey").alias("l_orderkey"), part.alias("low"), (part + 5 * F.col("p_size") - 1).alias("high")))
    return rel.expand_ranges(ranges, "low", "high", "code").groupBy("l_orderkey", "code").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey, p_partkey AS band FROM orders JOIN part ON CAST(floor(o_totalprice) AS BIGINT) BETWEEN p_partkey * 1000 AND p_partkey * 1000 + 499")
def q_range_join(read: Read) -> DataFrame:
    low = F.col("p_partkey") * 1000
    bands = read("part").select(F.col("p_partkey").alias("band"), low.alias("low"), (low + 499).alias("high"))
    codes = read("orders").select("o_orderkey", F.floor("o_totalprice").alias("code"))
    return rel.range_lookup(codes, "code", bands, "low", "high").select("o_orderkey", "band")


@_query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 5")
def q_limit_offset(read: Read) -> DataFrame:
    return read("nation").orderBy("n_nationkey").offset(5).limit(10).select("n_nationkey", "n_name")


@_query("SELECT r_regionkey, list_resize(keys, 8, 0)[1:8]::VARCHAR AS padded FROM (SELECT n_regionkey AS r_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1)")
def q_pad_take(read: Read) -> DataFrame:
    keys = F.array_sort(F.collect_list("n_nationkey"))
    padded = F.slice(F.concat(keys, F.array_repeat(F.lit(0), 8)), 1, 8)
    listed = F.concat(F.lit("["), F.array_join(padded.cast("array<string>"), ", "), F.lit("]"))
    return read("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(listed.alias("padded"))


@_query("SELECT o_custkey, count(*) > 10 AS more FROM orders GROUP BY o_custkey")
def q_exists_more_than(read: Read) -> DataFrame:
    return read("orders").groupBy("o_custkey").agg((F.count("*") > 10).alias("more"))


_POLICIES = {"AnyOn": "coalesce(bool_or(s), true)", "AllOn": "coalesce(bool_and(s), true)", "AnyOff": "coalesce(bool_or(NOT s), false)", "AllOff": "coalesce(bool_and(NOT s), true)"}


@_query("SELECT c_custkey, " + ", ".join(f"{e} AS {k}" for k, e in _POLICIES.items()) + " FROM (SELECT c_custkey, o_totalprice > 150000 AS s FROM customer LEFT JOIN orders ON c_custkey = o_custkey) GROUP BY c_custkey")
def q_visibility_policies(read: Read) -> DataFrame:
    states = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(rel.visibility(F.col("o_totalprice") > 150000, p).alias(p) for p in _POLICIES))
    joined = read("customer").select("c_custkey").join(states, "c_custkey", "left")
    return joined.select("c_custkey", *(F.coalesce(p, F.lit(p != "AnyOff")).alias(p) for p in _POLICIES))


@_query("SELECT l_returnflag, v[CAST(len(v) // 2 AS INTEGER) + 1] AS median FROM (SELECT l_returnflag, list(l_quantity ORDER BY l_quantity) AS v FROM lineitem GROUP BY 1)")
def q_upper_median(read: Read) -> DataFrame:
    return rel.upper_median(read("lineitem"), ("l_returnflag",), "l_quantity")


@_query(
    "SELECT 'r' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS label FROM region UNION ALL "
    "SELECT 'n' || n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_regionkey % 2 = 0 THEN r_name END) FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL "
    "SELECT 's' || s_suppkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_regionkey % 2 = 0 THEN r_name END) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def q_tree_inherit(read: Read) -> DataFrame:
    node = lambda df, p, key, parent, label: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), parent.alias("parent"), F.col(key).cast("long").alias("ordinal"), label.alias("label"))
    nodes = node(read("region"), "r", "r_regionkey", F.lit(None).cast("string"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")))
    nodes = nodes.unionByName(node(read("nation"), "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name"))))
    nodes = nodes.unionByName(node(read("supplier"), "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey"), F.lit(None).cast("string")))
    return rel.flatten_tree(nodes, ("label",)).select("id", "label")


@_query(
    "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_linenumber = 1), "
    "walk(start, node, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION SELECT start, b, depth + 1 FROM walk JOIN e ON node = a WHERE depth < 25) "
    "SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1, 2"
)
def q_traverse_depth(read: Read) -> DataFrame:
    """Which nations buy from which over how many steps, by a breadth-first walk over a graph with cycles."""
    sold = read("lineitem").where("l_quantity >= 50 and l_linenumber = 1").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).distinct()
    return rel.reachable(edges, read("nation").select(F.col("n_nationkey").alias("start")))


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events")
def q_state_fold(read: Read) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return rel.carry_forward(read("events"), ("user_id",), ("ts", "event_id"), value, "state").select("event_id", "state")


@_query(
    "SELECT event_id, CAST(s - least(min(s) OVER w, 0) AS BIGINT) AS depth FROM (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def q_stack_depth(read: Read) -> DataFrame:
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return rel.stack_depth(read("events"), ("user_id",), ("ts", "event_id"), step).select("event_id", "depth")


@_query(
    "SELECT user_id, session, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM "
    "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2"
)
def q_sessionise(read: Read) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    breaks = F.col("ts") - F.lag("ts").over(w) >= F.expr("INTERVAL '6' HOUR")
    runs = rel.sessions(read("events").select("user_id", "ts", "event_id"), ("user_id",), ("ts", "event_id"), breaks)
    return runs.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@_query(
    "SELECT user_id, span, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span FROM (SELECT *, "
    "CASE WHEN event_type = lag(event_type) OVER w AND ts - lag(ts) OVER w < CASE WHEN value < 50 THEN INTERVAL 24 HOUR ELSE INTERVAL 3 HOUR END THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2"
)
def q_span_merge(read: Read) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    limit = F.when(F.col("value") < 50, F.expr("INTERVAL '24' HOUR")).otherwise(F.expr("INTERVAL '3' HOUR"))
    same = (F.col("event_type") == F.lag("event_type").over(w)) & (F.col("ts") - F.lag("ts").over(w) < limit)
    runs = rel.sessions(read("events"), ("user_id",), ("ts", "event_id"), ~same, "span")
    return runs.groupBy("user_id", "span").agg(F.count("*").alias("n"))


@_query("SELECT min(doc_id) AS doc_id, sha1(text) AS content_key FROM documents GROUP BY text")
def q_dedup_content(read: Read) -> DataFrame:
    keyed = read("documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("content_key"))
    return keyed.groupBy("content_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_key")


@_query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id")
def q_group_concat(read: Read) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return read("conversations").where("text is not null and role is not null").groupBy("conv_id").agg(body.alias("body"))

"""Order-aware relational operators over DataFrames: each is one shuffle on its key unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges with fewer codes than this are expanded to an equi-join; longer ones are joined by buckets.
EXPAND_BELOW, EXPAND_BLOCK = 100, 4096


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key; the window's group limit keeps one row per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key, by partial aggregation."""
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(latest).select(*keys, *(F.col(f"_last.{v}").alias(v) for v in values))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], key: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of adjacent rows with equal keys within each group, from 1; nulls equal nulls."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_new", (F.row_number().over(w) == 1) | ~key.eqNullSafe(F.lag(key).over(w)))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(F.col("_new").cast("int")).over(run)).drop("_new")


def sessions(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], breaks: Column, name: str = "session") -> DataFrame:
    """Numbers runs of rows that go on until ``breaks`` (over the previous row, null for the first) is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("_new", F.coalesce(breaks, F.lit(True)))
    return marked.withColumn(name, F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lookup(df: DataFrame, table: DataFrame, on: str, how: str = "inner", small: bool = False) -> DataFrame:
    """Probe of a lookup table: inner drops rows without an entry, left keeps them. small: the table's size has been checked."""
    return df.join(F.broadcast(table) if small else table, on, how)


def merge_first(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All of the first table, and the rows of the second whose key it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Element n/2 (rounded down, from 0) of each key's sorted values: a value histogram, then its running count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_below", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_all", F.sum("_n").over(w))
    return run.where(F.col("_below") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias(name))


def visibility(states: Column, policy: str) -> Column:
    """Aggregate of booleans by policy; no state at all gives true, except for AnyOff."""
    return {
        "AnyOn": F.coalesce(F.bool_or(states), F.lit(True)),
        "AllOn": F.coalesce(F.bool_and(states), F.lit(True)),
        "AnyOff": F.coalesce(F.bool_or(~states), F.lit(False)),
        "AllOff": F.coalesce(F.bool_and(~states), F.lit(True)),
    }[policy]


def range_lookup(df: DataFrame, code: str, ranges: DataFrame, low: str, high: str, bucket: int = 4096) -> DataFrame:
    """Rows with the ranges that hold their code, as an equi-join on buckets of codes (not a nested loop over all ranges)."""
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return df.withColumn("_bucket", F.floor(F.col(code) / bucket)).join(spread, "_bucket").where(F.col(code).between(F.col(low), F.col(high))).drop("_bucket")


def expand_ranges(ranges: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each code of every range, its ends included; a range whose ends are swapped or null has none.

    Codes are made row by row where the range lies, so a long range is never held as an array of more than a block.
    """
    block = F.lit(EXPAND_BLOCK)
    starts = F.when(F.col(low) <= F.col(high), F.sequence(F.lit(0).cast("long"), F.floor((F.col(high) - F.col(low)) / block).cast("long")))
    spread = ranges.withColumn("_block", F.explode(starts))
    first = F.col(low) + F.col("_block") * block
    codes = F.sequence(first.cast("long"), F.least(F.col(high), first + block - 1).cast("long"))
    return spread.withColumn(name, F.explode(codes)).drop("_block")


def short_and_long(ranges: DataFrame, low: str, high: str, below: int = EXPAND_BELOW) -> tuple[DataFrame, DataFrame]:
    """The ranges to expand into codes and those to keep as ranges (see range_lookup), by their number of codes."""
    short = F.col(high) - F.col(low) < below
    return ranges.where(short), ranges.where(~short)


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """The last value that is not null, up to and with the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stack_depth(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], step: Column, name: str = "depth") -> DataFrame:
    """Running sum of +1 and -1 steps that never falls under 0 (a pop of an empty stack does nothing)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_sum", F.sum(step).over(w))
    return summed.withColumn(name, F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0))).drop("_sum")


def _kept(df: DataFrame) -> DataFrame:
    """A round's rows, computed once: checkpointed where the session has a checkpoint folder, persisted elsewhere."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() is not None else df.persist()


def flatten_tree(nodes: DataFrame, inherited: Sequence[str], depth: int | None = None) -> DataFrame:
    """Depth-first rows of a forest nodes(id, parent, ordinal, ...) with attributes inherited from the nearest ancestor that sets them.

    ``path`` (ordinals from the root) orders the result. One join per level, down to the last one (or to ``depth`` levels, if
    it is given), each with the level before only. Only what hangs from a root (a null parent) is reached; a node that is its own
    ancestor ends there.
    """
    child = nodes.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), "ordinal", *(F.col(c).alias(f"_{c}") for c in inherited))
    level = _kept(nodes.where("parent is null").select("id", *inherited, F.array("ordinal").alias("path"), F.array("id").alias("_line")))
    levels = [level]
    while depth is None or len(levels) < depth:
        met = level.join(child, F.col("id") == F.col("_parent")).where(~F.array_contains("_line", F.col("_id")))
        own = [F.coalesce(f"_{c}", c).alias(c) for c in inherited]
        level = _kept(met.select(F.col("_id").alias("id"), *own, F.array_append("path", F.col("ordinal")).alias("path"), F.array_append("_line", F.col("_id")).alias("_line")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("_line")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): the nodes that starts(start) lead to over edges(a, b), each with its least number of steps.

    A breadth-first walk with a visited set: each round joins the last round's new nodes only, and leaves out those that
    are known, so that cycles end.
    """
    known = fresh = _kept(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    while not fresh.isEmpty():
        step = fresh.join(edges, F.col("node") == F.col("a")).groupBy("start", F.col("b").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        fresh = _kept(step.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        known = _kept(known.unionByName(fresh))
    return known

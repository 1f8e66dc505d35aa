"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names and units are typed placeholders, the other words are
lower-cased. Each text has two templates: a capitalised word that begins a sentence is a word in one and a
name in the other. Windows of template tokens are joined by hash between documents and benchmark items; a run
of matched windows on one diagonal (document place less item place) is a leak if it covers enough of the item
and the placeholders' values agree slot by slot. So an item whose names and numbers were exchanged is
found, and a text that merely shares its placeholders is not. A window of few words is looked for with its
values, and widened until it holds enough words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import _spark, _text

WINDOW = 8
#: Tokens of an item that a leak covers at least (all of a shorter item); items under LEAST tokens are not looked for.
COVER, LEAST = 13, 5
#: The map of benchmark windows that the scan consults has 2**BITS bits or more, for 16 a window, up to 2**MOST_BITS (16 MiB).
BITS, MOST_BITS = 16, 27
#: Rows of benchmark windows that are broadcast at most. Beyond, the rows of one window are dealt among so many parts, so that a
#: passage shared by many documents is no hot key.
BROADCAST_WINDOWS, SALTS = 200_000, 64
#: Words that are units after a number (fixed values).
UNITS = (
    "kg g mg km m cm mm mi ft in lb lbs oz s ms h l ml w kw v a hz mhz ghz kb mb gb tb mph kmh usd eur gbp "
    "kilograms kilogram grams gram kilometers kilometres meters metres centimeters miles mile feet foot inches inch pounds "
    "ounces seconds second minutes minute hours hour days day weeks week months month years year percent dollars dollar "
    "euros euro cents degrees celsius liters litres litre liter watts volts euro stunden tage jahre heures jours ans horas"
).split()

_LITERAL, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
_PLACE = _text.mix64(np.arange(77, 81, dtype=np.uint64))
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = True
_TOKEN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 34, 46, 58, 63]] = True  # end of a sentence or line: the next capital is no name


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = _text.utf8(pa.array(words))
    return np.sort(_text.span_hashes(data, offsets[:-1], offsets[1:]))


_UNIT_HASHES = _hash_words(UNITS)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def templates(data: np.ndarray, offsets: np.ndarray, initial: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of each row: their hashes, kinds, values (hashes of what stands there), whether they count as words, and the rows' bounds.

    initial: a capitalised word that begins a text, sentence or line is a name, which still counts as a word.
    """
    low = _text.ASCII_LOWER[data].copy()
    if len(low) > 1:  # the Latin-1 capitals
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    starts, ends, bounds = _text.spans(_TOKEN[data], offsets)
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, np.zeros(0, np.int8), z, np.zeros(0, bool), bounds
    value = _text.span_hashes(low, starts, ends)
    first = np.zeros(len(starts), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    number = digits[ends] - digits[starts] == ends - starts
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    inner = ~first
    inner[1:] &= stops[starts[1:]] == stops[ends[:-1]]
    changed = np.concatenate([[0], np.cumsum(low != data)])
    two = np.where(data[starts] >= 0xC0, 2, 1)  # bytes of the first letter
    capital = changed[np.minimum(starts + two, ends)] > changed[starts]
    lower_rest = (changed[ends] == changed[np.minimum(starts + two, ends)]) & (ends - starts > two)
    name = (inner | initial) & capital & lower_rest & ~number
    after_number = np.concatenate([[False], number[:-1]]) & ~first
    unit = after_number & _member(value, _UNIT_HASHES)
    kind = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], _LITERAL).astype(np.int8)
    # neighbouring numbers (3.14) and names (given and family name) are one placeholder
    again = np.concatenate([[False], (kind[1:] == kind[:-1]) & ((kind[1:] == _NUMBER) | (kind[1:] == _NAME) & inner[1:])]) & ~first
    keep = np.flatnonzero(~again)
    with np.errstate(over="ignore"):
        order = np.arange(len(kind)) - keep[np.cumsum(~again) - 1]
        value = np.add.reduceat(value * (U64(2) * order.astype(np.uint64) + U64(1)), keep)
    word = ((kind == _LITERAL) | (kind == _NAME) & ~inner)[keep]
    kind = kind[keep]
    return np.where(kind == _LITERAL, value, _PLACE[kind]), kind, value, word, np.searchsorted(keep, bounds)


U64 = np.uint64


def _runs(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the token runs lo..hi: a polynomial, then a finaliser."""
    up, down = _text._POWERS.get(len(tokens) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(tokens) + 1, U64)
        np.cumsum(tokens * up[:-1], out=total[1:])
        return _text.mix64((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64) + U64(seed))


def _windows(data: np.ndarray, offsets: np.ndarray, sizes: list[int], window: int, initial: bool) -> Iterator[tuple]:
    """For each window size: hashes, rows, places, widths and, as a function of chosen windows, their slots (kind, value).

    A window with fewer than 5 words in 8 tokens is hashed with its values, and once more in the least width that has them;
    so is a smaller one, which is for whole short items, with fewer than 3 words or than words in half of its tokens.
    """
    token, kind, value, word, bounds = templates(data, offsets, initial)
    literal, counted = (np.concatenate([[0], np.cumsum(x)]) for x in (kind == _LITERAL, word))
    for n in sizes:
        grams, at = _text.ngram_hashes(token, bounds, n)
        count = np.diff(at)
        row = np.repeat(np.arange(len(count)), count)
        begin = bounds[:-1][row] + np.arange(len(grams)) - at[:-1][row]
        end = begin + n
        words = counted[end] - counted[begin]
        good = (8 * words >= 5 * n if n >= window else words >= max(3, -(-n // 2))) & (2 * (literal[end] - literal[begin]) >= n)
        few = np.flatnonzero(~good)
        if len(few):
            exact = _runs(value + kind.astype(U64), begin[few], end[few], n)
            # the first end by which enough words stand; a row that ends before has no wider window
            far = np.searchsorted(literal, literal[begin[few]] - (-5 * n // 8))
            wider = np.flatnonzero((far <= bounds[row[few] + 1]) & (far > end[few]))
            wide = _runs(token, begin[few[wider]], far[wider], 1 << 32)
            pick = np.concatenate([np.flatnonzero(good), few, few[wider]])
            grams = np.concatenate([grams[good], exact, wide])
            row, begin, end = row[pick], begin[pick], np.concatenate([end[good], end[few], far[wider]])
        if initial:
            grams = _text.mix64(grams)

        def slots(pick: np.ndarray, begin=begin, end=end) -> list[list[dict]]:
            out = []
            for b, e in zip(begin[pick], end[pick]):
                at = b + np.flatnonzero(kind[b:e])
                out.append([{"k": int(kind[i]), "v": int(value[i].view(np.int64))} for i in at])
            return out

        yield n, grams, row, begin - bounds[:-1][row], end - begin, slots


_SLOTS = pa.list_(pa.struct([("k", pa.int32()), ("v", pa.int64())]))
_HITS = "id long, h long, place long, size long, initial boolean, slots array<struct<k: int, v: long>>"


def _batch(ids: np.ndarray, h: np.ndarray, place: np.ndarray, size: np.ndarray, initial: bool, slots: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64)), pa.array(place), pa.array(size), pa.array([initial] * len(h), pa.bool_()), pa.array(slots, _SLOTS)], ["id", "h", "place", "size", "initial", "slots"])


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, least: int) -> Iterator[pa.RecordBatch]:
    """All windows of items; an item shorter than a window is one window of its own size. size: tokens of the item."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = _text.utf8(batch.column(1))
        for initial in (False, True):
            tokens = np.diff(templates(data, offsets, initial)[4])
            for n, grams, row, place, _, slots in _windows(data, offsets, list(range(least, window + 1)), window, initial):
                pick = np.flatnonzero((tokens[row] == n) | (n == window))
                yield _batch(ids[row[pick]], grams[pick], place[pick], tokens[row[pick]], initial, slots(pick))


def _document_windows(batches: Iterator[pa.RecordBatch], sizes: list[int], window: int, marked: np.ndarray, bits: int, chunk: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """The windows of documents whose bit is set in the map. size: tokens of the window."""
    mask = U64((1 << bits) - 1)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = _text.utf8(batch.column(1))
        for lo, hi in _text.blocks(offsets, chunk):
            for initial in (False, True):
                for _, grams, row, place, width, slots in _windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], sizes, window, initial):
                    at = (grams & mask).astype(np.int64)
                    pick = np.flatnonzero(marked[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                    if len(pick):
                        yield _batch(ids[lo + row[pick]], grams[pick], place[pick], width[pick], initial, slots(pick))
    _text.release()


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """(doc_id, item_id, reparameterised), a row for each benchmark item that leaked into a document.

    An item leaks if windows on one diagonal cover at least ``cover`` of its template tokens (all of a
    shorter item) and the slots are consistent: each of the item's names and units stands for one value in
    the document, and so do at least half of its numbers. reparameterised: some value differs. Null ids,
    null and empty texts and items of fewer than 5 tokens match nothing; repeated rows count once.
    """
    ship(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    items = items.mapInArrow(partial(_item_windows, window=window, least=LEAST), _HITS).distinct()
    items = _spark.materialize(items, "items")
    n = items.count()
    bits = min(MOST_BITS, max(BITS, (16 * n).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # a bucket holds 32768 numbers, the first from 1 on
    maps = items.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("map"))
    marked = np.zeros(((1 << bits) >> 3) + 4096, np.uint8)
    for part, found in maps.collect():  # at most 2**bits / 32768 rows of 4 KiB
        marked[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(found), np.uint8)
    sizes = sorted({min(int(r["size"]), window) for r in items.select(F.least("size", F.lit(window)).alias("size")).distinct().collect()})
    base = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    hits = base.mapInArrow(partial(_document_windows, sizes=sizes, window=window, marked=marked, bits=bits), _HITS)
    hits = hits.select(F.col("id").alias("doc_id"), "h", F.col("place").alias("doc_place"), F.col("size").alias("n"), "initial", F.col("slots").alias("there"))
    items = items.select(F.col("id").alias("item_id"), "h", "place", "size", "initial", "slots")
    if n <= BROADCAST_WINDOWS:
        met = hits.join(F.broadcast(items), ["h", "initial"])
    else:
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS).cast("long")))
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        met = hits.join(items.withColumn("salt", F.explode(salts)), ["h", "initial", "salt"])
    met = met.where(F.size("slots") == F.size("there"))
    pair = F.transform(F.arrays_zip("slots", "there"), lambda x: F.struct(x["slots"]["k"].alias("k"), x["slots"]["v"].alias("a"), x["there"]["v"].alias("b")))
    met = met.groupBy("doc_id", "item_id", "initial", (F.col("doc_place") - F.col("place")).alias("shift"))
    met = met.agg(F.max("size").alias("size"), F.array_sort(F.collect_set(F.struct("place", "n"))).alias("at"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"))
    covered = F.expr("aggregate(at, struct(0L as n, -1L as last), (a, x) -> struct(a.n + greatest(0L, x.place + x.n - greatest(a.last, x.place)) as n, greatest(a.last, x.place + x.n) as last), a -> a.n)")
    strict, numbers = F.filter("pairs", lambda x: x["k"] != _NUMBER), F.filter("pairs", lambda x: x["k"] == _NUMBER)
    values = lambda x: F.size(F.array_distinct(F.transform(x, lambda y: F.struct(y["k"], y["a"]))))
    single = (F.size(strict) == values(strict)) & (F.size(numbers) <= 2 * values(numbers))
    met = met.where(single & (covered >= F.least("size", F.lit(cover))))
    differs = F.exists("pairs", lambda x: x["a"] != x["b"])
    return met.groupBy("doc_id", "item_id").agg(F.min(differs).alias("reparameterised"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER) -> DataFrame:
    """(doc_id, contaminated, item_ids, n_reparameterised) for each row of docs(doc_id, text); see leaks().

    item_ids are sorted. A row with a null doc_id is never contaminated. Other columns are ignored; an
    empty table gives none.
    """
    found = leaks(docs, benchmark, window, cover).groupBy("doc_id")
    found = found.agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count_if("reparameterised").alias("n_reparameterised"))
    found = _spark.materialize(found, "leaks")
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("n_reparameterised", F.lit(0).cast("bigint")).alias("n_reparameterised"))

"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Counts come from every trusted text, not from a sample. The tables are sharded by n-gram: raw counts of
the highest order, continuation counts below, three discounts per order, and the interpolated
probabilities, are all joins and aggregations of distinct n-grams. The same joins give the probability of
each distinct n-gram type of the corpus; a document's log probability is the sum over its positions.

The types reach the documents by requests: a block of documents asks each shard of the type table for the
types that it holds, packed in one row, and gets their log probabilities back. The table is never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from . import _spark, _text

ORDER = 5
#: Trusted documents of which one in so many is kept out of the counts, to place the thresholds.
HELD_OUT = 5
#: A language's threshold: this quantile of its held-out log perplexities and half of its distance from the median.
QUANTILE, SLACK = 0.999, 0.5
#: Held-out documents that a language needs for a threshold of its own; others take the one over all languages.
LEAST = 20
#: Bytes of text in a block of documents, types in a shard of the table, and bytes of text whose requests one task of a shard answers.
BLOCK_BYTES, SHARD_TYPES, SERVED_BYTES = 16 << 20, 1 << 18, 4 << 30
_FLUSH = 1_000_000


def codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as an integer, and its row; before a text's first byte come zero bytes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + (row + 1) * (order - 1)
    padded = np.zeros(len(data) + len(offsets) * (order - 1), np.uint64)
    padded[at] = data
    out = np.zeros(len(data), np.uint64)
    for k in range(order):
        out |= padded[at - k] << np.uint64(8 * k)
    return out, row


def _types(batches: Iterator[pa.RecordBatch], order: int, chunk: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a partition (in flushes of bounded size) with their counts in counted rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, count = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        by = np.argsort(key, kind="stable")
        key, count = key[by], count[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(count, first)

    def rows() -> pa.RecordBatch:
        key, count = merged()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(count)], ["code", "n"])

    for batch in batches:
        data, offsets = _text.utf8(batch.column(0))
        counted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in _text.blocks(offsets, chunk):
            code, row = codes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
            if not len(code):
                continue
            key = np.sort(code << np.uint64(1) | counted[lo:hi][row].astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            key = key[first]
            held.append((key >> np.uint64(1), np.where(key & np.uint64(1), size, 0)))
            if sum(len(k) for k, _ in held) > _FLUSH:
                held[:] = [merged()]
                if len(held[0][0]) > _FLUSH // 2:
                    yield rows()
    if held:
        yield rows()


def _discounts(counts: DataFrame) -> Column:
    """D(c) of modified Kneser-Ney for a column c, from the counts of counts; 0.5, 0.75 and 0.9 where those are too few."""
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first())
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if y and n3 and n4 else []
    d = [x if 0 < x < i + 1 else f for i, (x, f) in enumerate(zip(d, (0.5, 0.75, 0.9)))] if d else [0.5, 0.75, 0.9]
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def model_tables(types: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 up: (code, p) of seen n-grams and (context, gamma) of seen contexts, from types(code, n)."""
    counts = [types.where("n > 0").select("code", F.col("n").alias("c"))]
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        counts.insert(0, _spark.materialize(counts[0].groupBy(F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(F.count("*").alias("c")), "counts"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        own = counts[k - 1].withColumn("d", _discounts(counts[k - 1])).withColumn("context", F.shiftright("code", 8))
        context = own.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma"))
        own = own.join(context, "context")
        if k == 1:
            lower = F.lit(1 / 256)
        else:
            below = out[-1][0].select(F.col("code").alias("suffix"), F.col("p").alias("lower_p"))
            own = own.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
            lower = F.col("lower_p")
        seen = own.select("code", ((F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * lower).alias("p"))
        out.append((_spark.materialize(seen, "grams"), _spark.materialize(context.select("context", "gamma"), "contexts")))
    return out


def type_logs(types: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(code, logp) for each distinct n-gram of types, seen in training or not, by backing off through the orders."""
    out, p = types.select("code"), F.lit(1 / 256)
    for k, (grams, contexts) in enumerate(tables, 1):
        mask = (1 << 8 * k) - 1
        out = out.withColumn("own", F.col("code").bitwiseAND(F.lit(mask)))
        out = out.join(grams.select(F.col("code").alias("own"), F.col("p").alias(f"p{k}")), "own", "left").drop("own")
        out = out.withColumn("own", F.shiftright(F.col("code").bitwiseAND(F.lit(mask)), 8))
        out = out.join(contexts.select(F.col("context").alias("own"), F.col("gamma").alias(f"g{k}")), "own", "left").drop("own")
        p = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"g{k}"), F.lit(1.0)) * p)
    return out.select("code", F.log(p).alias("logp"))


def _sums(data: np.ndarray, offsets: np.ndarray, order: int, keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Sums of log probabilities by row, looking each distinct n-gram of the chunk up once."""
    code, row = codes(data, offsets, order)
    if not len(code):
        return np.zeros(len(offsets) - 1)
    bits = np.uint64(max(1, int(len(offsets) - 1).bit_length()))
    packed = np.sort(code << bits | row.astype(np.uint64))
    code = packed >> bits
    first = np.concatenate([[True], code[1:] != code[:-1]])
    found = logs[np.searchsorted(keys, code[first].astype(np.int64))]
    each = found[np.cumsum(first) - 1]
    return np.bincount((packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), each, len(offsets) - 1)


_SCORES = "doc_id long, lang string, held_out boolean, n_bytes long, log_perplexity double"


_PACKED = "blk long, doc_id long, lang string, held_out boolean, size long, packed binary"


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (blk, doc_id, lang, held_out, text) with the texts compressed, as they are shuffled and read twice."""
    codec = pa.Codec("zstd")
    for batch in batches:
        data, offsets = _text.utf8(batch.column(4))
        at = offsets.tolist()
        packed = [codec.compress(data[a:b], asbytes=True) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], [x.split(" ")[0] for x in _PACKED.split(", ")])
    _text.release()


def _texts(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of _PACKED rows in runs of rows lo..hi: bytes and offsets."""
    codec = pa.Codec("zstd")
    bounds = np.concatenate([[0], np.cumsum(batch.column(4).to_numpy(zero_copy_only=False))])
    for lo, hi in _text.blocks(bounds, most):
        own = batch.column(5).slice(lo, hi - lo).to_pylist()
        data = b"".join(codec.decompress(x, int(bounds[lo + i + 1] - bounds[lo + i]), asbytes=True) for i, x in enumerate(own))
        yield lo, hi, np.frombuffer(data, np.uint8), bounds[lo : hi + 1] - bounds[lo]


def _scored(batch: pa.RecordBatch, order: int, keys: np.ndarray, logs: np.ndarray) -> pa.RecordBatch:
    total = np.zeros(len(batch))
    for lo, hi, data, offsets in _texts(batch):
        total[lo:hi] = _sums(data, offsets, order, keys, logs)
    size = batch.column(4).to_numpy(zero_copy_only=False)
    mean = pa.array(-total / np.maximum(size, 1), mask=size == 0)
    return pa.RecordBatch.from_arrays([*batch.columns[1:5], mean], ["doc_id", "lang", "held_out", "n_bytes", "log_perplexity"])


def _distinct(parts: list[np.ndarray], batch: pa.RecordBatch, order: int) -> None:
    """Adds the sorted distinct n-grams of some texts to parts, which stay few."""
    for _, _, data, offsets in _texts(batch):
        parts.append(np.unique(codes(data, offsets, order)[0]))
        if len(parts) > 4:
            parts[:] = [np.unique(np.concatenate(parts))]


def _sharded(parts: list[np.ndarray], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams by shard and then by code, and the shards' bounds among them."""
    code = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    shard = (code % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    return code[by], np.searchsorted(shard[by], np.arange(shards + 1))


def _requests(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of _PACKED come by blk: the types of each block, a row for each shard that holds some."""
    block, parts = None, []

    def rows() -> pa.RecordBatch:
        code, at = _sharded(parts, shards)
        use = np.flatnonzero(np.diff(at))
        packed = [code[at[k] : at[k + 1]].tobytes() for k in use]
        return pa.RecordBatch.from_arrays([pa.array(use), pa.array(np.full(len(use), -1 if block is None else block)), pa.array(packed, pa.binary())], ["shard", "blk", "codes"])

    for batch in batches:
        blk = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], blk[1:] != blk[:-1]])).tolist() + [len(blk)]
        for lo, hi in zip(cuts, cuts[1:]):
            if blk[lo] != block:
                yield rows()
                block, parts[:] = blk[lo], []
            _distinct(parts, batch.slice(lo, hi - lo), order)
    yield rows()
    _text.release()


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (shard, salt, role): first a shard's types (role 0), then the requests (role 1); yields the log probabilities asked for."""
    own, held = None, []
    keys = logs = None
    for batch in batches:
        shard, salt, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1])
        cuts = np.flatnonzero(np.concatenate([[True], new])).tolist() + [len(shard)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if role[lo] == 0:
                if own != (shard[lo], salt[lo]):
                    own, held = (shard[lo], salt[lo]), []
                held.append((part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False)))
                keys = None
                continue
            if keys is None:
                keys, logs = (np.concatenate([x[k] for x in held]) for k in (0, 1))
                by = np.argsort(keys)
                keys, logs = keys[by], logs[by]
            found = [logs[np.searchsorted(keys, np.frombuffer(x, np.int64))].tobytes() for x in part.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(5), part.column(0), pa.array(found, pa.binary())], ["blk", "shard", "logs"])


def _block_scores(docs: pa.Table, replies: pa.Table, order: int, shards: int) -> pa.Table:
    """The scores of one block's documents from the replies to its requests."""
    parts: list[np.ndarray] = []
    for batch in docs.to_batches():
        _distinct(parts, batch, order)
    code, at = _sharded(parts, shards)
    logs = np.zeros(len(code))
    for shard, raw in zip(replies.column("shard").to_pylist(), replies.column("logs").to_pylist()):
        logs[at[shard] : at[shard + 1]] = np.frombuffer(raw, np.float64)
    by = np.argsort(code)
    keys, logs = code[by].astype(np.int64), logs[by]
    return pa.Table.from_batches([_scored(batch, order, keys, logs) for batch in docs.to_batches()])


def _scores(rows: DataFrame, logs: DataFrame, types: int, order: int, block_bytes: int, shard_types: int) -> DataFrame:
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, shards = max(1, -(-size // block_bytes)), -(-types // shard_types) | 1  # odd, so that all bytes of an n-gram tell its shard
    salts = max(1, -(-size // (shards * SERVED_BYTES)))
    # copies of one text part by their ids; both uses of rows read one shuffle
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("blk"), "doc_id", "lang", "held_out", "text").mapInArrow(_squeezed, _PACKED).repartition("blk")
    asked = rows.sortWithinPartitions("blk").mapInArrow(partial(_requests, order=order, shards=shards), "shard long, blk long, codes binary")
    asked = asked.select("shard", F.pmod("blk", F.lit(salts)).alias("salt"), F.lit(1).alias("role"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("logp"), "blk", "codes")
    table = logs.select((F.col("code") % shards).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("role"), "code", "logp", F.lit(None).cast("long").alias("blk"), F.lit(None).cast("binary").alias("codes"))
    both = table.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role")
    replies = both.mapInArrow(_replies, "blk long, shard long, logs binary")
    return rows.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(partial(_block_scores, order=order, shards=shards), _SCORES)


def thresholds(scores: DataFrame) -> DataFrame:
    """(lang, threshold) from the held-out rows, by a histogram of log perplexity in steps of 0.001; lang is '' for null, '=' and the name for others, '*' over all."""
    bins = scores.where("held_out and log_perplexity is not null").select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), F.round(F.col("log_perplexity") * 1000).cast("int").alias("bin"))
    bins = bins.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang"), "bin", "n"))
    w = Window.partitionBy("lang")
    run = bins.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin")))
    out = run.groupBy("lang").agg(at(QUANTILE).alias("high"), at(0.5).alias("middle"), F.max("total").alias("total"))
    out = out.where((F.col("total") >= LEAST) | (F.col("lang") == "*"))
    return out.select("lang", ((F.col("high") + SLACK * (F.col("high") - F.col("middle")) + 1) / 1000).alias("threshold"))


def perplexity(docs: DataFrame, trusted: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_types: int = SHARD_TYPES) -> DataFrame:
    """(doc_id, lang, n_bytes, log_perplexity, threshold, kept) for each row of docs(doc_id, text, lang).

    trusted(doc_id) names the documents to learn from; one in five of them (by crc32 of the id) only places
    the thresholds. log_perplexity is the mean negative log probability of a byte. kept: at most the
    threshold of the row's language (null is a language of its own; one with few held-out documents takes
    that of all). Null and empty texts have no perplexity and are not kept. Without trusted documents the
    model is uniform and every text is kept. Equal texts of a language get equal results; other columns
    are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    trusted = trusted.select("doc_id").where("doc_id is not null").distinct()
    trusted = _spark.small(trusted, trusted.count()).withColumn("trusted", F.lit(True))
    rows = docs.select("doc_id", "text", "lang").join(trusted, "doc_id", "left")
    out = F.coalesce(_spark.remainder("doc_id", HELD_OUT) == 0, F.lit(False))
    is_trusted = F.coalesce("trusted", F.lit(False))
    types = rows.where("text is not null").select("text", (is_trusted & ~out).alias("counted"))
    types = types.mapInArrow(partial(_types, order=order), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    types = _spark.materialize(types, "types")
    logs = _spark.materialize(type_logs(types, model_tables(types, order)), "logs")
    rows = rows.select("doc_id", "lang", (is_trusted & out).alias("held_out"), "text")
    scores = _spark.materialize(_scores(rows, logs, types.count(), order, block_bytes, shard_types), "scores")
    limits = _spark.materialize(thresholds(scores), "limits")
    own = limits.where("lang <> '*'").select(F.col("lang").alias("own_lang"), F.col("threshold").alias("own"))
    found = scores.join(_spark.small(own, own.count()), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")) == F.col("own_lang"), "left")
    every = limits.where("lang = '*'").select("threshold").scalar()
    found = found.withColumn("threshold", F.coalesce("own", every))
    kept = F.col("log_perplexity").isNotNull() & F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return found.select("doc_id", "lang", "n_bytes", "log_perplexity", "threshold", kept.alias("kept"))

"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash (C-MinHash) needs two permutations of the shingle universe, not one per coordinate:
``sigma`` shuffles the universe once, and coordinate k of the signature is the least value of ``pi``
shifted circularly by k places, i.e. min over the set of ``pi(sigma(x) + k mod 2**32)``.  Both are
bijections of 32-bit values here.

How the links are found, none of it with all pairs of a group:

1. one scan makes a signature row for each document; equal shingle sets become one class, stood for by
   its smallest doc_id, so exact copies (a third of all rows, say) cost one row from there on;
2. classes that share a band form a bucket.  In each bucket every member is compared with one centre,
   the member with the most bucket company, by exact Jaccard of the full shingle sets;
3. components of these links; in buckets that still hold several components, the members outside of the
   largest one are held against the members of other components, in parts of bounded size: a pair whose
   signatures agree far too little for the threshold (5.4 standard deviations) is passed over, less than
   1e-7 of true links. All others are verified on the full sets within their part, and only links leave it;
4. components of all links.

Bands are chosen for the threshold: with 0.8 there are 40 bands of 6 coordinates, and a pair at similarity
0.8 shares no band with probability 6e-6, one at 0.85 with probability 1e-9.
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
from .components import connected_components

#: Coordinates of a signature at most, and the greatest share of pairs at the threshold that may have no band in common.
COORDINATES, MISSED = 240, 1e-5
#: Members of a bucket or of a centre that one task compares at a time.
BLOCK = 128
#: Members of a bucket whose signatures one task holds against each other at a time, and shingles of theirs (8 bytes each).
PART, PART_SHINGLES = 256, 1 << 20
_SIGNATURE = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def _bijection(x: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A permutation of 32-bit values: xor-shifts and odd multipliers; works in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(c1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(c2)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(values: np.ndarray, bounds: np.ndarray, k: int, block: int = 1 << 14) -> np.ndarray:
    """A (sets, k) matrix of 32-bit signatures; no set may be empty. Works through the values in blocks that fit the cache."""
    out = np.empty((len(bounds) - 1, k), np.uint32)
    for lo, hi in _text.blocks(bounds, block):
        own = values[bounds[lo] : bounds[hi]]
        at = bounds[lo:hi] - bounds[lo]
        sigma = _bijection((own >> np.uint64(32)).astype(np.uint32) ^ own.astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        for j in range(k):
            out[lo:hi, j] = np.minimum.reduceat(_bijection(sigma + np.uint32(j), 0x85EBCA6B, 0xC2B2AE35), at)
    return out


def banding(similarity: float) -> tuple[int, int]:
    """Bands and coordinates in each: the widest bands with which a pair at the threshold is missed with a chance of at most MISSED."""
    shapes = [(COORDINATES // r, r) for r in range(1, 17)]
    found = [(b, r) for b, r in shapes if (1 - similarity**r) ** b <= MISSED]
    if not found:
        raise ValueError("signatures of this length cannot find pairs of so small a similarity")
    return found[-1]


def _signature_rows(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    weights = (_text.mix64(np.arange(11, 11 + rows, dtype=np.uint64)) | np.uint64(1))[None, None, :]
    salt = _text.mix64(np.arange(1000, 1000 + bands, dtype=np.uint64))[None, :]
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, sets, bounds in _text.shingle_sets(batch.column(1), words):
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes > 0)
            starts = bounds[:-1][full]
            keys = np.zeros((2, hi - lo), np.uint64)
            band = np.zeros((0, bands), np.int64)
            sketch = np.zeros((0, bands * rows), np.uint8)
            if len(full):
                with np.errstate(over="ignore"):
                    keys[0, full] = np.add.reduceat(_text.mix64(sets), starts)
                    keys[1, full] = np.bitwise_xor.reduceat(_text.mix64(sets + np.uint64(7)), starts)
                    signature = circulant_signatures(sets, np.concatenate([starts, bounds[-1:]]), bands * rows)
                    wide = signature.reshape(-1, bands, rows).astype(np.uint64)
                    band = _text.mix64((wide * weights).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)
                    sketch = (signature & np.uint32(255)).astype(np.uint8)
            counts = np.where(sizes > 0, bands, 0)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            where = np.cumsum(sizes > 0) - 1
            sketches = [sketch[where[r]].tobytes() if sizes[r] else None for r in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(sizes), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.reshape(-1))), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )
    _text.release()


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (c, blk) with the centre's row (role 0) first; yields the pairs whose full sets are similar enough."""
    group, centre = None, np.zeros(0, np.uint64)
    for batch in batches:
        c, blk, ids, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        found: list[tuple[int, int]] = []
        for lo, hi, sets, bounds in _text.shingle_sets(batch.column(4), words):
            for r in range(lo, hi):
                own = sets[bounds[r - lo] : bounds[r - lo + 1]]
                if role[r] == 0:
                    group, centre = (c[r], blk[r]), own
                elif group == (c[r], blk[r]) and len(own) and len(centre):
                    both = np.sort(np.concatenate([own, centre]))
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= percent * (len(own) + len(centre) - inter):
                        found.append((int(c[r]), int(ids[r])))
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    _text.release()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the named documents, once each."""
    ids = ids.distinct()
    return docs.join(_spark.small(ids, ids.count()), "doc_id", "left_semi")


def repeated_ids(docs: DataFrame) -> tuple[DataFrame, int]:
    """The doc_ids of several rows, and how many there are."""
    found = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    found = _spark.materialize(found, "repeated")
    return found, found.count()


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (c, a) that are similar enough. A centre with many members is dealt out in blocks, each with a copy of its text."""
    per = pairs.groupBy("c").agg(F.ceil(F.count("*") / F.lit(float(BLOCK))).cast("long").alias("n_blk"))
    dealt = pairs.join(per, "c").select("c", F.pmod(F.xxhash64("a"), "n_blk").alias("blk"), "a")
    sides = dealt.select("c", "blk", F.col("a").alias("id"), F.lit(1).alias("role")).unionByName(dealt.select("c", "blk", F.col("c").alias("id"), F.lit(0).alias("role")).distinct())
    sides = _spark.materialize(sides, "sides")
    texts = _texts(docs, sides.select(F.col("id").alias("doc_id")))
    rows = sides.join(texts.withColumnRenamed("doc_id", "id"), "id").select("c", "blk", "id", "role", "text")
    rows = rows.repartition("c", "blk").sortWithinPartitions("c", "blk", "role")
    links = _spark.materialize(rows.mapInArrow(partial(_linked, words=words, percent=percent), "a long, b long"), "links")
    _spark.drop(sides)
    return links


_BLOCK = ["bucket", "band", "i", "j"]
_MEMBER = ["is_left", "rep", "comp", "in_core", "n_shingles", "bands", "sketch"]
_MEMBERS = "bucket long, band int, i int, j int, is_left boolean, rep long, comp long, in_core boolean, n_shingles long, bands array<long>, sketch binary"


class _Part:
    """Lefts and rights of one part of a bucket, as rows of _MEMBER (and a set, where that is known)."""

    def __init__(self, key: tuple) -> None:
        self.key, self.rows = key, []

    def pairs(self, agree: float, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each left (its place) the rights of other components whose sizes and signatures let them be similar, in the first band they share."""
        places = np.array([k for k, x in enumerate(self.rows) if not x[0]], np.int64)
        if not len(places) or len(places) == len(self.rows):
            return
        rights = [self.rows[k] for k in places]
        ids, comp, core = (np.array([x[k] for x in rights]) for k in (1, 2, 3))
        size = np.array([x[4] for x in rights], np.float64)
        band = np.array([x[5] for x in rights])
        sketch = np.stack([np.frombuffer(x[6], np.uint8) for x in rights])
        for k, (is_left, rep, own, _, n, own_band, own_sketch, *_) in enumerate(self.rows):
            if is_left:
                # two members outside of the core meet twice: once as left and right, once the other way
                at = np.flatnonzero((comp != own) & (core | (ids > rep)) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
                if len(at):
                    at = at[(sketch[at] == np.frombuffer(own_sketch, np.uint8)).mean(axis=1) >= agree]
                    at = at[(band[at] == np.array(own_band)).argmax(axis=1) == self.key[1]]
                    if len(at):
                        yield k, places[at]


def _hopeful(batches: Iterator[pa.RecordBatch], agree: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows that come by part, those that are in some pair of their part that may be similar."""
    part = None

    def kept(part: _Part | None) -> list[tuple]:
        use: set[int] = set()
        for k, at in part.pairs(agree, percent) if part else ():
            use.add(k)
            use.update(at.tolist())
        return [(*part.key, *part.rows[k]) for k in sorted(use)]

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    for batch in _and_end(batches):
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None,) * 11]:
            if part is None or row[:4] != part.key:
                out += kept(part)
                part = _Part(row[:4])
            part.rows.append(row[4:])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], _BLOCK + _MEMBER)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _linked_in_parts(batches: Iterator[pa.RecordBatch], agree: float, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Verifies the pairs of each part on full sets; pairs whose components a link of the part has joined need no link."""
    part = None

    def links(part: _Part | None) -> list[tuple[int, int]]:
        out, root = [], {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for k, at in part.pairs(agree, percent) if part else ():
            own = part.rows[k]
            for other in (part.rows[o] for o in at):
                a, b = find(own[2]), find(other[2])
                if a != b:
                    both = np.sort(np.concatenate([own[7], other[7]]))
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= percent * (len(both) - inter):
                        out.append((own[1], other[1]))
                        root[max(a, b)] = min(a, b)
        return out

    for batch in _and_end(batches):
        found: list[tuple[int, int]] = []
        if batch is None:
            found = links(part)
        else:
            sets = [v[at[r] : at[r + 1]].copy() for lo, hi, v, at in _text.shingle_sets(batch.column(11), words) for r in range(hi - lo)]
            for row, own in zip(zip(*(batch.column(k).to_pylist() for k in range(11))), sets):
                if part is None or row[:4] != part.key:
                    found += links(part)
                    part = _Part(row[:4])
                part.rows.append((*row[4:], own))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def _apart(members: DataFrame, near: DataFrame, sig: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, dealt out in parts: lefts outside of a bucket's core, rights."""
    known = members.join(near, F.col("rep") == F.col("node"), "left").select("band", "bucket", "rep", "n_shingles", "size", F.coalesce("root", "rep").alias("comp"))
    # the largest component of a bucket is its core; only members outside of it are held against the others
    each = known.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    rank = F.struct("n", -F.col("comp"))
    sides = [F.sum("n").alias("n_right"), F.sum("s").alias("s_right"), (F.sum("n") - F.max("n")).alias("n_left"), (F.sum("s") - F.max_by("s", rank)).alias("s_left")]
    mixed = each.groupBy("band", "bucket").agg(F.max_by("comp", rank).alias("core"), *sides)
    # as many parts as the members or their shingles ask for, but no more than members
    parts = [F.least(F.col(f"n_{x}"), F.ceil(F.greatest(F.col(f"n_{x}") / F.lit(float(PART)), F.col(f"s_{x}") / F.lit(float(PART_SHINGLES))))).cast("int").alias(f"n_{x}") for x in ("left", "right")]
    mixed = mixed.where("n_left > 0").select("band", "bucket", "core", *parts)
    every = _spark.materialize(known.join(mixed, ["band", "bucket"]), "mixed")
    at = {c: F.pmod(F.xxhash64("rep"), c).cast("int") for c in ("n_left", "n_right")}
    spread = {c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in at}
    shared = ["bucket", "band", "rep", "comp", "n_shingles", (F.col("comp") == F.col("core")).alias("in_core")]
    lefts = every.where("comp <> core").select(*shared, F.lit(True).alias("is_left"), at["n_left"].alias("i"), spread["n_right"].alias("j"))
    rights = every.select(*shared, F.lit(False).alias("is_left"), spread["n_left"].alias("i"), at["n_right"].alias("j"))
    shapes = sig.select(F.col("doc_id").alias("rep"), "bands", "sketch").where("sketch is not null")
    ids = every.select("rep").distinct()
    shapes = shapes.join(_spark.small(ids, ids.count()), "rep", "left_semi")
    blocks = lefts.unionByName(rights).join(shapes, "rep")
    return blocks.select(*_BLOCK, *_MEMBER).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    A document's set holds its distinct shingles of ``words`` lower-cased (A-Z) words; with fewer words,
    the whole sequence is its one shingle. Null, empty and white texts have an empty set and are linked
    with nothing, as are rows whose doc_id is null (their component_id is null and they are kept).
    Documents with similarity of at least ``similarity`` (whole percents count) are linked;
    component_id is the smallest doc_id reachable and kept marks that document. Rows that share a doc_id
    are one document, read by the least of their texts, and get a result row each. Other columns of docs are
    ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    repeated, n = repeated_ids(docs)
    if not n:
        return _classes(docs, words, similarity)
    repeated = _spark.small(repeated, n)
    again = docs.join(repeated, "doc_id", "left_semi")
    one = _spark.materialize(again.groupBy("doc_id").agg(F.min("text").alias("text")), "one")
    found = _classes(docs.join(repeated, "doc_id", "left_anti").unionByName(one), words, similarity)
    found = _spark.materialize(found, "found")
    copies = again.select("doc_id").join(_spark.small(found.join(repeated, "doc_id", "left_semi"), n), "doc_id")
    return found.join(repeated, "doc_id", "left_anti").unionByName(copies)


def _classes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """near_duplicates() of documents whose ids are distinct or null."""
    percent = round(similarity * 100)
    bands, rows = banding(percent / 100)
    sig = docs.mapInArrow(partial(_signature_rows, words=words, bands=bands, rows=rows), _SIGNATURE)
    sig = _spark.materialize(sig, "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    members = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = members.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = _spark.materialize(members.join(crowded, ["band", "bucket"]), "members")

    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    ranked = members.join(company, "rep").withColumn("rank", F.struct("company", -F.col("rep")))
    centres = ranked.groupBy("band", "bucket").agg(F.max_by(F.struct("rep", "n_shingles"), "rank").alias("centre"))
    pairs = members.join(centres, ["band", "bucket"]).where("rep <> centre.rep")
    pairs = pairs.where(f"100 * least(n_shingles, centre.n_shingles) >= {percent} * greatest(n_shingles, centre.n_shingles)")
    pairs = pairs.select(F.col("centre.rep").alias("c"), F.col("rep").alias("a")).distinct()
    pairs = _spark.materialize(pairs, "pairs")
    links = _verified(docs, pairs, words, percent)

    near = _spark.materialize(connected_components(links), "components")
    similarity = percent / 100
    agree = similarity - 5.4 * (similarity * (1 - similarity) / (bands * rows)) ** 0.5
    hopeful = _spark.materialize(_apart(members, near, sig).mapInArrow(partial(_hopeful, agree=agree, percent=percent), _MEMBERS), "hopeful")
    parts = hopeful.join(_texts(docs, hopeful.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep"), "rep")
    parts = parts.select(*_BLOCK, *_MEMBER, "text").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)
    more = parts.mapInArrow(partial(_linked_in_parts, agree=agree, words=words, percent=percent), "a long, b long")
    more = _spark.materialize(more, "links")

    roots = _spark.materialize(connected_components(links.unionByName(more)), "components")
    for used in (members, pairs, links, more, near, hopeful):
        _spark.drop(used)
    merged = classes.select("k1", "k2", "n_shingles", "rep", "copies").join(roots, F.col("rep") == F.col("node"), "left")
    merged = merged.where("copies > 1 or root is not null").select("k1", "k2", "n_shingles", F.coalesce("root", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(merged, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

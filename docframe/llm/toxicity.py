"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each document is the set of its hashed unigrams, bigrams and skip-bigrams (one or two words left out).
A coordinate is a feature that enough rows of the training sample have, told apart by its whole 64-bit hash:
what was not seen in training adds nothing, however long the text. FTRL-proximal keeps a learning rate for
each coordinate and its L1 term sets most weights to exactly 0, so what is broadcast is a short list of
(hash, weight).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import _spark, _text

#: Bits of the map that is consulted before the list of hashes.
BITS = 18
#: Bound of the training sample: about so many rows of each class (by hash), none longer than LONGEST characters.
ROWS_PER_CLASS, LONGEST = 6000, 200_000
#: A feature counts if 3 rows and one row in so many of the sample have it; passes end after so many updates.
RARE, UPDATES = 1000, 64_000
SKIPS = (1, 2, 3)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def features(column: pa.Array, chunk: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: lo, hi, the 64-bit hashes of all features, each one's row."""
    data, offsets = _text.utf8(column)
    data = _text.ASCII_LOWER[data]
    for lo, hi in _text.blocks(offsets, chunk):
        own, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, bounds = _text.spans(_WORD[own], at)
        h = _text.span_hashes(own, starts, ends)
        row = np.repeat(np.arange(lo, hi), np.diff(bounds))
        found, rows = [h], [row]
        with np.errstate(over="ignore"):
            for gap in SKIPS:
                if len(h) > gap:
                    same = row[gap:] == row[:-gap]
                    pair = _text.mix64(h[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + h[gap:][same] + np.uint64(gap))
                    found.append(pair)
                    rows.append(row[gap:][same])
        yield lo, hi, np.concatenate(found), np.concatenate(rows)


class _Known:
    """A sorted list of hashes; places() gives those of the features that are in it."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.shift = hashes, np.uint64(64 - BITS)
        self.marked = np.zeros(1 << BITS, bool)
        self.marked[(hashes >> self.shift).astype(np.int64)] = True

    def keys(self, found: np.ndarray, row: np.ndarray) -> np.ndarray:
        """row << 32 | place in the list, sorted and distinct, of the features that are in it."""
        live = np.flatnonzero(self.marked[(found >> self.shift).astype(np.int64)])
        if not len(live):
            return np.zeros(0, np.int64)
        found, row = found[live], row[live]
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        same = self.hashes[at] == found
        return np.unique(row[same] << 32 | at[same])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of rows, the features and in how many of its rows each is."""
    for batch in batches:
        for _, _, found, row in features(batch.column(2)):
            order = np.argsort(found, kind="stable")  # the rows of one feature stay in order
            found, row = found[order], row[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            once = new.copy()
            once[1:] |= row[1:] != row[:-1]
            n = np.add.reduceat(once, np.flatnonzero(new), dtype=np.int64) if len(found) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(n)], ["feature", "n"])


def _sets(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    known = _Known(frequent)
    for batch in batches:
        out = []
        for lo, hi, found, row in features(batch.column(2)):
            keys = known.keys(found, row - lo)
            cuts = np.searchsorted(keys, np.arange(hi - lo + 1) << 32)
            own = (keys & (1 << 32) - 1).astype("<i4")
            out += [own[cuts[i] : cuts[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["h", "label", "features"])


class FtrlProximal:
    """w_i = 0 where |z_i| <= l1, else -(z_i - sign(z_i) l1) / ((beta + sqrt(n_i)) / alpha + l2); the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> float:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        return p


def train(labelled: DataFrame, rows: int = ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes (sorted), weights and bias learned from labelled(doc_id, text, label); rows without text or label don't count."""
    ship(labelled.sparkSession)
    usable = labelled.where("text is not null and label in (0, 1) and doc_id is not null").where(F.length("text") <= LONGEST)
    usable = usable.select("doc_id", F.col("label").cast("int").alias("label"), "text")
    sample = _spark.bounded_sample(usable, "label", ["doc_id", "text"], rows).select("h", "label", "text")
    sample = _spark.materialize(sample, "sample")
    least = max(3, sample.count() // RARE)
    seen = sample.mapInArrow(_counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("feature")
    frequent = np.sort(seen.toArrow().column(0).to_numpy().view(np.uint64))
    found = sample.mapInArrow(partial(_sets, frequent=frequent), "h long, label int, features binary").collect()
    _spark.drop(sample)
    found.sort(key=lambda r: (r["h"], r["label"], r["features"]))
    model = FtrlProximal(len(frequent))
    rng = np.random.default_rng(7)
    sets = [np.frombuffer(r["features"], "<i4") for r in found]
    positive = sum(r["label"] for r in found)
    weight = {1: min(10.0, max(1.0, (len(found) - positive) / max(1, positive))), 0: min(10.0, max(1.0, positive / max(1, len(found) - positive)))}
    for _ in range(max(4, min(60, UPDATES // max(1, len(found)))) if 0 < positive < len(found) else 0):
        for i in rng.permutation(len(found)):
            model.learn(sets[i], found[i]["label"], weight[found[i]["label"]])
    if len({r["label"] for r in found}) == 1:
        return np.zeros(0, np.uint64), np.zeros(0), 4.0 if found[0]["label"] else -4.0
    w = model.weights()
    at = np.flatnonzero(w[:-1])
    return frequent[at], w[at], float(w[-1]) if found else -4.0


def _scored(batches: Iterator[pa.RecordBatch], hashes: np.ndarray, weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    known = _Known(hashes)
    for batch in batches:
        total = np.full(len(batch), bias)
        for lo, hi, found, row in features(batch.column(1)):
            keys = known.keys(found, row - lo)
            total[lo:hi] += np.bincount(keys >> 32, weights[keys & (1 << 32) - 1], hi - lo)
        score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labelled: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text).

    labelled(doc_id, text, label 0/1) are the rows to learn from; held_out is a column of docs that is
    passed on. Null, empty and wordless texts get the bias alone as their score. Without labels of both
    kinds all rows get one score (the seen label's side; 0.018 without any). Equal texts get equal scores,
    other columns are ignored, an empty table gives none.
    """
    ship(docs.sparkSession)
    hashes, weights, bias = train(labelled)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return rows.mapInArrow(partial(_scored, hashes=hashes, weights=weights, bias=bias), "doc_id long, held_out boolean, score double, predicted int")


def with_labels(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """docs(doc_id, text) that have a label, with it; the label table is broadcast only within its bound.

    A doc_id with several labels has the greatest of them; null ids and labels count as none.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    return docs.select("doc_id", "text").join(_spark.small(labels, labels.count()), "doc_id")

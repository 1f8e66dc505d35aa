"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of 64 bytes in both directions, gives every position a distribution over the
learned languages, and a document's probabilities are the mean over all its positions. It is trained in
numpy by back-propagation through time on a bounded sample of labelled rows.
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

WINDOW, HIDDEN = 64, 8
#: Bound of the training sample: rows of each language, and windows cut from each row.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 300, 4
_SPAN = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteGru:
    """Weights by direction: w (3H, 256) input table, u (3H, H), c (3H); v (L, 2H) and b (L) label positions."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["w" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros((3 * hidden, 1), np.float32)
        self.p["v"] = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.p["b"] = np.zeros((len(languages), 1), np.float32)

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) for bytes x (T, B). keep: gets what the backward pass needs, by step."""
        h, (t, b) = self.hidden, x.shape
        w, u = self.p["w" + d] + self.p["c" + d], self.p["u" + d]
        out = np.empty((t, h, b), np.float32)
        state = np.zeros((h, b), np.float32)
        own, rec = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(w, x[k], axis=1, out=own, mode="clip")
            np.matmul(u, state, out=rec)
            gates = own[: 2 * h]
            gates += rec[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:h], gates[h:]
            n = own[2 * h :]
            n += r * rec[2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((k, state, z.copy(), r.copy(), n.copy(), rec[2 * h :].copy()))
            state = out[k]
            np.subtract(keep[-1][1] if keep is not None else self._last(out, k, d), n, out=state)
            state *= z
            state += n
        return out

    def _last(self, out: np.ndarray, k: int, d: str) -> np.ndarray | np.float32:
        last = k - 1 if d == "f" else k + 1
        return out[last] if 0 <= last < len(out) else np.float32(0)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, L, B) of each position's language."""
        both = np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=1)
        logits = self.p["v"] @ both + self.p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the used positions (T, B) and its gradients, by back-propagation through time."""
        h, kept, g = self.hidden, {"f": [], "b": []}, {}
        states = {d: self.run(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=1)
        logits = self.p["v"] @ both + self.p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        scale = 1 / max(1, used.sum())
        at = np.broadcast_to(y[None, None, :], (len(x), 1, len(y)))
        loss = float(-(np.log(np.take_along_axis(prob, at, 1)[:, 0] + 1e-9) * used).sum() * scale)
        delta = prob
        np.put_along_axis(delta, at, np.take_along_axis(delta, at, 1) - 1, 1)
        delta *= used[:, None, :] * np.float32(scale)
        g["v"] = np.einsum("tlb,thb->lh", delta, both)
        g["b"] = delta.sum(axis=(0, 2))[:, None]
        into = np.einsum("lh,tlb->thb", self.p["v"], delta)
        for i, d in enumerate("fb"):
            u = self.p["u" + d]
            gw, gu, gc = np.zeros_like(self.p["w" + d]), np.zeros_like(u), np.zeros((3 * h, 1), np.float32)
            back = np.zeros((h, x.shape[1]), np.float32)
            for k, last, z, r, n, rec in reversed(kept[d]):
                dh = back + into[k, i * h : (i + 1) * h]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (last - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                own = np.concatenate([dz, dr, dn])
                rec_in = np.concatenate([dz, dr, dn * r])
                np.add.at(gw.T, x[k], own.T)
                gu += rec_in @ last.T
                gc += own.sum(axis=1, keepdims=True)
                back = dh * z + u.T @ rec_in
            g["w" + d], g["u" + d], g["c" + d] = gw, gu, gc
        return loss, g

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 96, rate: float = 0.02, seed: int = 2) -> float:
        """Adam over shuffled batches; windows (N, T) of bytes, 0 where a window is not filled. Returns the last mean loss."""
        rng, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        total = epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(len(windows)), []
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                x = np.ascontiguousarray(windows[pick].T)
                loss, g = self.gradients(x, labels[pick], (x > 0).astype(np.float32))
                losses.append(loss)
                step += 1
                shrink = min(1.0, 1 / max(1e-9, np.sqrt(sum(float((a * a).sum()) for a in g.values()))))
                now = rate * (1 - step / (total + 1))
                for k, a in g.items():
                    a = a * shrink
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * a
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * a * a
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def _cut(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (N, width) of each row's bytes, filled up with 0, and each window's row."""
    sizes = np.diff(offsets)
    count = -(-sizes // width)
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][row] + nth * width
    size = np.minimum(width, offsets[1:][row] - begin)
    at = begin[:, None] + np.arange(width)[None, :]
    out = data[np.minimum(at, max(len(data) - 1, 0))]
    out[np.arange(width)[None, :] >= size[:, None]] = 0
    return out, row


def _predict(batches: Iterator[pa.RecordBatch], model: ByteGru, chunk: int = 128 << 10) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    for batch in batches:
        data, offsets = _text.utf8(batch.column(1))
        total = np.zeros((len(batch), len(names)), np.float64)
        places = np.zeros(len(batch), np.float64)
        for lo, hi in _text.blocks(offsets, chunk):
            windows, row = _cut(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], WINDOW)
            for a in range(0, len(row), 4096):
                x = np.ascontiguousarray(windows[a : a + 4096].T)
                used = (x > 0).astype(np.float32)
                pooled = np.einsum("tlb,tb->bl", model.positions(x), used)
                for k in range(len(names)):
                    total[lo:hi, k] += np.bincount(row[a : a + 4096], pooled[:, k], hi - lo)
                places[lo:hi] += np.bincount(row[a : a + 4096], used.sum(axis=0), hi - lo)
        # products of other shapes differ in the last bits: rounded, so that equal texts get equal results in any batch
        total = np.round(total / np.maximum(places, 1)[:, None], 5)
        best = total.argmax(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(names[best], pa.string()), pa.array(np.clip(total.max(axis=1), 0, 1))],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, windows: int = WINDOWS_PER_ROW) -> ByteGru | None:
    """A network for the langs of docs(doc_id, text, lang), from about ``rows`` rows of each (by hash); None without any."""
    usable = docs.where("lang is not null and doc_id is not null").where(F.col("text").rlike("\\p{L}"))
    start = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - _SPAN, F.lit(1))).cast("int") + 1 for k in range(windows)]
    parts = F.array(*(F.substring(F.col("text"), s, F.lit(_SPAN)) for s in start))
    sample = _spark.bounded_sample(usable.select("lang", "doc_id", "text"), "lang", ["doc_id", "text"], rows)
    found = sample.select("lang", "h", "doc_id", parts.alias("parts")).orderBy("lang", "h", "doc_id", "parts").collect()
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return None
    cut, labels = [], []
    for r in found:
        for part in r["parts"]:
            raw = np.frombuffer(part.encode()[:WINDOW], np.uint8)
            if len(raw):
                cut.append(np.pad(raw, (0, WINDOW - len(raw))))
                labels.append(languages.index(r["lang"]))
    model = ByteGru(languages)
    if len(languages) > 1:
        model.fit(np.stack(cut), np.array(labels), epochs=max(4, min(12, 12 * 4800 // max(1, len(cut)))))
    return model


def identify(docs: DataFrame, labelled: DataFrame, held_out) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text).

    labelled(doc_id, text, lang) are the rows to learn from; held_out is a column of docs that is passed
    on. lang_pred is a learned language, ``und`` with score 0 where the text is null or has no letter, or
    nothing could be learned. score is the pooled probability. Equal texts get equal results; other
    columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    model = train(labelled)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("lettered"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text = F.when(F.col("lettered"), F.col("text"))
    out = rows.select("doc_id", text.alias("text"), "held_out").mapInArrow(partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")
    blank = F.col("score") == 0
    return out.select("doc_id", "held_out", F.when(blank, "und").otherwise(F.col("lang_pred")).alias("lang_pred"), "score")

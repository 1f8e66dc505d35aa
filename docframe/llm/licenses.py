"""Licence scans by a trained paragraph classifier, applied with DataFrame functions only.

A paragraph runs to the next blank line, over line breaks; it is read in overlapping windows of words, so
that a notice of up to half a window stands whole in one of them and several notices of a paragraph are
told apart. A window is the set of its word uni-, bi- and trigrams. Sparse logistic regressions over those
n-grams, one for each family and one for ``unknown`` (licensing of other kinds), are trained in numpy on
built-in notices (windows of them, words left out, several in one, amid other text) against texts that use
the same words otherwise. Whole notices are held out to set the temperature that calibrates the
probabilities; the weights are then learned from all. A family is confirmed by a template: a piece of a
notice whose bigrams the window largely contains.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .notices import NAMES, NOTICES, OTHER_TEXTS, OTHERS

#: Words at least one of which every n-gram of the model holds; a window without them has no features (fixed values).
TRIGGERS = (
    "license licensed licenses spdx mit apache gnu gpl lgpl agpl bsd mozilla mpl cc cc0 creative commons copyright rights "
    "reserved permission redistribution redistributions warranty warranties proprietary confidential affero lesser attribution sharealike "
    "noncommercial domain compliance software"
).split()
#: Words of a window and of a step; a template is a piece of at most half a window.
WIDTH, STEP, PIECE = 32, 16, 14
#: Least calibrated probability of a family or of unknown, and least share of a template's bigrams that confirms a family.
PROBABILITY, CONTAINED = 0.5, 0.6
#: One notice of each family in so many is held out for the calibration.
HELD_OUT = 4
VARIANTS = 14
UNKNOWN = "unknown"
_WORD = "[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(_WORD, text.lower().replace("licenc", "licens"))


def _grams(words: list[str]) -> set[str]:
    grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return {g for g in grams if set(g.split(" ")) & set(TRIGGERS)}


def _bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def templates() -> list[tuple[int, list[str]]]:
    """(family, sorted bigrams) of the pieces of all notices; equal ones of a family once."""
    found = set()
    for k, notices in enumerate(NOTICES.values()):
        for words in map(tokens, notices):
            cuts = list(range(0, max(1, len(words) - PIECE // 2), PIECE))
            for a, b in zip(cuts, [*cuts[1:], len(words)]):
                found.add((k, tuple(sorted(_bigrams(words[a : min(b, a + PIECE + PIECE // 2)])))))
    return [(k, list(x)) for k, x in sorted(found) if x]


def _samples(rng: np.random.Generator) -> list[tuple[set[str], set[int], bool]]:
    """(n-grams, classes, held out) of windows; a held-out notice is in no other sample."""
    out, families, unknown = [], list(NOTICES), len(NOTICES)
    filler = lambda: ["x"] * int(rng.integers(0, 12))

    def window(words: list[str]) -> list[str]:
        at = int(rng.integers(0, max(1, len(words) - STEP)))
        return words[at : at + WIDTH]

    def worn(words: list[str]) -> list[str]:
        return [w for w in words if rng.random() > 0.08]

    known = [(tokens(n), k, i % HELD_OUT == HELD_OUT - 1) for k, f in enumerate(families) for i, n in enumerate(NOTICES[f])]
    for words, k, held in known:
        out.append((_grams(words[:WIDTH]), {k}, held))
        for _ in range(VARIANTS):
            out.append((_grams([*filler(), *worn(window(words)), *filler()]), {k}, held))
    for i, text in enumerate(OTHERS):
        for _ in range(VARIANTS):
            words = tokens(text.replace("NAME", str(rng.choice(NAMES))).replace("VERSION", str(rng.integers(1, 9))))
            out.append((_grams([*filler(), *worn(words), *filler()]), {unknown}, i % HELD_OUT == HELD_OUT - 1))
    for i, text in enumerate(OTHER_TEXTS):
        for _ in range(4):
            out.append((_grams([*filler(), *tokens(text), *filler()]), set(), i % HELD_OUT == HELD_OUT - 1))
    for i, word in enumerate(TRIGGERS):  # a word alone is no notice
        out += [(_grams(["x"] * k + [word] + ["x"]), set(), i % HELD_OUT == HELD_OUT - 1) for k in range(4)]
    short = [x for x in known if len(x[0]) <= STEP]
    for _ in range(40 * VARIANTS):  # two notices in one window
        (a, k, held), (b, j, other) = (short[i] for i in rng.integers(0, len(short), 2))
        if held == other:
            out.append((_grams([*a, *filler()[:4], *b]), {k, j}, held))
    return out


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 250, rate: float = 6.0, l1: float = 4e-5) -> tuple[np.ndarray, np.ndarray]:
    """L1-sparse logistic regressions for all columns of y, by proximal gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    moved, moved_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(x)
        moved = 0.8 * moved + x.T @ error
        moved_b = 0.8 * moved_b + error.sum(axis=0)
        w = w - rate * moved
        b = b - rate * moved_b
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


@lru_cache(maxsize=1)
def train(seed: int = 3) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """Classes (the last is unknown), weights by n-gram and biases, both divided by the temperature, and the held-out log loss of a decision."""
    rows = _samples(np.random.default_rng(seed))
    names = [*NOTICES, UNKNOWN]
    vocabulary = sorted(set().union(*(g for g, _, _ in rows)))
    at = {g: i for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(rows), len(vocabulary))), np.zeros((len(rows), len(names)))
    for i, (grams, classes, _) in enumerate(rows):
        x[i, [at[g] for g in grams]] = 1
        y[i, list(classes)] = 1
    held = np.array([h for _, _, h in rows])
    w, b = _fit(x[~held], y[~held])
    z = x[held] @ w + b

    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y[held] > 0, -z, z) / t).mean())

    t = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    w, b = _fit(x, y)
    return names, {g: w[i] / t for g, i in at.items() if np.abs(w[i]).max() > 1e-3}, b / t, loss(t)


def _literal(values: list[str]) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def shown(value: float) -> str:
    """A weight as the applied expression has it."""
    return f"{value:.4g}"


def _doubles(values: list[float]) -> str:
    return f"cast(split('{','.join(map(shown, values))}', ',') as array<double>)"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_notices, n_unknown, families, notices) for each row of docs(doc_id, text).

    notices: array<struct<paragraph, family, probability, contained>>, sorted, one for each family of a
    paragraph, with the figures of its surest window. Paragraphs are runs of lines up to a blank one, counted
    from 0. A paragraph without a confirmed family is ``unknown`` if that class has at least PROBABILITY, or if
    a family has that no template confirms. families: the sorted distinct families, without unknown.
    Null and empty texts have none. Equal texts get equal results, other columns are ignored, an empty table
    gives none.
    """
    names, weights, bias, _ = train()
    grams = sorted(weights)
    n, known = len(names), len(NOTICES)
    trigger = "(?i)(?<![a-z0-9])(?:licence|licenced|licences|" + "|".join(TRIGGERS) + ")(?![a-z0-9])"
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.transform(F.split("text", r"\r?\n[ \t\x0b\x0c\r]*\n", -1), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    parts = F.filter(parts, lambda x: x["text"].rlike(trigger))
    parts = F.transform(parts, lambda x: F.struct(x["paragraph"].alias("paragraph"), F.regexp_extract_all(F.replace(F.lower(x["text"]), F.lit("licenc"), F.lit("licens")), F.lit(_WORD), F.lit(0)).alias("w")))
    df = df.select("doc_id", F.when(F.col("text").rlike(trigger), parts).alias("parts"))
    put = lambda to, sql: df.withColumn(to, F.expr(sql))
    df = put("wins", f"flatten(transform(parts, x -> transform(sequence(0, greatest(size(x.w) - {STEP} - 1, 0), {STEP}), i -> struct(x.paragraph as paragraph, slice(x.w, i + 1, {WIDTH}) as w))))")
    df = put("wins", f"filter(wins, x -> arrays_overlap(x.w, {_literal(TRIGGERS)}))")
    bigrams = "transform(slice(x.w, 1, greatest(size(x.w) - 1, 0)), (a, i) -> concat(a, ' ', x.w[i + 1]))"
    trigrams = "transform(slice(x.w, 1, greatest(size(x.w) - 2, 0)), (a, i) -> concat(a, ' ', x.w[i + 1], ' ', x.w[i + 2]))"
    df = put("wins", f"transform(wins, x -> struct(x.paragraph as paragraph, x.w as w, array_distinct({bigrams}) as bi))")
    places = "map_from_arrays(" + _literal(grams) + f", sequence(0, {len(grams) - 1}))"
    df = put("wins", f"transform(wins, x -> struct(x.paragraph as paragraph, x.bi as bi, transform(array_intersect({_literal(grams)}, array_union(array_union(x.w, x.bi), {trigrams})), g -> {places}[g]) as at))")
    df = put("wins", "filter(wins, x -> size(x.at) > 0)")
    w, b = _doubles([float(v) for g in grams for v in weights[g]]), _doubles([float(v) for v in bias])
    df = put("wins", f"transform(wins, x -> struct(x.paragraph as paragraph, x.bi as bi, transform({b}, (v, k) -> 1 / (1 + exp(-(v + aggregate(x.at, 0D, (s, i) -> s + {w}[i * {n} + k]))))) as p))")
    shares = [[t for f, t in templates() if f == k] for k in range(known)]
    share = ",".join(
        f"if(x.p[{k}] >= {PROBABILITY}, greatest(" + ",".join(f"size(array_intersect(x.bi, {_literal(t)})) / {len(t)}D" for t in own) + ", 0D), 0D)" for k, own in enumerate(shares)
    )
    df = put("wins", f"transform(wins, x -> struct(x.paragraph as paragraph, x.p as p, array({share}) as c))")
    # each window's classes, then the surest window of each paragraph and family
    named = _literal(names)
    sure = f"transform(filter(sequence(0, {known - 1}), k -> x.p[k] >= {PROBABILITY} and x.c[k] >= {CONTAINED}), k -> struct({named}[k] as family, round(x.p[k], 6) as probability, round(x.c[k], 6) as contained))"
    unsure = f"if(array_max(x.p) >= {PROBABILITY}, array(struct('{UNKNOWN}' as family, round(array_max(x.p), 6) as probability, round(array_max(x.c), 6) as contained)), array())"
    df = put("found", f"flatten(transform(wins, x -> transform(if(size({sure}) > 0, {sure}, {unsure}), y -> struct(x.paragraph as paragraph, y.family as family, y.probability as probability, y.contained as contained))))")
    df = put("found", f"filter(found, x -> x.family <> '{UNKNOWN}' or not exists(found, y -> y.paragraph = x.paragraph and y.family <> '{UNKNOWN}'))")
    better = "y.paragraph = x.paragraph and y.family = x.family and (y.probability > x.probability or y.probability = x.probability and y.contained > x.contained)"
    df = put("found", f"array_sort(array_distinct(filter(found, x -> not exists(found, y -> {better}))))")
    notices = F.coalesce("found", F.expr("cast(array() as array<struct<paragraph: int, family: string, probability: double, contained: double>>)"))
    df = df.select("doc_id", notices.alias("notices"))
    sure = F.filter("notices", lambda x: x["family"] != UNKNOWN)
    return df.select("doc_id", F.size(sure).cast("long").alias("n_notices"), (F.size("notices") - F.size(sure)).cast("long").alias("n_unknown"), F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"), "notices")

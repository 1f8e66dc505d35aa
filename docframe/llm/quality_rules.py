"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

The ratio compares two multinomials over hashed word uni- and bigrams: one of trusted target documents,
one of the raw corpus. A document's score is the mean of ``log p_target - log p_raw`` over its n-grams,
so a long document is not favoured. Every document is decided by one threshold, set from trusted documents
that the target counts have not seen: nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Buckets of the hashed n-grams: the size of all that is gathered from the corpus, whatever its size.
BUCKETS = 1 << 14
#: One trusted document in so many is held out of the target counts, to place the threshold.
HELD_OUT = 5
#: The threshold is this quantile of the held-out documents' scores, less half its distance from their median.
QUANTILE, SLACK = 0.001, 0.5
#: Threshold where no trusted document of 50 words is held out.
FALLBACK = -0.25
SMOOTHING = 1.0

#: Fixed value: the characters that part words, as they are (a SQL literal would read an escaped form feed as the letter f).
_WHITE = " \t\n\x0b\x0c\r"
_PREFIX = "_dfq_"


def _c(name: str) -> Column:
    return F.col(_PREFIX + name)


def _put(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.withColumns({_PREFIX + k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()})


def _words(docs: DataFrame) -> DataFrame:
    """Words of each text and a 64-bit hash of each."""
    df = _put(docs, text=F.coalesce(F.col("text"), F.lit("")))
    df = _put(df, trimmed=F.btrim(_c("text"), F.lit(_WHITE)))
    df = _put(df, words=F.when(_c("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split(_c("trimmed"), "[\\x20\\x09-\\x0D]+")))
    return _put(df, hashes=F.transform(_c("words"), lambda x: F.xxhash64(x)))


def _features(buckets: int) -> Column:
    mask = buckets - 1
    h, n = f"{_PREFIX}hashes", f"size({_PREFIX}hashes)"
    return F.expr(
        f"concat(transform({h}, x -> cast(x & {mask} as int)),"
        f" transform(slice({h}, 1, greatest({n} - 1, 0)), (x, i) -> cast(xxhash64(x, {h}[i + 1]) & {mask} as int)))"
    )


def ngram_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with the array of log ratios by bucket, from counts over all texts of docs.

    trusted(doc_id) names the target documents; without any the ratios are all 0.
    """
    trusted = trusted.select(F.col("doc_id").alias(_PREFIX + "id")).where(f"{_PREFIX}id is not null").distinct()
    trusted = _put(_spark.small(trusted, trusted.count()), target=F.lit(1))
    base = docs.select("doc_id", "text").where("text is not null")
    base = base.join(trusted, F.col("doc_id") == _c("id"), "left").select("text", _PREFIX + "target")
    grams = _words(base).select(_PREFIX + "target", F.explode(_features(buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count(_PREFIX + "target").alias("target"))
    counts = F.broadcast(_spark.materialize(counts, "ngrams"))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    p = lambda own, of: (F.coalesce(F.col(own), F.lit(0)) + SMOOTHING) / (F.col(of) + SMOOTHING * buckets)
    ratio = F.when(F.col("all_target") == 0, 0.0).otherwise(F.log(p("target", "all_target")) - F.log(p("raw", "all_raw")))
    rows = every.join(counts, "bucket", "left").withColumns({c: total.select(c).scalar() for c in ("all_raw", "all_target")})
    listed = F.array_sort(F.collect_list(F.struct("bucket", ratio.alias("ratio"))))
    return _spark.materialize(rows.agg(F.transform(listed, lambda x: x["ratio"]).alias("ratios")), "ratios")


def _llr() -> Column:
    return F.expr("aggregate(_dfq_features, 0D, (a, f) -> a + _dfq_ratios[f]) / greatest(size(_dfq_features), 1)")


def fit_threshold(docs: DataFrame, held_out: DataFrame, ratios: DataFrame, buckets: int = BUCKETS) -> float:
    """A score that nearly all clean documents exceed, from a histogram (steps of 0.001) of held-out trusted ones."""
    ids = held_out.select(F.col("doc_id").alias(_PREFIX + "id")).distinct()
    base = docs.select("doc_id", "text").join(_spark.small(ids, ids.count()), F.col("doc_id") == _c("id"), "left_semi")
    base = _put(_words(base).where("size(_dfq_words) >= 50"), features=_features(buckets), ratios=ratios.select("ratios").scalar())
    bins = base.groupBy(F.round(_llr() * 1000).cast("int").alias("bin")).count().orderBy("bin").collect()
    total, seen, low, middle = sum(r["count"] for r in bins), 0, None, None
    for r in bins:
        seen += r["count"]
        low = r["bin"] if low is None and seen >= QUANTILE * total else low
        middle = r["bin"] if middle is None and seen >= 0.5 * total else middle
    return (low - SLACK * (middle - low) - 1) / 1000 if total else FALLBACK


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float | None = None, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    docs needs doc_id and text, trusted(doc_id) names the target documents. Other columns of docs stay,
    except that those named like a result give way. A null text counts as empty: no words, so base_failed.
    llr is the mean log ratio (0 without n-grams, and for every document without trusted ones).
    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.
    kept: not base_failed and llr >= threshold; without a given threshold it is fitted (fit_threshold).
    Repeated rows are decided alike; an empty table gives none.
    """
    trusted = trusted.select("doc_id").where("doc_id is not null")
    out = _spark.remainder("doc_id", HELD_OUT) == 0
    ratios = ngram_ratios(docs, trusted.where(~out), buckets)
    if threshold is None:
        threshold = fit_threshold(docs, trusted.where(out), ratios, buckets)
    df = _put(_words(docs), n="cast(size(_dfq_words) as bigint)")
    windows = F.expr("transform(slice(_dfq_hashes, 1, greatest(size(_dfq_hashes) - 2, 0)), (x, i) -> xxhash64(x, _dfq_hashes[i + 1], _dfq_hashes[i + 2]))")
    lines = F.filter(F.split(_c("text"), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = _put(df, windows=windows, lines=lines, features=_features(buckets), ratios=ratios.select("ratios").scalar())
    df = _put(df, repeats=F.size(F.array_distinct(_c("windows"))) < F.size(_c("windows")))
    # windows in hash order; one is repeated if a neighbour there has its hash
    df = _put(df, sorted=F.when(_c("repeats"), F.expr("array_sort(transform(_dfq_windows, (x, i) -> struct(x, i)))")))
    hit = "filter(_dfq_sorted, (x, k) -> (k > 0 and _dfq_sorted[k - 1].x = x.x) or (k + 1 < size(_dfq_sorted) and _dfq_sorted[k + 1].x = x.x))"
    df = _put(df, hits=F.when(_c("repeats"), F.expr(f"array_sort(transform({hit}, x -> x.i))")))
    covered = "aggregate(_dfq_hits, struct(0L as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last), a -> a.n)"
    results = {
        "n_words": _c("n"),
        "word_chars": F.length(F.array_join(_c("words"), "")).cast("long"),
        "n_symbols": F.regexp_count(_c("text"), F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
        "n_repeat_words": F.when(_c("repeats"), F.expr(covered)).otherwise(F.lit(0)).cast("long"),
        "llr": _llr(),
    }
    kept = [c for c in docs.columns if c not in {*results, "base_failed", "kept"}]
    df = df.select(*kept, *(v.alias(k) for k, v in results.items()))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # a filter on kept must not be pushed below: it would copy all of the above into its condition, many times over
    stays = F.monotonically_increasing_id() >= 0
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & stays)

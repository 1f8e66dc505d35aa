"""run() against brute force where one is known: what each stage keeps."""

import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_decontamination import leaks
from test_operators import components, prose
from tokenizers import Tokenizer

from docframe.llm import packing, pii, queries


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline._spark.materialize(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.count())
        assert docs.select("doc_id").distinct().count() == kept[-1]
    assert kept[0] > kept[1] > kept[2] > 0 and kept[3] <= kept[2] and kept[4] == kept[3]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in docs.collect() for b in bench)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    tokens = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert tokens.count() == kept[-1] and tokens.where("n <> all").isEmpty()


BASE = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, schema, items, labels):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_against_brute_force(spark, tmp_path):
    """Base rules, all pairs, all windows, the scan expression and the tokenizer, each in plain Python."""
    rng = random.Random(3)
    items = {1: "Then Tom Miller bought 12 apples and 7 pears for 30 kg of flour while the old bridge was closed.", 2: prose(rng, 20)}
    texts = {i: prose(rng, 120) for i in range(200)}
    texts |= {300 + i: " ".join(w if rng.random() > 0.01 else "zz" for w in texts[i].split()) for i in range(30)} | {400 + i: texts[i] for i in range(20, 50)}
    texts |= {500 + i: f"{prose(rng, 60)} {items[1 + i % 2].replace('Tom Miller', 'Bob Stone').replace('12', '45')} {prose(rng, 60)}" for i in range(10)}
    texts |= {600 + i: f"{prose(rng, 80)} Mrs Ann Lee, +1 212 555 {1000 + i % 4}, a{i}@b.org, 10.0.0.{i}" for i in range(20)}
    texts |= {700: None, 701: "", 702: "too short", 703: "a b c " * 60}
    texts |= {800 + i: " ".join(f"%%{rng.randrange(30)}" for _ in range(150)) for i in range(20)}
    labels = [(i, 1, 0) for i in range(150)]
    folder = tables(spark, tmp_path, [(i, t, "en", "s", len(t or "")) for i, t in texts.items()], BASE, list(items.items()), labels)

    def well(t):
        words = (t or "").split(" ")
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        return len(words) >= 50 and 100 * len(covered) <= 50 * len(words) and "%%" not in t

    kept = {i: t for i, t in texts.items() if well(t)}
    kept = {i: kept[i] for i, (_, c) in components(kept, 5).items() if i == c}
    kept = {i: kept[i] for i in set(kept) - {d for d, _ in leaks(kept, items)}}
    assert 200 < len(kept) < 240 and not {703, 500} & set(kept)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    clean = {r.doc_id: r.text for r in pii.surrogates(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), queries.PII_KEY).collect()}
    for i, t in kept.items():
        assert (clean[i] == t) == (i < 600) and not re.search(r"Ann Lee|212 555|@b\.org|10\.0\.0\.", clean[i])
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for r in pieces:
        ids = [*tokenizer.encode(clean[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert Counter(r.doc_id for r in pieces) == Counter({i: len(packing.piece_lengths(next(r.doc_tokens for r in pieces if r.doc_id == i), 1024)) for i in kept})


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], BASE, [], [])).count() == 0


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    rng = random.Random(4)
    extra = ["kept", "n_entities", "n_words", "_row", "_id", "h", "llr", "label", "component_id", "item_id", "salt", "blk"]
    schema = BASE + "".join(f", {c} string" for c in extra)
    rows = [(i, f"{prose(rng, 90)} Mr John Smith", None, None, None, *(f"{c}{i}" for c in extra)) for i in range(30)]
    rows += [(30 + i, rows[i][1], *rows[i][2:]) for i in range(5)] + [(None, prose(rng, 80), None, None, None, *extra), (40, None, None, None, None, *extra)]
    folder = tables(spark, tmp_path, rows, schema, [(1, rows[7][1])], [(i, 1, 0) for i in range(30)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline._spark.materialize(stage(spark, docs, folder), f"clash-{name}")
        assert docs.schema.names == [x.split()[0] for x in schema.split(", ")]
    found = {r.doc_id: r for r in docs.collect()}
    assert set(found) == {*range(30), None} - {7}
    assert all(found[i][c] == f"{c}{i}" for i in range(30) if i != 7 for c in extra) and not any("John Smith" in r.text for r in found.values())
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()} == set(found)


def test_repeated_rows_are_reduced_to_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id % 3 = 0"))
    out = corpus_pipeline.near_duplicate_stage(spark, twice, sf)
    once = corpus_pipeline.near_duplicate_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in once.collect())
    other = docs.where("doc_id = 1").withColumns({"text": F.lit("!!"), "source": F.lit("zz")})
    out = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(other), sf).where("doc_id = 1").collect()
    assert [(r.text, r.source) for r in out] == [("!!", "zz")]


def test_registered(spark):
    assert sorted(set(queries.queries()) - {"quality_base_counts"}) == sorted(f"op{i}_{n}" for i, n in enumerate("near_duplicates quality_rules decontamination language_id licenses packing secrets pii perplexity toxicity".split(), 1))

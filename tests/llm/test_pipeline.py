import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm.common import keep
from barloom.llm.mixing import mixed

from .common_frames import documents, empty
from .test_decontamination import shingles
from .test_near import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in kept.items() if any(c.isalpha() for c in t)}
    groups = brute(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in items if s)}
    stages = dict(corpus_pipeline.STAGES)
    left = docs
    for name in ("language_id", "near_dedup", "decontamination"):
        left = stages[name](spark, left, SF)
        assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(kept)
    taken = sorted((r.doc_id, r.text) for r in mixed(docs.where(docs.doc_id.isin(list(kept)))).collect())
    rows = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start)
    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for row, (doc, text) in zip(rows, taken, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_rows(spark):
    docs = documents(spark).withColumn("a.b", F.lit(1)).withColumn("lang_pred", F.lit("clash")).withColumn("known", F.lit(None).cast("double"))
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))  # a copy without an id
    docs = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.lit("Another text of the same id, about a fox and a dog in the garden.")))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = keep(docs, name)
        seen[name] = sorted((r.doc_id or -1) for r in docs.collect())
    assert seen["language_id"] == [-1, -1, 1, 1, 5, 6, 7, 7, 9, 10, 11]
    assert seen["near_dedup"] == [-1, 1, 1, 5, 6, 9, 11]  # 10 holds 20 of its 25 shingles from 6
    assert seen["decontamination"] == seen["near_dedup"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(seen["mixing"])
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_contaminated_rows_go_whatever_their_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, f"well, {item} so"), (1, f"also {item}"), (1, "a clean text of the same id"), (None, "a clean text without an id")], "doc_id long, text string")
    got = sorted(r.text for r in corpus_pipeline.decontaminate(spark, docs, SF).collect())
    assert got == ["a clean text of the same id", "a clean text without an id"]


def test_unlearnt_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = docs.limit(3).withColumn("text", F.lit("все люди рождаются свободными и равными в своём достоинстве и правах")).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs.unionByName(foreign), SF)
    assert kept.where("text LIKE 'все%'").count() == 0 and kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()

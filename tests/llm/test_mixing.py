from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm.mixing import OP2_SQL, mixed, op2_pareto_mix, pareto_mix

from .common_frames import documents, empty

SF = "/root/testdata/sf0.001"


def test_equals_sql_and_reruns_agree(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    r = c.sql(OP2_SQL)
    want = sorted(tuple(x) for x in r.fetchall())
    got = [sorted(tuple(x[k] for k in r.columns) for x in op2_pareto_mix(spark, SF).collect()) for _ in range(2)]
    assert got[0] == got[1] == want


def test_targets_and_bounds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pareto_mix(docs)
    assert out.where("taken > 2 * size OR taken < 0").count() == 0
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("size").alias("largest")).collect()
    total = sum(r["size"] for r in by)
    assert sum(r.target for r in by) == pytest.approx(1.5 * total)
    for r in by:
        assert r.target <= 2 * r["size"] + 1e-6
        assert abs(r.taken - r.target) <= 0.1 * r["size"] + 1, r


def test_rows_that_differ_in_source_alone(spark):
    rows = [(None, "w " * 30, "a"), (None, "w " * 30, "b"), (1, "v " * 60, "a"), (2, "u " * 60, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {(r.doc_id, r.source): r.copies for r in pareto_mix(docs).where("copies > 0").collect()}
    got = Counter((r.doc_id, r.source) for r in mixed(docs).collect())
    assert got == want


def test_water_filling_by_hand(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 10, None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.target for r in pareto_mix(docs).collect()}
    # weights 5, 2, 1 of 45 words: a is capped at 20, the other 25 go 2 to 1, so b gets 16.7
    assert got == {1: 20.0, 2: pytest.approx(50 / 3), 3: pytest.approx(25 / 3)}


def test_inclusion_follows_probabilities(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.expr("repeat('w ', 50)")).otherwise(F.expr("repeat('w ', 200)")).alias("text"), F.lit("s").alias("source"))
    rates = {r["size"]: r.rate for r in pareto_mix(docs, weights=(1.0,), share=0.5, most=2.0).groupBy("size").agg(F.avg("copies").alias("rate")).collect()}
    # expected copies: level * (1, 2), level * (50 + 400) = 0.5 * 250
    assert rates[50] == pytest.approx(0.2778, abs=0.04) and rates[200] == pytest.approx(0.5556, abs=0.04)


def test_odd_rows(spark):
    docs = documents(spark)
    out = pareto_mix(docs).collect()
    assert len(out) == docs.count()
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    rows = mixed(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r.copies for r in out)
    assert pareto_mix(empty(spark)).count() == 0 and mixed(empty(spark)).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ("__id", "__hash", "__source", "__k", "__copies", "id", "hash", "from", "row", "copies", "copy", "text_hash", "a.b")
    docs = spark.createDataFrame([(k, "w " * (k + 1), "s") for k in range(30)], "doc_id long, text string, source string")
    docs = docs.select("doc_id", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in names], "text", "source")
    out = mixed(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == pareto_mix(docs).agg(F.sum("copies")).first()[0] and all(tuple(r)[1:-2] == tuple(f"{c} {r.doc_id}" for c in names) for r in rows)

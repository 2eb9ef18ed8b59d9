"""Approximate nearest neighbours by anisotropic quantisation (operator 6).

The nearest vector by Euclidean distance maximises q.x - |x|^2 / 2, so norms are kept exactly and the
inner product is approximated from four-bit codes, quantised with the score-aware loss. Codebooks are
fitted in one task on a bounded sample (TRAIN vectors, smallest hashes of the id); every vector is encoded
once, two codes a byte, into a table. Of more than k equal vectors only the k + 1 smallest ids are kept there,
as the others cannot be among the k nearest of any query.

Queries are broadcast in blocks of QUERY_BLOCK. A task scans the codes of its rows, ROWS at a time, reranks
the RERANK best of each query exactly, and hands on the k best of all it has seen; these are merged by
query. Vectors do not travel, and nothing but k rows a query and task does. Measured recall at 10 against
brute force is in the tests.

Defined results: vectors that are null, empty, zero, of another dimension than most, or that hold a null
or non-finite component take no part, nor does a null id; rows that repeat an id count once (with the
smallest vector); equal vectors are ranked by id; very long vectors are quantised like others; an empty
table gives no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.anisotropic import Quantiser

TRAIN, ROWS, QUERY_BLOCK, RERANK = 20_000, 16_384, 8192, 160
ENCODED = "vec_id long, vector array<double>, codes binary, norm double"
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sample = pd.concat(list(parts)).sort_values("vec_id")
    if len(sample):
        model = Quantiser.fit(np.stack(sample["vector"].to_numpy()))
        yield pd.DataFrame({"books": [model.books.astype(np.float64).tobytes()], "spaces": [model.books.shape[0]], "eta": [model.eta]})


def _encoder(model, dims: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims)
                codes = model.value.pack(model.value.encode(x))
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "vector": batch.column(1), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": (x**2).sum(1)})

    return encode


def _scanner(model, queries, dims: int, k: int, rerank: int, most: int):
    """The k best of each query among the rows of a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = queries.value
        best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        best = np.full((len(q), k), np.inf)

        def search(part: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(part).sort_by("vec_id").combine_chunks()
            ids, x, norm = table.column("vec_id").to_numpy(), _matrix(table.column("vector").combine_chunks(), dims), table.column("norm").to_numpy()
            codes = model.value.unpack(np.stack([np.frombuffer(c.as_py(), np.uint8) for c in table.column("codes")]))
            n = min(rerank + 1, len(ids))
            for a in range(0, len(q), 256):
                b = min(a + 256, len(q))
                near = norm.astype(np.float32)[None] - 2.0 * model.value.scan(q[a:b], codes)
                top = np.sort(np.argpartition(near, n - 1, axis=1)[:, :n], axis=1)  # equal vectors stay in order of id
                exact = np.sqrt(((x[top] - q[a:b, None]) ** 2).sum(2))
                exact[ids[top] == query_ids[a:b, None]] = np.inf
                dist, who = np.concatenate([best[a:b], exact], 1), np.concatenate([best_id[a:b], ids[top]], 1)
                order = np.lexsort((who, dist), axis=1)[:, :k]
                best[a:b], best_id[a:b] = np.take_along_axis(dist, order, 1), np.take_along_axis(who, order, 1)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                search(held)
                held = []
        if sum(b.num_rows for b in held):
            search(held)
        there = np.isfinite(best)
        yield pa.RecordBatch.from_pydict({"query_id": np.repeat(query_ids, there.sum(1)), "vec_id": best_id[there], "score": best[there]})

    return scan


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, rerank: int = RERANK, rows_at_once: int = ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query among vectors (vec_id, vector)."""
    spark = vectors.sparkSession
    common.ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = common.keep(rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("query").alias("query")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes or not sizes[0].q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, _, n_queries = sizes[0]
    rows = rows.where(F.size("vector") == dims)
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN).coalesce(1)
    fitted = sample.mapInPandas(_fit, "books binary, spaces long, eta double").first()
    books = np.frombuffer(bytes(fitted.books), np.float64).reshape(fitted.spaces, -1, Quantiser.width())
    model = spark.sparkContext.broadcast(Quantiser(dims, books, fitted.eta))
    # of equal vectors only the smallest ids can be among the k nearest of any query
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    once = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1)
    encoded = common.keep(once.select("vec_id", "vector").mapInArrow(_encoder(model, dims), ENCODED), "encoded")
    blocks = -(-n_queries // query_block)
    asked = rows.where("query").select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"))
    found = None
    for c in range(blocks):
        part = asked.where(F.col("block") == c).orderBy("vec_id").toPandas()  # about query_block rows
        if len(part):
            queries = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), np.stack(part["vector"].to_numpy())))
            best = encoded.mapInArrow(_scanner(model, queries, dims, k, rerank, rows_at_once), FOUND)
            best = common.keep(best, "nearest") if blocks > 1 else best
            found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(vectors, F.col("vec_id") % 100 == 0)

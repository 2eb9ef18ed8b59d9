"""Byte-level BPE encoding and decoding of texts (operator 13).

encode() adds the ids of each text, decode() turns ids back into bytes; both work on a row at a time, so that
nothing is shuffled. A worker keeps the ids of units that it has met, in a table of bounded size.

Defined results: a null or empty text has no ids, and no ids give no bytes; texts of any length are encoded
whole; special strings are text like any other; rows with equal doc_id each get their row; an empty table gives
no row; other columns are ignored. An id outside the vocabulary fails the task that decodes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.byte_bpe import ByteBpe, read_ranks
from barloom.llm.pieces import slices



def _bpe(path: str, pattern: str) -> ByteBpe:
    return common.worker_state(("bpe", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each document (doc_id, text)."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                found = bpe.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(ends, np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and data (binary) of each row (doc_id, ids); a null list counts as empty."""
    common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            data = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, data binary")


def decimal_ids(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids again, and digests both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = decode(encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(decimal_ids(ids).cast("binary"), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

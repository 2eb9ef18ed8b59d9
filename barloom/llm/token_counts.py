"""Token counts by a two-tier lookup on the map side (operator 8).

Tier one is a broadcast table of frequent units (words with the space before them) and their
numbers of tokens, at most `table` entries. Tier two is a bounded cache in each Python worker,
filled by the library. No unit is ever shuffled by its text: the only exchange merges the short
lists of frequent units that partitions hand in while the table is built.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts of any length are counted
whole; rows with equal doc_id each get their row; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common, pieces


def _frequent(share: int, most: int):
    """Each partition's most frequent units, counted in one of `share` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and zlib.crc32(text.encode()) % share == 0:
                    seen.update(pieces.keys(text)[1:])
            if len(seen) > 20 * most:  # bounded; rare units may lose counts, which only costs speed
                seen = Counter(dict(seen.most_common(10 * most)))
        top = [(u, n) for u, n in seen.most_common(most) if n > 1 and len(u) <= pieces.LONGEST_CACHED]
        yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    return count


def frequent_units(docs: DataFrame, table: int = 65_536, share: int = 8) -> list[str]:
    """At most `table` frequent units of the corpus: what fits the broadcast bound."""
    lists = docs.select("text").mapInArrow(_frequent(share, table // 4), "unit string, n long")
    top = lists.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table)
    return [r.unit for r in top.collect()]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, table: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    spark = docs.sparkSession
    common.ship(spark)
    frequent = frequent_units(docs, table)
    lengths = np.minimum(pieces.PieceLengths(model, {}).units(frequent), 65535).astype(np.uint16)
    ends = np.cumsum([0, *map(len, frequent)])  # units can hold any character, so that none can part them
    compact = spark.sparkContext.broadcast(("".join(frequent), ends, lengths))
    key = zlib.crc32(ends.tobytes(), zlib.crc32(compact.value[0].encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> pieces.PieceLengths:
            blob, at, n = compact.value
            units = (blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist()))
            return pieces.PieceLengths(model, dict(zip(units, n.tolist(), strict=True)))

        counter = common.worker_state(("lengths", model, key), make)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [k for a, b in pieces.slices(texts) for k in counter.count(texts[a:b])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

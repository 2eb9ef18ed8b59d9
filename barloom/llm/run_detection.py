"""Periodic runs of words (operator 12).

find_runs() lists the runs of each text: maximal stretches of words, `[^\\x20\\x09-\\x0D]+`, with smallest period
q and at least max(least_length, least_periods * q) words, and gives the text without repetitions: words that a
run holds behind its first q words are left out. Documents are looked at in tasks, many at a time, with an
enhanced suffix array over their words; nothing is shuffled.

Defined results: null texts and texts without words have no runs and collapse to an empty text; words compare
by their bytes; the collapsed text joins the kept words by single spaces, whether a word is dropped or not; rows
with equal doc_id each get their row; a text of any length is looked at as a whole, with about 60 bytes of
memory a word (and 4 more for each doubling of its longest repeated stretch); an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.pieces import slices
from barloom.llm.word_runs import periodic_runs

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: doc_id, n words, the runs by start and period, and the kept words.
FOUND = "doc_id long, n long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

Change = Callable[[int | None, np.ndarray], np.ndarray]


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, change: Change | None = None) -> DataFrame:
    """doc_id, n, runs and collapsed of each document (doc_id, text). change takes a doc_id and the numbers of a
    document's words and gives those that are looked at in their place."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts, 1_000_000):
                yield _found(ids[a:b], texts[a:b], least_length, least_periods, change)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def _found(ids: list, texts: list[str], least_length: int, least_periods: int, change: Change | None) -> pa.RecordBatch:
    names: dict[bytes, int] = {}
    sequences = []
    for doc_id, text in zip(ids, texts):
        numbers = np.array([names.setdefault(w, len(names)) for w in text.encode().split()], np.int64)
        sequences.append(change(doc_id, numbers) if change else numbers)
    owner, start, length, period = periodic_runs(sequences, least_length, least_periods)
    at = np.searchsorted(owner, np.arange(len(ids) + 1))
    words = list(names)
    collapsed = []
    for k, numbers in enumerate(sequences):
        mine = slice(at[k], at[k + 1])
        if at[k] < at[k + 1]:
            cover = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(cover, start[mine] + period[mine], 1)
            np.add.at(cover, start[mine] + length[mine], -1)
            numbers = numbers[np.cumsum(cover[:-1]) == 0]
        collapsed.append(b" ".join(map(words.__getitem__, numbers.tolist())))
    runs = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(s) for s in sequences], pa.int64()), pa.ListArray.from_arrays(at.astype(np.int32), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
        schema=_SCHEMA,
    )


def repeated_ends(doc_id: int | None, numbers: np.ndarray) -> np.ndarray:
    """Lets the words of one document in ten, drawn by its id, end in a repetition; none without an id."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(numbers)
    if doc_id is None or h % 10 or not n:
        return numbers
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([numbers[:a], numbers[a + np.arange(n - a) % p]])


def strongest(runs: Column) -> Column:
    """The run of the largest length / period, exactly; ties go to the smaller start, then to the smaller period.
    Null where there is none."""

    def better(best: Column, x: Column) -> Column:
        more, than = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (more > than), x).otherwise(best)  # runs come by start and period

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with a repetition put at the end of one in ten, and their digests."""
    out = find_runs(common.table(spark, sf_dir, "documents"), change=repeated_ends).withColumn("best", strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

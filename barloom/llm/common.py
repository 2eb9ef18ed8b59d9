"""Small helpers that the corpus operators share: shared storage, words, shipping the package."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from contextlib import suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word everywhere in this subpackage: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()
_worker: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it, and bound
    the rows that a worker gets at a time."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # rows hold whole texts
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def worker_state(key, make):
    """What a Python worker keeps from task to task: one object, that of the operator at work. Another
    operator's caches go as soon as this one starts, so that stages in a row do not add up."""
    if key not in _worker:
        _worker.clear()
        give_back()
        _worker[key] = make()
    return _worker[key]


def give_back() -> None:
    """Return memory that this worker has freed to the system: the C library keeps the holes that large
    arrays leave, and a worker lives as long as its executor."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI: spark.checkpoint.dir where it
    is set; where it is not, in local mode (tests), a temporary folder that this process sets."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", "") or (sc.getCheckpointDir() or "")
    if not found:
        if not re.match(r"local(\[[^,]*(,\d+)?\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = sc.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; best effort removal when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone by now; the folder is scratch space
        pass


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost
    executors, and computes df once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """All columns of docs in a struct with names by position: helper columns beside it clash with none."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])


def unpacked(rows: DataFrame, docs: DataFrame, row: str = "row") -> DataFrame:
    """The columns of docs from such a struct."""
    return rows.select(*[F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def first_row(row: str) -> Column:
    """Of a group of packed rows, the one whose columns have the least digest: the same in every run."""
    return F.min_by(row, F.sha2(F.to_json(row).cast("binary"), 256)).alias(row)


def tasks_for(files: DataFrame, most: int = 10_000) -> int:
    """Partitions to read files with, one row a file: a fixed number, which Spark does not merge as it
    would merge the few bytes that the rows themselves have."""
    return max(1, min(most, files.count()))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_bucket(column: Column, n: int) -> Column:
    """crc32 of the value's text, modulo n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI in the shared folder (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")

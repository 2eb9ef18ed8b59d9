"""Reading and writing tables of bars, payloads and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.functions.columns import yes

BARS_1D = "symbol string, ts timestamp, open double, high double, low double, close double, adj_close double, volume double, source string"
BARS_5M = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, cumulative_volume double, source string"
QUOTES = "symbol string, ts timestamp, price double, cumulative_volume double, payload_json string"


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    kind = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    raise ValueError(f"no reader for {path}: csv or parquet is expected")


def load_bars(bars: DataFrame, symbols: list[str] | DataFrame | None = None) -> DataFrame:
    """Bars of some symbols (a list, or a table with a column symbol), in order."""
    if isinstance(symbols, DataFrame):
        bars = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    elif symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    return bars.orderBy("symbol", "ts")


def load_quotes(quotes: DataFrame, session_date: str, symbols: list[str] | None = None, zone: str = "America/New_York") -> DataFrame:
    """Quotes of a New York day: a half-open range of instants."""
    start = F.to_utc_timestamp(F.lit(session_date).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(F.lit(session_date).cast("date"), 1).cast("timestamp"), zone)
    out = quotes.where((F.col("ts") >= start) & (F.col("ts") < end))
    return out.where(F.col("symbol").isin(symbols)) if symbols else out


def merge_last(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Rows by key, those of `new` before those of `old`; columns that one lacks are NULL there."""
    rows = old.withColumn("__load", F.lit(0)).unionByName(new.withColumn("__load", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__load"))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__load")


def upsert_bars(spark: SparkSession, new: DataFrame, path: str, keys: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Insert or replace into a table that is partitioned by session_date; other days stay untouched."""
    new = new.withColumn("session_date", F.to_date("ts"))
    try:
        days = new.select("session_date").distinct()
        old = spark.read.parquet(path).join(F.broadcast(days), "session_date", "left_semi")  # touched days only
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    merged = merge_last(old, new, keys)
    # read and written folders are the same: put the merged days next to them first
    staged = f"{path.rstrip('/')}__staged"
    merged.write.mode("overwrite").parquet(staged)
    write_partitions(spark.read.parquet(staged), path, "session_date")


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


append_daily_archive = upsert_bars


def write_latest_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_payload(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns and all others as JSON text."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("payload_json"))


def load_payload_table(df: DataFrame, schema: str | StructType) -> DataFrame:
    """Key columns and the payload's fields; fields that repeat a key's name are dropped."""
    keys = [c for c in df.columns if c != "payload_json"]
    out = df.withColumn("__p", F.from_json("payload_json", schema))
    fields = [f for f in out.schema["__p"].dataType.fieldNames() if f not in keys]
    return out.select(*keys, *[F.col(f"__p.`{f}`").alias(f) for f in fields])


def save_shortlist(df: DataFrame, path: str) -> None:
    """Replaces the rows of the sessions in df, keeps others."""
    order = Window.partitionBy("session_date").orderBy("symbol")
    out = df.withColumns({"rank_order": F.col("rank_order") if "rank_order" in df.columns else F.row_number().over(order), "score": F.col("score") if "score" in df.columns else F.lit(0.0)})
    write_partitions(to_payload(out, ["session_date", "symbol", "rank_order", "score"]), path, "session_date")


def write_reports(report: DataFrame, summary: DataFrame, run: DataFrame, path: str) -> None:
    report.write.mode("overwrite").parquet(f"{path}/report")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    report.where(yes(F.col("breakout_signal"))).write.mode("overwrite").option("header", True).csv(f"{path}/signals")
    run.write.mode("overwrite").json(f"{path}/run")

"""Bars, quotes, fills and other inputs derived from the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_price() -> tuple:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return 50.0 + F.col("l_extendedprice") / 2000.0, order


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume from lineitem by supplier and ship date.

    Lines are exchanged by symbol before they are added up (most days have one line), so that windows over a
    symbol's bars find them together and in order: no other exchange, no other sort."""
    price, order = _line_price()
    keys = {"symbol": F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0")), "date": F.to_date("l_shipdate")}
    rows = table(spark, sf_dir, "lineitem").withColumns({**keys, "px": price, "o": order}).repartition("symbol")
    return rows.groupBy("symbol", "date").agg(
        F.min_by("px", "o").alias("open"),
        F.max(F.col("px") * (1.0 + F.col("l_discount"))).alias("high"),
        F.min(F.col("px") * (1.0 - F.col("l_tax"))).alias("low"),
        F.max_by("px", "o").alias("close"),
        (F.sum("l_quantity") * 1000.0).alias("volume"),
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, market_cap, industry, sector from suppliers and where they are."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("symbol"), F.col("s_acctbal").alias("market_cap"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


#: Users that trade one symbol of the events: symbols grow with the table.
USERS = 15


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return e.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("E"), F.floor(F.col("user_id") / USERS).cast("string")).alias("symbol"), (20.0 + F.col("value") / 10.0).alias("px"), k.alias("k"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (5-minute wall clock), session_date, open, high, low, close, volume from events."""
    e = _events(spark, sf_dir)
    minute = F.date_trunc("hour", F.col("ts").cast("timestamp")) + F.make_dt_interval(mins=(F.floor(F.minute("ts") / 5) * 5).cast("int"))
    rows = e.withColumns({"bar": minute.cast("timestamp_ntz"), "up": F.col("px") * (1.0 + 0.001 * (F.col("event_id") % 7)), "down": F.col("px") * (1.0 - 0.001 * (F.col("event_id") % 5))})
    return rows.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min(F.to_date("bar")).alias("session_date"),
        F.min_by("px", "event_id").alias("open"),
        F.max("up").alias("high"),
        F.min("down").alias("low"),
        F.max_by("px", "event_id").alias("close"),
        F.sum("k").alias("volume"),
    )


def daily_of(bars: DataFrame) -> DataFrame:
    """Intraday bars rolled up to daily bars."""
    return bars.groupBy("symbol", F.col("session_date").alias("date")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, cumulative_volume (by day) from events."""
    e = _events(spark, sf_dir)
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("px").alias("price"), F.sum("k").over(day.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_volume"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, side, shares, price and a total order from lineitem by part."""
    price, order = _line_price()
    side = F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell")
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"), side.alias("side"), F.col("l_quantity").cast("long").alias("shares"), price.alias("price"), order.alias("o"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, equity from orders by day; one row a day."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("t"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("m", F.avg("t").over(Window.partitionBy())).select("date", (100000.0 + F.sum((F.col("t") / F.col("m") - 1.0) * 500.0).over(run)).alias("equity"))

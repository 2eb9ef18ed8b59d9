"""Cleaning, filters and data quality of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import require_columns, yes

BAR = ("open", "high", "low", "close", "volume")
NEW_YORK = "America/New_York"


def normalize_symbol(c: str | Column) -> Column:
    """Trimmed, upper case, dots as dashes."""
    return F.translate(F.upper(F.trim(F.col(c) if isinstance(c, str) else c)), ".", "-")


def number(c: str) -> Column:
    """The value as a double; NULL for NaN and for what is no number."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def normalize_daily_bars(df: DataFrame) -> DataFrame:
    """Lower-case names, ts as date, numbers, rows without key dropped, seven columns."""
    df = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    if "date" not in df.columns and "ts" in df.columns:
        df = df.withColumnRenamed("ts", "date")
    require_columns(df, "symbol", "date", *BAR)
    out = df.select(normalize_symbol("symbol").alias("symbol"), F.to_date("date").alias("date"), *[number(c).alias(c) for c in BAR])
    return out.dropna(subset=["symbol", "date"])


def normalize_intraday_bars(df: DataFrame, utc: bool = True, zone: str = NEW_YORK) -> DataFrame:
    """As daily bars, with ts in New York wall clock (UTC instants converted, others kept) and its date."""
    df = df.withColumnsRenamed({c: c.lower() for c in df.columns})
    require_columns(df, "symbol", "ts", *BAR)
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone) if utc else F.col("ts").cast("timestamp")
    out = df.select(normalize_symbol("symbol").alias("symbol"), ts.alias("ts"), *[number(c).alias(c) for c in BAR])
    return out.withColumn("session_date", F.to_date("ts")).dropna(subset=["symbol", "ts"])


def wide_to_long_bars(df: DataFrame, symbols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns named `SYMBOL|Field` beside `date` -> one row a symbol and date; and the asked symbols
    that have no rows."""
    values = [c for c in df.columns if c != "date"]
    long = df.unpivot("date", values, "name", "value").withColumns({"symbol": normalize_symbol(F.split("name", r"\|")[0]), "field": F.lower(F.regexp_replace(F.split("name", r"\|")[1], " ", "_"))})
    fields = sorted({c.split("|")[1].lower().replace(" ", "_") for c in values})
    rows = long.groupBy("symbol", "date").pivot("field", fields).agg(F.first("value", ignorenulls=True)).dropna(how="all", subset=fields)
    asked = df.sparkSession.createDataFrame([(s,) for s in symbols or []], "symbol string").select(normalize_symbol("symbol").alias("symbol"))
    return rows, asked.join(rows.select("symbol").distinct(), "symbol", "left_anti")


def dedupe_keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def tradeability_flags(daily: DataFrame, min_price: float = 5.0, min_volume: float = 1e6, min_dollar_volume: float = 1e7) -> DataFrame:
    dollars = F.col("close") * F.col("volume")
    ok = yes((F.col("close") >= min_price) & (F.col("volume") >= min_volume) & (dollars >= min_dollar_volume))
    return daily.withColumns({"dollar_volume": dollars, "tradeable": ok.cast("byte")})


def session_fields(df: DataFrame) -> DataFrame:
    """minutes_from_open (from 9:30; rows before are dropped), slot of five minutes and bucket."""
    minutes = F.hour("ts") * 60 + F.minute("ts") - 570
    out = df.withColumn("minutes_from_open", minutes).where("minutes_from_open >= 0")
    return out.withColumns({"slot": F.floor(F.col("minutes_from_open") / 5).cast("int"), "session_bucket": session_bucket(F.col("minutes_from_open"))})


def session_bucket(m: Column) -> Column:
    return F.when(m.between(0, 90), "open_drive").when(m.between(95, 300), "midday").when(m > 300, "power_hour").otherwise("off_hours")


def in_signal_window(m: Column, low: int = 5, high: int = 90) -> Column:
    return m.between(low, high)


def scope_daily_history(daily: DataFrame, first, last, lookback_days: int = 450) -> DataFrame:
    """Daily rows of the sessions and of the calendar days before."""
    return daily.where(F.col("date").between(F.date_sub(F.lit(first).cast("date"), lookback_days), F.lit(last).cast("date")))


def setup_candidates(scored: DataFrame, first, last, floor: float = 0.0, normal: float = 60.0, override: float = 50.0) -> DataFrame:
    """Rows within dates with enough history, a leader and the setup floor; with their tier."""
    s = F.col("setup_score_pre")
    tier = F.when(s >= normal, "normal").when(s >= override, "override").otherwise("none")
    dates = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return scored.where(dates & yes(F.col("history_ok")) & yes(F.col("leader_pass")) & yes(s >= floor)).withColumn("setup_tier", tier)


def audit_symbol_gaps(bars: DataFrame, expected: DataFrame, tolerance_days: int = 0) -> DataFrame:
    """status fresh, stale or missing of each expected symbol against the newest bar among them."""
    latest = bars.groupBy("symbol").agg(F.max("ts").alias("latest_ts"))
    rows = expected.select("symbol").distinct().join(latest, "symbol", "left")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("latest_ts").alias("reference_ts"))))  # one row
    gap = F.datediff("reference_ts", "latest_ts")
    status = F.when(F.col("latest_ts").isNull(), "missing").when(gap > tolerance_days, "stale").otherwise("fresh")
    return rows.select("symbol", "latest_ts", "reference_ts", gap.alias("gap_days"), status.alias("status"))


def latest_ts_by_symbol(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("latest_ts"))


def bars_freshness_days(bars: DataFrame, now: Column) -> DataFrame:
    """Days between now and the newest bar; infinite without bars."""
    age = F.datediff(now, F.max("ts")).cast("double")
    return bars.agg(F.coalesce(age, F.lit(float("inf"))).alias("age_days"))


def signal_time_filter(df: DataFrame, cutoff: str) -> DataFrame:
    return df.where(F.date_format("trigger_time", "HH:mm") >= cutoff)


def signal_score_filter(df: DataFrame, least: float) -> DataFrame:
    return df.where(F.col("trigger_score") >= least)

"""Quotes to five-minute bars, stop alerts and live breakouts, as batch and as stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from barloom.functions.columns import yes
from barloom.operators.intraday import against_baseline, first_trigger, session_running, standard_breakouts

MINUTES = 5
STATE = "start long, open double, high double, low double, close double, volume double, cum double"


def clean_quotes(df: DataFrame) -> DataFrame:
    """Upper-case symbol, numeric price, missing cumulative volume as 0; rows without price go."""
    out = df.select(F.upper("symbol").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("price").try_cast("double").alias("price"), F.coalesce(F.col("cumulative_volume").try_cast("double"), F.lit(0.0)).alias("cumulative_volume"))
    return out.where("price IS NOT NULL AND NOT isnan(price)")


def quote_stream(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Clean quotes of a stream, once for each symbol and ts."""
    return clean_quotes(df).withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def quotes_to_bars(quotes: DataFrame) -> DataFrame:
    """Bars of all quotes (batch): volume is the growth of cumulative volume, carried across bars and days; the
    first quote and a day's reset give 0. Quotes are ordered within a symbol's day; from day to day only the
    last cumulative volume is carried."""
    rows = quotes.withColumn("day", F.to_date("ts"))
    last = rows.groupBy("symbol", "day").agg(F.max_by("cumulative_volume", "ts").alias("last"))
    carried = last.select("symbol", "day", F.lag("last").over(Window.partitionBy("symbol").orderBy("day")).alias("carried"))
    before = F.coalesce(F.lag("cumulative_volume").over(Window.partitionBy("symbol", "day").orderBy("ts")), F.col("carried"))
    rows = rows.join(carried, ["symbol", "day"]).withColumn("before", before)
    step = F.greatest(F.lit(0.0), F.col("cumulative_volume") - F.col("before"))
    rows = rows.withColumns({"v": F.coalesce(F.when(F.col("before").isNotNull(), step), F.lit(0.0)), "bar": F.window("ts", f"{MINUTES} minutes")["start"]})
    return rows.groupBy("symbol", F.col("bar").alias("ts")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("v").alias("volume"))


WIDTH = MINUTES * 60_000_000
EVENTS = "symbol string, kind string, us long, open double, high double, low double, close double, volume double"


class BarProcessor(StatefulProcessor):
    """One symbol's open bar and volume counter. A bar goes out when a quote of a later bar comes, or by a timer when
    the watermark passes its end; the counter stays. Quotes of bars that are closed are told as late ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.bar = handle, handle.getValueState("bar", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self.bar.get() if self.bar.exists() else None
        told: list[tuple] = []
        data = pd.concat(list(rows)).sort_values("us")
        for us, price, cum in zip(data["us"].tolist(), data["price"].tolist(), data["cumulative_volume"].tolist()):
            start = us - us % WIDTH
            if s is not None and (start < s[0] or (start == s[0] and s[1] is None)):
                told.append((key[0], "late", us, None, None, None, price, cum))
                continue
            step = max(0.0, cum - s[6]) if s is not None else 0.0
            if s is not None and start == s[0]:
                s = (start, s[1], max(s[2], price), min(s[3], price), price, s[5] + step, cum)
            else:
                if s is not None and s[1] is not None:
                    told.append((key[0], "bar", *s[:6]))
                s = (start, price, price, price, price, step, cum)
        if s is not None:
            self.bar.update(s)
            if s[1] is not None:
                self.handle.registerTimer((s[0] + WIDTH) // 1000)
        if told:
            yield pd.DataFrame(told, columns=[c.split()[0] for c in EVENTS.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.bar.get() if self.bar.exists() else None
        if s is not None and s[1] is not None and (s[0] + WIDTH) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.bar.update((s[0], None, None, None, None, 0.0, s[6]))
            yield pd.DataFrame([(key[0], "bar", *s[:6])], columns=[c.split()[0] for c in EVENTS.split(", ")])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.bar.update((int(r["start"]), *(float(r[c]) for c in ("open", "high", "low", "close", "volume", "cum"))))

    def close(self) -> None:
        pass


def open_bars(history: DataFrame) -> DataFrame:
    """What a stream that follows on clean quotes of a history starts from: each symbol's newest bar, which is still
    open, and its volume counter."""
    newest = quotes_to_bars(history).groupBy("symbol").agg(F.max_by(F.struct("ts", "open", "high", "low", "close", "volume"), "ts").alias("b"))
    counters = history.groupBy("symbol").agg(F.max_by("cumulative_volume", "ts").alias("cum"))
    return newest.join(counters, "symbol").select("symbol", F.unix_micros("b.ts").alias("start"), *[f"b.{c}" for c in ("open", "high", "low", "close", "volume")], "cum")


def bar_events(quotes: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Completed bars (kind `bar`) and quotes of bars that were closed already (kind `late`: close is the price,
    volume the cumulative volume) of a quote stream (quote_stream), with state by symbol; us are microseconds. With a
    history of clean quotes, the state starts from where that ends. Quotes that the watermark excludes do not get
    here; the stream's progress counts them. Needs the RocksDB state store, which is set where none is chosen."""
    spark = quotes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = open_bars(history).groupBy("symbol") if history is not None else None
    rows = quotes.select("symbol", "ts", F.unix_micros("ts").alias("us"), "price", "cumulative_volume")
    return rows.groupBy("symbol").transformWithStateInPandas(BarProcessor(), EVENTS, "Append", "EventTime", start)


def completed_bars(events: DataFrame) -> DataFrame:
    return events.where("kind = 'bar'").select("symbol", F.timestamp_micros("us").alias("ts"), "open", "high", "low", "close", "volume")


def late_quotes(events: DataFrame) -> DataFrame:
    return events.where("kind = 'late'").select("symbol", F.timestamp_micros("us").alias("ts"), F.col("close").alias("price"), F.col("volume").alias("cumulative_volume"))


def bar_stream(quotes: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Completed bars of a quote stream."""
    return completed_bars(bar_events(quotes, history))


def stop_alerts(quotes: DataFrame, positions: DataFrame, peak_at: float = 2.0) -> DataFrame:
    """Quotes at or below a position's stop; the prior-low stop after a large gain is looked at first.
    Works on batches and streams; positions are static and Spark sizes the join."""
    rows = quotes.join(positions, "symbol")
    prior = yes(F.col("partial_profit_taken") & (F.col("peak_close") >= F.col("entry_price") * (1.0 + peak_at)) & (F.col("price") < F.col("prior_day_low")))
    stop = yes(F.col("price") <= F.col("initial_stop"))
    alert = F.when(prior, "prior_low_stop").when(stop, "initial_stop")
    return rows.withColumn("alert", alert).where("alert IS NOT NULL").select("symbol", "ts", "price", "alert")


TRIGGER = "symbol string, session_date date, trigger_time timestamp, trigger_close double, trigger_score double, trigger_cum_vol_ratio double, trigger_bar_vol_ratio double, trigger_move_from_open double, trigger_low double, trigger_session_low_so_far double, trigger_breakout_type string"


def live_breakouts(bars: DataFrame, history: DataFrame, baseline: DataFrame, context: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """First triggers of sessions, as bars arrive: each once, in the folder of the micro-batch that found it
    (out/epoch=n, overwritten where a batch is run again).

    A batch reads its own symbols' bars of its own sessions in the history (a table that the caller's bar sink
    appends to; session_date prunes it) and their rows of the baseline (intraday.slot_baseline of the sessions
    before, which update_baseline carries on from night to night). trigger: as for DataStreamWriter.trigger, all
    that is available at once by default."""

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("session_date", F.to_date("ts"))
        days = [r.session_date for r in rows.select("session_date").distinct().collect()]  # the batch's days
        if not days:
            return
        touched = rows.select("symbol", "session_date").distinct()
        today = history.where(F.col("session_date").isin(days))
        seen = today.unionByName(rows, allowMissingColumns=True).dropDuplicates(["symbol", "ts"]).join(touched, ["symbol", "session_date"], "left_semi")
        slim = baseline.join(touched.select("symbol").distinct(), "symbol", "left_semi")
        found = first_trigger(standard_breakouts(against_baseline(session_running(seen), slim), context))
        told = _earlier(batch.sparkSession, out, epoch)
        found = found if told is None else found.join(told, ["symbol", "session_date"], "left_anti")
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _earlier(spark: SparkSession, out: str, epoch: int) -> DataFrame | None:
    """Sessions that batches before this one have told of."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{TRIGGER}, epoch long").parquet(out).where(F.col("epoch") < epoch).select("symbol", "session_date")


def read_triggers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{TRIGGER}, epoch long").parquet(out)

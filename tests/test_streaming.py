from pyspark.sql import functions as F

from barloom.sources import fixtures as fx
from barloom.operators.intraday import against_baseline, first_trigger, same_slot_volume, session_running, slot_baseline, standard_breakouts, update_baseline
from barloom.streaming.bars import bar_events, bar_stream, clean_quotes, completed_bars, late_quotes, live_breakouts, quote_stream, quotes_to_bars, read_triggers

SF = "/root/testdata/sf0.001"


def key(r):
    return (r.symbol, r.ts, round(r.open, 6), round(r.high, 6), round(r.low, 6), round(r.close, 6), round(r.volume, 6))


def test_stream_equals_batch(spark, tmp_path):
    quotes = fx.quotes(spark, SF).orderBy("ts").toPandas()
    folder = tmp_path / "quotes"
    folder.mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq

    size = -(-len(quotes) // 5)
    for k in range(5):
        part = quotes.iloc[k * size : (k + 1) * size]
        pq.write_table(pa.Table.from_pandas(part, preserve_index=False), folder / f"{k}.parquet", coerce_timestamps="us")
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    run = bar_stream(quote_stream(stream)).writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    got = {key(r) for r in spark.table("bars").collect()}
    want = [key(r) for r in quotes_to_bars(clean_quotes(fx.quotes(spark, SF))).collect()]
    open_bars = {}
    for w in want:  # what no later quote and no watermark has closed yet
        open_bars[w[0]] = max(open_bars.get(w[0], w[1]), w[1])
    closed = {w for w in want if w[1] < open_bars[w[0]]}
    assert closed <= got <= set(want)


def test_volume_is_carried_and_resets_are_cut(spark):
    rows = [("a", "2024-01-02 10:00:00", 1.0, 100.0), ("a", "2024-01-02 10:01:00", 2.0, 130.0), ("a", "2024-01-02 10:16:00", 3.0, 150.0), ("a", "2024-01-03 10:00:00", 4.0, 7.0), ("a", "2024-01-03 10:01:00", None, 9.0)]
    df = clean_quotes(spark.createDataFrame(rows, "symbol string, ts string, price double, cumulative_volume double"))
    got = [(r.open, r.close, r.volume) for r in quotes_to_bars(df).orderBy("ts").collect()]
    assert got == [(1.0, 2.0, 30.0), (3.0, 3.0, 20.0), (4.0, 4.0, 0.0)]


def test_live_triggers_come_once(spark, tmp_path):
    import shutil

    bars = fx.intraday(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    rolled = fx.daily_of(bars)
    context = rolled.select("symbol", F.col("date").alias("session_date"), (F.col("open") * 1.001).alias("pivot_high"), F.lit(False).alias("diag_valid"), F.lit(None).cast("double").alias("diag_resistance"), F.lit(1.0).alias("atr20"), F.col("open").alias("prev_close"))
    last = bars.agg(F.max("session_date")).first()[0]
    old, new = bars.where(F.col("session_date") < last), bars.where(F.col("session_date") == last)
    folder = tmp_path / "bars"
    rows = new.drop("session_date").orderBy("ts").toPandas()
    for k in range(3):  # bars of one session come in three batches; the sink's table grows with them
        part = spark.createDataFrame(rows.iloc[k::3] if k else rows.iloc[0::3])
        part.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    baseline = slot_baseline(session_running(old))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(path):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        live_breakouts(stream, old.unionByName(new), baseline, context, out, path).awaitTermination(240)

    run(mark)
    events = standard_breakouts(same_slot_volume(session_running(bars)), context)
    want = {(r.symbol, r.session_date, r.trigger_time) for r in first_trigger(events).where(F.col("session_date") == last).collect()}
    got = [(r.symbol, r.session_date, r.trigger_time) for r in read_triggers(spark, out).collect()]
    assert want and sorted(got) == sorted(want)
    run(str(tmp_path / "again"))  # a new checkpoint runs all batches again: each overwrites its own folder
    assert sorted((r.symbol, r.session_date, r.trigger_time) for r in read_triggers(spark, out).collect()) == sorted(want)
    shutil.rmtree(out)


def test_baseline_from_night_to_night(spark):
    bars = session_running(fx.intraday(spark, SF)).withColumn("volume", F.when(F.col("slot") % 7 != 3, F.col("volume")))
    bars = session_running(bars.drop("slot", "cum_volume", "session_open", "session_high_so_far", "session_low_so_far", "prev_bar_close"))
    days = [r.session_date for r in bars.select("session_date").distinct().orderBy("session_date").collect()]
    assert len(days) > 25
    of = lambda a, b: bars.where(F.col("session_date").between(days[a], days[b]))
    baseline = slot_baseline(of(0, 11), 8)
    for a, b in ((10, 15), (16, 16), (17, len(days) - 2)):  # the first night repeats two sessions
        baseline = update_baseline(baseline, of(a, b), 8)
    columns = ("slot_volume_mean", "slot_cum_volume_mean", "bar_vol_ratio", "cum_vol_ratio")
    today = bars.where(F.col("session_date") == days[-1])
    rows = lambda df: sorted((r.symbol, r.ts, *(None if r[c] is None else round(r[c], 9) for c in columns)) for r in df.collect())
    want = rows(same_slot_volume(bars, 8, 3).where(F.col("session_date") == days[-1]))
    assert rows(against_baseline(today, baseline, 8, 3)) == want and any(r[2] for r in want) and max(len(r.sessions) for r in baseline.collect()) == 8


def test_restarted_stream_goes_on_from_history_and_tells_late_quotes(spark, tmp_path):
    at = lambda m, sec=0: f"2024-01-02 10:{m:02d}:{sec:02d}"
    old = [("a", at(0), 1.0, 100.0), ("a", at(6), 2.0, 150.0), ("a", at(7), 1.5, 160.0)]
    batches = [
        [("a", at(8), 3.0, 190.0), ("b", at(8), 9.0, 10.0)],  # goes on with the bar that history left open
        [("a", at(11), 4.0, 200.0), ("a", at(6, 30), 7.0, 155.0)],  # the second row's bar is open until the first comes
        [("a", at(7, 30), 8.0, 170.0), ("a", at(16), 5.0, 230.0)],  # its bar is closed by now
        [("a", at(40), 6.0, 260.0), ("b", at(41), 8.0, 30.0)],
    ]
    schema = "symbol string, ts string, price double, cumulative_volume double"
    history = clean_quotes(spark.createDataFrame(old, schema))
    folder, mark, out = str(tmp_path / "in"), str(tmp_path / "mark"), str(tmp_path / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = quote_stream(spark.readStream.schema(schema).parquet(folder), "30 minutes")
        events = bar_events(stream, history)  # a query of its own each time: what it knows is in its checkpoint
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(240)
    events = spark.read.parquet(out)
    got = sorted((r.symbol, r.ts.strftime("%H:%M"), r.open, r.high, r.low, r.close, r.volume) for r in completed_bars(events).collect())
    assert got == [("A", "10:05", 2.0, 7.0, 1.5, 7.0, 90.0), ("A", "10:10", 4.0, 4.0, 4.0, 4.0, 45.0), ("A", "10:15", 5.0, 5.0, 5.0, 5.0, 30.0), ("B", "10:05", 9.0, 9.0, 9.0, 9.0, 0.0)]
    assert [(r.symbol, r.ts.strftime("%H:%M:%S"), r.price, r.cumulative_volume) for r in late_quotes(events).collect()] == [("A", "10:07:30", 8.0, 170.0)]

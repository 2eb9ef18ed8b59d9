import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import ranks
from barloom.functions.columns import assert_unique, pct_rank, require_columns
from barloom.operators import clean, daily, evaluate, intraday, learn, ledger, levels, report
from barloom.plans import queries
from barloom.sources import fixtures as fx
from barloom.sources import io

SF = "/root/testdata/sf0.001"


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def bars(spark, highs, lows=None, closes=None, symbol="A"):
    lows = lows or [h - 1.0 for h in highs]
    closes = closes or [(h + low) / 2 for h, low in zip(highs, lows)]
    rows = [(symbol, day(k), float(c), float(h), float(low), float(c), 1000.0) for k, (h, low, c) in enumerate(zip(highs, lows, closes))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_percent_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 2.0), ("d", 3.0), ("d", None)], "by string, x double")
    got = sorted((r.x, r.p) for r in df.withColumn("p", pct_rank("x", "by")).collect() if r.x is not None)
    assert got == [(1.0, 0.25), (2.0, 0.625), (2.0, 0.625), (3.0, 1.0)]
    assert df.withColumn("p", pct_rank("x", "by")).where("x IS NULL AND p IS NULL").count() == 1


def test_swing_high_neighbours(spark):
    df = bars(spark, [1, 2, 5, 5, 3, 4, 5, 2, 1]).withColumn("s", levels.swing_high())
    assert [r.s for r in df.orderBy("date").collect()] == [False, False, True, False, False, False, True, False, False]


def test_zigzag_keeps_the_first_of_equals_and_both_at_once(spark):
    highs = [5, 9, 5, 5.5, 9, 5, 5, 12, 5, 5, 5, 5]
    lows = [4, 4.5, 4, 4.2, 4.4, 3.9, 3.8, 1, 3.7, 3.7, 3.7, 3.7]
    got = [(r.i, r.kind) for r in levels.zigzag_pivots(bars(spark, highs, lows), order=1).orderBy("i", "kind").collect()]
    assert got[0] == (2, "high") and (8, "high") in got or (8, "low") in got
    runs = [k for _, k in got]
    assert all(a != b for a, b in zip(runs, runs[1:]))


def loop_zigzag(highs, lows, order):
    n, found = len(highs), []
    for i in range(n):
        around = [j for k in range(1, order + 1) for j in (max(0, i - k), min(n - 1, i + k))]
        if all(highs[i] > highs[j] for j in around):
            found.append((i, 0, "high", highs[i]))
        if all(lows[i] < lows[j] for j in around):
            found.append((i, 1, "low", lows[i]))
    out = []
    for i, _, kind, price in found:
        if out and out[-1][1] == kind:
            better = price > out[-1][2] if kind == "high" else price < out[-1][2]
            if better:
                out[-1] = (i, kind, price)
        else:
            out.append((i, kind, price))
    return [(i + 1, kind) for i, kind, _ in out if i + order <= n - 1]


def test_zigzag_equals_a_loop(spark):
    r = random.Random(3)
    for n in (1, 4, 60):
        highs = [10 + r.randint(0, 6) for _ in range(n)]
        lows = [h - 1 - r.randint(0, 4) for h in highs]
        got = [(x.i, x.kind) for x in levels.zigzag_pivots(bars(spark, highs, lows), 2).orderBy("i", "kind").collect()]
        assert got == loop_zigzag([float(h) for h in highs], [float(x) for x in lows], 2)


def test_anchor_is_the_first_of_two_equal_highs(spark):
    df = daily.anchored_vwap(bars(spark, [5, 9, 6, 9, 7])).orderBy("date").collect()
    typical = [(r.high + r.low + r.close) / 3 for r in df]
    assert df[4].anchored_vwap == pytest.approx(sum(typical[1:]) / 4)


def test_first_trigger_takes_the_first_value_of_each_column(spark):
    rows = [("A", 1, "2024-01-02 09:35:00", 10.0, None), ("A", 1, "2024-01-02 09:40:00", 11.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, n int, t string, close double, cum_vol_ratio double").select("symbol", F.to_timestamp("t").alias("ts"), F.to_date("t").alias("session_date"), "close", "cum_vol_ratio", F.lit(True).alias("broke_out"))
    r = intraday.first_trigger(df, ("close", "cum_vol_ratio")).first()
    assert r.trigger_close == 10.0 and r.trigger_cum_vol_ratio == 2.0 and r.trigger_time.minute == 35


def test_fifo_discards_what_was_not_there(spark):
    rows = [(day(0), "buy", 10, 1.0, 0), (day(1), "sell", 15, 2.0, 1), (day(2), "buy", 5, 3.0, 2), (day(3), "sell", 2, 4.0, 3), (day(4), "sell", 9, 5.0, 4)]
    df = spark.createDataFrame([("A", *r) for r in rows], "symbol string, date date, side string, shares long, price double, o int")
    got = sorted((r.entry_date, r.exit_date, r.shares, r.pnl) for r in ledger.fifo_round_trips(df, ["date", "o"]).collect())
    assert got == [(day(0), day(1), 10, 10.0), (day(2), day(3), 2, 2.0), (day(2), day(4), 3, 6.0)]


@pytest.mark.parametrize(("parts", "days"), [(64, 1), (3, 9), (7, 1000)])  # fills a day; parts of the axis
def test_fifo_equals_a_queue(spark, monkeypatch, parts, days):
    monkeypatch.setattr(ledger, "PARTS", parts)
    r, rows, want = random.Random(4), [], []
    at = lambda k: day(k // days)
    for s in "ABC":
        queue = []
        for k in range(80):
            side, n, price = r.choice(["buy", "sell"]), r.choice([r.randint(1, 300), 10**6]), r.randint(1, 9)
            rows.append((s, at(k), side, n, float(price), k))
            if side == "buy":
                queue.append([k, n, price])
            while side == "sell" and n and queue:
                m = min(n, queue[0][1])
                want.append((s, at(queue[0][0]), at(k), m, float((price - queue[0][2]) * m)))
                queue[0][1] -= m
                n -= m
                if not queue[0][1]:
                    queue.pop(0)
    df = spark.createDataFrame(rows, "symbol string, date date, side string, shares long, price double, o int")
    got = sorted((x.symbol, x.entry_date, x.exit_date, x.shares, x.pnl) for x in ledger.fifo_round_trips(df, ["date", "o"]).collect())
    assert got == sorted(want)


def test_fifo_is_one_exchange_and_spreads_only_long_symbols(spark, monkeypatch):
    r = random.Random(8)
    sizes = {"A": 60, "B": 400, "C": 7, "D": 350, "E": 1}
    rows = [(s, day(k // 3), r.choice(["buy", "sell"]), r.randint(1, 90), float(r.randint(1, 9)), k) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([*rows, (None, day(0), "buy", 5, 1.0, 0), (None, day(1), "sell", 5, 1.0, 1)], "symbol string, date date, side string, shares long, price double, o int")
    plain = ledger.fifo_round_trips(df, ["date", "o"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = sorted(map(tuple, plain.collect()))
    monkeypatch.setattr(ledger, "MANY", 100)
    monkeypatch.setattr(ledger, "BUCKETS", 2)
    assert sorted(ledger._long_symbols(df)) == ["B", "D"]
    assert sorted(map(tuple, ledger.fifo_round_trips(df, ["date", "o"]).collect())) == want and {w[0] for w in want} == set("ABCD")


def test_trade_stats_by_hand(spark):
    trips = spark.createDataFrame([(3.0, 0.3), (-1.0, -0.1), (0.0, 0.0), (5.0, None), (-1.0, 0.2)], "pnl double, ret double")
    assert tuple(ledger.trade_stats(trips).first()) == pytest.approx((5, 0.4, 0.1, 0.1, 4.0))
    assert tuple(ledger.trade_stats(trips.limit(0)).first()) == (0, None, None, None, None)


def test_four_decimals_of_numbers_that_no_long_holds(spark):
    values = [4.5e41, -4.5e41, 1e15, 12.34567, -0.00001, None]
    trades = spark.createDataFrame([(day(k), 1e9) for k in range(5)], "date date, ret double")
    got = [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k").select(queries.r4("x")).collect()]
    assert got[:-1] == pytest.approx([4.5e41, -4.5e41, 1e15, 12.3457, 0.0], rel=1e-15) and got[-1] is None
    curve = queries.rows(ledger.daily_trade_curve(trades, 1000), "day_ret equity", "date").orderBy("date").collect()
    assert [r.equity for r in curve] == pytest.approx([(1 + 1e6) ** (k + 1) for k in range(5)])


def test_entries_as_of_by_hand(spark):
    at = lambda m: dt.datetime(2024, 1, 2, 9, 30) + dt.timedelta(minutes=m)
    d = at(0).date()
    rows = [("A", d, at(m), c, low) for m, c, low in ((0, 1.0, 0.9), (5, 2.0, 0.8), (10, 3.0, 2.9), (15, 4.0, 0.1))] + [("B", d, at(0), 9.0, 9.0)]
    bars_ = spark.createDataFrame(rows, "symbol string, session_date date, ts timestamp_ntz, close double, low double")
    asked = [("A", d, at(5)), ("A", d, at(5)), ("A", d, at(6)), ("A", d, at(-3)), ("A", d, at(16)), ("B", d, at(0)), ("C", d, at(0))]
    signals = spark.createDataFrame(asked, "symbol string, session_date date, trigger_time timestamp_ntz")
    got = {(x.symbol, x.trigger_time): (x.entry_ts, x.entry_close, x.low_at_entry) for x in intraday.entry_as_of(signals, bars_).collect()}
    none = (None, None, None)
    assert got == {("A", at(5)): (at(5), 2.0, 0.8), ("A", at(6)): (at(10), 3.0, 0.8), ("A", at(-3)): (at(0), 1.0, 0.9), ("A", at(16)): none, ("B", at(0)): (at(0), 9.0, 9.0), ("C", at(0)): none}


def exits(spark, highs, lows, closes, entry=10.0, stop=8.0, pivot=9.0):
    b = bars(spark, highs, lows, closes)
    s = spark.createDataFrame([(1, "A", day(0), entry, stop, pivot)], "id long, symbol string, date date, entry double, stop double, pivot double")
    return ledger.exit_rule_outcomes(s, b).first()


def test_stop_beats_partial_on_the_same_day(spark):
    r = exits(spark, [10, 13, 10], [9, 7.5, 9], [10, 9.5, 9.5])
    assert (r.reason, r.exit_date, r.partial, r.exit_price) == ("hard_stop_lod", day(1), False, 8.0)


def test_peak_of_today_counts_from_tomorrow(spark):
    r = exits(spark, [10, 13, 40, 33], [9, 12, 12.5, 11], [10, 12, 31, 30])
    # day 2 closes above three times the entry: its low is not below day 1's; day 3 falls below day 2's low
    assert (r.reason, r.exit_date, r.partial) == ("super_winner_prior_low_stop", day(3), True)


def test_still_open(spark):
    r = exits(spark, [10, 11], [9, 9.5], [10, 10.5])
    assert r.reason == "open" and r.exit_date is None and r.ret == pytest.approx(0.05)


def test_first_day(spark):
    # closes below the pivot on the day of the signal: left at that close; the stop counts from the next day on
    r = exits(spark, [10, 13], [7, 12], [8.5, 12])
    assert (r.reason, r.exit_date, r.exit_price, r.partial) == ("day0_close_below_pivot_exit_all", day(0), 8.5, False) and r.ret == pytest.approx(-0.15)
    # the first day's close is a peak: day 1 takes half and falls below day 0's low
    r = exits(spark, [31, 32, 33], [29, 28, 30], [30.5, 31, 32])
    assert (r.reason, r.exit_date, r.exit_price, r.partial) == ("super_winner_prior_low_stop", day(1), 29.0, True)
    r = exits(spark, [13], [12], [12.5])
    assert (r.reason, r.ret) == ("open", pytest.approx(0.25))


def exits_by_loop(rows, at, entry, stop, pivot, fail_days):
    """Day by day, as a position is kept; rows are (date, high, low, close)."""
    closes = [r[3] for r in rows]
    avg = lambda k, n: sum(closes[k - n + 1 : k + 1]) / n if k >= n - 1 else None
    friday = lambda d: d + dt.timedelta(days=(4 - d.weekday()) % 7)
    if closes[at] < pivot:
        return "day0_close_below_pivot_exit_all", rows[at][0], closes[at], False
    peak, taken = max(entry, closes[at]), False
    for k in range(at + 1, len(rows)):
        d, high, low, close = rows[k]
        if low <= stop:
            return "hard_stop_lod", d, stop, taken
        if (d - rows[at][0]).days <= fail_days and close < pivot:
            return "pivot_fail_exit_all", d, close, taken
        taken = taken or high >= entry * 1.2
        if taken and peak >= 3.0 * entry and low < rows[k - 1][2]:
            return "super_winner_prior_low_stop", d, rows[k - 1][2], True
        week_end = k + 1 == len(rows) or friday(rows[k + 1][0]) != friday(d)
        if taken and week_end and avg(k, 50) is not None and close < avg(k, 50):
            return "weekly_close_below_50dma", d, close, True
        if not taken and avg(k, 21) is not None and close < avg(k, 21):
            return "pre_partial_dma21_exit", d, close, False
        peak = max(peak, close)
    return "open", None, None, taken


def test_exits_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ledger, "BLOCK", 8)  # so that paths run over many blocks
    r = random.Random(21)
    rows, signals, want = [], [], {}
    for s in range(12):
        price, path = 20.0, []
        for k in range(150 + 20 * s):
            price *= math.exp(r.gauss(0.004, 0.035))
            high, low = price * (1 + abs(r.gauss(0, 0.02))), price * (1 - abs(r.gauss(0, 0.02)))
            path.append((day(k + k // 5 * 2), high, low, price))
        rows += [(f"S{s}", d, c, h, low, c, 1.0) for d, h, low, c in path]
        for at in range(0, len(path), 3):
            entry, stop, pivot, fail = path[at][3] * r.choice([1.0, 0.9, 0.4]), path[at][3] * r.choice([0.3, 0.8, 0.95]), path[at][3] * r.choice([0.5, 0.97, 1.001]), r.choice([1, 2, 4])
            key = f"{s}/{at}"
            signals.append((key, f"S{s}", path[at][0], entry, stop, pivot, fail))
            reason, d, x, partial = exits_by_loop(path, at, entry, stop, pivot, fail)
            final = (x if x is not None else path[-1][3]) / entry - 1
            want[key] = (reason, d, x, partial, 0.1 + 0.5 * final if partial else final)
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    asked = spark.createDataFrame(signals, "id string, symbol string, date date, entry double, stop double, pivot double, fail_days int")
    got = {x.id: (x.reason, x.exit_date, x.exit_price, x.partial, x.ret) for x in ledger.exit_rule_outcomes(asked, df).collect()}
    assert got.keys() == want.keys() and {w[0] for w in want.values()} >= {"hard_stop_lod", "pivot_fail_exit_all", "super_winner_prior_low_stop", "weekly_close_below_50dma", "pre_partial_dma21_exit", "open"}
    for k, w in want.items():
        assert got[k][:2] == w[:2] and got[k][3] == w[3] and got[k][2] == (pytest.approx(w[2]) if w[2] else None) and got[k][4] == pytest.approx(w[4]), k


def test_exits_exchange_signals_and_bars_once(spark):
    b = bars(spark, [10, 13, 12, 11], [9, 9, 9, 7], [10, 12, 11, 10.5])
    names = "id long, symbol string, date date, entry double, stop double, pivot double"
    s = spark.createDataFrame([(1, "A", day(0), 10.0, 8.0, 9.0), (2, "A", day(9), 10.0, 8.0, 9.0), (3, "B", day(0), 10.0, 8.0, 9.0), (4, None, day(0), 10.0, 8.0, 9.0), (5, "A", day(0), None, None, None), (6, "A", day(1), 0.0, 1.0, 12.5)], names)
    out = ledger.exit_rule_outcomes(s, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
    got = {r.id: (r.exit_date, r.reason, r.exit_price, r.partial, r.ret) for r in out.collect()}
    none = (None, "open", None, False, None)  # no bar of that day, none of that symbol, no symbol, no levels
    assert got == {1: (day(3), "hard_stop_lod", 8.0, True, pytest.approx(0.0)), 2: none, 3: none, 4: none, 5: none, 6: (day(1), "day0_close_below_pivot_exit_all", 12.0, False, None)}
    own = b.select(F.lit(7).alias("id"), "symbol", "date", F.col("close").alias("entry"), F.col("low").alias("stop"), F.col("low").alias("pivot")).where("close = 10")
    assert [(r.id, r.exit_date, r.reason) for r in ledger.exit_rule_outcomes(own, b).collect()] == [(7, day(1), "hard_stop_lod")]


def test_variants_by_hand(spark):
    b = bars(spark, [10, 13, 12, 11], [9, 9, 9, 7], [10, 12, 11, 10.5])
    s = spark.createDataFrame([(k, "A", day(0), 10.0 + k, 9.0, 9.0, g, t, "09:50") for k, (g, t) in enumerate([(0.0, 80.0), (0.07, 70.0), (0.2, 90.0), (None, None)])], "id long, symbol string, date date, entry double, base double, pivot double, gap double, trigger_score double, trigger_hhmm string")
    every = (ledger.Variant("all"), ledger.Variant("gap", gap_max=0.05), ledger.Variant("late", after="09:55"), ledger.Variant("score", trigger_min=78.0, buffer=0.0025))
    out = ledger.variant_compare(s, b, every)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.variant: (r.n, r.median_ret, r.still_open) for r in out.collect()}
    ret = lambda e, x: x / e - 1
    sold = lambda e, x: 0.1 + 0.5 * ret(e, x)
    want = {e: sold(e, 8.991) if e * 1.2 <= 13 else ret(e, 8.991) for e in (10.0, 11.0, 13.0)}
    assert got == {"all": (3, pytest.approx(sorted(want.values())[1]), 0), "gap": (2, pytest.approx((want[10.0] + want[13.0]) / 2), 0), "score": (1, pytest.approx(sold(10.0, 9.0 * 0.9975)), 0)}


def test_tight_entry_reasons_in_order(spark):
    base = dict(history_ok=True, broke_out=True, leader_score=90.0, setup_score_pre=70.0, trigger_score=85.0, trigger_close=10.1, zigzag_line_value=10.0, prev_close=10.0, open=10.0, adr20_pct=0.05, cum_vol_ratio=2.0, bar_vol_ratio=2.0, pts_hold=5.0)
    rows = [dict(base, k=0), dict(base, k=1, leader_score=1.0, trigger_close=20.0), dict(base, k=2, trigger_close=12.0, open=12.0), dict(base, k=3, open=11.0), dict(base, k=4, adr20_pct=None)]
    schema = "adr20_pct double, bar_vol_ratio double, broke_out boolean, cum_vol_ratio double, history_ok boolean, k int, leader_score double, open double, prev_close double, pts_hold double, setup_score_pre double, trigger_close double, trigger_score double, zigzag_line_value double"
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = [(r.entry_filter_reason, r.entry_stop_policy) for r in report.tight_entry(df).orderBy("k").collect()]
    assert got == [("passed_entry_engine", "ignore_stop_limit"), ("failed_base_signal", "none"), ("entry_distance_norm_too_high", "none"), ("gap_norm_too_high", "none"), ("failed_tight_lane_shape", "none")]


def test_walk_forward_skips_the_first_fold(spark):
    dates = spark.range(40).select(F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("date"))
    got = [tuple(r) for r in learn.walk_forward_folds(dates, 5, 15, 1).orderBy("fold").collect()]
    assert got == [(0, 0, 19, 20, 25), (1, 0, 24, 25, 30), (2, 0, 29, 30, 35), (3, 0, 34, 35, 40)]
    dates = dates.limit(37)  # what is left after five blocks makes the fifth fold
    got = [tuple(r)[2:] for r in learn.walk_forward_folds(dates, 5, 15, 1).orderBy("fold").collect()]
    assert got == [(18, 19, 23), (22, 23, 27), (26, 27, 31), (30, 31, 35), (34, 35, 37)]
    got = [tuple(r)[2:] for r in learn.walk_forward_folds(dates, 5, 15, 0).orderBy("fold").collect()]
    assert got[0] == (15, 15, 19) and got[-1] == (31, 31, 37) and len(got) == 5
    assert learn.walk_forward_folds(dates.limit(15), 5, 15, 1).count() == 0


def test_cost_labels_by_hand(spark):
    rows = [(100.0, 101.0), (100.0, 100.3), (100.0, 100.0), (0.0, 5.0), (None, 5.0)]
    got = [(r.net_return, r.label) for r in intraday.exec_cost_labels(spark.createDataFrame(rows, "next_open double, session_close double")).collect()]

    def by_hand(entry, close):
        penalty = min(0.0040, max(0.0010, 0.0005 + 0.25 * abs(close - entry) / entry))
        return close * (1 - 0.00075) * 0.998 / (entry * (1 + 0.00075 + penalty) * 1.002) - 1

    for (e, c), (net, label) in zip(rows[:3], got):
        assert net == pytest.approx(by_hand(e, c)) and label == int(net > 0)
    assert [x[1] for x in got] == [1, 0, 0, 0] and got[3][0] is None


def test_relative_strength_and_hold_score_by_hand(spark):
    highs = [100.0 * 1.01**k for k in range(300)]
    one = bars(spark, highs, [0.99 * h for h in highs], highs)
    r = daily.base_features(one).withColumn("rs", daily.rs_blend()).orderBy(F.desc("date")).first()
    want = 100 * (0.4 * (1.01**21 - 1) + 0.2 * (1.01**63 - 1) + 0.2 * (1.01**126 - 1) + 0.2 * (1.01**252 - 1))
    assert r.rs == pytest.approx(want)
    adjusted = one.withColumn("adj_close", F.when(F.col("date") < F.lit(day(299)), F.col("close")).otherwise(F.col("close") * 2))
    universe = spark.createDataFrame([("A", "s", "i")], "symbol string, sector string, industry string")
    a, b = (daily.daily_feature_history(x, universe).orderBy(F.desc("date")).first() for x in (one, adjusted))
    assert b.close == pytest.approx(2 * a.close) and b.rs_score > a.rs_score
    early = {x.history_n: x for x in daily.hold_score(one).where("history_n <= 30").collect()}
    assert early[9].hold_pullback == 0.0 and early[10].hold_pullback > 0  # a high of ten rows needs ten
    assert early[20].hold_slope == 0.0 and early[26].hold_slope > 0  # without the longer slope the shorter counts for nothing


def test_order_states_by_hand(spark):
    rows = [("new", 10, 10, "FILLED"), ("rejected", 10, 12, "FILLED"), ("pending cancel", 10, 3, "CANCEL_REQUESTED"), ("cancelled", 10, 3, "CANCELLED"), ("user cancel", 10, 3, "PARTIALLY_FILLED"), ("user cancel", 10, 0, "CANCELLED"), ("order reject", 1, 0, "REJECTED"), ("failure", 1, 0, "FAILED"), ("partial", 5, 1, "PARTIALLY_FILLED"), ("partial", 5, 0, "PARTIAL"), ("filled", 0, 0, "FILLED"), (None, 1, None, "UNKNOWN"), ("submitted", 1, 0, "SUBMITTED")]
    df = spark.createDataFrame(rows, "s string, q int, f int, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ledger.order_status("s", "q", "f")).collect())


def test_sizing_with_missing_values(spark):
    names = "id int, open double, prev_close double, low_so_far_at_trigger double, effective_pivot_level double, pivot_high double, trigger_close double, atr20 double, adr20_pct double, entry_stop_policy string"
    rows = [
        (1, 10.0, 10.0, 9.5, 9.8, None, 10.0, 1.0, 0.1, "respect_stop_limit"),
        (2, 11.0, 10.0, 9.5, 9.8, None, 10.0, 1.0, 0.1, "respect_stop_limit"),  # opens ten percent up
        (3, None, 10.0, 9.5, 9.8, None, 10.0, 1.0, 0.1, "respect_stop_limit"),  # unknown gap
        (4, 10.0, 10.0, None, 9.8, None, 10.0, 1.0, 0.1, "respect_stop_limit"),  # no low
        (5, 10.0, 10.0, 9.5, None, None, 10.0, 1.0, 0.1, "respect_stop_limit"),  # no level
        (6, 10.0, 10.0, 9.5, 9.8, None, 10.0, None, None, "respect_stop_limit"),  # no limit
        (7, 10.0, 10.0, 9.5, 9.8, None, 10.0, 0.1, None, "respect_stop_limit"),  # too wide
        (8, 10.0, 10.0, 9.5, 9.8, None, 10.0, 0.1, 0.01, "ignore_stop_limit"),
        (9, 10.0, 10.0, 10.5, 10.8, None, 10.0, 1.0, 0.1, "respect_stop_limit"),  # no risk
    ]
    got = {r.id: r.shares for r in report.risk_sizing(spark.createDataFrame(rows, names), 9000.0, 9000.0).collect()}
    shares = int(3000 / 10)  # a third of the equity, as a risk of all of it leaves more
    assert got == dict.fromkeys((1, 3, 6, 8), shares)
    small = {r.id: r.shares for r in report.risk_sizing(spark.createDataFrame(rows, names), 9000.0, 9000.0, risk=0.01).collect()}
    assert small == dict.fromkeys((1, 3, 6, 8), int(90 / (10 - 9.5 * 0.999)))


def test_signals_of_every_day_are_sized_by_what_they_have(spark):
    sf = "/root/testdata/sf0.01"
    found = queries._signals(spark, sf).where("low IS NOT NULL AND prev_close > 0 AND atr20 IS NOT NULL AND adr20_pct IS NOT NULL")
    fits = {
        (r.symbol, r.date)
        for r in found.select("symbol", "date", "open", "close", "low", "prev_close", "atr20", "adr20_pct", "leader_score", "resistance_used").collect()
        if r.open / r.prev_close - 1.0 < 0.10 and 0 < (risk := r.close - min(r.low, r.resistance_used) * (1.0 - 0.001)) and ((r.leader_score or 0) >= 90 or risk <= min(r.atr20, r.adr20_pct * r.close))
    }
    whole = {(r.symbol, r.date) for r in found.select("symbol", "date").collect()}
    got = {(r.symbol, r.date) for r in queries.QUERIES["sized_signals"](spark, sf).collect()}
    assert got & whole == fits and any(date.day % 13 == 0 for _, date in got)


def test_priority_bonus_and_missing_ranks(spark):
    report_ = spark.createDataFrame([("A", day(3), 96.0, 10.0, 0.0, 0.0, 0.0), ("B", day(3), 94.0, 10.0, 0.0, 0.0, 0.0)], "symbol string, date date, leader_score double, setup_score_pre double, trigger_score double, cum_vol_ratio double, move_from_open double")
    features = daily.base_features(bars(spark, range(10, 60))).withColumn("runup", daily.prior_runup())
    universe = spark.createDataFrame([("A", "i", None), ("B", None, None)], "symbol string, industry string, market_cap double")
    got = {r.symbol: r for r in report.industry_priority(report_, features, universe).collect()}
    assert got["A"].industry_priority == pytest.approx(25.0 * 36 / 40 + 10.0 * 0.02 / 0.08 + 20.0) and not got["A"].a_plus
    assert got["B"].industry_priority == pytest.approx(25.0 * 34 / 40 + 10.0 * 0.02 / 0.08)
    assert got["A"].small_cap_score == got["B"].industry_rs == 0.5


def test_daily_scores_join_nothing_and_signals_are_kept(spark):
    rows = fx.daily(spark, SF)
    scored = levels.daily_scores(rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 3 and "Join" not in plan  # lines by symbol, bars by date and by symbol again
    names = ["symbol", "date", "rs_today", "leader_score"]
    want = daily.relative_strength(daily.base_features(rows)).select(names)
    assert scored.select(names).exceptAll(want).count() == 0 and scored.count() == want.count()
    priorities = queries.QUERIES["industry_priorities"](spark, SF)
    assert "InMemoryTableScan" in priorities._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_watchlist_exchanges_its_history_by_date_only(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is small by its nature says so
    try:
        plan = queries.QUERIES["watchlist"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = [x.lstrip(" :+-") for x in plan.split("\n")]
    by = lambda *keys: len([x for x in lines if all(f"{k}#" in x for k in keys) and x.startswith("Exchange hash")])
    assert not [x for x in lines if x.startswith("SortMergeJoin [date")]
    assert by("date", "sector") == by("date", "industry") == 1 and by("date") == 3  # those of the means, and the history's


def test_best_point_falls_back_in_steps(spark):
    df = spark.createDataFrame([("a", 5, 9.0, 90.0), ("b", 60, 1.0, 80.0), ("c", 70, 0.5, 95.0)], "grid_id string, n long, score double, leader_min double")
    best = lambda *a: learn.select_best(df, *a).first().grid_id
    assert best(50, F.col("leader_min") >= 90) == "c" and best(50, F.col("leader_min") >= 99) == "b" and best(99, F.col("leader_min") >= 90) == "a" and best(50) == "b"


def test_ranks_and_quantiles_of_whole_columns(spark):
    r = random.Random(6)
    x = [r.choice([None, round(r.gauss(0, 1), 2)]) for _ in range(4000)] + [0.5] * 900
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(6)
    series = pd.Series(x)
    known = series.dropna()
    got = {row.x: row.k for row in ranks.pct_ranks(df, "x", "k").collect()}
    assert got == pytest.approx(dict(zip(known, known.rank(pct=True))))
    probabilities = [0.0, 0.01, 0.5, 0.83, 1.0]
    row = ranks.quantiles(df, "x", probabilities).first()
    assert row.n == len(known) and [row[f"q{i}"] for i in range(5)] == pytest.approx([known.quantile(p) for p in probabilities])
    none = ranks.quantiles(df.where("x IS NULL"), "x", [0.5]).first()
    assert none.n == 0 and none.q0 is None


def test_sweep_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(r.choice([None, r.random()]), r.random(), round(r.gauss(0, 1), 1), -r.random()) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, ret double, mae double").repartition(3)
    grid = spark.createDataFrame([(f"{x}/{y}", x, y) for x in (0.0, 0.3, 0.7) for y in (0.2, 0.5, 0.9, 1.0)], "grid_id string, x double, y double")
    for fan in (3, 64):
        got = {g.grid_id: g for g in learn.threshold_sweep(df, grid, {"a": "x"}, {"b": "y"}, min_count=2, fan=fan).collect()}
        for g in grid.collect():
            mine = [(ret, mae) for a, b, ret, mae in rows if a is not None and a >= g.x and b <= g.y]
            assert len(mine) >= 2
            s, row = pd.Series([m[0] for m in mine]), got[g.grid_id]
            assert (row.n, row.mean_ret, row.median_ret, row.win_rate, row.mean_mae) == pytest.approx((len(mine), s.mean(), s.median(), (s > 0).mean(), sum(m[1] for m in mine) / len(mine)))


def test_logistic_scores_equal_a_plain_fit(spark):
    r = random.Random(3)
    rows = []
    for k in range(400):
        x = [r.gauss(0, 1), r.gauss(0, 2)]
        rows.append((k, day(k % 20), *x, int(x[0] - 0.5 * x[1] + r.gauss(0, 1) > 0.8)))
    df = spark.createDataFrame(rows, "k int, date date, a double, b double, y int")
    fitted = learn.fit_preprocessor(df, ["a", "b"])
    ready = learn.transform(df, fitted)
    p = pd.DataFrame(rows, columns=["k", "date", "a", "b", "y"])
    z = p.groupby("date")[["a", "b"]].transform(lambda c: (c - c.mean()) / c.std(ddof=1))
    z = z.apply(lambda c: c.clip(c.quantile(0.01), c.quantile(0.99)))
    z = (z.fillna(z.median()) - z.fillna(z.median()).mean()) / z.fillna(z.median()).std(ddof=0)
    got = {x.k: (x.a_x, x.b_x, x.score) for x in learn.train_and_score_logistic(ready, ready, ["a_x", "b_x"], "y").collect()}
    x, y = np.column_stack([np.ones(len(z)), z.to_numpy()]), p["y"].to_numpy()
    weight, beta = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), np.zeros(3)
    for _ in range(60):  # Newton's method on the penalised likelihood, the intercept free
        m = 1 / (1 + np.exp(-x @ beta))
        penalty = np.diag([0.0, 1.0, 1.0])
        beta -= np.linalg.solve(x.T @ (x * (weight * m * (1 - m))[:, None]) + penalty, x.T @ (weight * (m - y)) + penalty @ beta)
    want = 1 / (1 + np.exp(-x @ beta))
    for k in range(400):
        assert got[k][:2] == pytest.approx(tuple(z.iloc[k]), abs=1e-6) and got[k][2] == pytest.approx(want[k], abs=1e-4)
    c = learn.coefficient_summary(spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "a", 8.0)], "fold int, feature string, coefficient double")).first()
    assert (c.folds, c.mean, c.median) == (3, 4.0, 3.0)


def plain_fit(x, y, c=1.0):
    """Newton's method on the penalised, balanced likelihood, the intercept free."""
    x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    weight = c * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        m = 1 / (1 + np.exp(-x @ beta))
        beta = beta - np.linalg.solve(x.T @ (x * (weight * m * (1 - m))[:, None]) + penalty, x.T @ (weight * (m - y)) + penalty @ beta)
    return beta


def test_walk_forward_fits_equal_a_plain_fit_a_fold(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        for s in range(12):
            x = [r.gauss(0, 1), r.choice([None, r.gauss(0, 2)]), r.gauss(1, 1)]
            y = None if r.random() < 0.05 else int(x[0] - (x[1] or 0) + r.gauss(0, 2) > 0.5) if k >= 8 else 0
            rows.append((f"S{s:02d}", day(k), *x, y))
    names = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, y int").repartition(7)
    folds = learn.walk_forward_folds(df.select("date"), 4, 10, 3)
    scored, coefficients = evaluate.walk_forward_fits(df, folds, names, "y")
    got = {(x.symbol, x.date): (x.fold, x.score) for x in scored.collect()}
    fits = {(x.fold, x.feature): x.coefficient for x in coefficients.collect()}
    p = pd.DataFrame(rows, columns=["symbol", "date", *names, "y"])
    raw = p.groupby("date")[names].transform(lambda c: (c - c.mean()) / c.std(ddof=1))
    days = sorted(p["date"].unique())
    assert len(fits) == 4 * folds.count()
    seen, checked = 0, 0
    for f in folds.collect():
        train = p["date"].isin(days[: f.train_to]) & p["y"].notna()
        valid = p["date"].isin(days[f.valid_from : f.valid_to])
        low, high = raw[train].quantile(0.01), raw[train].quantile(0.99)
        z = raw.clip(low, high, axis=1)
        z = z.fillna(z[train].median())
        z = (z - z[train].mean()) / z[train].std(ddof=0)
        beta = plain_fit(z[train].to_numpy(), p["y"][train].to_numpy())
        assert [fits[f.fold, n] for n in ["intercept", *names]] == pytest.approx(list(beta), abs=1e-6)
        for i in p[valid].index:
            fold, score = got[p["symbol"][i], p["date"][i]]
            assert fold == f.fold and score == pytest.approx(1 / (1 + math.exp(-beta[0] - z.loc[i].to_numpy() @ beta[1:])), abs=1e-6)
            seen += 1
        mine = p[valid & p["y"].notna()].assign(s=[got[k][1] for k in zip(p["symbol"][valid & p["y"].notna()], p["date"][valid & p["y"].notna()])])
        m = next(x for x in evaluate.fold_metrics(scored, "y", 3, ("c",)).collect() if x.fold == f.fold)
        best = mine.sort_values(["date", "s"], ascending=[True, False]).groupby("date").head(3)
        pos, neg = mine[mine["y"] == 1]["s"], mine[mine["y"] == 0]["s"]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert (m.validation_rows, m.selected_count) == (len(mine), len(best)) and m.validation_start == days[f.valid_from]
        assert (m.positive_rate, m.roc_auc, m.topk_precision, m.topk_recall) == pytest.approx((mine["y"].mean(), auc, best["y"].mean(), best["y"].sum() / len(pos)))
        ranked = mine.sort_values("s", ascending=False)["y"].to_numpy()
        assert m.average_precision == pytest.approx((np.cumsum(ranked) / np.arange(1, len(ranked) + 1))[ranked == 1].mean())
        checked += 1
    assert seen == len(got) and checked == folds.count() >= 2
    summary = {x.feature: x for x in learn.coefficient_summary(coefficients).collect()}
    a = [v for (_, n), v in fits.items() if n == "a"]
    assert (summary["a"].mean, summary["a"].std, summary["a"].median) == pytest.approx((np.mean(a), np.std(a, ddof=1), np.median(a)))


def test_walk_forward_keeps_only_what_its_scores_need(spark):
    scored, _ = queries._walk_forward(spark, SF, "symbol", "date")
    assert scored.columns == ["symbol", "date", "fold", "score"] and scored.count() > 0
    held = re.search(r"InMemoryRelation \[([^]]*)\]", scored._jdf.queryExecution().executedPlan().toString()).group(1)
    assert {x.split("#")[0].strip() for x in held.split(",")} == {"symbol", "date", "y", "day", *[f"{n}_z" for n in queries.MODEL_FEATURES]}
    spark.catalog.clearCache()


def test_folds_of_one_class_have_no_fit(spark):
    rows = [(f"S{s}", day(k), float(s * k % 7), int(k >= 20 and s % 2)) for k in range(40) for s in range(4)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, y int")
    scored, coefficients = evaluate.walk_forward_fits(df, learn.walk_forward_folds(df.select("date"), 3, 10, 1), ["a"], "y")
    assert {x.fold for x in coefficients.collect()} == {x.fold for x in scored.collect()} == {1}
    one = spark.createDataFrame([("S", day(0), 0.5, 1), ("T", day(0), 0.4, 1)], "symbol string, date date, score double, y int")
    assert learn.average_precision(one, "score", "y").first()[0] is None and learn.roc_auc(one, "score", "y").first()[0] is None
    none = learn.top_k_metrics(one.withColumn("y", F.lit(0)), "score", "y", 1).first()
    assert tuple(none) == (0.0, 0.0, 1)
    empty, nothing = evaluate.walk_forward_fits(df.where("a > 99"), learn.walk_forward_folds(df.where("a > 99").select("date"), 3, 10, 1), ["a"], "y")
    assert empty.count() == nothing.count() == 0


def test_quantiles_of_many_columns_at_once(spark, monkeypatch):
    r = random.Random(8)
    rows = [(k % 3, r.choice([None, float("nan"), round(r.gauss(0, 3), 1)]), r.gauss(0, 1), None) for k in range(5000)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double").repartition(5)
    probabilities = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    for small, accuracy in ((20_000, 10_000), (10, 300)):  # the second: through brackets of some fifty values
        monkeypatch.setattr(ranks, "SMALL", small)
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        got = {(x.g, x.column): x for x in ranks.quantiles_by(df, ["a", "b", "c"], probabilities, ("g",)).collect()}
        assert set(got) == {(g, c) for g in range(3) for c in "ab"}
        for (g, c), row in got.items():
            known = pd.Series([x["ab".index(c) + 1] for x in rows if x[0] == g]).dropna().astype(float)
            assert row.n == len(known) and [row[f"q{i}"] for i in range(6)] == pytest.approx([known.quantile(p) for p in probabilities])
            assert (row["mean"], row["std"]) == pytest.approx((known.mean(), known.std()))
    told = {x.feature: x for x in learn.feature_distribution(df, ["a", "b", "c"]).collect()}
    assert told["c"].n == 0 and told["c"].p50 is None and told["b"].n == 5000


def test_truncation_leaves_earlier_rows_unchanged(spark):
    full = fx.daily(spark, SF)
    cut = dt.date(1999, 1, 1)
    columns = ["symbol", "date", "setup_score_pre", "trigger_score_daily", "breakout_type", "daily_signal"]
    a = levels.daily_scores(full).where(F.col("date") <= F.lit(cut)).select(*columns)
    b = levels.daily_scores(full.where(F.col("date") <= F.lit(cut))).select(*columns)
    key = lambda r: (r.symbol, r.date)
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr) and key
    line = lambda df: levels.zigzag_line(df, confirm_bars=3).where(F.col("date") <= F.lit(dt.date(1998, 12, 1))).select("symbol", "date", "zigzag_line_valid")
    assert line(full).count() == line(full.where(F.col("date") <= F.lit(cut))).count()


def test_symbols_do_not_touch(spark):
    one = bars(spark, range(10, 60))
    two = one.unionByName(bars(spark, range(90, 30, -1), symbol="B"))
    a = daily.base_features(one).select("date", "atr14", "pullback_depth", "pivot_high")
    b = daily.base_features(two).where("symbol = 'A'").select("date", "atr14", "pullback_depth", "pivot_high")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ema_equals_a_loop(spark):
    r = random.Random(2)
    rows = []
    for s in ("A", "B"):
        for k in list(range(3)) + list(range(29, 36)) + [70, 100]:  # sessions with gaps, over months
            for m in range(0, 120, 5):
                if r.random() < 0.85:  # bars are missing, also at boundaries
                    at = dt.datetime(2024, 1, 1, 9, 30) + dt.timedelta(days=k, minutes=m)
                    rows.append((s, at, at.date(), r.uniform(9, 11)))
    rows.append(("C", dt.datetime(2024, 1, 1, 9, 40), dt.date(2024, 1, 1), 5.0))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, session_date date, close double").repartition(5)
    for span, least in ((8, 8), (2, 1), (1, 2)):
        got = {(x.symbol, x.ts): x.ema_15m for x in intraday.ema_15m(df, span, least).collect()}
        assert len(got) == len(rows)
        for s in ("A", "B", "C"):
            value, n = None, 0
            for _, at, _, close in sorted(x for x in rows if x[0] == s):
                m = at.hour * 60 + at.minute - 570
                if m % 15 == 0 and m >= 15:
                    value = close if value is None else value + (close - value) * 2 / (span + 1)
                    n += 1
                assert got[s, at] == (pytest.approx(value) if n >= least else None), (s, at)


def test_boundaries_by_hand(spark):
    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    # the bar of 9:45 is the first boundary; that of 10:00 is missing; the next session starts without a sample
    rows = [("A", at(1, 9, 30), 10.0), ("A", at(1, 9, 40), 11.0), ("A", at(1, 9, 45), 12.0), ("A", at(1, 10, 5), 13.0), ("A", at(2, 9, 30), 14.0), ("A", at(2, 9, 45), 15.0)]
    bars_ = spark.createDataFrame([(s, t, t.date(), c, c, c, c, 100.0) for s, t, c in rows], "symbol string, ts timestamp_ntz, session_date date, open double, high double, low double, close double, volume double")
    out = intraday.ema_15m(intraday.session_vwap(bars_), least=1).orderBy("ts").collect()
    sample = 12 / ((10 + 11 + 12) / 3) - 1
    assert [x.close_vs_vwap for x in out] == [None, None, pytest.approx(sample), pytest.approx(sample), None, pytest.approx(15 / 14.5 - 1)]
    assert [x.ema_15m for x in out] == [None, None, 12.0, 12.0, 12.0, pytest.approx(12 + 3 * 2 / 9)]


def test_cleaning(spark):
    raw = spark.createDataFrame([(" brk.b ", "2024-01-02", "1", "2", "x", "nan", "5"), (None, "2024-01-02", "1", "1", "1", "1", "1")], "Symbol string, ts string, Open string, High string, Low string, Close string, Volume string")
    r = clean.normalize_daily_bars(raw).collect()
    assert len(r) == 1 and r[0].symbol == "BRK-B" and r[0].open == 1.0 and r[0].low is None and r[0].close is None
    with pytest.raises(ValueError, match="volume"):
        require_columns(raw, "volume")
    wide = spark.createDataFrame([(day(0), 1.0, 2.0, None, None)], "date date, `aa|Close` double, `aa|Adj Close` double, `bb|Close` double, `bb|Adj Close` double")
    rows, missing = clean.wide_to_long_bars(wide, ["AA", "BB", "CC"])
    assert [tuple(x) for x in rows.collect()] == [("AA", day(0), 2.0, 1.0)] and {x.symbol for x in missing.collect()} == {"BB", "CC"}
    m = spark.createDataFrame([(0,), (90,), (92,), (95,), (300,), (301,)], "m int")
    assert [x.b for x in m.select(clean.session_bucket(F.col("m")).alias("b")).collect()] == ["open_drive", "open_drive", "off_hours", "midday", "midday", "power_hour"]
    with pytest.raises(ValueError):
        assert_unique(m.union(m), "m")


def test_upsert_archive_and_payload(spark, tmp_path):
    def load(rows):
        return spark.createDataFrame(rows, "symbol string, ts timestamp, close double")

    t = dt.datetime(2024, 1, 2, 15)
    path = str(tmp_path / "bars")
    io.upsert_bars(spark, load([("A", t, 1.0), ("B", t, 2.0), ("A", t + dt.timedelta(days=1), 3.0)]), path)
    io.upsert_bars(spark, load([("A", t, 9.0), ("C", t, 4.0)]).withColumn("source", F.lit("x")), path)
    got = sorted((r.symbol, r.ts.day, r.close) for r in spark.read.parquet(path).collect())
    assert got == [("A", 2, 9.0), ("A", 3, 3.0), ("B", 2, 2.0), ("C", 2, 4.0)]
    packed = io.to_payload(spark.createDataFrame([("A", 1, "z")], "symbol string, n int, s string"), ["symbol"])
    assert [tuple(r) for r in io.load_payload_table(packed, "n int, s string, symbol string").collect()] == [("A", 1, "z")]
    short = str(tmp_path / "short")
    for d, s in (("2024-01-02", "A"), ("2024-01-03", "B"), ("2024-01-02", "C")):
        io.save_shortlist(spark.createDataFrame([(d, s)], "session_date string, symbol string"), short)
    assert sorted((str(r.session_date), r.symbol) for r in spark.read.parquet(short).collect()) == [("2024-01-02", "C"), ("2024-01-03", "B")]
    with pytest.raises(ValueError):
        io.read_table(spark, "x.pickle")


def test_report_flow(spark):
    scored = levels.daily_scores(fx.daily(spark, SF))
    std = scored.withColumns({"setup_candidate": F.col("leader_pass"), "broke_out": F.col("breakout_type") != "none", "breakout_signal": F.col("daily_signal"), "trigger_close": F.col("close"), "cum_vol_ratio": F.col("volume") / F.col("vol20"), "trigger_time": F.lit(None).cast("timestamp")})
    zz = levels.daily_zigzag_scores(fx.daily(spark, SF)).withColumns({"broke_out": F.col("close") >= F.col("zigzag_line_value"), "entry_signal": F.lit(False), "trigger_close": F.col("close"), "cum_vol_ratio": F.col("volume") / F.col("vol20"), "trigger_time": F.lit(None).cast("timestamp")}).select("symbol", "date", "history_ok", "leader_score", "setup_score_pre", "broke_out", "entry_signal", "trigger_close", "cum_vol_ratio", "trigger_time", "zigzag_line_value", "setup_candidate", "pivot_high")
    merged = report.merge_lanes(std, zz).cache()
    signals = merged.where("breakout_signal")
    n = signals.count()
    assert n > 0 and signals.where("entry_priority_bucket <> 0 OR entry_lane <> 'compact' OR leader_score < 60 OR cum_vol_ratio < 1.5").count() == 0
    total = report.daily_summary(merged).agg(F.sum("signal_count"), F.sum("standard_count"), F.sum("zigzag_count"), F.sum("tight_reversal_count"), F.sum("setup_count")).first()
    both = merged.where("breakout_signal AND signal_before AND lane_before = 'standard'").count()
    assert tuple(total) == (n, both, 0, 0, merged.where("setup_candidate").count())
    one = report.dedupe_signals(signals)
    assert one.count() == signals.select("symbol", "date").distinct().count()
    assert report.select_candidates(merged, 2, every_date=True).groupBy("date").count().where("count > 2").count() == 0
    s = report.shortlist(merged, 3).collect()
    assert [r.rank_order for r in s] == list(range(1, len(s) + 1)) and s[0].session_date > s[0].date
    assert report.report_sort(merged).count() == merged.count() and "breakout_signal" in report.signals_projection(merged).columns


def test_live_functions(spark):
    q = spark.createDataFrame([("A", 1.0, 5.0), ("A", 9.0, 5.0)], "symbol string, price double, x double").withColumn("ts", F.current_timestamp())
    held = spark.createDataFrame([("A", 2.0, True, 40.0, 10.0, 9.5)], "symbol string, initial_stop double, partial_profit_taken boolean, peak_close double, entry_price double, prior_day_low double")
    from barloom.streaming.bars import stop_alerts

    assert sorted(r.alert for r in stop_alerts(q, held).collect()) == ["prior_low_stop", "prior_low_stop"]


def test_exit_actions_by_hand(spark):
    held = dict(quantity=7, entry_date=day(0), entry_price=10.0, initial_stop=8.0, pivot_level=9.0, initial_shares=7, initial_risk=2.0, partial_profit_taken=False, reduced_on_dma21=False, pending_dma21_grace=False, peak_close=11.0)
    now = dict(date=day(5), high=10.8, low=9.6, close=10.5, prev_low=9.5, dma10=10.0, dma21=9.8, dma50=9.0, week_end=False, hold_score=60.0, tight_low_volume_day=False)
    below21, below10 = dict(close=9.7, dma21=9.8), dict(close=9.9, dma21=9.8, dma10=10.0)
    taken, reduced = dict(partial_profit_taken=True), dict(reduced_on_dma21=True)
    # (position, row, compact, (action, reason, price, target, partial, reduced, grace, peak))
    cases = [
        ({}, dict(low=8.0, close=8.5), True, ("exit_all", "hard_stop_lod", 8.0, 0, False, False, False, 11.0)),
        ({}, dict(date=day(1), close=8.9), True, ("exit_all", "pivot_fail_exit_all", 8.9, 0, False, False, False, 11.0)),
        ({}, dict(date=day(2), close=8.9), True, ("exit_all", "pre_partial_dma21_exit", 8.9, 0, False, False, False, 11.0)),
        (dict(pending_dma21_grace=True), dict(high=12.0), True, ("reduce", "partial_tp_1st", 12.0, 4, True, False, True, 11.0)),  # seven shares leave four
        (dict(peak_close=30.0) | taken, dict(low=9.4), True, ("exit_all", "super_winner_prior_low_stop", 9.5, 0, True, False, False, 30.0)),
        (dict(peak_close=29.9) | taken, dict(low=9.4), True, ("hold", "compact_runner_hold", None, 7, True, False, False, 29.9)),
        (taken, dict(week_end=True, close=8.9), True, ("exit_all", "weekly_close_below_50dma", 8.9, 0, True, False, False, 11.0)),
        (taken, dict(close=11.5), True, ("hold", "compact_runner_hold", None, 7, True, False, False, 11.5)),
        ({}, dict(close=11.5), True, ("hold", "compact_pre_partial_hold", None, 7, False, False, False, 11.5)),
        ({}, dict(close=9.7, dma21=None), True, ("hold", "compact_pre_partial_hold", None, 7, False, False, False, 11.0)),
        ({}, dict(tight_low_volume_day=True) | below21, False, ("hold", "dma21_grace", None, 7, False, False, True, 11.0)),
        (dict(pending_dma21_grace=True), dict(tight_low_volume_day=True, hold_score=45.0) | below21, False, ("hold", "dma21_hold", None, 7, False, False, False, 11.0)),
        ({}, dict(hold_score=30.0) | below21, False, ("reduce", "dma21_reduce_to_small_runner", 9.7, 1, False, True, False, 11.0)),
        (reduced, dict(hold_score=39.9) | below21, False, ("exit_all", "dma21_exit_after_reduce", 9.7, 0, False, True, False, 11.0)),
        (reduced, dict(hold_score=None) | below21, False, ("hold", "dma21_runner_hold", None, 7, False, True, False, 11.0)),
        (dict(pending_dma21_grace=True), dict(hold_score=49.0) | below10, False, ("exit_all", "dma10_holdscore_exit_all", 9.9, 0, False, False, True, 11.0)),
        ({}, dict(hold_score=54.0) | below10, False, ("reduce", "dma10_holdscore_reduce", 9.9, 2, False, False, False, 11.0)),
        (dict(quantity=2), dict(hold_score=54.0) | below10, False, ("hold", "hold", None, 2, False, False, False, 11.0)),
        (taken, dict(week_end=True, close=8.9, dma21=8.0, dma10=8.0), False, ("hold", "hold", None, 7, True, False, False, 11.0)),  # weekly closes count in the compact rules alone
    ]
    pos = pd.DataFrame([dict(held, **p, symbol=f"{k:02d}") if not p else {**held, **p, "symbol": f"{k:02d}"} for k, (p, *_) in enumerate(cases)])
    kinds = "quantity int, entry_date date, entry_price double, initial_stop double, pivot_level double, initial_shares int, initial_risk double, partial_profit_taken boolean, reduced_on_dma21 boolean, pending_dma21_grace boolean, peak_close double, symbol string"
    row_kinds = "date date, high double, low double, close double, prev_low double, dma10 double, dma21 double, dma50 double, week_end boolean, hold_score double, tight_low_volume_day boolean, symbol string"
    latest = spark.createDataFrame([tuple({**now, **r, "symbol": f"{k:02d}"}.values()) for k, (_, r, *_) in enumerate(cases)], row_kinds)
    positions = spark.createDataFrame([tuple(x) for x in pos[[c.split()[0] for c in kinds.split(", ")]].itertuples(index=False)], kinds)
    for compact in (True, False):
        out = {x.symbol: x for x in ledger.exit_action(positions, latest, ledger.ExitRules(compact=compact)).collect()}
        for k, (_, _, when, want) in enumerate(cases):
            if when is compact:
                x = out[f"{k:02d}"]
                assert (x.action, x.reason, x.price, x.target_shares, x.partial_now, x.reduced_now, x.grace_now, x.peak_now) == want, k
    early = ledger.exit_action(positions, latest, ledger.ExitRules(partial_r=0.2)).where("symbol = '08'").first()
    assert (early.reason, early.price) == ("partial_tp_1st", 10.4)  # the nearer of the two targets


def test_parameter_file(spark, tmp_path):
    from pyspark.sql import Row

    from barloom.operators import calibration

    standard = Row(leader_min=85.0, setup_min=58.0, trigger_min=72.0, cum_vol_min=1.2, bar_vol_min=1.0)
    tight = Row(leader_min=80.0, setup_min=57.0, trigger_min=69.0, cum_vol_min=1.0, dist_max=0.8, gap_max=0.7)
    params = calibration.calibrated(standard, tight, source="test")
    assert params["daily_calibration"]["leader_min"] == 80.0 and params["intraday_calibration"]["tight_reversal"]["same_day_stop_rate_max"] == 0.35
    calibration.write_parameters(spark, params, f"{tmp_path}/params")
    assert calibration.read_parameters(spark, f"{tmp_path}/params") == params
    cfg = calibration.report_config(params, min_history=10)
    assert cfg.standard == report.StandardRules(60.0, 72.0, 1.2, 1.0, -1.0, 0.01) and cfg.compact_leader == 80.0 and cfg.min_history == 10
    assert (cfg.tight.leader_min, cfg.tight.setup_min, cfg.tight.max_dist, cfg.tight.max_gap) == (63.0, 57.0, 0.8, 0.7)
    (tmp_path / "part.json").write_text('{"daily_calibration": {"leader_min": 77.0}, "intraday_calibration": {"standard_breakout": {"trigger_min": 5.0}}, "note": 1}')
    found = calibration.read_parameters(spark, f"{tmp_path}/part.json")
    assert found["daily_calibration"]["leader_min"] == 77.0 and found["daily_calibration"]["tight_leader_min"] == 63.0 and found["note"] == 1
    assert found["intraday_calibration"] == {"standard_breakout": {"trigger_min": 5.0}, "tight_reversal": calibration.DEFAULTS["intraday_calibration"]["tight_reversal"]}
    assert calibration.read_parameters(spark, None) == calibration.DEFAULTS and calibration.calibrated(None, None)["daily_calibration"] == calibration.DEFAULTS["daily_calibration"]
    # defaults of the rules and of the report
    assert report.TightEntry() == report.TightEntry(89.0, 57.0, 69.0, 0.0, 0.0, 0.80, 0.70) and report.StandardRules().move_min == -1.0
    t = report.ReportConfig().tight
    assert (t.setup_min, t.trigger_min, t.cum_vol_min, t.max_dist, t.max_gap) == (0.0, 0.0, 1.5, 99.0, 99.0)


def test_bars_and_quotes_of_a_day(spark):
    utc = lambda text: pd.Timestamp(text, tz="UTC").to_pydatetime()
    df = spark.createDataFrame([("B", utc("2024-01-02"), 1.0), ("A", utc("2024-01-03"), 2.0), ("A", utc("2024-01-02"), 3.0), ("C", utc("2024-01-02"), 4.0)], "symbol string, ts timestamp, close double")
    assert [x.close for x in io.load_bars(df, ["A", "B"]).collect()] == [3.0, 2.0, 1.0] and [x.close for x in io.load_bars(df).collect()] == [3.0, 2.0, 1.0, 4.0]
    assert [x.close for x in io.load_bars(df, spark.createDataFrame([("C",), ("C",)], "symbol string")).collect()] == [4.0]
    # New York goes to summer time on 10 March 2024: that day has 23 hours, from 5:00 to 4:00 UTC
    times = ["2024-03-10 04:59:59", "2024-03-10 05:00:00", "2024-03-11 03:59:59", "2024-03-11 04:00:00", "2024-03-12 03:59:59", "2024-03-12 04:00:00"]
    quotes = spark.createDataFrame([("A", utc(t), float(k)) for k, t in enumerate(times)] + [("B", utc(times[1]), 9.0)], "symbol string, ts timestamp, price double")
    of = lambda d, *a: sorted(x.price for x in io.load_quotes(quotes, d, *a).collect())
    assert of("2024-03-09") == [0.0] and of("2024-03-10") == [1.0, 2.0, 9.0] and of("2024-03-10", ["A"]) == [1.0, 2.0] and of("2024-03-11") == [3.0, 4.0] and of("2024-03-12") == [5.0]


def test_snapshots_reports_and_duplicates(spark, tmp_path):
    df = spark.createDataFrame([("A", day(0), 1, True), ("A", day(0), 2, None), ("B", day(1), 3, False)], "symbol string, date date, k int, breakout_signal boolean")
    assert sorted((x.symbol, x.k) for x in clean.dedupe_keep_last(df, ["symbol", "date"], "k").collect()) == [("A", 2), ("B", 3)]
    io.write_latest_snapshot(df, f"{tmp_path}/snap")
    io.write_latest_snapshot(df.where("k = 3"), f"{tmp_path}/snap")  # replaces what was there
    assert [tuple(x) for x in spark.read.parquet(f"{tmp_path}/snap").collect()] == [("B", day(1), 3, False)]
    summary, run = df.groupBy("date").count(), spark.createDataFrame([("r1", 3)], "run string, n int")
    io.write_reports(df, summary, run, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/report").count() == 3 and [x.n for x in spark.read.json(f"{tmp_path}/out/run").collect()] == [3]
    read = lambda name: spark.read.option("header", True).csv(f"{tmp_path}/out/{name}")
    assert [x.k for x in read("signals").collect()] == ["1"] and sorted((x.date, x["count"]) for x in read("summary").collect()) == [("2024-01-01", "2"), ("2024-01-02", "1")]

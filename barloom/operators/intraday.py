"""Session features, same-slot volume and breakout events of intraday bars.

Hash the bars by symbol once (by_symbol): windows by session and by slot then share that exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, div, floor0, session, weighted, yes, zero
from barloom.operators.clean import session_fields


def so_far() -> WindowSpec:
    return session().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def by_symbol(bars: DataFrame) -> DataFrame:
    return bars.repartition("symbol")


def session_running(bars: DataFrame) -> DataFrame:
    """slot (position in the session), running volume and extremes, session open, previous close."""
    return bars.withColumns({
        "slot": F.row_number().over(session()) - 1,
        "cum_volume": F.sum("volume").over(so_far()),
        "session_open": F.first("open").over(so_far()),
        "session_high_so_far": F.max("high").over(so_far()),
        "session_low_so_far": F.min("low").over(so_far()),
        "prev_bar_close": F.lag("close").over(session()),
    })


def minutes_from_open() -> Column:
    """Minutes since 9:30 by the wall clock."""
    return F.hour("ts") * 60 + F.minute("ts") - 570


def at_boundary(every: int = 15) -> Column:
    """Whether a bar stands at a boundary of so many minutes from the open, the open itself left out."""
    m = minutes_from_open()
    return (m % every == 0) & (m >= every)


def session_vwap(bars: DataFrame, every: int = 15) -> DataFrame:
    """VWAP so far, and the close against it, sampled at the boundaries and carried on within the session."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    out = bars.withColumn("vwap", div(F.sum(typical * F.col("volume")).over(so_far()), F.sum("volume").over(so_far())))
    sampled = F.when(at_boundary(every), div("close", "vwap") - 1.0)
    return out.withColumn("close_vs_vwap", F.last(sampled, ignorenulls=True).over(so_far()))


def _carried(parts: str, at: str, keep: float, seen: Column, value: Column, kind: str) -> Column:
    """For parts (at, n, local) in order: what was seen and the average before each of them. A part of n closes
    turns an average a into keep**n * a + local, and such steps follow one another."""
    state = F.struct(F.array().cast(f"array<struct<{at}:{kind},seen:bigint,value:double>>").alias("out"), seen.cast("long").alias("seen"), value.cast("double").alias("value"))

    def step(s: Column, x: Column) -> Column:
        told = F.struct(x[at].alias(at), s["seen"].alias("seen"), s["value"].alias("value"))
        return F.struct(F.array_append(s["out"], told).alias("out"), (s["seen"] + x["n"]).alias("seen"), (s["value"] * F.pow(F.lit(keep), x["n"].cast("double")) + x["local"]).alias("value"))

    return F.aggregate(parts, state, step, lambda s: s["out"])


def ema_15m(bars: DataFrame, span: int = 8, least: int = 8, every: int = 15) -> DataFrame:
    """Exponential average of a symbol's closes at the boundaries, across sessions: a bar has that of the last
    boundary so far, once there were `least` of them; the first close starts it.

    The average is a chain of affine steps, which may be put together in any grouping: a window sums up a session
    by itself, sessions are put together by month and months by symbol (short arrays), and each session then starts
    from what the ones before it left. So a symbol's bars spread over tasks by session, and none is a group."""
    keep = 1.0 - 2.0 / (span + 1.0)
    x = F.when(at_boundary(every), F.col("close"))
    out = bars.withColumn("__x", x).withColumn("__n", F.count("__x").over(so_far()))
    if keep > 0.0:
        weighed = F.col("__x") * (1.0 - keep) * F.pow(F.lit(keep), -F.col("__n").cast("double"))
        local = F.coalesce(F.sum(weighed).over(so_far()), F.lit(0.0)) * F.pow(F.lit(keep), F.col("__n").cast("double"))
    else:
        local = F.coalesce(F.last("__x", ignorenulls=True).over(so_far()), F.lit(0.0))
    out = out.withColumn("__l", local)
    first = F.min_by("__x", F.when(F.col("__x").isNotNull(), F.col("ts"))).alias("first")
    days = out.groupBy("symbol", "session_date").agg(F.max("__n").alias("n"), F.max_by("__l", "ts").alias("local"), first)
    parts = F.sort_array(F.collect_list(F.struct("session_date", "n", "local", "first"))).alias("days")
    months = days.groupBy("symbol", F.trunc("session_date", "month").alias("month")).agg(parts)
    whole_month = F.aggregate("days", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("local")), lambda s, d: F.struct((s["n"] + d["n"]).alias("n"), (s["local"] * F.pow(F.lit(keep), d["n"].cast("double")) + d["local"]).alias("local")))
    begins = lambda a: F.get(F.filter(F.transform(a, lambda d: d["first"]), lambda v: v.isNotNull()), F.lit(0))
    totals = months.withColumn("whole", whole_month).select("symbol", "month", F.col("whole.n").alias("n"), F.col("whole.local").alias("local"), begins("days").alias("first"))
    series_ = totals.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("month", "n", "local", "first"))).alias("months"))
    start = series_.select("symbol", F.explode(_carried("months", "month", keep, F.lit(0), begins(F.col("months")), "date")).alias("m")).select("symbol", "m.*")
    each = months.join(start, ["symbol", "month"]).select("symbol", F.explode(_carried("days", "session_date", keep, F.col("seen"), F.col("value"), "date")).alias("d")).select("symbol", "d.*")
    out = out.join(each.withColumnsRenamed({"seen": "__seen", "value": "__v"}), ["symbol", "session_date"], "left")
    average = F.when(F.col("__n") > 0, F.pow(F.lit(keep), F.col("__n").cast("double")) * F.col("__v") + F.col("__l")).otherwise(F.col("__v"))
    upto = F.col("__seen") + F.col("__n")
    return out.withColumn("ema_15m", F.when(upto >= max(1, least), average)).drop("__x", "__n", "__l", "__seen", "__v")


def same_slot_volume(bars: DataFrame, lookback: int = 20, least: int = 5, slot: str = "slot") -> DataFrame:
    """Bar and running volume against their means in the same slot of the sessions before."""
    w = Window.partitionBy("symbol", slot).orderBy("session_date").rowsBetween(-lookback, -1)
    enough = F.count("volume").over(w) >= least
    out = bars.withColumns({"slot_volume_mean": F.when(enough, F.avg("volume").over(w)), "slot_cum_volume_mean": F.when(enough, F.avg("cum_volume").over(w))})
    return out.withColumns({"bar_vol_ratio": div("volume", "slot_volume_mean"), "cum_vol_ratio": div("cum_volume", "slot_cum_volume_mean")})


def slot_baseline(bars: DataFrame, lookback: int = 20, slot: str = "slot") -> DataFrame:
    """The newest sessions of each symbol and slot (symbol, slot, sessions: session_date, volume, cum_volume), of
    bars with running volume: the slim table from which baselines are told without the bars."""
    entry = F.struct("session_date", "volume", "cum_volume")
    newest = F.sort_array(F.collect_list(entry), asc=False)
    return bars.groupBy("symbol", F.col(slot).alias("slot")).agg(F.reverse(F.slice(newest, 1, lookback)).alias("sessions"))


def update_baseline(baseline: DataFrame, bars: DataFrame, lookback: int = 20, slot: str = "slot") -> DataFrame:
    """The baseline after further sessions (bars with running volume); sessions that it has already are replaced."""
    new = slot_baseline(bars, lookback, slot).withColumnRenamed("sessions", "__new")
    both = baseline.join(new, ["symbol", "slot"], "full")
    days = F.transform("__new", lambda e: e["session_date"])
    kept = F.when(F.col("__new").isNull(), F.col("sessions")).otherwise(F.filter("sessions", lambda e: ~F.array_contains(days, e["session_date"])))
    empty = F.array().cast(new.schema["__new"].dataType)
    every = F.sort_array(F.concat(F.coalesce(kept, empty), F.coalesce("__new", empty)), asc=False)
    return both.select("symbol", "slot", F.reverse(F.slice(every, 1, lookback)).alias("sessions"))


def against_baseline(bars: DataFrame, baseline: DataFrame, lookback: int = 20, least: int = 5, slot: str = "slot") -> DataFrame:
    """What same_slot_volume() adds, from a baseline that holds the sessions before those of the bars."""
    rows = bars.join(baseline.withColumnRenamed("slot", slot), ["symbol", slot], "left")
    before = F.slice(F.sort_array(F.filter("sessions", lambda e: e["session_date"] < F.col("session_date")), asc=False), 1, lookback)
    rows = rows.withColumn("sessions", before)
    mean = lambda c: F.when(F.size(known := F.filter(F.transform("sessions", lambda e: e[c].cast("double")), lambda v: v.isNotNull())) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))
    enough = F.size(F.filter("sessions", lambda e: e["volume"].isNotNull())) >= least
    out = rows.withColumns({"slot_volume_mean": F.when(enough, mean("volume")), "slot_cum_volume_mean": F.when(enough, mean("cum_volume"))}).drop("sessions")
    return out.withColumns({"bar_vol_ratio": div("volume", "slot_volume_mean"), "cum_vol_ratio": div("cum_volume", "slot_cum_volume_mean")})


def next_bar(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"next_open": F.lead("open").over(session()), "next_ts": F.lead("ts").over(session()), "session_close": F.last("close", ignorenulls=True).over(whole())})


def intraday_feature_panel(bars: DataFrame, daily_prev: DataFrame, low: int = 5, high: int = 90) -> DataFrame:
    """Features of the bars within the signal window, of sessions from 9:30 on, with slots of five minutes, and
    what was known the day before (symbol, date, prev_day_high, daily_rs_score_prev, prev_day_atr14, ...)."""
    out = session_fields(by_symbol(bars)).withColumnRenamed("slot", "minute_slot")
    out = session_running(out).drop("slot").withColumnRenamed("minute_slot", "slot")
    out = next_bar(ema_15m(session_vwap(same_slot_volume(out)))).where(F.col("minutes_from_open").between(low, high))
    out = out.join(daily_prev.withColumnRenamed("date", "session_date"), ["symbol", "session_date"], "left")
    return out.withColumns({
        "intraday_rvol": F.col("bar_vol_ratio"),
        "volume_spike_5m": F.col("bar_vol_ratio") - 1.0,
        "distance_to_prev_day_high": div("close", "prev_day_high") - 1.0,
        "rs_x_intraday_rvol": F.col("daily_rs_score_prev") * F.col("bar_vol_ratio"),
        "intraday_range_expansion_vs_atr": div(F.col("session_high_so_far") - F.col("session_low_so_far"), "prev_day_atr14"),
    })


def exec_cost_labels(panel: DataFrame, slip: float = 0.0005, spread: float = 0.0005, commission: float = 0.002, floor: float = 0.0010, cap: float = 0.0040) -> DataFrame:
    """Net return from the next open to the session's close after costs on either side; the entry also
    pays a penalty between floor and cap that grows with how far the session still goes."""
    side = slip + spread / 2.0
    rows = panel.where("next_open IS NOT NULL AND session_close IS NOT NULL")
    reach = zero(div(F.abs(F.col("session_close") - F.col("next_open")), "next_open"))
    penalty = F.greatest(F.lit(floor), F.least(F.lit(cap), 0.0005 + 0.25 * reach))
    entry, out = F.col("next_open") * (1.0 + side + penalty), F.col("session_close") * (1.0 - side)
    net = div(out * (1.0 - commission), entry * (1.0 + commission)) - 1.0
    return rows.withColumns({"net_return": net, "label": yes(net > 0).cast("int")})


def _volume_points() -> Column:
    return 0.60 * clip01(F.col("cum_vol_ratio") / 2.0) + 0.40 * clip01(F.col("bar_vol_ratio") / 2.0)


def _move() -> Column:
    return div("close", "session_open") - 1.0


def _expansion() -> Column:
    atr = div("atr20", "prev_close")
    return 0.50 * clip01(div(div(F.col("high") - F.col("low"), "close"), atr) / 0.35) + 0.50 * clip01(_move() / 0.03)


def _hold() -> Column:
    return clip01((div(F.col("close") - F.col("low"), F.col("high") - F.col("low")) - 0.50) / 0.50)


def standard_breakouts(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Bars with session features and the day's levels (symbol, session_date, pivot_high, diag_valid,
    diag_resistance, atr20, prev_close): what breaks out and its score (NULL without a volume baseline)."""
    out = bars.join(context, ["symbol", "session_date"], "left")

    def crosses(level: str, ok: Column) -> Column:
        return yes(ok & (F.col("high") >= F.col(level)) & (F.col("prev_bar_close").isNull() | (F.col("prev_bar_close") < F.col(level))))

    out = out.withColumns({"breaks_pivot": crosses("pivot_high", F.lit(True)), "breaks_diagonal": crosses("diag_resistance", F.col("diag_valid"))})
    h, d = F.col("breaks_pivot"), F.col("breaks_diagonal")
    out = out.withColumns({
        "breakout_type": F.when(h & d, "both").when(h, "horizontal").when(d, "diagonal").otherwise("none"),
        "resistance_used": F.when(h & d, F.greatest("pivot_high", "diag_resistance")).when(h, F.col("pivot_high")).when(d, F.col("diag_resistance")),
    })
    over = floor0(div("close", "resistance_used") - 1.0)
    risk = div(div(F.col("close") - F.col("session_low_so_far"), "close"), div("atr20", "prev_close"))
    score = weighted(
        (35.0, 0.70 * (h | d).cast("double") + 0.30 * clip01(over / 0.02)),
        (25.0, _volume_points()),
        (15.0, _expansion()),
        (15.0, clip01(1.0 - risk)),
        (10.0, 0.70 * _hold() + 0.30 * clip01(1.0 - over / 0.03)),
    )
    return out.withColumns({"broke_out": h | d, "dist_above_res": over, "move_from_open": _move(), "trigger_score": score})


def zigzag_breakouts(bars: DataFrame, scored: DataFrame) -> DataFrame:
    """Bars of candidate sessions (symbol, session_date and the zigzag columns) whose close crosses the
    line. Compute same_slot_volume() before: leaving sessions out first would change its baseline."""
    out = bars.join(scored, ["symbol", "session_date"])
    line = F.col("zigzag_line_value")
    crossed = yes(F.col("zigzag_line_valid_pre") & (F.col("close") >= line) & (F.col("prev_bar_close").isNull() | (F.col("prev_bar_close") < line)))
    over = floor0(div("close", "zigzag_line_value") - 1.0)
    move = F.when(F.col("slot") == 0, _move()).otherwise(div("close", "prev_close") - 1.0)
    points = {
        "pts_breakout": 45.0 * zero(0.55 * crossed.cast("double") + 0.45 * clip01(over / 0.008)),
        "pts_volume": 5.0 * zero(_volume_points()),
        "pts_expansion": 15.0 * zero(_expansion()),
        "pts_reversal": 25.0 * weighted((0.40, zero(clip01(move / 0.06))), (0.40, zero(clip01((div("close", "recent_low_5") - 1.0) / 0.15))), (0.20, zero(clip01(F.col("pullback_depth") / 0.15)))),
        "pts_hold": 10.0 * (0.70 * zero(_hold()) + 0.30 * zero(clip01(1.0 - over / 0.06))),
    }
    out = out.withColumns(points | {"broke_out": crossed, "dist_above_line": over, "move_from_open": _move()})
    return out.withColumn("trigger_score", sum((F.col(p) for p in points), F.lit(0.0)))


TRIGGER_COLUMNS = ("close", "trigger_score", "cum_vol_ratio", "bar_vol_ratio", "move_from_open", "low", "session_low_so_far", "breakout_type")


def first_trigger(events: DataFrame, columns: tuple[str, ...] = TRIGGER_COLUMNS) -> DataFrame:
    """Earliest breakout of each session; of each column the first value that is not NULL."""
    hits = events.where("broke_out")
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"trigger_{c}" if c != "trigger_score" else c) for c in columns]
    return hits.groupBy("symbol", "session_date").agg(F.min("ts").alias("trigger_time"), *firsts)


def best_trigger_in_window(events: DataFrame, slots: int = 6) -> DataFrame:
    """Of the breakouts within `slots` of a session's first, the one of highest score, then the earliest."""
    hits = events.where("broke_out").withColumn("__first", F.min("slot").over(Window.partitionBy("symbol", "session_date")))
    near = hits.where(F.col("slot") <= F.col("__first") + slots)
    order = Window.partitionBy("symbol", "session_date").orderBy(F.desc_nulls_last("trigger_score"), "ts")
    return near.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__first").withColumnRenamed("ts", "trigger_time")


def candidate_sessions(bars: DataFrame, candidates: DataFrame) -> DataFrame:
    """Bars of the candidates' sessions (symbol, session_date)."""
    return bars.join(candidates.select("symbol", "session_date").distinct(), ["symbol", "session_date"], "left_semi")


def lookback_sessions(bars: DataFrame, candidates: DataFrame, back: int = 25) -> DataFrame:
    """Bars of the candidates' sessions and of the `back` sessions (of all symbols' calendar) before."""
    calendar = bars.select("session_date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("session_date")))  # a row a day
    at = candidates.join(calendar, "session_date").select("symbol", F.explode(F.sequence(F.greatest(F.lit(1), F.col("pos") - back), F.col("pos"))).alias("pos")).distinct()
    wanted = at.join(calendar, "pos").select("symbol", "session_date")
    return bars.join(wanted, ["symbol", "session_date"], "left_semi")


def entry_as_of(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Forward as-of: the first bar of the session at or after the trigger, and the session's low by then. Triggers
    and bars go through one window a session, from its end, where a trigger takes the bar that came last."""
    c = F.col
    low = F.min("low").over(so_far())
    there = bars.select("symbol", "session_date", "ts", F.struct("ts", "close", low.alias("low")).alias("bar"))
    asked = signals.select("symbol", "session_date", c("trigger_time").alias("ts")).distinct()
    rows = there.unionByName(asked.withColumn("bar", F.lit(None).cast(there.schema["bar"].dataType)))
    # at equal times the bar counts as later than the trigger
    back = Window.partitionBy("symbol", "session_date").orderBy(F.desc("ts"), c("bar").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("entry", F.last("bar", ignorenulls=True).over(back)).where("bar IS NULL")
    return rows.select("symbol", "session_date", c("ts").alias("trigger_time"), c("entry.ts").alias("entry_ts"), c("entry.close").alias("entry_close"), c("entry.low").alias("low_at_entry"))


def first_touch(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """First later bar of the session whose low is at or below the stop (entry_ts, stop)."""
    rows = entries.join(bars.select("symbol", "session_date", "ts", "low"), ["symbol", "session_date"])
    hit = F.when((F.col("ts") > F.col("entry_ts")) & (F.col("low") <= F.col("stop")), F.col("ts"))
    return rows.groupBy("symbol", "session_date", "entry_ts", "stop").agg(F.min(hit).alias("stop_ts"))

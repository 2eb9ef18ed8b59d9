"""Rules, lanes, ordering and selection of the signal report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, div, floor0, weighted, yes, zero
from barloom.operators.clean import scope_daily_history, setup_candidates
from barloom.operators.daily import global_pct_rank, industry_rs
from barloom.operators.intraday import best_trigger_in_window, by_symbol, candidate_sessions, first_trigger, same_slot_volume, session_running, standard_breakouts, zigzag_breakouts
from barloom.operators.levels import daily_scores, daily_zigzag_scores


@dataclass(frozen=True)
class StandardRules:
    leader_min: float = 60.0
    trigger_min: float = 0.0
    cum_vol_min: float = 1.5
    bar_vol_min: float = 0.0
    move_min: float = -1.0
    above_pivot: float = 0.01


@dataclass(frozen=True)
class TightEntry:
    leader_min: float = 89.0
    setup_min: float = 57.0
    trigger_min: float = 69.0
    cum_vol_min: float = 0.0
    bar_vol_min: float = 0.0
    max_dist: float = 0.80
    max_gap: float = 0.70
    override_dist: float = 0.35
    override_setup: float = 62.0
    override_trigger: float = 80.0


def attach_triggers(candidates: DataFrame, triggers: DataFrame) -> DataFrame:
    """Candidates with their session's trigger; without one, breakout_type is `none`."""
    out = candidates.join(triggers.withColumnRenamed("session_date", "date"), ["symbol", "date"], "left")
    out = out.withColumn("breakout_type", F.coalesce(F.col("trigger_breakout_type") if "trigger_breakout_type" in out.columns else F.lit(None).cast("string"), F.lit("none")))
    return out.withColumn("broke_out", F.col("breakout_type") != "none")


def standard_rules(report: DataFrame, rules: StandardRules = StandardRules()) -> DataFrame:
    c = F.col
    ok = c("broke_out") & (c("leader_score") >= rules.leader_min) & (c("trigger_score") >= rules.trigger_min) & (zero(c("trigger_cum_vol_ratio")) >= rules.cum_vol_min) & (zero(c("trigger_bar_vol_ratio")) >= rules.bar_vol_min)
    ok = ok & (c("trigger_move_from_open") >= rules.move_min) & (c("trigger_close") >= c("pivot_high") * (1.0 + rules.above_pivot))
    return report.withColumn("standard_rule_pass", yes(ok)).withColumn("breakout_signal", yes(c("history_ok")) & c("standard_rule_pass"))


def tight_entry(report: DataFrame, cfg: TightEntry = TightEntry()) -> DataFrame:
    """The tight reversal lane: distances in daily ranges, lane, stop policy, score and the first reason
    that keeps a row out."""
    c = F.col
    out = report.withColumns({"entry_dist": div("trigger_close", "zigzag_line_value") - 1.0, "gap_pct": div("open", "prev_close") - 1.0})
    out = out.withColumns({"entry_dist_norm": div("entry_dist", "adr20_pct"), "gap_norm": div(floor0(c("gap_pct")), "adr20_pct")})
    base = yes(c("history_ok")) & yes(c("broke_out")) & yes((c("leader_score") >= cfg.leader_min) & (c("setup_score_pre") >= cfg.setup_min) & (c("trigger_score") >= cfg.trigger_min)) & (zero(c("cum_vol_ratio")) >= cfg.cum_vol_min) & (zero(c("bar_vol_ratio")) >= cfg.bar_vol_min)
    tight = base & yes((c("entry_dist_norm") <= cfg.max_dist) & (c("gap_norm") <= cfg.max_gap))
    override = tight & yes((c("entry_dist_norm") <= cfg.override_dist) & (c("setup_score_pre") >= cfg.override_setup) & (c("trigger_score") >= cfg.override_trigger))
    score = weighted(
        (15.0, clip01((c("leader_score") - cfg.leader_min) / 12.0)),
        (30.0, clip01((c("setup_score_pre") - cfg.setup_min) / 18.0)),
        (15.0, clip01((c("trigger_score") - cfg.trigger_min) / 16.0)),
        (25.0, clip01(1.0 - c("entry_dist_norm") / cfg.max_dist)),
        (15.0, clip01(1.0 - c("gap_norm") / cfg.max_gap)),
    )
    reason = F.when(~base, "failed_base_signal").when(~tight & yes(c("entry_dist_norm") > cfg.max_dist), "entry_distance_norm_too_high").when(~tight & yes(c("gap_norm") > cfg.max_gap), "gap_norm_too_high").when(~tight, "failed_tight_lane_shape").otherwise("passed_entry_engine")
    return out.withColumns({
        "entry_base_signal": base,
        "entry_signal": tight,
        "entry_lane": F.when(tight, "tight_reversal").otherwise("none"),
        "entry_stop_policy": F.when(override, "ignore_stop_limit").when(tight, "respect_stop_limit").otherwise("none"),
        "lane_tight_score": score,
        "same_day_priority_score": F.when(tight, score + 5.0 * clip01(c("pts_hold") / 10.0)),
        "entry_filter_reason": reason,
    })


def merge_lanes(standard: DataFrame, zigzag: DataFrame, leader_min: float = 60.0, cum_vol_min: float = 1.5, above_pivot: float = 0.01) -> DataFrame:
    """Both lanes in one table; the compact rule then decides. standard_signal and zigzag_signal tell which of its
    signals a lane had found too, lane_before and signal_before what the lanes had said. Needs cum_vol_ratio, trigger_close, leader_score, history_ok and broke_out in both."""
    c = F.col
    std = standard.withColumns({"lane_before": F.lit("standard"), "signal_before": yes(c("breakout_signal")), "effective_pivot_level": c("pivot_high")})
    zz = zigzag.withColumns({"lane_before": F.lit("zigzag"), "signal_before": yes(c("entry_signal")), "effective_pivot_level": c("zigzag_line_value")})
    out = std.unionByName(zz, allowMissingColumns=True)
    pivot, volume = F.coalesce("effective_pivot_level", "pivot_high"), zero(c("cum_vol_ratio"))
    signal = yes(c("history_ok")) & yes(c("broke_out")) & yes(c("leader_score") >= leader_min) & (volume >= cum_vol_min) & yes(c("trigger_close") >= pivot * (1.0 + above_pivot))
    return out.withColumns({
        "breakout_signal": signal,
        "standard_signal": signal & c("signal_before") & (c("lane_before") == "standard"),
        "zigzag_signal": signal & c("signal_before") & (c("lane_before") == "zigzag"),
        "entry_source": F.when(signal, "compact_breakout").otherwise("none"),
        "entry_lane": F.when(signal, "compact").otherwise("none"),
        "entry_stop_policy": F.when(signal, "respect_stop_limit").otherwise("none"),
        "entry_priority_bucket": F.when(signal, 0).otherwise(99),
        "same_day_priority_score": F.when(signal, volume),
        "priority_score_within_source": F.when(signal, volume),
        "trigger_time_ny": F.date_format("trigger_time", "HH:mm"),
    })


def lane_summary(report: DataFrame) -> DataFrame:
    """Counts a date of the standard lane: setups, by tier, breakouts and signals."""
    c = F.col
    return report.groupBy("date").agg(
        F.count(F.lit(1)).alias("setup_count"),
        F.count_if(c("setup_tier") == "normal").alias("normal_setup_count"),
        F.count_if(c("setup_tier") == "override").alias("override_setup_count"),
        F.count_if(c("broke_out")).alias("breakout_count"),
        F.count_if(c("breakout_signal")).alias("breakout_signal_count"),
    )


def daily_summary(report: DataFrame) -> DataFrame:
    """Counts a date of the merged report: setups, signals, what each lane alone had signalled, and rows whose
    source is the tight lane."""
    c = F.col
    return report.groupBy("date").agg(
        F.count_if(yes(c("setup_candidate"))).alias("setup_count"),
        F.count_if(yes(c("breakout_signal"))).alias("signal_count"),
        F.count_if(yes(c("standard_signal"))).alias("standard_count"),
        F.count_if(yes(c("zigzag_signal"))).alias("zigzag_count"),
        F.count_if(yes(c("entry_source") == "tight_reversal")).alias("tight_reversal_count"),
    )


@dataclass(frozen=True)
class ReportConfig:
    """Thresholds and windows of the report; min_history and pivot_window follow the daily history at hand."""

    min_history: int = 126
    pivot_window: int = 20
    lookback_days: int = 450
    setup_floor: float = 50.0
    leader_min: float = 60.0
    standard: StandardRules = StandardRules()
    tight: TightEntry = TightEntry(leader_min=60.0, setup_min=0.0, trigger_min=0.0, cum_vol_min=1.5, max_dist=99.0, max_gap=99.0)
    compact_leader: float = 60.0
    compact_cum_vol: float = 1.5
    compact_above_pivot: float = 0.01


_CONTEXT = ("pivot_high", "diag_valid", "diag_resistance", "atr20", "prev_close")
_LINE = ("zigzag_line_value", "zigzag_line_valid_pre", "atr20", "prev_close", "recent_low_5", "pullback_depth")


def standard_lane(daily: DataFrame, bars: DataFrame, first, last, cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """Setup candidates of the sessions with the first breakout of their bars (with session and slot features)
    and the standard rules."""
    scored = daily_scores(daily, cfg.min_history, cfg.leader_min, cfg.pivot_window)
    found = setup_candidates(scored, first, last, cfg.setup_floor).withColumn("setup_candidate", F.lit(True)).drop("breakout_type")
    context = found.select("symbol", F.col("date").alias("session_date"), *_CONTEXT)
    events = standard_breakouts(candidate_sessions(bars, context), context)
    triggers = first_trigger(events)
    out = standard_rules(attach_triggers(found, triggers), cfg.standard)
    names = {"trigger_cum_vol_ratio": "cum_vol_ratio", "trigger_bar_vol_ratio": "bar_vol_ratio", "trigger_move_from_open": "move_from_open", "trigger_low": "trigger_bar_low", "trigger_session_low_so_far": "low_so_far_at_trigger"}
    return out.withColumnsRenamed(names)


def zigzag_lane(daily: DataFrame, bars: DataFrame, first, last, cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """Candidates of the falling line with the best breakout near their session's first, and the tight lane."""
    scored = daily_zigzag_scores(daily, cfg.leader_min, cfg.min_history).where("setup_candidate")
    scored = scored.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    context = scored.select("symbol", F.col("date").alias("session_date"), *_LINE)
    best = best_trigger_in_window(zigzag_breakouts(candidate_sessions(bars, context), context))
    names = {"session_date": "date", "close": "trigger_close", "low": "trigger_bar_low", "session_low_so_far": "low_so_far_at_trigger"}
    best = best.select("symbol", "session_date", "trigger_time", "close", "trigger_score", "cum_vol_ratio", "bar_vol_ratio", "move_from_open", "low", "session_low_so_far", "pts_hold", "broke_out").withColumnsRenamed(names)
    out = scored.join(best, ["symbol", "date"], "left").withColumns({"broke_out": yes(F.col("broke_out")), "breakout_type": F.when(yes(F.col("broke_out")), "zigzag_diagonal").otherwise("none")})
    return tight_entry(out, cfg.tight)


_MERGED = ("symbol", "date", "open", "high", "low", "close", "volume", "prev_close", "atr20", "adr20_pct", "history_ok", "leader_pass", "setup_candidate", "leader_score", "setup_score_pre", "trigger_time", "trigger_close", "trigger_score", "cum_vol_ratio", "bar_vol_ratio", "move_from_open", "breakout_type", "broke_out", "pivot_high", "trigger_bar_low", "low_so_far_at_trigger")


def breakout_signal_report(daily: DataFrame, bars: DataFrame, cfg: ReportConfig = ReportConfig()) -> tuple[DataFrame, DataFrame]:
    """The nightly report over daily bars and intraday bars (symbol, ts, session_date, ...), and its counts a date.

    Both lanes score the daily history before the intraday sessions, look for breakouts in the bars of their
    candidates' sessions, and are merged; the compact rule decides. Same-slot baselines see all sessions."""
    first, last = bars.agg(F.min("session_date"), F.max("session_date")).first()
    if first is None:
        first, last = daily.agg(F.min("date"), F.max("date")).first()
    scoped = scope_daily_history(daily, first, last, cfg.lookback_days)
    slots = same_slot_volume(session_running(by_symbol(bars)))
    standard = standard_lane(scoped, slots, first, last, cfg).select(*_MERGED, "breakout_signal", "standard_rule_pass", "setup_tier")
    zigzag = zigzag_lane(scoped, slots, first, last, cfg).select(*_MERGED, "zigzag_line_value", "entry_signal", "entry_dist_norm", "gap_norm", "entry_filter_reason", "pts_hold")
    report = merge_lanes(standard, zigzag, cfg.compact_leader, cfg.compact_cum_vol, cfg.compact_above_pivot)
    return report, daily_summary(report)


def run_summary(report: DataFrame, audits: DataFrame) -> DataFrame:
    """One row: rows, symbols and signals of the report, stale and missing symbols of the audits."""
    a = audits.agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "missing").alias("missing"))
    r = report.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.count_if(F.col("breakout_signal")).alias("signals"))
    return r.crossJoin(a)  # one row each


SORTS = {
    "candidates": (("same_day_priority_score", 0), ("entry_priority_bucket", 1), ("priority_score_within_source", 0), ("leader_score", 0), ("trigger_time", 1), ("symbol", 1)),
    "shortlist": (("same_day_priority_score", 0), ("entry_priority_bucket", 1), ("priority_score_within_source", 0), ("leader_score", 0), ("setup_score_pre", 0), ("symbol", 1)),
    "report": (("date", 1), ("breakout_signal", 0), ("entry_priority_bucket", 1), ("priority_score_within_source", 0), ("trigger_time", 1), ("leader_score", 0), ("symbol", 1)),
    "standard": (("date", 1), ("broke_out", 0), ("breakout_signal", 0), ("trigger_time", 1), ("leader_score", 0), ("symbol", 1)),
    "entry": (("date", 1), ("entry_signal", 0), ("same_day_priority_score", 0), ("leader_score", 0), ("trigger_time", 1), ("symbol", 1)),
}


def order_of(kind: str, drop: tuple[str, ...] = ()) -> list[Column]:
    return [(F.asc_nulls_last if up else F.desc_nulls_last)(c) for c, up in SORTS[kind] if c not in drop]


def report_sort(report: DataFrame, kind: str = "report") -> DataFrame:
    return report.orderBy(*order_of(kind))


SIGNAL_COLUMNS = ("symbol", "date", "breakout_signal", "pivot_high", "effective_pivot_level", "trigger_time", "trigger_close", "trigger_score", "cum_vol_ratio", "bar_vol_ratio", "move_from_open", "leader_score", "setup_score_pre", "rs_rating", "entry_source", "entry_lane", "entry_stop_policy", "entry_priority_bucket", "priority_score_within_source", "same_day_priority_score", "trigger_bar_low", "low_so_far_at_trigger", "breakout_type", "atr20", "adr20_pct", "prev_close")


def signals_projection(report: DataFrame) -> DataFrame:
    out = report.select(*[c for c in SIGNAL_COLUMNS if c in report.columns])
    if "breakout_signal" in out.columns:
        out = out.withColumn("breakout_signal", yes(F.col("breakout_signal")))
    return out.orderBy("date", "symbol")


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """One row a symbol and date: bucket, then score, time, leader."""
    kinds = {"entry_priority_bucket": "int", "priority_score_within_source": "double", "trigger_time": "timestamp", "leader_score": "double"}
    out = signals.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in signals.columns})
    w = Window.partitionBy("symbol", "date").orderBy(F.asc_nulls_last("entry_priority_bucket"), F.desc_nulls_last("priority_score_within_source"), F.asc_nulls_last("trigger_time"), F.desc_nulls_last("leader_score"))
    return out.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def select_candidates(report: DataFrame, k: int, every_date: bool = False) -> DataFrame:
    """The k best signals of the latest date, or of every date."""
    rows = report.where(yes(F.col("breakout_signal")))
    keys = order_of("candidates")
    if every_date:
        return rows.withColumn("pick", F.row_number().over(Window.partitionBy("date").orderBy(*keys))).where(F.col("pick") <= k)
    latest = rows.agg(F.max("date").alias("date"))
    return rows.join(F.broadcast(latest), "date").orderBy(*keys).limit(k)  # latest is one row


def next_weekday(d: str) -> Column:
    n = F.weekday(F.col(d))
    return F.date_add(F.col(d), F.when(n >= 4, 7 - n).otherwise(1))


def shortlist(report: DataFrame, n: int = 100) -> DataFrame:
    """Setups and signals of the report's latest date, one row a symbol, the first n, for the next weekday."""
    rows = report.join(F.broadcast(report.agg(F.max("date").alias("date"))), "date")  # one row
    rows = rows.where(yes(F.col("setup_candidate")) | yes(F.col("breakout_signal")))
    keys = order_of("shortlist")
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(*keys))).where("__k = 1").drop("__k")
    top = rows.orderBy(*keys).limit(n)
    return top.withColumns({"rank_order": F.row_number().over(Window.orderBy(*keys)), "session_date": next_weekday("date")})  # n rows


def top_universe(rows: DataFrame, n: int = 3000) -> DataFrame:
    """The n largest symbols, ranked; unknown sectors and industries named so."""
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("market_cap"))
    one = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    top = one.orderBy(F.desc_nulls_last("market_cap"), "symbol").limit(n)
    return top.fillna("Unknown", ["sector", "industry"]).withColumn("rank_market_cap", F.row_number().over(Window.orderBy(F.desc_nulls_last("market_cap"), "symbol")))  # n rows


def watchlist_topk(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("feature_date").orderBy(F.desc("score"), F.desc_nulls_last("leader_score"), "symbol")
    out = scored.withColumn("rank_order", F.row_number().over(w)).where(F.col("rank_order") <= k)
    day = Window.partitionBy("feature_date")
    return out.withColumns({"daily_cutoff": F.min("score").over(day), "daily_rows": F.count(F.lit(1)).over(day)})


def top_n(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The n first rows by the keys."""
    return df.orderBy(*keys).limit(n)


def monitor_symbols(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(F.upper("symbol").alias("symbol")).union(b.select(F.upper("symbol"))).distinct().orderBy("symbol")


def shortlist_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the intersection over size of the union of two lists' (date, symbol)."""
    rows = a.select("date", "symbol").distinct().withColumn("side", F.lit(1)).union(b.select("date", "symbol").distinct().withColumn("side", F.lit(2)))
    both = rows.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n"))
    return both.agg(div(F.count_if(F.col("n") == 2).cast("double"), F.count(F.lit(1)).cast("double")).alias("overlap"))


def latest_per_symbol(df: DataFrame, order: str = "date") -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def patch_close(daily: DataFrame, quotes: DataFrame) -> DataFrame:
    """Today's close replaced by a live quote (symbol, date, price) where there is one."""
    out = daily.join(quotes.select("symbol", "date", F.col("price").alias("__p")), ["symbol", "date"], "left")
    return out.withColumn("close", F.coalesce("__p", "close")).drop("__p")


def anti_symbols(df: DataFrame, held: DataFrame) -> DataFrame:
    return df.join(held.select("symbol").distinct(), "symbol", "left_anti")


def industry_priority(report: DataFrame, features: DataFrame, universe: DataFrame) -> DataFrame:
    """Weighted priority of signals with run-up (their own, or that of the features), industry strength and company
    size. The signals stay persisted, as the ranks of sizes read them again."""
    c = F.col
    out = report if "runup" in report.columns else report.join(features.select("symbol", "date", "runup"), ["symbol", "date"], "left")
    out = out.persist().join(universe.select("symbol", "industry", "market_cap"), "symbol", "left")
    out = out.join(industry_rs(features, universe), ["industry", "date"], "left")
    out = global_pct_rank(out, "market_cap", "cap_rank").withColumn("small_cap_score", 1.0 - c("cap_rank"))
    volume = F.coalesce("cum_vol_ratio", F.lit(0.75))
    parts = {
        "n_leader": clip01((c("leader_score") - 60.0) / 40.0),
        "n_setup": clip01(1.0 - F.abs(c("setup_score_pre") - 72.0) / 10.0),
        "n_trigger": clip01((F.coalesce("trigger_score", F.lit(60.0)) - 50.0) / 40.0),
        "n_volume": clip01(F.log1p(volume) / F.log1p(F.lit(5.0))),
        "n_runup": clip01(c("runup") / 1.2),
        "n_move": clip01((c("move_from_open") + 0.02) / 0.08),
    }
    out = out.withColumns({k: zero(v) for k, v in parts.items()})
    out = out.withColumns({"small_cap_score": F.coalesce("small_cap_score", F.lit(0.5)), "industry_rs": F.coalesce("industry_rs", F.lit(0.5))})
    a_plus = yes((c("leader_score") >= 95) & (c("setup_score_pre") >= 68) & (c("trigger_score") >= 77) & (c("cum_vol_ratio") >= 3) & (c("move_from_open") >= -0.05))
    score = weighted(*zip((25.0, 20.0, 18.0, 15.0, 12.0, 10.0), map(c, parts))) + 20.0 * c("leader95").cast("double")
    return out.withColumns({"a_plus": a_plus, "leader95": yes(c("leader_score") >= 95)}).withColumn("industry_priority", score)


def risk_sizing(signals: DataFrame, equity: float, cash: float, risk: float = 1.0, slots: int = 3, buffer: float = 0.001) -> DataFrame:
    """Stop and share count of each signal; no row for gaps of 10 % and more (an unknown gap passes), without
    a low, a level or a price, or where the stop is wider than the limits that are known."""
    c = F.col
    price = c("trigger_close")
    gap = F.when((c("prev_close") > 0) & c("open").isNotNull(), c("open") / c("prev_close") - 1.0)
    out = signals.where(~yes(gap >= 0.10))
    low, level = c("low_so_far_at_trigger"), F.coalesce("effective_pivot_level", "pivot_high")
    out = out.where(low.isNotNull() & level.isNotNull() & yes(price > 0)).withColumn("stop", F.least(low, level) * (1.0 - buffer))
    out = out.withColumn("risk_per_share", price - c("stop"))
    limit = F.least("atr20", c("adr20_pct") * price)  # skips what is missing
    respects = F.coalesce("entry_stop_policy", F.lit("respect_stop_limit")) == "respect_stop_limit"
    out = out.where(yes(c("risk_per_share") > 0) & ~(respects & yes(c("risk_per_share") > limit)))
    shares = F.floor(F.least(div(F.lit(equity * risk), "risk_per_share"), div(F.lit(equity / slots), price), div(F.lit(cash), price)))
    return out.withColumn("shares", shares.cast("long")).where("shares > 0")

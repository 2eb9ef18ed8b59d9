"""Swing points, resistance lines and the daily breakout scores.

Lines are found without loops: a pivot row carries its predecessor in a struct, and every bar takes
the last such struct that is confirmed by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, div, floor0, lag, prior_n, rolling, series, strict_max, weighted, yes, zero
from barloom.operators.daily import base_features, leader_pass, regime, relative_strength, surf, with_strength


def swing_high(left: int = 2, right: int = 2) -> Column:
    """Higher than the bars to the left, not lower than those to the right."""
    h = F.col("high")
    cond = F.lit(True)
    for k in range(1, left + 1):
        cond = cond & (h > F.lag("high", k).over(series()))
    for k in range(1, right + 1):
        cond = cond & (h >= F.lead("high", k).over(series()))
    return yes(cond)


def _line(df: DataFrame, pivot: Column, price: str, seen_after: int) -> DataFrame:
    """__line: (i1, p1, i2, p2) of the last two pivots that are `seen_after` bars old; __i: bar number."""
    df = df.withColumn("__i", F.row_number().over(series())).withColumn("__pivot", pivot)
    here = F.when(F.col("__pivot"), F.struct(F.col("__i").alias("i"), F.col(price).alias("p")))
    df = df.withColumn("__here", here).withColumn("__prev", F.last("__here", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1)))
    pair = F.when(F.col("__pivot"), F.struct(F.col("__prev.i").alias("i1"), F.col("__prev.p").alias("p1"), F.col("__i").alias("i2"), F.col(price).alias("p2")))
    df = df.withColumn("__pair", pair).withColumn("__line", F.last("__pair", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -seen_after)))
    return df.drop("__pivot", "__here", "__prev", "__pair")


def diag_resistance(daily: DataFrame, left: int = 2, right: int = 2, min_gap: int = 2, max_gap: int = 15, max_age: int = 15, max_slope: float = 0.01, falling_only: bool = False, causal: bool = False) -> DataFrame:
    """The line through the last two confirmed swing highs: its value today and one bar back.
    causal: use what was confirmed by the previous bar."""
    df = _line(daily, swing_high(left, right), "high", right + causal)
    gap, age = F.col("__line.i2") - F.col("__line.i1"), F.col("__i") - F.col("__line.i2")
    slope = div(F.col("__line.p2") - F.col("__line.p1"), gap)
    ok = yes(gap.between(min_gap, max_gap) & (age <= max_age) & (div(F.abs(slope), F.abs(F.col("__line.p2"))) <= max_slope))
    if falling_only:
        ok = ok & yes(slope < 0)
    value = F.col("__line.p2") + slope * age
    out = df.withColumns({"diag_valid": ok, "diag_slope": F.when(ok, slope), "diag_resistance": F.when(ok, value), "diag_resistance_prev": F.when(ok, value - slope)})
    return out.drop("__i", "__line")


def extrema(df: DataFrame, order: int = 3) -> DataFrame:
    """is_high, is_low: strict extrema over `order` bars on both sides; beyond the ends the end bar itself
    stands for the missing ones."""
    whole = series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    high, low = F.lit(True), F.lit(True)
    n, size = F.row_number().over(series()), F.count(F.lit(1)).over(whole)
    for k in range(1, order + 1):
        for step in (F.lag, F.lead):
            h = F.when(n > k, step("high", k).over(series())).otherwise(F.first("high").over(whole)) if step is F.lag else F.when(n <= size - k, step("high", k).over(series())).otherwise(F.last("high").over(whole))
            low_k = F.when(n > k, step("low", k).over(series())).otherwise(F.first("low").over(whole)) if step is F.lag else F.when(n <= size - k, step("low", k).over(series())).otherwise(F.last("low").over(whole))
            high, low = high & (F.col("high") > h), low & (F.col("low") < low_k)
    return df.withColumns({"is_high": yes(high), "is_low": yes(low)})


def zigzag_pivots(daily: DataFrame, order: int = 3) -> DataFrame:
    """symbol, i, date, kind, price: alternating extrema. Of a run of one kind the most extreme stays, the
    first of equals; a bar that is both is a high first. Pivots too near the end are then dropped."""
    rows = extrema(daily.withColumns({"i": F.row_number().over(series()), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))}), order)
    both = F.array(F.when(F.col("is_high"), F.struct(F.lit(0).alias("o"), F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit(1).alias("o"), F.lit("low").alias("kind"), F.col("low").alias("price"))))
    found = rows.where("is_high OR is_low").select("symbol", "date", "i", "n", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("symbol", "date", "i", "n", "x.*")
    w = Window.partitionBy("symbol").orderBy("i", "o")
    found = found.withColumn("new", yes(F.lag("kind").over(w) != F.col("kind")).cast("int")).withColumn("run", F.sum("new").over(w))
    height = F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))
    best = found.groupBy("symbol", "run").agg(F.max_by(F.struct("i", "date", "kind", "price", "n"), F.struct(height, -F.col("i"))).alias("b")).select("symbol", "b.*")
    return best.where(F.col("i") + order <= F.col("n")).select("symbol", "i", "date", "kind", "price")


def zigzag_line(daily: DataFrame, order: int = 3, confirm_bars: int = 1, min_gap: int = 5, max_gap: int = 40, max_slope: float = 0.03) -> DataFrame:
    """The falling line through the last two high pivots that are confirm_bars old, with its gap, age and
    value today and one bar back. confirm_bars >= order never looks ahead."""
    highs = zigzag_pivots(daily, order).where("kind = 'high'").select("symbol", "date", F.lit(True).alias("__p"))
    df = daily.join(highs, ["symbol", "date"], "left")
    df = _line(df, yes(F.col("__p")), "high", confirm_bars).drop("__p")
    gap, age = F.col("__line.i2") - F.col("__line.i1"), F.col("__i") - F.col("__line.i2")
    slope = div(F.col("__line.p2") - F.col("__line.p1"), gap)
    value = F.col("__line.p2") + slope * age
    ok = yes((F.col("__line.p2") < F.col("__line.p1")) & gap.between(min_gap, max_gap) & (div(F.abs(slope), F.abs(F.col("__line.p2"))) <= max_slope))
    return df.withColumns({
        "zigzag_line_valid": ok,
        "zigzag_gap": F.when(ok, gap),
        "zigzag_age": F.when(ok, age),
        "zigzag_slope": F.when(ok, div(F.abs(slope), F.abs(F.col("__line.p2")))),
        "zigzag_line_value": F.when(ok, value),
        "zigzag_line_prev": F.when(ok, value - slope),
    }).drop("__i", "__line")


def zigzag_setup_score(lined: DataFrame) -> DataFrame:
    """Score of bars with a valid line (needs vol20), and what was known on the previous bar."""
    recent = series().rowsBetween(-4, 0)
    lists = lined.withColumns({"__h": F.collect_list("high").over(recent), "__l": F.collect_list("low").over(recent), "__v": F.collect_list("volume").over(recent)})

    def tail(c: str, most: int) -> Column:
        k = F.least(F.col("zigzag_age"), F.lit(most), F.size(c)).cast("int")
        return F.when(k > 0, F.slice(c, F.size(c) - k + 1, k))

    line = F.greatest("zigzag_line_value", F.lit(1e-9))
    spread = (F.array_max(tail("__h", 5)) - F.array_min(tail("__l", 5))) / line
    v = tail("__v", 3)
    dry = div(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), F.greatest("vol20", F.lit(1e-9)))
    near = F.abs((F.col("zigzag_line_value") - F.col("close")) / line)
    parts = (
        (20.0, F.lit(1.0)),
        (20.0, clip01(1.0 - near / 0.06)),
        (15.0, clip01(1.0 - F.abs(F.col("zigzag_gap") - 12.0) / 18.0)),
        (15.0, clip01(1.0 - F.abs(F.col("zigzag_age") - 8.0) / 12.0)),
        (10.0, clip01(1.0 - F.col("zigzag_slope") / 0.03)),
        (10.0, clip01(1.0 - spread / 0.20)),
        (10.0, zero(F.when(F.col("vol20").isNotNull(), clip01(1.0 - (dry - 0.60) / 0.70)))),
    )
    score = F.when(F.col("zigzag_line_valid"), weighted(*parts))
    out = lists.withColumn("zigzag_setup_raw", score).drop("__h", "__l", "__v")
    return out.withColumns({"zigzag_setup_pre": lag("zigzag_setup_raw"), "zigzag_line_prevday": lag("zigzag_line_value"), "zigzag_line_valid_pre": yes(lag("zigzag_line_valid"))})


def daily_zigzag_scores(daily: DataFrame, leader_min: float = 60.0, min_history: int = 126, **line) -> DataFrame:
    """Lines, setup score, prior extremes and the candidate flag of the zigzag lane."""
    scored = zigzag_setup_score(zigzag_line(base_features(daily), **line))
    out = scored.join(relative_strength(scored), ["symbol", "date"])
    ok, lead = F.col("history_n") >= min_history, yes(F.col("leader_score") >= leader_min)
    return out.withColumns({"history_ok": ok, "leader_pass_min": lead, "leader_pass": lead, "setup_candidate": ok & lead & F.col("zigzag_line_valid_pre"), "setup_score_pre": F.col("zigzag_setup_pre")})


def daily_scores(daily: DataFrame, min_history: int = 126, leader_min: float = 60.0, pivot_window: int = 20, normal_min: float = 60.0, override_min: float = 50.0, override_trigger: float = 85.0, diagonal: dict | None = None) -> DataFrame:
    """All daily columns of the standard lane: setup, trigger, breakout type, signal and total score."""
    out = base_features(with_strength(daily))
    if pivot_window != 20:
        out = out.withColumn("pivot_high", rolling(F.max, "high", prior_n(pivot_window), pivot_window))
    out = diag_resistance(out.withColumn("history_ok", F.col("history_n") >= min_history), **(diagonal or {}))
    out = out.withColumns({"s10": surf(("sma10", 10, 0.70), 0.80, 0.985, 2.0), "s20": surf(("sma20", 15, 0.73), 1.00, 0.98, 2.0)})
    c = F.col("close")
    gap_pivot, gap_diag = div("pivot_high", "close") - 1.0, F.when(F.col("diag_valid"), div("diag_resistance", "close") - 1.0)
    shrink = lambda a, b, low, width: clip01(1.0 - (div(a, b) - low) / width)
    quality = F.when(F.col("diag_valid"), clip01(1.0 - div(F.abs(F.col("diag_slope")), F.abs(F.col("diag_resistance"))) / 0.01)).otherwise(0.0)
    out = out.withColumns({
        "regime": regime().cast("double"),
        "surf": strict_max(F.col("s10"), F.col("s20")),
        "contraction": 0.5 * shrink("atr5", "atr20", 0.6, 0.4) + 0.5 * shrink("range5", "range20", 0.6, 0.4),
        "dry_up": shrink("vol5", "vol20", 0.5, 0.5),
        "near_resistance": clip01(1.0 - floor0(F.least(gap_pivot, gap_diag)) / 0.03),
        "shallow": clip01(1.0 - floor0(div(F.col("high10") - c, "high10")) / 0.08),
        "diag_quality": quality,
    })
    approach = F.col("rolling_high_3_pre")
    band = F.greatest(F.lit(0.04), zero(1.75 * div(lag("atr20"), "prev_close")))
    near_pre = clip01(1.0 - floor0(F.least(div("pivot_high", approach) - 1.0, F.when(F.col("diag_valid"), div("diag_resistance_prev", approach) - 1.0))) / band)
    weights = (("regime", 18.0), ("surf", 24.0), ("contraction", 12.0), ("dry_up", 6.0), ("near_resistance", 20.0), ("shallow", 12.0), ("diag_quality", 8.0))
    now = weighted(*((w, zero(F.col(k))) for k, w in weights))
    before = weighted(*((w, zero(near_pre if k == "near_resistance" else lag(k))) for k, w in weights))
    out = out.withColumns({"setup_score": now, "setup_score_pre": before})
    out = out.withColumn("leader_pass", leader_pass(leader_min))

    horizontal = yes((c >= F.col("pivot_high")) & (F.col("prev_close") < F.col("pivot_high")))
    diagonal_up = yes(F.col("diag_valid") & (c >= F.col("diag_resistance")) & (F.col("prev_close") < F.col("diag_resistance_prev")))
    kind = F.when(horizontal & diagonal_up, "both").when(horizontal, "horizontal").when(diagonal_up, "diagonal").otherwise("none")
    level = F.when(horizontal & diagonal_up, F.greatest("pivot_high", "diag_resistance")).when(horizontal, F.col("pivot_high")).when(diagonal_up, F.col("diag_resistance"))
    out = out.withColumns({"breakout_type": kind, "resistance_used": level})
    over = zero(floor0(div(c, "resistance_used") - 1.0))
    crossed = (F.col("breakout_type") != "none").cast("double")
    atr_pct = div("atr20", "close")
    position = div(c - F.col("low"), F.col("high") - F.col("low"))
    trigger = weighted(
        (35.0, 0.7 * crossed + 0.3 * clip01(over / 0.02)),
        (25.0, zero(clip01(div("volume", "vol20") / 1.5))),
        (15.0, 0.5 * zero(clip01(div("range_pct", atr_pct) / 1.2)) + 0.5 * zero(clip01((div("close", "open") - 1.0) / 0.03))),
        (15.0, zero(clip01(1.0 - div(div(c - F.col("low"), c), atr_pct)))),
        (10.0, 0.7 * zero(clip01((position - 0.5) / 0.5)) + 0.3 * clip01(1.0 - over / 0.03)),
    )
    out = out.withColumn("trigger_score_daily", trigger)
    normal = yes(F.col("setup_score_pre") >= normal_min)
    strong = yes((F.col("setup_score_pre") >= override_min) & (F.col("trigger_score_daily") >= override_trigger))
    signal = F.col("history_ok") & F.col("leader_pass") & (F.col("breakout_type") != "none") & (normal | strong)
    total = weighted((0.40, F.col("setup_score_pre")), (0.35, F.col("trigger_score_daily")), (0.25, zero(F.col("leader_score"))))
    return out.withColumns({"daily_signal": yes(signal), "total_score": total})

"""Per-symbol rolling features and per-date ranks of daily bars.

All windows share one partitioning and order (symbol, date), so that a chain of these costs one
exchange; ranks by date run on a slim projection that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import clip01, col, div, floor0, lag, last_n, pct_rank, prior_n, rolling, series, strict_max, weighted, yes, zero
from barloom.functions.ranks import pct_ranks


def sma(c: str | Column, n: int, least: int | None = None) -> Column:
    return rolling(F.avg, c, last_n(n), least or n)


def true_range() -> Column:
    pc = lag("close")
    plain = F.col("high") - F.col("low")
    return F.when(pc.isNull(), plain).otherwise(F.greatest(plain, F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))


def roc(n: int, c: str = "close") -> Column:
    return div(c, lag(c, n)) - 1.0


def week_key(date: str = "date") -> Column:
    """The Friday that ends the date's week (Saturday to Friday)."""
    return F.next_day(F.date_sub(F.col(date), 1), "FRI")


def base_features(daily: DataFrame) -> DataFrame:
    """Lags, ranges, averages and levels that the scores are made of."""
    out = daily.withColumns({"prev_close": lag("close"), "prev_high": lag("high"), "prev_low": lag("low"), "tr": true_range(), "history_n": F.row_number().over(series())})
    out = out.withColumns({
        **{f"atr{n}": sma("tr", n) for n in (5, 14, 20)},
        **{f"sma{n}": sma("close", n) for n in (10, 20, 21, 50)},
        **{f"vol{n}": sma("volume", n) for n in (5, 20)},
        **{f"range{n}": rolling(F.max, "high", last_n(n), n) - rolling(F.min, "low", last_n(n), n) for n in (5, 20)},
        "adr20_pct": sma(div(F.col("high") - F.col("low"), "close"), 20),
        "adr20_alt": sma(div("high", "low") - 1.0, 20, 10),
        "rolling_high_3_pre": rolling(F.max, "high", prior_n(3), 1),
        "pivot_high": rolling(F.max, "high", prior_n(20), 20),
        "high10": rolling(F.max, "high", prior_n(10), 10),
        "recent_low_5": rolling(F.min, "low", prior_n(5), 3),
        "recent_high_5": rolling(F.max, "high", prior_n(5), 3),
        "recent_low_10": rolling(F.min, "low", prior_n(10), 5),
        **{f"roc{n}": roc(n) for n in (21, 63, 126, 252)},
        "range_pct": div(F.col("high") - F.col("low"), "close"),
        "week_end": F.col("date") == F.max("date").over(Window.partitionBy("symbol", week_key())),
    })
    return out.withColumns({
        "pullback_depth": floor0(div(F.col("recent_high_5") - F.col("prev_close"), "recent_high_5")),
        "range_median10": rolling(lambda c: F.percentile(c, 0.5), "range_pct", last_n(10), 10),
        "history_ok": F.col("history_n") >= 126,
    })


def money_flow_pressure(n: int = 20, least: int = 10) -> Column:
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    return sma(div((c - low) - (h - c), h - low), n, least)


def anchored_vwap(daily: DataFrame, n: int = 63) -> DataFrame:
    """VWAP since the first bar of the highest high of the last n bars."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    pv = typical * F.col("volume")
    out = daily.withColumns({"__pv": pv, "__n": F.row_number().over(series())}).withColumns({"__a": F.coalesce(F.sum("__pv").over(before), F.lit(0.0)), "__b": F.coalesce(F.sum("volume").over(before), F.lit(0.0))})
    anchor = F.max(F.struct(F.col("high"), (-F.col("__n")).alias("k"), "__a", "__b")).over(last_n(n))
    out = out.withColumns({"__x": anchor, "__p": F.sum("__pv").over(upto), "__v": F.sum("volume").over(upto)})
    return out.withColumn("anchored_vwap", div(F.col("__p") - F.col("__x.__a"), F.col("__v") - F.col("__x.__b"))).drop("__pv", "__n", "__a", "__b", "__x", "__p", "__v")


def rs_blend() -> Column:
    """Relative strength of one symbol in percent, the shortest return first; missing returns count as 0."""
    return weighted(*((100.0 * w, zero(F.col(f"roc{n}"))) for w, n in ((0.4, 21), (0.2, 63), (0.2, 126), (0.2, 252))))


#: Columns of the feature history, as of the day and as of the day before.
END_OF_DAY = ("daily_buy_pressure_eod", "adr_pct_20_eod", "industry_buy_pressure_eod", "sector_buy_pressure_eod", "daily_rrs_eod", "daily_rs_score_eod", "industry_rs_eod")
DAY_BEFORE = (
    "daily_buy_pressure_prev", "prev_day_adr_pct", "industry_buy_pressure_prev", "sector_buy_pressure_prev", "daily_rrs_prev", "daily_rs_score_prev",
    "distance_to_avwap_63_prev", "industry_rs_prev", "prev_day_close_vs_sma50", "prev_day_high", "prev_day_atr14",
)


def daily_feature_history(daily: DataFrame, universe: DataFrame) -> DataFrame:
    """Features of adjusted closes (adj_close where there is one): END_OF_DAY, and DAY_BEFORE as of the symbol's
    previous bar. Means of buy pressure by date and sector and by date and industry, and of the strength score by
    date and industry; their previous values are the group's of its previous date. Symbols without a group have
    none."""
    if "adj_close" in daily.columns:
        daily = daily.withColumn("close", F.coalesce("adj_close", "close"))
    out = base_features(daily)
    out = out.withColumn("buy_pressure", money_flow_pressure())
    out = anchored_vwap(out).withColumn("rs_score", rs_blend())
    out = out.withColumn("rrs", div("rs_score", div("atr14", "close")))
    before = {
        "daily_buy_pressure_prev": "buy_pressure",
        "prev_day_adr_pct": "adr20_alt",
        "daily_rrs_prev": "rrs",
        "daily_rs_score_prev": "rs_score",
        "distance_to_avwap_63_prev": div("close", "anchored_vwap") - 1.0,
        "prev_day_close_vs_sma50": div("close", "sma50") - 1.0,
        "prev_day_high": "high",
        "prev_day_atr14": "atr14",
    }
    out = out.withColumns({name: lag(c) for name, c in before.items()})  # with the windows above, before any join
    out = out.join(universe.select("symbol", "sector", "industry"), "symbol", "left")
    for group, values in (("sector", {"buy_pressure": "buy_pressure"}), ("industry", {"buy_pressure": "buy_pressure", "rs": "rs_score"})):
        means = group_means_with_prev(out, group, {f"{group}_{k}": c for k, c in values.items()})
        out = out.join(F.broadcast(means), ["date", group], "left")  # a row a date and group
    now = ("buy_pressure", "adr20_alt", "industry_buy_pressure", "sector_buy_pressure", "rrs", "rs_score", "industry_rs")
    return out.withColumns({name: F.col(c) for name, c in zip(END_OF_DAY, now)})


def group_means_with_prev(df: DataFrame, group: str, values: dict[str, str]) -> DataFrame:
    """Means by date and group under the given names, and <name>_prev of the group's previous date."""
    means = df.where(F.col(group).isNotNull()).groupBy("date", group).agg(*[F.avg(c).alias(name) for name, c in values.items()])
    by = Window.partitionBy(group).orderBy("date")  # a row a date
    return means.withColumns({f"{name}_prev": F.lag(name).over(by) for name in values})


def group_mean_with_prev(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean by date and group, and the group's mean on its previous date."""
    return group_means_with_prev(df, group, {f"{group}_mean": value})


#: Features of the plain watchlist and their weights.
WATCHLIST_WEIGHTS = {
    "daily_buy_pressure_eod": 0.20,
    "daily_rs_score_eod": 0.25,
    "daily_rrs_eod": 0.20,
    "adr_pct_20_eod": 0.10,
    "industry_buy_pressure_eod": 0.10,
    "sector_buy_pressure_eod": 0.05,
    "industry_rs_eod": 0.10,
}


def prior_runup() -> Column:
    """Larger of the monthly and the quarterly return (one is enough), as of the previous session."""
    return F.lag(F.greatest("roc21", "roc63")).over(series())


def surf(share: tuple[str, int, float], distance: float, deep: float, deep_most: float, atr: str = "atr20") -> Column:
    """How well the close rides an average: (average, rows, share that gives full points)."""
    ma, n, full = share
    frame = last_n(n)
    above = F.avg(yes(F.col("close") >= F.col(ma)).cast("double")).over(frame)
    far = F.avg(div(F.abs(F.col("close") - F.col(ma)), atr)).over(frame)
    count = F.sum(yes(F.col("close") < deep * F.col(ma)).cast("double")).over(frame)
    score = weighted((0.40, clip01(above / full)), (0.35, clip01(1.0 - far / distance)), (0.25, clip01(1.0 - count / deep_most)))
    return F.when((F.count(F.col(ma)).over(frame) >= n) & (F.count(F.col(atr)).over(frame) >= n), score)


def regime(fast: str = "sma10", slow: str = "sma20") -> Column:
    return yes((F.col("close") >= F.col(fast)) & (F.col("close") >= F.col(slow)) & (F.col(fast) > lag(fast, 3)) & (F.col(slow) > lag(slow, 5)))


def hold_score(daily: DataFrame) -> DataFrame:
    """Score for holding on: trend, surf, shallow pullback, slope, quiet days, no distribution."""
    out = base_features(daily)
    out = out.withColumns({"s10": surf(("sma10", 5, 0.80), 1.00, 0.985, 1.0), "s21": surf(("sma21", 8, 0.75), 1.20, 0.98, 1.5), "h10": rolling(F.max, "high", last_n(10), 10)})
    position = div(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    depth = clip01(1.0 - floor0(div(F.col("h10") - F.col("close"), "h10")) / 0.10)
    # a slope that is missing leaves nothing of both
    slope = zero(weighted((0.6, clip01((div("sma10", lag("sma10", 3)) - 1.0) / 0.03)), (0.4, clip01((div("sma21", lag("sma21", 5)) - 1.0) / 0.05))))
    quiet = yes((F.col("range_pct") < F.col("range_median10")) & (F.col("volume") < F.col("vol20")) & (F.col("close") <= F.col("prev_close")))
    dumped = yes((F.col("close") < F.col("prev_close")) & (F.col("volume") > 1.2 * F.col("vol20")) & (position < 0.35) & (F.col("range_pct") > 1.05 * F.col("range_median10")))
    points = {
        "hold_regime": 25.0 * regime("sma10", "sma21").cast("double"),
        "hold_surf": 25.0 * zero(F.greatest("s10", "s21")),
        "hold_pullback": 15.0 * zero(depth),
        "hold_slope": 15.0 * slope,
        "hold_quiet": 10.0 * quiet.cast("double"),
        "hold_anti_distribution": 10.0 * (1.0 - dumped.cast("double")),
    }
    out = out.withColumns(points)
    return out.withColumn("hold_score", sum((F.col(c) for c in points), F.lit(0.0)))


def _strength() -> Column:
    return weighted(*((w, zero(100.0 * pct_rank(c, "date"))) for w, c in ((0.45, "roc21"), (0.35, "roc63"), (0.20, "roc126"))))


def relative_strength(features: DataFrame) -> DataFrame:
    """symbol, date, rs_today and, as of the previous session, leader_score: percent ranks by date of
    three returns, .45 / .35 / .20. Slim: three columns go through the exchange by date."""
    slim = features.select("symbol", "date", "roc21", "roc63", "roc126").repartition("date")  # serves all three ranks
    ranked = slim.withColumn("rs_today", _strength()).select("symbol", "date", "rs_today")
    return ranked.withColumn("leader_score", lag("rs_today"))


def with_strength(daily: DataFrame) -> DataFrame:
    """Daily bars with rs_today and leader_score, as relative_strength() has them: bars go through the exchange by
    date and come back by symbol, so that features made of them need no join."""
    rows = daily.withColumns({f"roc{n}": roc(n) for n in (21, 63, 126)}).repartition("date")
    return rows.withColumn("rs_today", _strength()).select(*daily.columns, "rs_today").withColumn("leader_score", lag("rs_today"))


def leader_pass(least: float = 60.0) -> Column:
    strong = (lag("roc21") >= 0.15) & (lag("roc63") >= 0.30) & (lag("roc126") >= 0.50)
    return yes(F.col("leader_score") >= least) | yes(strong)


def industry_rs(features: DataFrame, universe: DataFrame) -> DataFrame:
    """industry, date, industry_rs: percent rank by date of the industry's median return blend, as of
    its previous date."""
    rows = features.select("symbol", "date", weighted((0.25, F.col("roc21")), (0.35, F.col("roc63")), (0.40, F.col("roc126"))).alias("blend"))
    rows = rows.join(universe.select("symbol", "industry"), "symbol").groupBy("industry", "date").agg(F.median("blend").alias("median"))
    ranked = rows.withColumn("rank", pct_rank("median", "date"))
    return ranked.select("industry", "date", F.lag("rank").over(Window.partitionBy("industry").orderBy("date")).alias("industry_rs"))


def cross_sectional_zscore(df: DataFrame, names: list[str], by: str = "date") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumns({f"{c}_z": div(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))) for c in names})


def legacy_watchlist(df: DataFrame, weights: dict[str, float], n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Top n by date of the weighted sum of percent ranks (to nine decimals); ties go to the larger of the given
    columns, then to the smaller symbol. One exchange by date serves all ranks."""
    score = sum((w * zero(pct_rank(c, "date")) for c, w in weights.items()), F.lit(0.0))
    out = df.repartition("date").withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)), *map(F.desc_nulls_last, ties), "symbol"))
    return out.withColumn("rank_order", rank).where(F.col("rank_order") <= n)


def global_pct_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Percent rank over all rows, NULL for NULL."""
    return df.join(pct_ranks(df, value, out), value, "left")


def forward_outcomes(events: DataFrame, daily: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), strong: float = 0.05) -> DataFrame:
    """Returns after h bars of each event (symbol, date, entry), same-day adverse excursion, success."""
    bars = daily.select("symbol", "date", F.col("low").alias("__low"), *[F.lead("close", h).over(series()).alias(f"__c{h}") for h in horizons])
    out = events.join(bars, ["symbol", "date"], "left").withColumns({f"ret_{h}": div(f"__c{h}", "entry") - 1.0 for h in horizons} | {"mae": div("__low", "entry") - 1.0})
    last = F.col(f"ret_{horizons[-1]}")
    return out.withColumns({"success": yes(last > 0), "strong_success": yes(last >= strong)}).drop("__low", *[f"__c{h}" for h in horizons])

"""Registered bar queries: each reads the star tables and has a DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import div, lag, last_n, pct_rank, prior_n, rolling, series, yes, zero
from barloom.operators import calibration, clean, daily, evaluate, intraday, learn, ledger, levels, report
from barloom.plans import oracle as q
from barloom.sources import fixtures as fx
from barloom.streaming.bars import clean_quotes, quotes_to_bars, stop_alerts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def r4(c: str | Column, name: str | None = None) -> Column:
    """Four decimals, cut where no result of the fixtures' price steps lies on the edge. Numbers beyond 2^53 have
    no decimals left, and their floor would end at the largest long."""
    x = (F.col(c) if isinstance(c, str) else c) * 10000 + 0.48713
    return (F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x) / 10000).alias(name or c)


def rows(df: DataFrame, names: str, *plain: str) -> DataFrame:
    return df.select(*plain, *[r4(c) for c in names.split()])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BASE = q.stack(q.DAILY, q.features(), select="")
BAR = "open high low close volume"


@query(q.stack(q.DAILY, select=f"SELECT {q.rows(BAR, 'symbol', 'date')} FROM daily"))
def daily_bars(spark, d):
    return rows(clean.normalize_daily_bars(fx.daily(spark, d)), BAR, "symbol", "date")


FEATURES = "atr5 atr14 atr20 sma10 sma20 sma21 sma50 vol5 vol20 range5 range20 adr20_pct adr20_alt rolling_high_3_pre pivot_high high10 recent_low_5 recent_high_5 recent_low_10 pullback_depth roc21 roc63 roc126 roc252 range_median10"


@query(BASE + f"SELECT {q.rows(FEATURES, 'symbol', 'date', 'week_end', 'history_ok')} FROM base")
def rolling_features(spark, d):
    return rows(daily.base_features(fx.daily(spark, d)), FEATURES, "symbol", "date", "week_end", "history_ok")


@query(q.stack(q.DAILY, "t AS (SELECT *, close * volume AS dollar_volume FROM daily)", select="SELECT symbol, date, floor(dollar_volume * 10000 + 0.48713) / 10000 AS dollar_volume, coalesce(close >= 60 AND volume >= 30000 AND dollar_volume >= 2000000, false)::INT AS tradeable FROM t"))
def tradeability(spark, d):
    out = clean.tradeability_flags(fx.daily(spark, d), 60.0, 30000.0, 2e6)
    return out.select("symbol", "date", r4("dollar_volume"), F.col("tradeable").cast("int").alias("tradeable"))


@query(q.stack(q.DAILY, q.vwap(), select=f"SELECT symbol, date, {q.r4('anchored_vwap')} FROM vwap"))
def anchored_vwap(spark, d):
    return rows(daily.anchored_vwap(fx.daily(spark, d)), "anchored_vwap", "symbol", "date")


@query(q.stack(q.DAILY, q.features(), q.strength(), select=f"SELECT {q.rows('rs_today leader_score', 'symbol', 'date')} FROM rs"))
def relative_strength(spark, d):
    return rows(daily.relative_strength(daily.base_features(fx.daily(spark, d))), "rs_today leader_score", "symbol", "date")


HISTORY = q.stack(q.DAILY, q.UNIVERSE, q.features(), q.vwap(), q.feature_history(), select="")
HISTORY_COLUMNS = " ".join((*daily.END_OF_DAY, *daily.DAY_BEFORE))


@query(HISTORY + f"SELECT {q.rows(HISTORY_COLUMNS, 'symbol', 'date', 'sector', 'industry')} FROM history")
def feature_history(spark, d):
    out = daily.daily_feature_history(fx.daily(spark, d), fx.universe(spark, d))
    return rows(out, HISTORY_COLUMNS, "symbol", "date", "sector", "industry")


@query(q.stack(q.DAILY, q.UNIVERSE, "m AS (SELECT date, sector, avg(close) AS sector_mean FROM daily JOIN universe USING (symbol) GROUP BY 1, 2)", select=f"SELECT date, sector, {q.r4('sector_mean')}, {q.r4('lag(sector_mean) OVER (PARTITION BY sector ORDER BY date)', 'sector_mean_prev')} FROM m"))
def sector_means(spark, d):
    out = daily.group_mean_with_prev(fx.daily(spark, d).join(fx.universe(spark, d), "symbol"), "close", "sector")
    return rows(out, "sector_mean sector_mean_prev", "date", "sector")


@query(q.stack(q.DAILY, q.UNIVERSE, q.features(), "m AS (SELECT industry, date, median(0.25 * roc21 + 0.35 * roc63 + 0.4 * roc126) AS median FROM base JOIN universe USING (symbol) GROUP BY 1, 2)", f"r AS (SELECT *, {q.pct_rank('median', 'date')} AS rk FROM m)", select=f"SELECT industry, date, {q.r4('lag(rk) OVER (PARTITION BY industry ORDER BY date)', 'industry_rs')} FROM r"))
def industry_strength(spark, d):
    return rows(daily.industry_rs(daily.base_features(fx.daily(spark, d)), fx.universe(spark, d)), "industry_rs", "industry", "date")


@query(q.stack(q.DAILY, select=f"SELECT symbol, date, {q.r4('(close - avg(close) OVER d) / nullif(stddev_samp(close) OVER d, 0)', 'close_z')}, {q.r4('(volume - avg(volume) OVER d) / nullif(stddev_samp(volume) OVER d, 0)', 'volume_z')} FROM daily WINDOW d AS (PARTITION BY date)"))
def zscores(spark, d):
    return rows(daily.cross_sectional_zscore(fx.daily(spark, d), ["close", "volume"]), "close_z volume_z", "symbol", "date")


_LIST_SCORE = " + ".join(f"{w} * coalesce({q.pct_rank(c, 'date')}, 0)" for c, w in daily.WATCHLIST_WEIGHTS.items())


@query(HISTORY + f""", s AS (SELECT symbol, date, daily_rs_score_eod, {_LIST_SCORE} AS score FROM history)
, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(score, 9) DESC, daily_rs_score_eod DESC NULLS LAST, symbol) AS rank_order FROM s)
SELECT symbol, date, {q.r4('score')}, rank_order FROM k WHERE rank_order <= 5""")
def watchlist(spark, d):
    """The plain watchlist of each date over its seven features."""
    out = daily.daily_feature_history(fx.daily(spark, d), fx.universe(spark, d))
    best = daily.legacy_watchlist(out, daily.WATCHLIST_WEIGHTS, 5, ("daily_rs_score_eod",))
    return best.select("symbol", "date", r4("score"), F.col("rank_order").cast("long").alias("rank_order"))


@query("WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity FROM lineitem) SELECT l_quantity, any_value(rk) AS qty_rank, count(*) AS n FROM (SELECT l_quantity, (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / count(*) OVER () AS rk FROM t) GROUP BY 1")
def global_rank(spark, d):
    out = daily.global_pct_rank(fx.table(spark, d, "lineitem").select("l_quantity"), "l_quantity", "qty_rank")
    return out.groupBy("l_quantity").agg(F.max("qty_rank").alias("qty_rank"), F.count(F.lit(1)).alias("n"))


@query(q.stack(q.DAILY, q.diagonal("daily"), select=f"SELECT {q.rows('diag_slope diag_resistance diag_resistance_prev', 'symbol', 'date', 'diag_valid')} FROM diag"))
def diagonal_lines(spark, d):
    return rows(levels.diag_resistance(fx.daily(spark, d)), "diag_slope diag_resistance diag_resistance_prev", "symbol", "date", "diag_valid")


@query(q.stack(q.DAILY, q.zigzag(), select=f"SELECT symbol, i, date, kind, {q.r4('price')} FROM zz"))
def zigzag_pivots(spark, d):
    out = levels.zigzag_pivots(fx.daily(spark, d))
    return out.select("symbol", F.col("i").cast("long").alias("i"), "date", "kind", r4("price"))


ZIGZAG = "zigzag_line_value zigzag_line_prev zigzag_setup_raw zigzag_setup_pre zigzag_line_prevday"


@query(q.stack(q.DAILY, q.features(), q.zigzag(), q.zigzag_lines(), q.zigzag_scores(), q.strength(), select=f"SELECT {q.rows(ZIGZAG + ' leader_score', 'symbol', 'date', 'zigzag_line_valid')}, history_n >= 126 AND coalesce(leader_score >= 60, false) AND zigzag_line_valid_pre AS setup_candidate FROM zscore JOIN rs USING (symbol, date)"))
def zigzag_scores(spark, d):
    return rows(levels.daily_zigzag_scores(fx.daily(spark, d)), ZIGZAG + " leader_score", "symbol", "date", "zigzag_line_valid", "setup_candidate")


SCORED = q.stack(q.DAILY, q.features(), q.diagonal(), q.strength(), q.scores(), select="")
SCORE_COLUMNS = "setup_score setup_score_pre leader_score trigger_score_daily total_score"


@query(SCORED + f"SELECT {q.rows(SCORE_COLUMNS, 'symbol', 'date', 'breakout_type', 'leader_pass', 'daily_signal')} FROM scored")
def daily_scores(spark, d):
    return rows(levels.daily_scores(fx.daily(spark, d)), SCORE_COLUMNS, "symbol", "date", "breakout_type", "leader_pass", "daily_signal")


@query(SCORED + f", top AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY total_score DESC, symbol) AS pick FROM scored WHERE history_ok AND leader_pass AND total_score IS NOT NULL) SELECT symbol, date, pick, breakout_type, {q.rows('total_score leader_score setup_score_pre')} FROM top WHERE pick <= 10")
def daily_screen(spark, d):
    """The ten best symbols of each date."""
    out = levels.daily_scores(fx.daily(spark, d)).where("history_ok AND leader_pass AND total_score IS NOT NULL")
    w = Window.partitionBy("date").orderBy(F.desc("total_score"), "symbol")
    return rows(out.withColumn("pick", F.row_number().over(w).cast("long")).where("pick <= 10"), "total_score leader_score setup_score_pre", "symbol", "date", "pick", "breakout_type")


HOLD_SQL = " + ".join([
    f"25.0 * {q.regime('sma10', 'sma21')}",
    "25.0 * coalesce(greatest(s10, s21), 0.0)",
    f"15.0 * {q.zero(q.clip01(f'1.0 - {q.floor0('(h10 - close) / nullif(h10, 0)')} / 0.10'))}",
    f"15.0 * coalesce(0.6 * {q.clip01(f'(sma10 / nullif({q.lag('sma10', 3)}, 0) - 1.0) / 0.03')} + 0.4 * {q.clip01(f'(sma21 / nullif({q.lag('sma21', 5)}, 0) - 1.0) / 0.05')}, 0.0)",
    "10.0 * coalesce(range_pct < range_median10 AND volume < vol20 AND close <= prev_close, false)::INT",
    "10.0 * (1.0 - coalesce(close < prev_close AND volume > 1.2 * vol20 AND (close - low) / nullif(high - low, 0) < 0.35 AND range_pct > 1.05 * range_median10, false)::INT)",
])


@query(q.stack(q.DAILY, q.features(), f"h AS (SELECT *, {q.surf('sma10', 5, 0.8, 1.0, 0.985, 1.0)} AS s10, {q.surf('sma21', 8, 0.75, 1.2, 0.98, 1.5)} AS s21, {q.roll('max', 'high', 10)} AS h10 FROM base)", select=f"SELECT symbol, date, {q.r4(HOLD_SQL, 'hold_score')} FROM h"))
def hold_scores(spark, d):
    return rows(daily.hold_score(fx.daily(spark, d)), "hold_score", "symbol", "date")


def breakout_events(spark, d) -> DataFrame:
    """Breakouts of the highest high of three bars, as events with levels."""
    bars = fx.daily(spark, d).withColumns({"pivot_high": rolling(F.max, "high", prior_n(3), 3), "prev_close": lag("close"), "vol20": daily.sma("volume", 20, 5)})
    hit = yes((F.col("close") >= F.col("pivot_high")) & (F.col("prev_close") < F.col("pivot_high")))
    out = bars.where(hit).withColumns({"entry": F.col("close"), "stop": F.col("low") * 0.999, "pivot": F.col("pivot_high"), "x": div("close", "pivot_high") - 1.0, "v": div("volume", "vol20")})
    out = out.withColumns({"base": F.col("low"), "gap": div("open", "prev_close") - 1.0, "trigger_score": 40.0 + 40.0 * F.col("v"), "trigger_hhmm": F.concat(F.lit("09:"), (F.dayofmonth("date") % 30 + 30).cast("string"))})
    return out.select("symbol", "date", "entry", "stop", "pivot", "x", "v", "base", "gap", "trigger_score", "trigger_hhmm", F.concat_ws("|", "symbol", F.col("date").cast("string")).alias("id"))


EVENTS_SQL = f"""eb AS (SELECT *, {q.roll('max', 'high', 3, None, True)} AS pivot_high, {q.lag('close')} AS prev_close, {q.roll('avg', 'volume', 20, 5)} AS vol20 FROM daily)
, evs AS (SELECT symbol, date, close AS entry, low * 0.999 AS stop, pivot_high AS pivot_level, close / nullif(pivot_high, 0) - 1.0 AS x, volume / nullif(vol20, 0) AS v, low AS base, open / nullif(prev_close, 0) - 1.0 AS gap, 40.0 + 40.0 * (volume / nullif(vol20, 0)) AS trigger_score, '09:' || (day(date) % 30 + 30)::VARCHAR AS trigger_hhmm, symbol || '|' || date::VARCHAR AS id FROM eb WHERE close >= pivot_high AND prev_close < pivot_high)"""
OUTCOMES_SQL = f"""outs AS (SELECT e.*, c5 / nullif(entry, 0) - 1.0 AS ret_5, c10 / nullif(entry, 0) - 1.0 AS ret_10, c20 / nullif(entry, 0) - 1.0 AS ret_20, dlow / nullif(entry, 0) - 1.0 AS mae FROM evs e JOIN (SELECT symbol, date, low AS dlow, lead(close, 5) OVER ({q.W}) AS c5, lead(close, 10) OVER ({q.W}) AS c10, lead(close, 20) OVER ({q.W}) AS c20 FROM daily) USING (symbol, date))"""


@query(q.stack(q.DAILY, EVENTS_SQL, OUTCOMES_SQL, select=f"SELECT {q.rows('ret_5 ret_10 ret_20 mae', 'symbol', 'date')}, coalesce(ret_20 > 0, false) AS success, coalesce(ret_20 >= 0.05, false) AS strong_success FROM outs"))
def forward_outcomes(spark, d):
    return rows(daily.forward_outcomes(breakout_events(spark, d), fx.daily(spark, d)), "ret_5 ret_10 ret_20 mae", "symbol", "date", "success", "strong_success")


def sweep_grid(spark: SparkSession) -> DataFrame:
    g = spark.range(0, 12).select((F.col("id") * 0.002).alias("x_min")).crossJoin(spark.range(0, 8).select((0.4 + F.col("id") * 0.2).alias("v_min")))  # 96 points
    return g.withColumn("grid_id", F.concat_ws("/", F.round(F.col("x_min") * 1000).cast("int").cast("string"), F.round(F.col("v_min") * 10).cast("int").cast("string")))


GRID_SQL = "grid AS (SELECT a * 0.002::DOUBLE AS x_min, 0.4::DOUBLE + b * 0.2::DOUBLE AS v_min, (round(a * 0.002 * 1000)::INT)::VARCHAR || '/' || (round((0.4 + b * 0.2) * 10)::INT)::VARCHAR AS grid_id FROM range(12) t(a), range(8) u(b))"
SWEEP_SQL = "sweep AS (SELECT grid_id, count(*) AS n, avg(ret_20) AS mean_ret, median(ret_20) AS median_ret, avg((ret_20 > 0)::INT) AS win_rate, avg(mae) AS mean_mae FROM outs JOIN grid ON x >= x_min AND v >= v_min WHERE ret_20 IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"


def sweep(spark, d) -> DataFrame:
    events = daily.forward_outcomes(breakout_events(spark, d), fx.daily(spark, d)).where("ret_20 IS NOT NULL")
    return learn.threshold_sweep(events, sweep_grid(spark), {"x": "x_min", "v": "v_min"}, min_count=5, ret="ret_20")


@query(q.stack(q.DAILY, EVENTS_SQL, OUTCOMES_SQL, GRID_SQL, SWEEP_SQL, select=f"SELECT {q.rows('mean_ret median_ret win_rate mean_mae', 'grid_id', 'n')}, {q.r4('mean_ret + 0.35 * median_ret + 0.03 * win_rate + 0.15 * mean_mae', 'score')} FROM sweep"))
def threshold_sweep(spark, d):
    return rows(sweep(spark, d), "mean_ret median_ret win_rate mean_mae score", "grid_id", "n")


@query(q.stack(q.DAILY, EVENTS_SQL, OUTCOMES_SQL, GRID_SQL, SWEEP_SQL, "sc AS (SELECT s.*, x_min, mean_ret + 0.35 * median_ret + 0.03 * win_rate + 0.15 * mean_mae AS score FROM sweep s JOIN grid USING (grid_id))", select="SELECT grid_id, n FROM sc ORDER BY CASE WHEN n >= 50 AND x_min >= 0.01 THEN 0 WHEN n >= 50 THEN 1 ELSE 2 END, score DESC, n DESC, grid_id LIMIT 1"))
def best_thresholds(spark, d):
    swept = sweep(spark, d).join(F.broadcast(sweep_grid(spark).select("grid_id", "x_min")), "grid_id")  # 96 points
    return learn.select_best(swept, 50, F.col("x_min") >= 0.01).select("grid_id", "n")


#: The grids of the two lanes, by threshold; `max` thresholds may not be exceeded.
STANDARD_GRID = {
    "leader_min": (80.0, 85.0, 89.0, 90.0, 94.0),
    "setup_min": (48.0, 52.0, 55.0, 58.0, 61.0, 65.0, 70.0, 71.0),
    "trigger_min": (68.0, 70.0, 72.0, 74.0, 76.0, 78.0, 80.0),
    "cum_vol_min": (0.0, 1.0, 1.20, 1.35, 1.50),
    "bar_vol_min": (0.0, 1.0, 1.10),
}
TIGHT_GRID = {
    "leader_min": (80.0, 85.0, 89.0, 90.0, 94.0),
    "setup_min": (50.0, 55.0, 57.0, 60.0, 62.0, 65.0),
    "trigger_min": (62.0, 65.0, 68.0, 69.0, 72.0, 75.0),
    "cum_vol_min": (0.0, 1.0, 1.20, 1.35),
    "dist_max": (0.50, 0.65, 0.80, 1.00, 1.20),
    "gap_max": (0.40, 0.55, 0.70, 0.90, 1.10),
}


def lane_grid(spark: SparkSession, values: dict[str, tuple[float, ...]]) -> DataFrame:
    """All combinations; grid_id names the thresholds in order."""
    grid = spark.range(1).drop("id")
    for name, numbers in values.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, numbers))).alias(name))
    return grid.withColumn("grid_id", F.concat_ws("/", *[(F.col(c) * 100).cast("int").cast("string") for c in values]))


def lane_grid_sql(values: dict[str, tuple[float, ...]]) -> str:
    lists = ", ".join(f"(SELECT unnest([{', '.join(map(repr, numbers))}])::DOUBLE AS {name})" for name, numbers in values.items())
    return f"grid AS (SELECT *, {" || '/' || ".join(f'((({c}) * 100)::INT)::VARCHAR' for c in values)} AS grid_id FROM {lists})"


def lane_events(spark, d) -> DataFrame:
    """Daily breakouts of three bars with the scores that the grids look at, shifted to where these thresholds cut."""
    s = levels.daily_scores(fx.daily(spark, d), pivot_window=3).where("breakout_type <> 'none' AND history_ok")
    s = s.withColumns({"entry": F.col("close"), "leader": F.col("leader_score") + 20.0, "setup": F.col("setup_score_pre") + 10.0, "trigger": F.col("trigger_score_daily"), "cum_vol": zero(div("volume", "vol20")), "bar_vol": zero(div("volume", "vol5")), "dist": div(div("close", "resistance_used") - 1.0, "adr20_pct"), "gap_norm": div(F.greatest(F.lit(0.0), div("open", "prev_close") - 1.0), "adr20_pct")})
    return daily.forward_outcomes(s, fx.daily(spark, d)).where("ret_20 IS NOT NULL")


LANE_SQL = q.stack(q.DAILY, q.features(pivot=3), q.diagonal(), q.strength(), q.scores(), select="") + f""", le AS (SELECT symbol, date, close AS entry, low, leader_score + 20.0 AS leader, setup_score_pre + 10.0 AS setup, trigger_score_daily AS "trigger", coalesce(volume / nullif(vol20, 0), 0.0) AS cum_vol, coalesce(volume / nullif(vol5, 0), 0.0) AS bar_vol, (close / nullif(resistance_used, 0) - 1.0) / nullif(adr20_pct, 0) AS dist, {q.floor0('open / nullif(prev_close, 0) - 1.0')} / nullif(adr20_pct, 0) AS gap_norm FROM scored WHERE breakout_type <> 'none' AND history_ok)
, lo AS (SELECT le.*, c20 / nullif(entry, 0) - 1.0 AS ret_20, le.low / nullif(entry, 0) - 1.0 AS mae FROM le JOIN (SELECT symbol, date, lead(close, 20) OVER ({q.W}) AS c20 FROM daily) USING (symbol, date) WHERE c20 IS NOT NULL)
"""


def _lane_sweep_sql(values: dict, condition: str, least: int) -> str:
    return LANE_SQL + f", {lane_grid_sql(values)}, sweep AS (SELECT grid_id, count(*) AS n, avg(ret_20) AS mean_ret, median(ret_20) AS median_ret, avg((ret_20 > 0)::INT) AS win_rate, avg(mae) AS mean_mae FROM lo JOIN grid ON {condition} GROUP BY 1 HAVING count(*) >= {least}) SELECT {q.rows('mean_ret median_ret win_rate mean_mae', 'grid_id', 'n')}, {q.r4('mean_ret + 0.35 * median_ret + 0.03 * win_rate + 0.15 * mean_mae', 'score')} FROM sweep"


_LEAST = {"leader": "leader_min", "setup": "setup_min", "trigger": "trigger_min", "cum_vol": "cum_vol_min"}


@query(_lane_sweep_sql(STANDARD_GRID, 'leader >= leader_min AND setup >= setup_min AND "trigger" >= trigger_min AND cum_vol >= cum_vol_min AND bar_vol >= bar_vol_min', 20))
def standard_sweep(spark, d):
    """The 4,200 points of the standard lane."""
    out = learn.threshold_sweep(lane_events(spark, d), lane_grid(spark, STANDARD_GRID), _LEAST | {"bar_vol": "bar_vol_min"}, min_count=20, ret="ret_20")
    return rows(out, "mean_ret median_ret win_rate mean_mae score", "grid_id", "n")


@query(_lane_sweep_sql(TIGHT_GRID, 'leader >= leader_min AND setup >= setup_min AND "trigger" >= trigger_min AND cum_vol >= cum_vol_min AND dist <= dist_max AND gap_norm <= gap_max', 10))
def tight_sweep(spark, d):
    """The 18,000 points of the tight lane."""
    out = learn.threshold_sweep(lane_events(spark, d), lane_grid(spark, TIGHT_GRID), _LEAST, {"dist": "dist_max", "gap_norm": "gap_max"}, min_count=10, ret="ret_20")
    return rows(out, "mean_ret median_ret win_rate mean_mae score", "grid_id", "n")


@query(q.stack(q.DAILY, EVENTS_SQL, OUTCOMES_SQL, "z AS (SELECT *, coalesce(ret_20 > 0, false) AS success, coalesce(ret_20 >= 0.05, false) AS strong FROM outs)", "y AS (SELECT * FROM z WHERE CASE WHEN (SELECT count(*) FROM z WHERE strong) >= 10 THEN strong ELSE success END)", select=f"SELECT count(*) AS n, {q.r4('quantile_cont(x, 0.3)', 'x_min')}, {q.r4('quantile_cont(v, 0.8)', 'v_max')} FROM y"))
def success_quantiles(spark, d):
    events = daily.forward_outcomes(breakout_events(spark, d), fx.daily(spark, d))
    return rows(learn.success_quantiles(events, ["x"], ["v"]), "x_min v_max", "n")


@query(q.stack(q.DAILY, "l AS (UNPIVOT (SELECT close, volume, high - low AS spread FROM daily) ON close, volume, spread INTO NAME feature VALUE x)", select=f"SELECT feature, count(x) AS n, {q.r4('avg(x)', 'mean')}, {q.r4('stddev_samp(x)', 'std')}, {q.r4('quantile_cont(x, 0.01)', 'p01')}, {q.r4('quantile_cont(x, 0.5)', 'p50')}, {q.r4('quantile_cont(x, 0.99)', 'p99')} FROM l GROUP BY 1"))
def feature_distribution(spark, d):
    out = learn.feature_distribution(fx.daily(spark, d).withColumn("spread", F.col("high") - F.col("low")), ["close", "volume", "spread"])
    return rows(out, "mean std p01 p50 p99", "feature", "n")


def exit_sql(events: str = "evs", fail_days: str = "1") -> str:
    """First exits by plain search of every signal's path."""
    week = "date = max(date) OVER (PARTITION BY symbol, date + ((5 - isodow(date) + 7) % 7)::INT)"
    rule = ["stop_n", "fail_n", "trail_n", "week_n", "drop_n"]
    return f"""xa AS MATERIALIZED (SELECT symbol, date, high, low, close, row_number() OVER ({q.W}) AS n, {q.lag('low')} AS prev_low, {q.roll('avg', 'close', 21)} AS dma21,
    {q.roll('avg', 'close', 50)} AS dma50, {week} AS week_end, last(close) OVER ({q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close FROM daily)
, xe AS MATERIALIZED (SELECT e.id, e.symbol, e.date, e.entry, e.stop, e.pivot_level, {fail_days} AS fd, b.n AS n0, b.close AS close0, last_close FROM {events} e JOIN xa b USING (symbol, date))
, xp AS MATERIALIZED (SELECT id, min(b.n) FILTER (b.n > n0 AND b.low <= stop) AS stop_n, min(b.n) FILTER (b.date - e.date <= fd AND b.close < pivot_level) AS fail_n,
    min(b.n) FILTER (b.n > n0 AND b.high >= entry * 1.2) AS p, min(b.n) FILTER (b.close >= entry * 3.0) AS k, min(b.n) FILTER (b.n > n0 AND b.close < dma21) AS drop_n
  FROM xe e JOIN xa b ON e.symbol = b.symbol AND b.n >= n0 GROUP BY id)
, xr AS MATERIALIZED (SELECT id, min(b.n) FILTER (b.n >= p AND b.n > k AND b.low < prev_low) AS trail_n, min(b.n) FILTER (b.n >= p AND week_end AND b.close < dma50) AS week_n
  FROM xe e JOIN xp USING (id) JOIN xa b ON e.symbol = b.symbol AND b.n >= p GROUP BY id)
, xs AS (SELECT id, stop_n, fail_n, p, trail_n, week_n, CASE WHEN p IS NULL OR drop_n < p THEN drop_n END AS drop_n FROM xp LEFT JOIN xr USING (id))
, xt AS (SELECT *, least({', '.join(rule)}) AS hit FROM xs)
, xu AS (SELECT e.*, p, hit, b.date AS exit_date, CASE WHEN hit IS NULL THEN 'open' WHEN hit = n0 THEN '{ledger.FAILED_AT_ONCE}' WHEN hit = stop_n THEN '{ledger.HARD}' WHEN hit = fail_n THEN '{ledger.FAILED}'
    WHEN hit = trail_n THEN '{ledger.TRAILED}' WHEN hit = week_n THEN '{ledger.WEEKLY}' ELSE '{ledger.BELOW_21}' END AS reason, b.close AS hit_close, b.prev_low AS hit_prev_low
  FROM xe e JOIN xt USING (id) LEFT JOIN xa b ON e.symbol = b.symbol AND b.n = hit)
, xv AS (SELECT *, CASE reason WHEN '{ledger.HARD}' THEN stop WHEN '{ledger.TRAILED}' THEN hit_prev_low ELSE hit_close END AS exit_price FROM xu)
, xw AS (SELECT *, coalesce(p < hit OR (p = hit AND reason NOT IN ('{ledger.HARD}', '{ledger.FAILED}')) OR (p IS NOT NULL AND hit IS NULL), false) AS partial, coalesce(exit_price, last_close) / nullif(entry, 0) - 1.0 AS raw FROM xv)
, exits AS (SELECT id, symbol, date, entry, exit_date, reason, exit_price, partial, CASE WHEN partial THEN 0.1 + 0.5 * raw ELSE raw END AS ret FROM xw)"""


@query(q.stack(q.DAILY, EVENTS_SQL.replace("evs AS (", "evs AS MATERIALIZED ("), exit_sql(), select=f"SELECT {q.rows('exit_price ret', 'symbol', 'date', 'exit_date', 'reason', 'partial')} FROM exits"))
def exit_outcomes(spark, d):
    return rows(ledger.exit_rule_outcomes(breakout_events(spark, d), fx.daily(spark, d)), "exit_price ret", "symbol", "date", "exit_date", "reason", "partial")


def _variant_sql(v: ledger.Variant) -> str:
    parts = [f"buffer = {v.buffer!r} AND fail_days = {v.fail_days} AND NOT coalesce(gap >= {v.gap_max!r}, false)"]
    parts += [f"trigger_hhmm >= '{v.after}'"] if v.after else []
    parts += [f"trigger_score >= {v.trigger_min!r}"] if v.trigger_min is not None else []
    return f"SELECT '{v.name}' AS variant, reason, ret FROM rv JOIN exits USING (id) WHERE {' AND '.join(parts)}"


_RULES = "rv AS MATERIALIZED (SELECT e.* EXCLUDE (stop, id), base * (1.0::DOUBLE - buffer) AS stop, id || '#' || buffer || '#' || fail_days AS id, buffer, fail_days FROM evs e, (VALUES (0.001::DOUBLE), (0.0025)) b(buffer), (VALUES (1), (2)) f(fail_days))"


@query(q.stack(q.DAILY, EVENTS_SQL, _RULES, exit_sql("rv", "fail_days"), f"vs AS ({' UNION ALL '.join(map(_variant_sql, ledger.VARIANTS))})", select=f"SELECT variant, count(*) AS n, {q.r4('avg(ret)', 'mean_ret')}, {q.r4('median(ret)', 'median_ret')}, {q.r4('avg((ret > 0)::INT)', 'win_rate')}, count(*) FILTER (reason = 'open') AS still_open FROM vs GROUP BY 1"))
def variants(spark, d):
    """The eleven variants of filter, stop buffer and pivot-failure days."""
    return rows(ledger.variant_compare(breakout_events(spark, d), fx.daily(spark, d)), "mean_ret median_ret win_rate", "variant", "n", "still_open")


def round_trips(spark, d) -> DataFrame:
    return ledger.fifo_round_trips(fx.fills(spark, d), ["date", "o"])


@query(q.stack(q.fifo(), select=f"SELECT symbol, entry_date, exit_date, shares, {q.rows('entry_price exit_price')}, {q.r4('(exit_price - entry_price) * shares', 'pnl')} FROM trips"))
def fifo_trips(spark, d):
    return rows(round_trips(spark, d), "entry_price exit_price pnl", "symbol", "entry_date", "exit_date", "shares")


@query(q.stack(q.fifo(), "t AS (SELECT *, (exit_price - entry_price) * shares AS pnl, exit_price / nullif(entry_price, 0) - 1.0 AS ret FROM trips)", select=f"SELECT count(*) AS trades, {q.r4('avg((pnl > 0)::INT)', 'win_rate')}, {q.r4('avg(ret)', 'mean_ret')}, {q.r4('median(ret)', 'median_ret')}, {q.r4('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0)', 'profit_factor')} FROM t"))
def trip_stats(spark, d):
    return rows(ledger.trade_stats(round_trips(spark, d)), "win_rate mean_ret median_ret profit_factor", "trades")


@query(q.stack(q.fifo(), select=f"SELECT year(exit_date)::INT AS year, {q.r4(f'sum(greatest((exit_price - entry_price) * shares, 0.0)) * {ledger.TAX_RATE}', 'reserve')}, {q.r4('sum(greatest((exit_price - entry_price) * shares, 0.0))', 'profit')}, count(*) AS events FROM trips GROUP BY 1"))
def tax_by_year(spark, d):
    return rows(ledger.tax_reserve(round_trips(spark, d)), "reserve profit", "year", "events")


@query(q.stack(q.fifo(), "t AS (SELECT exit_date AS date, sum(exit_price / nullif(entry_price, 0) - 1.0) / 1000.0 AS day_ret FROM trips GROUP BY 1)", "u AS (SELECT date, day_ret, exp(sum(ln(1.0 + day_ret)) OVER (ORDER BY date)) AS equity FROM t)", select=f"SELECT date, {q.r4('day_ret')}, {q.r4('equity')}, {q.r4('equity / max(equity) OVER (ORDER BY date) - 1.0', 'drawdown')} FROM u"))
def trade_curve(spark, d):
    trades = round_trips(spark, d).select(F.col("exit_date").alias("date"), "ret")
    return rows(ledger.daily_trade_curve(trades, 1000), "day_ret equity drawdown", "date")


@query("WITH b AS (SELECT l_partkey, count(*) FILTER (l_linestatus = 'O') AS b, count(*) FILTER (l_linestatus <> 'O') AS s FROM lineitem GROUP BY 1) SELECT count(*) FILTER (b > s) AS open_trades FROM b")
def open_trades(spark, d):
    return ledger.open_trade_count(fx.fills(spark, d))


@query("SELECT l_returnflag AS reason, count(*) AS n FROM lineitem WHERE l_linestatus <> 'O' GROUP BY 1")
def exit_reasons(spark, d):
    fills = fx.table(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.col("l_returnflag").alias("reason"))
    return ledger.exit_reason_counts(fills)


EQUITY_SQL = """t AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) AS t FROM orders GROUP BY 1)
, eq AS (SELECT date, 100000.0 + sum((t / m - 1.0) * 500.0) OVER (ORDER BY date) AS equity FROM (SELECT *, avg(t) OVER () AS m FROM t))
, er AS (SELECT *, equity / nullif(lag(equity) OVER (ORDER BY date), 0) - 1.0 AS r, equity / max(equity) OVER (ORDER BY date) - 1.0 AS dd FROM eq)"""


@query(q.stack(EQUITY_SQL, select=f"SELECT {q.r4('arg_max(equity, date) / arg_min(equity, date) - 1.0', 'total_return')}, {q.r4('min(dd)', 'max_drawdown')}, arg_min(date, dd) AS max_drawdown_date, {q.r4('avg(r) / stddev_pop(r) * sqrt(252.0)', 'sharpe')}, {q.r4('avg(r) / stddev_pop(CASE WHEN r < 0 THEN r END) * sqrt(252.0)', 'sortino')} FROM er"))
def equity_statistics(spark, d):
    return rows(ledger.equity_stats(fx.equity(spark, d)), "total_return max_drawdown sharpe sortino", "max_drawdown_date")


@query("WITH p AS (SELECT 'C' || o_custkey AS symbol, (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * (o_orderkey % 9 + 1))::BIGINT AS quantity, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS avg_price, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS market_value FROM orders) SELECT symbol, sum(quantity)::BIGINT AS quantity, " + q.r4("sum(abs(quantity) * avg_price) / nullif(sum(CASE WHEN avg_price IS NOT NULL THEN abs(quantity) END), 0)", "avg_price") + ", " + q.r4("sum(market_value)", "market_value") + ", count(*) AS n FROM p GROUP BY 1")
def positions(spark, d):
    o = fx.table(spark, d, "orders")
    p = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), (F.when(F.col("o_orderstatus") == "F", -1).otherwise(1) * (F.col("o_orderkey") % 9 + 1)).cast("long").alias("quantity"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("avg_price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("market_value"), F.to_json(F.struct("o_orderkey")).alias("payload_json"))
    return rows(ledger.aggregate_positions(p).withColumn("n", F.size("payloads").cast("long")), "avg_price market_value", "symbol", "quantity", "n")


SESSION = "cum_volume session_open session_high_so_far session_low_so_far prev_bar_close"
RUN = q.stack(q.INTRADAY, q.RUNNING, q.SLOTTED, select="")


@query(RUN + f"SELECT {q.rows(BAR, 'symbol', 'ts', 'session_date')} FROM bars")
def intraday_bars(spark, d):
    return rows(fx.intraday(spark, d), BAR, "symbol", "ts", "session_date")


@query(RUN + f"SELECT {q.rows(SESSION, 'symbol', 'ts', 'slot')}, {q.r4(f'sum((high + low + close) / 3.0 * volume) OVER ({q.S}) / nullif(sum(volume) OVER ({q.S}), 0)', 'vwap')} FROM running")
def session_features(spark, d):
    out = intraday.session_vwap(intraday.session_running(intraday.by_symbol(fx.intraday(spark, d)))).withColumn("slot", F.col("slot").cast("long"))
    return rows(out, SESSION + " vwap", "symbol", "ts", "slot")


@query(RUN + f"SELECT {q.rows('slot_volume_mean slot_cum_volume_mean bar_vol_ratio cum_vol_ratio', 'symbol', 'ts')} FROM slotted")
def slot_volume(spark, d):
    out = intraday.same_slot_volume(intraday.session_running(intraday.by_symbol(fx.intraday(spark, d))))
    return rows(out, "slot_volume_mean slot_cum_volume_mean bar_vol_ratio cum_vol_ratio", "symbol", "ts")


@query(RUN + f""", n AS (SELECT *, lead(open) OVER ({q.S}) AS next_open, last(close) OVER ({q.S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS session_close FROM running)
, c AS (SELECT *, greatest(0.0010, least(0.0040, 0.0005 + 0.25 * coalesce(abs(session_close - next_open) / nullif(next_open, 0), 0.0))) AS penalty FROM n WHERE next_open IS NOT NULL)
, e AS (SELECT *, (session_close * (1.0 - 0.00075) * (1.0 - 0.002)) / nullif(next_open * (1.0 + 0.00075 + penalty) * (1.0 + 0.002), 0) - 1.0 AS net_return FROM c)
SELECT symbol, ts, {q.rows('next_open session_close net_return')}, coalesce(net_return > 0, false)::INT AS label FROM e""")
def cost_labels(spark, d):
    out = intraday.exec_cost_labels(intraday.next_bar(intraday.session_running(fx.intraday(spark, d))))
    return rows(out, "next_open session_close net_return", "symbol", "ts", "label")


def _rolled_levels(spark, d):
    """Daily context of the intraday fixture, with a pivot of five sessions."""
    rolled = fx.daily_of(fx.intraday(spark, d))
    out = rolled.withColumns({"prev_close": lag("close"), "tr": daily.true_range(), "pivot_high": rolling(F.max, "high", prior_n(5), 5)}).withColumn("atr20", daily.sma("tr", 5, 3))
    return levels.diag_resistance(out)


CONTEXT_SQL = f"""{q.ROLLED}
, ctx0 AS (SELECT *, {q.lag('close')} AS prev_close, CASE WHEN {q.lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) END AS tr, {q.roll('max', 'high', 5, None, True)} AS pivot_high FROM rolled)
, ctx1 AS (SELECT *, {q.roll('avg', 'tr', 5, 3)} AS atr20 FROM ctx0)
, {q.diagonal('ctx1', 'ctx')}"""
_VOL = f"0.6 * {q.clip01('cum_vol_ratio / 2.0')} + 0.4 * {q.clip01('bar_vol_ratio / 2.0')}"
_ATR = "(atr20 / nullif(prev_close, 0))"
_MOVE = "(close / nullif(session_open, 0) - 1.0)"
_EXP = f"0.5 * {q.clip01(f'(((high - low) / nullif(close, 0)) / nullif({_ATR}, 0)) / 0.35')} + 0.5 * {q.clip01(f'{_MOVE} / 0.03')}"
_HOLD = q.clip01("((close - low) / nullif(high - low, 0) - 0.5) / 0.5")
_OVER = q.floor0("close / nullif(resistance_used, 0) - 1.0")
STD_SQL = f"""sb AS (SELECT s.*, c.pivot_high, c.diag_valid, c.diag_resistance, c.atr20, c.prev_close, coalesce(s.high >= c.pivot_high AND (prev_bar_close IS NULL OR prev_bar_close < c.pivot_high), false) AS h_up, coalesce(c.diag_valid AND s.high >= c.diag_resistance AND (prev_bar_close IS NULL OR prev_bar_close < c.diag_resistance), false) AS d_up FROM slotted s LEFT JOIN ctx c ON s.symbol = c.symbol AND s.session_date = c.date)
, sc AS (SELECT *, CASE WHEN h_up AND d_up THEN 'both' WHEN h_up THEN 'horizontal' WHEN d_up THEN 'diagonal' ELSE 'none' END AS breakout_type, CASE WHEN h_up AND d_up THEN greatest(pivot_high, diag_resistance) WHEN h_up THEN pivot_high WHEN d_up THEN diag_resistance END AS resistance_used FROM sb)
, std AS (SELECT *, {_MOVE} AS move_from_open, {_OVER} AS dist_above_res, 35.0 * (0.7 * (h_up OR d_up)::INT + 0.3 * {q.clip01(f'{_OVER} / 0.02')}) + 25.0 * ({_VOL}) + 15.0 * ({_EXP}) + 15.0 * {q.clip01(f'1.0 - ((close - session_low_so_far) / nullif(close, 0)) / nullif({_ATR}, 0)')} + 10.0 * (0.7 * {_HOLD} + 0.3 * {q.clip01(f'1.0 - {_OVER} / 0.03')}) AS trigger_score FROM sc)"""
INTRA = q.stack(q.INTRADAY, q.RUNNING, q.SLOTTED, CONTEXT_SQL, STD_SQL, select="")


def _standard_events(spark, d) -> DataFrame:
    bars = intraday.same_slot_volume(intraday.session_running(intraday.by_symbol(fx.intraday(spark, d))))
    context = _rolled_levels(spark, d).select("symbol", F.col("date").alias("session_date"), "pivot_high", "diag_valid", "diag_resistance", "atr20", "prev_close")
    return intraday.standard_breakouts(bars, context)


@query(INTRA + f"SELECT symbol, ts, breakout_type, {q.rows('resistance_used dist_above_res move_from_open trigger_score')} FROM std WHERE h_up OR d_up")
def standard_breakouts(spark, d):
    return rows(_standard_events(spark, d).where("broke_out"), "resistance_used dist_above_res move_from_open trigger_score", "symbol", "ts", "breakout_type")


@query(INTRA + "SELECT symbol, session_date, min(ts) AS trigger_time, " + ", ".join([*(q.r4(f"arg_min({c}, ts) FILTER ({c} IS NOT NULL)", n) for c, n in (("close", "trigger_close"), ("trigger_score", "trigger_score"), ("cum_vol_ratio", "trigger_cum_vol_ratio"), ("low", "trigger_low"))), "arg_min(breakout_type, ts) AS trigger_breakout_type"]) + " FROM std WHERE h_up OR d_up GROUP BY 1, 2")
def first_triggers(spark, d):
    return rows(intraday.first_trigger(_standard_events(spark, d)), "trigger_close trigger_score trigger_cum_vol_ratio trigger_low", "symbol", "session_date", "trigger_time", "trigger_breakout_type")


@query(INTRA + f", f AS (SELECT *, min(slot) OVER (PARTITION BY symbol, session_date) AS f0 FROM std WHERE h_up OR d_up), g AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY trigger_score DESC NULLS LAST, ts) AS k FROM f WHERE slot <= f0 + 6) SELECT symbol, session_date, ts AS trigger_time, {q.rows('trigger_score close')} FROM g WHERE k = 1")
def best_triggers(spark, d):
    return rows(intraday.best_trigger_in_window(_standard_events(spark, d)), "trigger_score close", "symbol", "session_date", "trigger_time")


@query(INTRA + """, t AS (SELECT symbol, session_date, min(ts) AS trigger_time FROM std WHERE h_up OR d_up GROUP BY 1, 2)
, e AS (SELECT t.*, b.ts, b.close, b.low, min(CASE WHEN b.ts >= trigger_time THEN b.ts END) OVER (PARTITION BY t.symbol, t.session_date) AS entry_ts FROM t JOIN bars b USING (symbol, session_date))
, f AS (SELECT symbol, session_date, trigger_time, any_value(entry_ts) AS entry_ts, arg_min(close, ts) FILTER (ts >= trigger_time) AS entry_close, min(low) FILTER (ts <= entry_ts) AS low_at_entry FROM e GROUP BY 1, 2, 3)
""" + f"SELECT f.symbol, f.session_date, f.entry_ts, {q.r4('any_value(entry_close)', 'entry_close')}, {q.r4('any_value(low_at_entry)', 'low_at_entry')}, min(CASE WHEN b.ts > entry_ts AND b.low <= low_at_entry THEN b.ts END) AS stop_ts FROM f JOIN bars b ON f.symbol = b.symbol AND f.session_date = b.session_date GROUP BY 1, 2, 3")
def entries_and_stops(spark, d):
    bars = fx.intraday(spark, d)
    triggers = intraday.first_trigger(_standard_events(spark, d))
    entries = intraday.entry_as_of(triggers, bars).withColumn("stop", F.col("low_at_entry"))
    stops = intraday.first_touch(entries, bars).drop("stop")
    return rows(entries.join(stops, ["symbol", "session_date", "entry_ts"]), "entry_close low_at_entry", "symbol", "session_date", "entry_ts", "stop_ts")


ZZ_CONTEXT = f"""{q.ROLLED}
, z0 AS (SELECT *, {q.lag('close')} AS prev_close, CASE WHEN {q.lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')})) END AS tr, {q.roll('avg', 'volume', 5, 3)} AS vol20, {q.roll('min', 'low', 5, 3, True)} AS recent_low_5, {q.roll('max', 'high', 5, 3, True)} AS recent_high_5 FROM rolled)
, z1 AS (SELECT *, {q.roll('avg', 'tr', 5, 3)} AS atr20, {q.floor0('(recent_high_5 - prev_close) / nullif(recent_high_5, 0)')} AS pullback_depth FROM z0)
, {q.zigzag('z1', 'zz')}
, {q.zigzag_lines('z1', 'zz', 'zline')}
, {q.zigzag_scores('zline', 'zscore')}"""
_ZOVER = q.floor0("close / nullif(zigzag_line_value, 0) - 1.0")
_ZMOVE = f"(CASE WHEN slot = 0 THEN {_MOVE} ELSE close / nullif(prev_close, 0) - 1.0 END)"
ZZ_SQL = f"""zb AS (SELECT s.*, c.zigzag_line_value, c.zigzag_line_valid_pre, c.atr20, c.prev_close, c.recent_low_5, c.pullback_depth, coalesce(c.zigzag_line_valid_pre AND s.close >= c.zigzag_line_value AND (prev_bar_close IS NULL OR prev_bar_close < c.zigzag_line_value), false) AS up FROM slotted s JOIN zscore c ON s.symbol = c.symbol AND s.session_date = c.date WHERE c.zigzag_line_valid_pre)
, zev AS (SELECT *, 45.0 * {q.zero(f'0.55 * up::INT + 0.45 * {q.clip01(f'{_ZOVER} / 0.008')}')} + 5.0 * {q.zero(_VOL)} + 15.0 * {q.zero(_EXP)} + 25.0 * (0.4 * {q.zero(q.clip01(f'{_ZMOVE} / 0.06'))} + 0.4 * {q.zero(q.clip01('(close / nullif(recent_low_5, 0) - 1.0) / 0.15'))} + 0.2 * {q.zero(q.clip01('pullback_depth / 0.15'))}) + 10.0 * (0.7 * {q.zero(_HOLD)} + 0.3 * {q.zero(q.clip01(f'1.0 - {_ZOVER} / 0.06'))}) AS trigger_score FROM zb)"""


@query(q.stack(q.INTRADAY, q.RUNNING, q.SLOTTED, ZZ_CONTEXT, ZZ_SQL, select=f"SELECT symbol, ts, {q.rows('zigzag_line_value trigger_score')} FROM zev WHERE up"))
def zigzag_breakouts(spark, d):
    bars = intraday.same_slot_volume(intraday.session_running(intraday.by_symbol(fx.intraday(spark, d))))
    rolled = fx.daily_of(fx.intraday(spark, d)).withColumns({"prev_close": lag("close"), "tr": daily.true_range(), "vol20": daily.sma("volume", 5, 3), "recent_low_5": rolling(F.min, "low", prior_n(5), 3), "recent_high_5": rolling(F.max, "high", prior_n(5), 3)})
    rolled = rolled.withColumns({"atr20": daily.sma("tr", 5, 3), "pullback_depth": F.when((x := div(F.col("recent_high_5") - F.col("prev_close"), "recent_high_5")).isNotNull(), F.greatest(F.lit(0.0), x))})
    scored = levels.zigzag_setup_score(levels.zigzag_line(rolled)).where("zigzag_line_valid_pre")
    context = scored.select("symbol", F.col("date").alias("session_date"), "zigzag_line_value", "zigzag_line_valid_pre", "atr20", "prev_close", "recent_low_5", "pullback_depth")
    return rows(intraday.zigzag_breakouts(bars, context).where("broke_out"), "zigzag_line_value trigger_score", "symbol", "ts")


@query(q.stack(q.EVENTS, f"qs AS (SELECT symbol, ts, px AS price, sum(k) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, event_id) AS cum FROM ev)", "v AS (SELECT *, coalesce(greatest(0.0, cum - lag(cum) OVER (PARTITION BY symbol ORDER BY ts)), 0.0) AS v FROM qs)", select=f"SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS ts, {q.r4('arg_min(price, ts)', 'open')}, {q.r4('max(price)', 'high')}, {q.r4('min(price)', 'low')}, {q.r4('arg_max(price, ts)', 'close')}, {q.r4('sum(v)', 'volume')} FROM v GROUP BY 1, 2"))
def quote_bars(spark, d):
    return rows(quotes_to_bars(clean_quotes(fx.quotes(spark, d))).withColumn("ts", F.col("ts").cast("timestamp_ntz")), BAR, "symbol", "ts")


@query(q.stack(q.EVENTS, "p AS (SELECT symbol, quantile_cont(px, 0.02) AS initial_stop FROM ev GROUP BY 1)", select=f"SELECT symbol, ts, {q.r4('px', 'price')}, 'initial_stop' AS alert FROM ev JOIN p USING (symbol) WHERE px <= initial_stop"))
def quote_alerts(spark, d):
    quotes = clean_quotes(fx.quotes(spark, d))
    held = quotes.groupBy("symbol").agg(F.percentile("price", 0.02).alias("initial_stop")).withColumns({"partial_profit_taken": F.lit(False), "peak_close": F.lit(0.0), "entry_price": F.lit(1.0), "prior_day_low": F.lit(0.0)})
    return rows(stop_alerts(quotes, held).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "price", "symbol", "ts", "alert")


@query(q.stack(q.DAILY, q.UNIVERSE, "l AS (SELECT symbol, max(date) AS latest FROM daily WHERE right(symbol, 1) <> '3' GROUP BY 1)", select="SELECT symbol, latest AS latest_ts, (SELECT max(latest) FROM l) - latest AS gap_days, CASE WHEN latest IS NULL THEN 'missing' WHEN (SELECT max(latest) FROM l) - latest > 3 THEN 'stale' ELSE 'fresh' END AS status FROM universe LEFT JOIN l USING (symbol)"))
def gap_audit(spark, d):
    bars = fx.daily(spark, d).where(~F.col("symbol").endswith("3")).withColumnRenamed("date", "ts")
    return clean.audit_symbol_gaps(bars, fx.universe(spark, d), 3).select("symbol", "latest_ts", F.col("gap_days").cast("long").alias("gap_days"), "status")


@query(q.stack(q.UNIVERSE, select="SELECT symbol, industry, floor(market_cap * 10000 + 0.48713) / 10000 AS market_cap, row_number() OVER (ORDER BY market_cap DESC, symbol) AS rank_market_cap FROM (SELECT * FROM universe ORDER BY market_cap DESC, symbol LIMIT 50)"))
def top_universe(spark, d):
    out = report.top_universe(fx.universe(spark, d), 50).withColumn("rank_market_cap", F.col("rank_market_cap").cast("long"))
    return rows(out, "market_cap", "symbol", "industry", "rank_market_cap")


@query(q.stack(
    q.DAILY,
    "d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS o, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM daily))",
    "sz AS (SELECT any_value(n) AS n, greatest(1, (any_value(n) - 40) // 5) AS s FROM d)",
    # the first block has too little training before its embargo; what is left after five blocks is the last fold
    "f AS (SELECT k - 1 AS fold, 40 + k * s - 5 AS train_to, 40 + k * s AS valid_from, CASE WHEN k = 5 THEN n ELSE 40 + (k + 1) * s END AS valid_to FROM sz, range(1, 6) t(k) WHERE 40 + k * s < n)",
    "t AS (SELECT date, fold, CASE WHEN o < train_to THEN 'train' WHEN o >= valid_from THEN 'valid' END AS part FROM d JOIN f ON o < valid_to)",
    select="SELECT fold, part, count(*) AS n, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date FROM daily JOIN t USING (date) WHERE part IS NOT NULL GROUP BY 1, 2",
))
def walk_forward(spark, d):
    bars = fx.daily(spark, d)
    folds = learn.walk_forward_folds(bars.select("date"), 5, 40, 5)
    out = learn.fold_rows(bars, folds).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return out


RANKED_SQL = f"""lab AS (SELECT symbol, date, round(close) AS score, ({'lead(close) OVER (' + q.W + ')'} > close)::INT AS y FROM daily), la AS (SELECT * FROM lab WHERE y IS NOT NULL)"""


def _labelled(spark, d) -> DataFrame:
    out = fx.daily(spark, d).withColumns({"score": F.rint("close"), "y": (F.lead("close").over(series()) > F.col("close")).cast("int")})
    return out.where("y IS NOT NULL")


@query(q.stack(q.DAILY, RANKED_SQL.replace("round(close)", "round_even(close, 0)"), "b AS (SELECT score, count(*) AS n, sum(y) AS p FROM la GROUP BY 1)", "m AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0 AS mid, sum(n) OVER (ORDER BY score DESC) AS nn, sum(p) OVER (ORDER BY score DESC) AS pp FROM b)", select=f"SELECT {q.r4('(sum(p * mid) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(n - p))', 'roc_auc')}, {q.r4('sum(p * pp / nn) / sum(p)', 'average_precision')} FROM m"))
def ranking_metrics(spark, d):
    rows_ = _labelled(spark, d)
    both = learn.roc_auc(rows_, "score", "y").crossJoin(learn.average_precision(rows_, "score", "y"))  # one row each
    return rows(both, "roc_auc average_precision")


MODEL_FEATURES = list(daily.WATCHLIST_WEIGHTS)


def _walk_forward(spark, d, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Next-day direction from the seven features of the day, by walk-forward fits; all folds are fitted together."""
    history = daily.daily_feature_history(fx.daily(spark, d), fx.universe(spark, d))
    panel = history.withColumn("y", (F.lead("close").over(series()) > F.col("close")).cast("int")).select("symbol", "date", "y", *MODEL_FEATURES)
    return evaluate.walk_forward_fits(panel, learn.walk_forward_folds(fx.daily(spark, d).select("date"), 5, 40, 5), MODEL_FEATURES, "y", keep=keep)


@query(None)
def logistic_scores(spark, d):
    """Scores of the validation blocks by the fits of their folds: no row is scored by a fit that saw it."""
    return _walk_forward(spark, d, "symbol", "date")[0].select("symbol", "date", "fold", "score")


@query(None)
def fold_metrics(spark, d):
    """AUC, average precision and top-5 precision and recall of each fold, over real fits."""
    ties = ("daily_buy_pressure_eod", "daily_rs_score_eod")
    return evaluate.fold_metrics(_walk_forward(spark, d, "symbol", "date", "y", *ties)[0], "y", 5, ties)


@query(None)
def fold_coefficients(spark, d):
    """Mean, deviation and median over the folds of each coefficient."""
    return learn.coefficient_summary(_walk_forward(spark, d)[1])


_MINUTES = "hour(ts) * 60 + minute(ts) - 570"


@query("WITH RECURSIVE " + f"""{q.INTRADAY}
, marks AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars WHERE ({_MINUTES}) % 15 = 0 AND ({_MINUTES}) >= 15)
, smooth AS (SELECT symbol, n, ts, close::DOUBLE AS ema FROM marks WHERE n = 1
  UNION ALL SELECT m.symbol, m.n, m.ts, s.ema * (7.0::DOUBLE / 9.0) + m.close * (2.0::DOUBLE / 9.0) FROM smooth s JOIN marks m ON m.symbol = s.symbol AND m.n = s.n + 1)
SELECT b.symbol, b.ts, {q.r4('CASE WHEN s.n >= 8 THEN s.ema END', 'ema_15m')} FROM bars b ASOF LEFT JOIN smooth s ON b.symbol = s.symbol AND b.ts >= s.ts""")
def ema_15m(spark, d):
    return rows(intraday.ema_15m(intraday.session_running(fx.intraday(spark, d))), "ema_15m", "symbol", "ts")


_STATES = ("new", "Submitted", "filled", "cancelled", "pending cancel", "Cancel Requested", "user cancel", "rejected", "order rejected", "fail: limit", "part filled", "expired", "")


@query(f"""WITH o AS (SELECT upper(replace(CASE WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' ELSE coalesce(nullif({list(_STATES)!r}[o_orderkey % {len(_STATES)} + 1], ''), 'UNKNOWN') END, ' ', '_')) AS s, o_orderkey % 7 AS q, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 5 END AS f FROM orders)
SELECT CASE WHEN f >= q AND q > 0 THEN 'FILLED' WHEN s IN ('CANCEL_REQUESTED', 'CANCELLATION_REQUESTED', 'PENDING_CANCEL') THEN 'CANCEL_REQUESTED' WHEN s IN ('FILLED', 'CANCELLED', 'CANCELED', 'REJECTED', 'FAILED', 'EXPIRED') THEN s WHEN s LIKE '%CANCEL%' THEN CASE WHEN f = 0 THEN 'CANCELLED' ELSE 'PARTIALLY_FILLED' END WHEN s LIKE '%REJECT%' THEN 'REJECTED' WHEN s LIKE '%FAIL%' THEN 'FAILED' WHEN s LIKE '%PART%' AND f > 0 THEN 'PARTIALLY_FILLED' ELSE s END AS state, count(*) AS n FROM o GROUP BY 1""")
def order_states(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 11 != 0, F.get(F.array(*map(F.lit, _STATES)), (k % len(_STATES)).cast("int")))
    o = fx.table(spark, d, "orders").select(status.alias("status"), (k % 7).cast("int").alias("quantity"), F.when(k % 6 != 0, k % 5).cast("int").alias("filled"))
    return o.groupBy(ledger.order_status("status", "quantity", "filled").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'slot' || (o_orderkey % 50) AS slot_id, arg_max(o_orderkey, (o_orderdate, o_orderkey::VARCHAR)) AS o_orderkey FROM orders GROUP BY 1")
def slot_orders(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("placed_at"), F.col("o_orderkey").cast("string").alias("client_order_id"), F.to_json(F.struct(F.concat(F.lit("slot"), (F.col("o_orderkey") % 50).cast("string")).alias("slot_id"))).alias("payload_json"))
    return ledger.latest_order_per_slot(o).select("slot_id", "o_orderkey")


@query(q.stack(q.DAILY, "a AS (SELECT DISTINCT date, symbol FROM daily WHERE close >= 75)", "b AS (SELECT DISTINCT date, symbol FROM daily WHERE volume >= 30000)", select=f"SELECT {q.r4('(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b))', 'overlap')}"))
def list_overlap(spark, d):
    bars = fx.daily(spark, d)
    return rows(report.shortlist_overlap(bars.where("close >= 75"), bars.where("volume >= 30000")), "overlap")


@query(q.stack(q.DAILY, q.UNIVERSE, select="SELECT DISTINCT upper(symbol) AS symbol FROM (SELECT symbol FROM daily WHERE close >= 100 UNION ALL SELECT symbol FROM universe WHERE market_cap > 5000)"))
def monitored(spark, d):
    return report.monitor_symbols(fx.daily(spark, d).where("close >= 100"), fx.universe(spark, d).where("market_cap > 5000"))


@query(q.stack(q.INTRADAY, "m AS (SELECT symbol, ts, hour(ts) * 60 + minute(ts) - 570 AS m FROM bars)", select="SELECT symbol, ts, m::INT AS minutes_from_open, (m // 5)::INT AS slot, CASE WHEN m BETWEEN 0 AND 90 THEN 'open_drive' WHEN m BETWEEN 95 AND 300 THEN 'midday' WHEN m > 300 THEN 'power_hour' ELSE 'off_hours' END AS session_bucket, m BETWEEN 5 AND 90 AS in_window FROM m WHERE m >= 0"))
def session_times(spark, d):
    out = clean.session_fields(fx.intraday(spark, d))
    return out.select("symbol", "ts", "minutes_from_open", "slot", "session_bucket", clean.in_signal_window(F.col("minutes_from_open")).alias("in_window"))


@query(q.stack(q.DAILY, f"f AS (SELECT symbol, date AS feature_date, close FROM daily WHERE close >= 60)", "mp AS (SELECT * FROM (SELECT feature_date, lead(feature_date) OVER (ORDER BY feature_date) AS next_session_date FROM (SELECT DISTINCT feature_date FROM f)) WHERE next_session_date IS NOT NULL)", "tr AS (SELECT date AS session_date, symbol, close / nullif(open, 0) - 1.0 AS net_return FROM daily WHERE volume >= 20000)", "lb AS (SELECT date AS session_date, symbol, coalesce(close > lag(close) OVER (PARTITION BY symbol ORDER BY date), false)::INT AS close_up FROM daily)", select=f"SELECT f.symbol, f.feature_date, mp.next_session_date, (t.net_return IS NOT NULL)::INT AS any_trade, coalesce((t.net_return > 0)::INT, 0) AS any_profit, {q.r4('t.net_return', 'best_return')}, coalesce(lb.close_up, 0) AS close_up, lb.symbol IS NOT NULL AS has_daily FROM f JOIN mp USING (feature_date) LEFT JOIN lb ON lb.symbol = f.symbol AND lb.session_date = mp.next_session_date LEFT JOIN tr t ON t.symbol = f.symbol AND t.session_date = mp.next_session_date"))
def training_panel(spark, d):
    bars = fx.daily(spark, d)
    features = bars.where("close >= 60").select("symbol", F.col("date").alias("feature_date"), "close")
    trades = bars.where("volume >= 20000").select(F.col("date").alias("session_date"), "symbol", (div("close", "open") - 1.0).alias("net_return"))
    out = learn.training_panel(features, learn.watchlist_labels(trades, bars))
    return rows(out, "best_return", "symbol", "feature_date", "next_session_date", "any_trade", "any_profit", "close_up", "has_daily")


@query(q.stack(q.INTRADAY, "c AS (SELECT DISTINCT symbol, session_date FROM bars WHERE close >= 30)", "cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS pos FROM (SELECT DISTINCT session_date FROM bars))", "w AS (SELECT DISTINCT c.symbol, k.session_date FROM c JOIN cal p USING (session_date) JOIN cal k ON k.pos BETWEEN p.pos - 3 AND p.pos)", select="SELECT b.symbol, b.ts FROM bars b SEMI JOIN w ON b.symbol = w.symbol AND b.session_date = w.session_date"))
def lookback_bars(spark, d):
    bars = fx.intraday(spark, d)
    return intraday.lookback_sessions(bars, bars.where("close >= 30").select("symbol", "session_date"), 3).select("symbol", "ts")


def _signals(spark, d) -> DataFrame:
    """Daily breakouts with what sizing and priorities need."""
    s = levels.daily_scores(fx.daily(spark, d)).withColumn("runup", daily.prior_runup()).where("breakout_type <> 'none'")
    return s.withColumns({"trigger_close": F.col("close"), "trigger_score": F.col("trigger_score_daily"), "cum_vol_ratio": div("volume", "vol20"), "move_from_open": div("close", "open") - 1.0, "low_so_far_at_trigger": F.col("low"), "effective_pivot_level": F.col("resistance_used"), "entry_stop_policy": F.when(F.col("leader_score") >= 90, "ignore_stop_limit").otherwise("respect_stop_limit")})


_SIG = "sig AS (SELECT *, close AS trigger_close, trigger_score_daily AS trigger_score, volume / nullif(vol20, 0) AS cum_vol_ratio, close / nullif(open, 0) - 1.0 AS move_from_open FROM scored WHERE breakout_type <> 'none')"


@query(SCORED + f""", {_SIG}
, lk AS (SELECT symbol, date, open, close, low, prev_close, atr20, adr20_pct, leader_score, coalesce(resistance_used, pivot_high) AS level FROM sig)
, st AS (SELECT *, least(low, level) * (1.0 - 0.001::DOUBLE) AS stop, least(atr20, adr20_pct * close) AS most FROM lk WHERE low IS NOT NULL AND level IS NOT NULL AND NOT coalesce(prev_close > 0 AND open / nullif(prev_close, 0) - 1.0 >= 0.10, false))
, sz AS (SELECT *, floor(least(100000.0 * 1.0 / nullif(close - stop, 0), 100000.0 / 3 / close, 50000.0 / close))::BIGINT AS shares FROM st WHERE close - stop > 0 AND (coalesce(leader_score >= 90, false) OR most IS NULL OR close - stop <= most))
SELECT symbol, date, shares, {q.rows('stop')} FROM sz WHERE shares > 0""")
def sized_signals(spark, d):
    return rows(report.risk_sizing(_signals(spark, d), 100000.0, 50000.0), "stop", "symbol", "date", "shares")


@query(SCORED + f""", {_SIG}, {q.UNIVERSE}
, im AS (SELECT industry, date, median(0.25 * roc21 + 0.35 * roc63 + 0.4 * roc126) AS median FROM base JOIN universe USING (symbol) GROUP BY 1, 2)
, ir AS (SELECT industry, date, lag(rk) OVER (PARTITION BY industry ORDER BY date) AS industry_rs FROM (SELECT *, {q.pct_rank('median', 'date')} AS rk FROM im))
, ru AS (SELECT symbol, date, lag(greatest(roc21, roc63)) OVER ({q.W}) AS runup FROM base)
, jp AS (SELECT s.*, runup, industry, market_cap, industry_rs FROM (SELECT * FROM sig) s LEFT JOIN ru USING (symbol, date) LEFT JOIN universe USING (symbol) LEFT JOIN ir USING (industry, date))
, jr AS (SELECT * EXCLUDE (industry_rs), coalesce(industry_rs, 0.5) AS industry_rs, 1.0 - (rank() OVER (ORDER BY market_cap) + (count(*) OVER (PARTITION BY market_cap) - 1) / 2.0) / count(*) OVER () AS small_cap_score, coalesce(leader_score >= 95 AND setup_score_pre >= 68 AND trigger_score >= 77 AND cum_vol_ratio >= 3 AND move_from_open >= -0.05, false) AS a_plus FROM jp)
SELECT symbol, date, a_plus, {q.rows('small_cap_score industry_rs')}, {q.r4(' + '.join([f"25.0 * {q.zero(q.clip01('(leader_score - 60.0) / 40.0'))}", f"20.0 * {q.zero(q.clip01('1.0 - abs(setup_score_pre - 72.0) / 10.0'))}", f"18.0 * {q.zero(q.clip01('(coalesce(trigger_score, 60.0) - 50.0) / 40.0'))}", f"15.0 * {q.zero(q.clip01('ln(1.0 + coalesce(cum_vol_ratio, 0.75)) / ln(6.0)'))}", f"12.0 * {q.zero(q.clip01('runup / 1.2'))}", f"10.0 * {q.zero(q.clip01('(move_from_open + 0.02) / 0.08'))}", '20.0 * coalesce(leader_score >= 95, false)::INT']), 'industry_priority')} FROM jr""")
def industry_priorities(spark, d):
    names = ("leader_score", "setup_score_pre", "trigger_score", "cum_vol_ratio", "move_from_open", "runup")
    signals = _signals(spark, d).select("symbol", "date", *names)
    return rows(report.industry_priority(signals, daily.base_features(fx.daily(spark, d)), fx.universe(spark, d)), "small_cap_score industry_rs industry_priority", "symbol", "date", "a_plus")


#: Thresholds that let signals through on thirty sessions: ranks of one return, windows of five and ten bars.
CFG = report.ReportConfig(min_history=10, pivot_window=5, lookback_days=20, setup_floor=10.0, leader_min=15.0, standard=report.StandardRules(leader_min=15.0, trigger_min=20.0, cum_vol_min=0.5, above_pivot=0.0), tight=report.TightEntry(leader_min=15.0, setup_min=20.0, trigger_min=20.0, max_dist=3.0, max_gap=2.0, override_dist=1.0, override_setup=40.0, override_trigger=40.0), compact_leader=15.0, compact_cum_vol=0.5, compact_above_pivot=0.001)


def signal_report(spark, d) -> tuple[DataFrame, DataFrame]:
    bars = fx.intraday(spark, d)
    return report.breakout_signal_report(fx.daily_of(bars), bars, CFG)


def report_sql(cfg: report.ReportConfig) -> str:
    """The report's tables under a configuration, up to `rep`."""
    s, t = cfg.standard, cfg.tight
    slots = q.stack(q.INTRADAY, q.RUNNING, q.SLOTTED, q.ROLLED.replace("rolled AS (", "rolled0 AS ("), select="") + f", span AS (SELECT min(session_date) AS a, max(session_date) AS b FROM bars), rolled AS (SELECT r.* FROM rolled0 r, span WHERE r.date BETWEEN a - {cfg.lookback_days} AND b)"
    std = f"""{q.features('rolled', pivot=cfg.pivot_window)}
, {q.diagonal()}
, {q.strength()}
, {q.scores(history=cfg.min_history)}
, sc0 AS (SELECT *, coalesce(leader_score >= {cfg.leader_min}, false) OR coalesce({q.lag('roc21')} >= 0.15 AND {q.lag('roc63')} >= 0.3 AND {q.lag('roc126')} >= 0.5, false) AS lead_ok FROM scored)
, cand AS (SELECT sc0.*, CASE WHEN setup_score_pre >= 60 THEN 'normal' WHEN setup_score_pre >= 50 THEN 'override' ELSE 'none' END AS setup_tier FROM sc0, span WHERE date BETWEEN a AND b AND history_n >= {cfg.min_history} AND lead_ok AND setup_score_pre >= {cfg.setup_floor})
, ctx AS (SELECT symbol, date, pivot_high, diag_valid, diag_resistance, atr20, prev_close FROM cand)"""
    return slots + f""", {std}
, {STD_SQL.replace('FROM slotted s LEFT JOIN ctx', 'FROM slotted s JOIN ctx')}
, ft AS (SELECT symbol, session_date, min(ts) AS trigger_time, {', '.join(f'arg_min({c}, ts) FILTER ({c} IS NOT NULL) AS {n}' for c, n in (('close', 'trigger_close'), ('trigger_score', 'trigger_score'), ('cum_vol_ratio', 'cum_vol_ratio'), ('bar_vol_ratio', 'bar_vol_ratio'), ('move_from_open', 'move_from_open'), ('low', 'trigger_bar_low'), ('session_low_so_far', 'low_so_far'), ('breakout_type', 'kind')))} FROM std WHERE h_up OR d_up GROUP BY 1, 2)
, sl AS (SELECT c.symbol, c.date, 'standard' AS lane, true AS setup_candidate, setup_tier, leader_score, setup_score_pre, pivot_high, pivot_high AS level, trigger_time, trigger_close, trigger_score, cum_vol_ratio, bar_vol_ratio, move_from_open, trigger_bar_low, low_so_far, coalesce(kind, 'none') AS breakout_type, kind IS NOT NULL AS broke_out,
    coalesce(kind IS NOT NULL AND leader_score >= {s.leader_min} AND trigger_score >= {s.trigger_min} AND coalesce(cum_vol_ratio, 0) >= {s.cum_vol_min} AND coalesce(bar_vol_ratio, 0) >= {s.bar_vol_min} AND move_from_open >= {s.move_min}
      AND trigger_close >= pivot_high * (1.0 + {s.above_pivot}::DOUBLE), false) AS lane_signal, NULL AS reason FROM cand c LEFT JOIN ft ON c.symbol = ft.symbol AND c.date = ft.session_date)
, {q.zigzag('rolled')}
, {q.zigzag_lines()}
, {q.zigzag_scores()}
, zc AS (SELECT z.*, leader_score FROM zscore z JOIN rs USING (symbol, date), span WHERE date BETWEEN a AND b AND history_n >= {cfg.min_history} AND coalesce(leader_score >= {cfg.leader_min}, false) AND zigzag_line_valid_pre)
, {ZZ_SQL.replace('JOIN zscore c ON', 'JOIN zc c ON')}
, bf AS (SELECT *, min(slot) OVER (PARTITION BY symbol, session_date) AS f0 FROM zev WHERE up)
, bt AS (SELECT * FROM (SELECT *, {_MOVE} AS move_from_open, 10.0 * (0.7 * {q.zero(_HOLD)} + 0.3 * {q.zero(q.clip01(f'1.0 - {_ZOVER} / 0.06'))}) AS pts_hold, row_number() OVER (PARTITION BY symbol, session_date ORDER BY trigger_score DESC NULLS LAST, ts) AS k FROM bf WHERE slot <= f0 + 6) WHERE k = 1)
, zj AS (SELECT c.symbol, c.date, c.leader_score, c.zigzag_setup_pre AS setup_score_pre, c.pivot_high, c.zigzag_line_value, c.history_n, b.ts AS trigger_time, b.close AS trigger_close, b.trigger_score, b.cum_vol_ratio, b.bar_vol_ratio, b.move_from_open, b.low AS trigger_bar_low, b.session_low_so_far AS low_so_far, coalesce(b.up, false) AS broke_out, (b.close / nullif(c.zigzag_line_value, 0) - 1.0) / nullif(c.adr20_pct, 0) AS dist, {q.floor0('c.open / nullif(c.prev_close, 0) - 1.0')} / nullif(c.adr20_pct, 0) AS gap FROM zc c LEFT JOIN bt b ON c.symbol = b.symbol AND c.date = b.session_date)
, zt AS (SELECT *, broke_out AND coalesce(leader_score >= {t.leader_min} AND setup_score_pre >= {t.setup_min} AND trigger_score >= {t.trigger_min}, false) AND coalesce(cum_vol_ratio, 0) >= {t.cum_vol_min} AND coalesce(bar_vol_ratio, 0) >= {t.bar_vol_min} AS base_ok FROM zj)
, zl AS (SELECT symbol, date, 'zigzag' AS lane, true AS setup_candidate, NULL AS setup_tier, leader_score, setup_score_pre, pivot_high, zigzag_line_value AS level, trigger_time, trigger_close, trigger_score, cum_vol_ratio, bar_vol_ratio, move_from_open, trigger_bar_low, low_so_far, CASE WHEN broke_out THEN 'zigzag_diagonal' ELSE 'none' END AS breakout_type, broke_out,
    base_ok AND coalesce(dist <= {t.max_dist} AND gap <= {t.max_gap}, false) AS lane_signal,
    CASE WHEN NOT base_ok THEN 'failed_base_signal' WHEN coalesce(dist <= {t.max_dist} AND gap <= {t.max_gap}, false) THEN 'passed_entry_engine' WHEN coalesce(dist > {t.max_dist}, false) THEN 'entry_distance_norm_too_high' WHEN coalesce(gap > {t.max_gap}, false) THEN 'gap_norm_too_high' ELSE 'failed_tight_lane_shape' END AS reason FROM zt)
, rep AS (SELECT *, broke_out AND coalesce(leader_score >= {cfg.compact_leader}, false) AND coalesce(cum_vol_ratio, 0.0) >= {cfg.compact_cum_vol} AND coalesce(trigger_close >= coalesce(level, pivot_high) * (1.0 + {cfg.compact_above_pivot}::DOUBLE), false) AS signal FROM (SELECT * FROM sl UNION ALL SELECT * FROM zl))
"""


_REPORT = report_sql(CFG)
_PICKED = "trigger_close trigger_score cum_vol_ratio leader_score setup_score_pre"


@query(_REPORT + f"SELECT symbol, date, lane, breakout_type, setup_tier, trigger_time, lane_signal, signal AS breakout_signal, reason AS entry_filter_reason, CASE WHEN signal THEN 0 ELSE 99 END AS bucket, {q.rows(_PICKED + ' trigger_bar_low low_so_far level')} FROM rep")
def breakout_report(spark, d):
    """The whole nightly report: both lanes, their rules and triggers, and the compact rule."""
    out, _ = signal_report(spark, d)
    out = out.withColumnsRenamed({"lane_before": "lane", "signal_before": "lane_signal", "low_so_far_at_trigger": "low_so_far", "effective_pivot_level": "level", "entry_priority_bucket": "bucket"})
    return rows(out, _PICKED + " trigger_bar_low low_so_far level", "symbol", "date", "lane", "breakout_type", "setup_tier", "trigger_time", "lane_signal", "breakout_signal", "entry_filter_reason", "bucket")


#: The thresholds of the report's defaults and of the default parameters, over thirty sessions.
DEFAULT_CFG = report.ReportConfig(min_history=10, pivot_window=5, lookback_days=20)
CALIBRATED_CFG = calibration.report_config(calibration.DEFAULTS, min_history=10, pivot_window=5, lookback_days=20)
_SHORT = f"SELECT symbol, date, lane, breakout_type, lane_signal, signal AS breakout_signal, reason AS entry_filter_reason, {q.rows(_PICKED)} FROM rep"


def _short_report(spark, d, cfg: report.ReportConfig) -> DataFrame:
    bars = fx.intraday(spark, d)
    out, _ = report.breakout_signal_report(fx.daily_of(bars), bars, cfg)
    return rows(out.withColumnsRenamed({"lane_before": "lane", "signal_before": "lane_signal"}), _PICKED, "symbol", "date", "lane", "breakout_type", "lane_signal", "breakout_signal", "entry_filter_reason")


@query(report_sql(DEFAULT_CFG) + _SHORT)
def default_report(spark, d):
    """The report under its default thresholds."""
    return _short_report(spark, d, DEFAULT_CFG)


@query(report_sql(CALIBRATED_CFG) + _SHORT)
def calibrated_report(spark, d):
    """The report under the thresholds that the default parameters carry."""
    return _short_report(spark, d, CALIBRATED_CFG)


@query(_REPORT + """SELECT date, count(*) AS setup_count, count(*) FILTER (setup_tier = 'normal') AS normal_setup_count, count(*) FILTER (setup_tier = 'override') AS override_setup_count,
  count(*) FILTER (broke_out) AS breakout_count, count(*) FILTER (lane_signal) AS breakout_signal_count FROM sl GROUP BY 1""")
def standard_lane_summary(spark, d):
    """Setups by tier, breakouts and signals a date of the standard lane."""
    out, _ = signal_report(spark, d)
    standard = out.where("lane_before = 'standard'").withColumn("breakout_signal", F.col("signal_before"))
    summary = report.lane_summary(standard)
    return summary.select("date", *[F.col(c).cast("long").alias(c) for c in summary.columns[1:]])


@query(_REPORT + "SELECT date, count(*) AS setup_count, count(*) FILTER (signal) AS signal_count, count(*) FILTER (signal AND lane_signal AND lane = 'standard') AS standard_count, count(*) FILTER (signal AND lane_signal AND lane = 'zigzag') AS zigzag_count, 0 AS tight_reversal_count FROM rep GROUP BY 1")
def report_summary(spark, d):
    _, out = signal_report(spark, d)
    return out.select("date", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


_ORDER = "CASE WHEN signal THEN 0 ELSE 99 END, CASE WHEN signal THEN coalesce(cum_vol_ratio, 0.0) END DESC NULLS LAST"


@query(_REPORT + f"SELECT symbol, date, lane, signal, row_number() OVER (ORDER BY date, signal DESC, {_ORDER}, trigger_time NULLS LAST, leader_score DESC NULLS LAST, symbol, lane) AS place FROM rep")
def sorted_report(spark, d):
    """Places in the report's canonical order; ties of both lanes go by lane."""
    out, _ = signal_report(spark, d)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*report.order_of("report"), "lane_before"))  # a row a candidate of thirty sessions
    return out.select("symbol", "date", F.col("lane_before").alias("lane"), F.col("breakout_signal").alias("signal"), place.cast("long").alias("place"))


@query(_REPORT + f", one AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY {_ORDER}, trigger_time NULLS LAST, leader_score DESC NULLS LAST) AS k FROM rep WHERE signal) SELECT symbol, date, trigger_time, {q.rows('cum_vol_ratio leader_score')} FROM one WHERE k = 1")
def deduped_signals(spark, d):
    """Signals as projected for the next step, one a symbol and date."""
    out, _ = signal_report(spark, d)
    projected = report.signals_projection(out.where("breakout_signal"))
    return rows(report.dedupe_signals(projected), "cum_vol_ratio leader_score", "symbol", "date", "trigger_time")


@query(_REPORT + f", one AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN signal THEN coalesce(cum_vol_ratio, 0.0) END DESC NULLS LAST, leader_score DESC NULLS LAST, trigger_time NULLS LAST, symbol) AS k FROM rep WHERE signal) SELECT symbol, date, k AS pick, {q.rows('cum_vol_ratio')} FROM one WHERE k <= 3")
def picked_candidates(spark, d):
    """The three best signals of every date."""
    out, _ = signal_report(spark, d)
    return rows(report.select_candidates(out, 3, every_date=True).withColumn("pick", F.col("pick").cast("long")), "cum_vol_ratio", "symbol", "date", "pick")


@query(_REPORT + f""", lt AS (SELECT * FROM rep WHERE date = (SELECT max(date) FROM rep))
, o1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN signal THEN coalesce(cum_vol_ratio, 0.0) END DESC NULLS LAST, {_ORDER}, leader_score DESC NULLS LAST, setup_score_pre DESC NULLS LAST) AS k FROM lt)
, o2 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN signal THEN coalesce(cum_vol_ratio, 0.0) END DESC NULLS LAST, {_ORDER}, leader_score DESC NULLS LAST, setup_score_pre DESC NULLS LAST, symbol) AS rank_order FROM o1 WHERE k = 1)
SELECT symbol, date, rank_order, date + CASE isodow(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS session_date, {q.rows('leader_score setup_score_pre')} FROM o2 WHERE rank_order <= 5""")
def next_shortlist(spark, d):
    out, _ = signal_report(spark, d)
    return rows(report.shortlist(out, 5).withColumn("rank_order", F.col("rank_order").cast("long")), "leader_score setup_score_pre", "symbol", "date", "rank_order", "session_date")


@query(_REPORT + ", a AS (SELECT u.symbol, CASE WHEN m IS NULL THEN 'missing' WHEN (SELECT max(date) FROM rolled0) - m > 0 THEN 'stale' ELSE 'fresh' END AS status FROM (SELECT DISTINCT symbol FROM rolled0) u LEFT JOIN (SELECT symbol, max(date) AS m FROM rolled0 WHERE symbol <> 'E3' AND (symbol <> 'E5' OR date < (SELECT max(date) FROM rolled0)) GROUP BY 1) USING (symbol)) SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, count(*) FILTER (signal) AS signals, (SELECT count(*) FROM a WHERE status = 'stale') AS stale, (SELECT count(*) FROM a WHERE status = 'missing') AS missing FROM rep")
def report_totals(spark, d):
    """One row over the report and an audit in which a symbol is missing and one is a day behind."""
    out, _ = signal_report(spark, d)
    rolled = fx.daily_of(fx.intraday(spark, d))
    newest = rolled.agg(F.max("date").alias("newest"))
    bars = rolled.crossJoin(newest).where("symbol <> 'E3' AND (symbol <> 'E5' OR date < newest)").withColumnRenamed("date", "ts")  # one row
    return report.run_summary(out, clean.audit_symbol_gaps(bars, rolled.select("symbol")))


@query(SCORED + f"SELECT symbol, date, CASE WHEN setup_score_pre >= 60 THEN 'normal' WHEN setup_score_pre >= 50 THEN 'override' ELSE 'none' END AS setup_tier, {q.rows('setup_score_pre leader_score')} FROM scored WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND history_ok AND leader_pass AND setup_score_pre >= 50")
def setups(spark, d):
    """Setup candidates of a year; without the scope, as history before it feeds the scores."""
    scored = levels.daily_scores(fx.daily(spark, d))
    return rows(clean.setup_candidates(scored, "1997-01-01", "1997-12-31", 50.0), "setup_score_pre leader_score", "symbol", "date", "setup_tier")


@query(q.stack(q.DAILY, select=f"SELECT symbol, date, {q.r4('close')} FROM daily WHERE date BETWEEN DATE '1997-06-01' - 90 AND DATE '1997-06-30'"))
def scoped_history(spark, d):
    return rows(clean.scope_daily_history(fx.daily(spark, d), "1997-06-01", "1997-06-30", 90), "close", "symbol", "date")


@query(SCORED + f", top AS (SELECT *, row_number() OVER (ORDER BY total_score DESC, symbol, date) AS k FROM scored WHERE total_score IS NOT NULL AND breakout_type <> 'none') SELECT symbol, date, {q.rows('total_score')} FROM top WHERE k <= 30")
def best_breakouts(spark, d):
    """The thirty best breakouts."""
    scored = levels.daily_scores(fx.daily(spark, d)).where("total_score IS NOT NULL AND breakout_type <> 'none'")
    return rows(report.top_n(scored, 30, F.desc("total_score"), F.asc("symbol"), F.asc("date")), "total_score", "symbol", "date")


@query(q.stack(q.DAILY, f"l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM daily), p AS (SELECT symbol, max(date) AS date, 1.01 * arg_max(close, date) AS price FROM daily WHERE right(symbol, 1) IN ('1', '2') GROUP BY 1)", select=f"SELECT l.symbol, l.date, floor(coalesce(p.price, l.close) * 10000 + 0.48713) / 10000 AS close FROM l LEFT JOIN p USING (symbol, date) WHERE k = 1 AND right(l.symbol, 1) <> '9'"))
def latest_with_quotes(spark, d):
    """The newest row of each symbol that is not held, its close replaced by a quote where there is one."""
    bars = fx.daily(spark, d)
    latest = report.latest_per_symbol(report.anti_symbols(bars, bars.where(F.col("symbol").endswith("9"))))
    quotes = bars.where(F.substring("symbol", -1, 1).isin("1", "2")).groupBy("symbol").agg(F.max("date").alias("date"), (1.01 * F.max_by("close", "date")).alias("price"))
    return rows(report.patch_close(latest, quotes), "close", "symbol", "date")


@query(SCORED + f", t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY total_score DESC, leader_score DESC NULLS LAST, symbol) AS k FROM scored WHERE total_score IS NOT NULL) SELECT symbol, date AS feature_date, k AS rank_order, count(*) OVER (PARTITION BY date) AS daily_rows, {q.r4('min(total_score) OVER (PARTITION BY date)', 'daily_cutoff')} FROM t WHERE k <= 5")
def ranked_watchlist(spark, d):
    scored = levels.daily_scores(fx.daily(spark, d)).where("total_score IS NOT NULL").select("symbol", F.col("date").alias("feature_date"), F.col("total_score").alias("score"), "leader_score")
    return rows(report.watchlist_topk(scored, 5).withColumn("rank_order", F.col("rank_order").cast("long")), "daily_cutoff", "symbol", "feature_date", "rank_order", "daily_rows")


def _positions(spark, d) -> DataFrame:
    """A position in each symbol, entered ten bars before its newest bar, with flags by symbol."""
    n = F.col("symbol").substr(2, 5).cast("int")
    bars = fx.daily(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    entry = F.col("close") * F.when(n % 5 == 0, 0.4).when(n % 5 == 1, 0.8).otherwise(1.0)
    return bars.where(F.col("k") == F.when(n % 6 == 0, 2).otherwise(11)).select(
        "symbol",
        F.col("date").alias("entry_date"),
        entry.alias("entry_price"),
        (entry * F.when(n % 7 == 0, 1.2).otherwise(0.5)).alias("initial_stop"),
        (entry * F.when(n % 6 == 0, 1.5).otherwise(1.0)).alias("pivot_level"),
        (101 + n % 2).alias("initial_shares"),
        (20 + n % 82).alias("quantity"),
        (entry * 0.5).alias("initial_risk"),
        (n % 3 == 0).alias("partial_profit_taken"),
        (n % 4 < 2).alias("reduced_on_dma21"),
        (n % 8 < 4).alias("pending_dma21_grace"),
        (entry * F.when(n % 5 == 0, 3.2).otherwise(1.1)).alias("peak_close"),
    )


def _exit_rows(spark, d) -> DataFrame:
    out = daily.hold_score(fx.daily(spark, d)).withColumnsRenamed({"sma10": "dma10", "sma21": "dma21", "sma50": "dma50"}).withColumn("tight_low_volume_day", F.col("hold_quiet") > 0)
    return report.latest_per_symbol(out).select("symbol", "date", "close", "high", "low", "prev_low", "dma10", "dma21", "dma50", "week_end", "hold_score", "tight_low_volume_day")


_HOLD_ROWS = f"""hx AS (SELECT *, {q.surf('sma10', 5, 0.8, 1.0, 0.985, 1.0)} AS s10, {q.surf('sma21', 8, 0.75, 1.2, 0.98, 1.5)} AS s21, {q.roll('max', 'high', 10)} AS h10, {q.lag('low')} AS prev_low,
    row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM base)
, hs AS MATERIALIZED (SELECT symbol, date, high, low, close, prev_low, sma10, sma21, sma50, week_end, k, substr(symbol, 2)::INT AS n, {HOLD_SQL} AS hold_score,
    coalesce(range_pct < range_median10 AND volume < vol20 AND close <= prev_close, false) AS quiet FROM hx)"""
_EXIT_SQL = """ps AS (SELECT symbol, n, date AS entry_date, e AS entry_price, e * CASE WHEN n % 7 = 0 THEN 1.2 ELSE 0.5 END AS initial_stop, e * CASE WHEN n % 6 = 0 THEN 1.5 ELSE 1.0 END AS pivot_level, n % 3 = 0 AS taken,
    n % 4 < 2 AS reduced, n % 8 < 4 AS grace, e * CASE WHEN n % 5 = 0 THEN 3.2 ELSE 1.1 END AS peak, 101 + n % 2 AS shares, 20 + n % 82 AS quantity
  FROM (SELECT *, close * CASE n % 5 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 ELSE 1.0 END AS e FROM hs WHERE k = CASE WHEN n % 6 = 0 THEN 2 ELSE 11 END))
, act AS (SELECT p.*, h.close, prev_low, compact, CASE
    WHEN h.low <= initial_stop THEN 'hard_stop_lod' WHEN h.date - entry_date <= 1 AND h.close < pivot_level THEN 'pivot_fail_exit_all'
    WHEN NOT taken AND h.high >= entry_price * 1.2 THEN 'partial_tp_1st' WHEN taken AND peak / entry_price - 1.0 >= 2.0 AND h.low < prev_low THEN 'super_winner_prior_low_stop'
    WHEN compact AND taken AND h.week_end AND h.close < sma50 THEN 'weekly_close_below_50dma' WHEN compact AND taken THEN 'compact_runner_hold'
    WHEN compact AND h.close < sma21 THEN 'pre_partial_dma21_exit' WHEN compact THEN 'compact_pre_partial_hold'
    WHEN h.close < sma21 AND quiet AND NOT grace THEN 'dma21_grace'
    WHEN h.close < sma21 AND NOT reduced THEN CASE WHEN hold_score < 45 THEN 'dma21_reduce_to_small_runner' ELSE 'dma21_hold' END
    WHEN h.close < sma21 THEN CASE WHEN hold_score < 40 THEN 'dma21_exit_after_reduce' ELSE 'dma21_runner_hold' END
    WHEN h.close < sma10 AND hold_score < 50 THEN 'dma10_holdscore_exit_all' WHEN h.close < sma10 AND hold_score < 55 AND quantity > ceil(shares * 0.25) THEN 'dma10_holdscore_reduce' ELSE 'hold' END AS reason
  FROM ps p JOIN hs h ON p.symbol = h.symbol AND h.k = 1, (VALUES (true), (false)) c(compact))
, told AS (SELECT *, CASE WHEN reason IN ('partial_tp_1st', 'dma21_reduce_to_small_runner', 'dma10_holdscore_reduce') THEN 'reduce' WHEN reason LIKE '%hold' OR reason = 'dma21_grace' THEN 'hold' ELSE 'exit_all' END AS action FROM act)"""


@query(q.stack(q.DAILY, q.features(), _HOLD_ROWS, _EXIT_SQL, select=f"""SELECT symbol, compact, action, reason,
  CASE WHEN action = 'exit_all' THEN 0 WHEN action = 'hold' THEN quantity ELSE ceil(shares * CASE reason WHEN 'partial_tp_1st' THEN 0.5 WHEN 'dma10_holdscore_reduce' THEN 0.25 ELSE 0.1 END)::BIGINT END AS target_shares,
  taken OR reason = 'partial_tp_1st' AS partial_now, CASE reason WHEN 'dma21_reduce_to_small_runner' THEN true ELSE reduced END AS reduced_now,
  reason = 'dma21_grace' OR (grace AND reason IN ('partial_tp_1st', 'dma10_holdscore_exit_all', 'dma10_holdscore_reduce')) AS grace_now,
  {q.r4("CASE WHEN action = 'hold' THEN NULL WHEN reason = 'hard_stop_lod' THEN initial_stop WHEN reason = 'super_winner_prior_low_stop' THEN prev_low WHEN reason = 'partial_tp_1st' THEN entry_price * 1.2 ELSE close END", 'price')},
  {q.r4("CASE WHEN reason LIKE 'compact%' OR reason IN ('weekly_close_below_50dma', 'pre_partial_dma21_exit') THEN greatest(peak, close) ELSE peak END", 'peak_now')} FROM told"""))
def exit_actions(spark, d):
    """What to do with a position in each symbol, by the compact rules and by hold scores."""
    positions, latest = _positions(spark, d), _exit_rows(spark, d)
    both = [ledger.exit_action(positions, latest, ledger.ExitRules(compact=x)).withColumn("compact", F.lit(x)) for x in (True, False)]
    return rows(both[0].unionByName(both[1]), "price peak_now", "symbol", "compact", "action", "reason", "target_shares", "partial_now", "reduced_now", "grace_now")


PANEL = "close_vs_vwap next_open session_close intraday_rvol volume_spike_5m distance_to_prev_day_high rs_x_intraday_rvol intraday_range_expansion_vs_atr"
_SESSIONS = q.stack(q.INTRADAY.replace("bars AS (", "every_bar AS ("), f"bars AS (SELECT * FROM every_bar WHERE {_MINUTES} >= 0)", q.RUNNING.replace(
    f"row_number() OVER ({q.S}) - 1 AS slot", f"({_MINUTES}) // 5 AS slot"), q.SLOTTED, select="")


@query(_SESSIONS + f""", v AS (SELECT *, sum((high + low + close) / 3.0 * volume) OVER ({q.S}) / nullif(sum(volume) OVER ({q.S}), 0) AS vwap, {_MINUTES} AS minutes_from_open,
    lead(open) OVER ({q.S}) AS next_open, last(close) OVER ({q.S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS session_close FROM slotted)
, w AS (SELECT *, last_value(CASE WHEN minutes_from_open % 15 = 0 AND minutes_from_open >= 15 THEN close / nullif(vwap, 0) - 1.0 END IGNORE NULLS) OVER ({q.S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close_vs_vwap FROM v)
, {q.ROLLED.replace('FROM bars', 'FROM every_bar')}
, dp AS (SELECT symbol, date AS session_date, {q.lag('high')} AS prev_day_high, {q.lag('close / nullif(open, 0) - 1.0')} AS rs, {q.lag('high - low')} AS atr FROM rolled)
, p AS (SELECT *, bar_vol_ratio AS intraday_rvol, bar_vol_ratio - 1.0 AS volume_spike_5m, close / nullif(prev_day_high, 0) - 1.0 AS distance_to_prev_day_high, rs * bar_vol_ratio AS rs_x_intraday_rvol,
    (session_high_so_far - session_low_so_far) / nullif(atr, 0) AS intraday_range_expansion_vs_atr FROM w LEFT JOIN dp USING (symbol, session_date))
SELECT symbol, ts, minutes_from_open, {q.rows(PANEL)} FROM p WHERE minutes_from_open BETWEEN 5 AND 90""")
def intraday_panel(spark, d):
    """Features of the bars within the signal window (the exponential average has a query of its own)."""
    bars = fx.intraday(spark, d)
    before = {"prev_day_high": lag("high"), "daily_rs_score_prev": lag(div("close", "open") - 1.0), "prev_day_atr14": lag(F.col("high") - F.col("low"))}
    out = intraday.intraday_feature_panel(bars, fx.daily_of(bars).withColumns(before).select("symbol", "date", *before))
    return rows(out, PANEL, "symbol", "ts", F.col("minutes_from_open").cast("long").alias("minutes_from_open"))


@query(q.stack(q.INTRADAY, select=f"SELECT replace(symbol, 'E', 'E-') AS symbol, timezone('America/New_York', timezone('UTC', ts)) AS ts, timezone('America/New_York', timezone('UTC', ts))::DATE AS session_date, {q.rows(BAR)} FROM bars"))
def new_york_bars(spark, d):
    """Bars read as UTC instants, in New York wall clock, symbols cleaned."""
    bars = fx.intraday(spark, d).withColumns({"Symbol": F.concat(F.lit(" "), F.lower(F.replace(F.col("symbol"), F.lit("E"), F.lit("e.")))), "ts": F.col("ts").cast("timestamp")})
    out = clean.normalize_intraday_bars(bars.withColumnRenamed("Symbol", "SYMBOL"))
    return rows(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), BAR, "symbol", "ts", "session_date")


@query(q.stack(q.DAILY, select="SELECT symbol, max(date) AS latest_ts, (SELECT DATE '2002-01-01' - max(date) FROM daily)::DOUBLE AS age_days FROM daily GROUP BY 1"))
def freshness(spark, d):
    bars = fx.daily(spark, d).withColumnRenamed("date", "ts")
    age = clean.bars_freshness_days(bars, F.lit("2002-01-01").cast("date"))
    return clean.latest_ts_by_symbol(bars).crossJoin(age)  # one row


@query(INTRA + f", ft AS (SELECT symbol, session_date, min(ts) AS trigger_time, arg_min(trigger_score, ts) FILTER (trigger_score IS NOT NULL) AS trigger_score FROM std WHERE h_up OR d_up GROUP BY 1, 2) SELECT symbol, session_date, trigger_time, {q.rows('trigger_score')} FROM ft WHERE strftime(trigger_time, '%H:%M') >= '09:45' AND trigger_score >= 40")
def filtered_triggers(spark, d):
    found = intraday.first_trigger(_standard_events(spark, d))
    return rows(clean.signal_score_filter(clean.signal_time_filter(found, "09:45"), 40.0), "trigger_score", "symbol", "session_date", "trigger_time")

"""DuckDB twins of the bar queries, built from shared common table expressions."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY date"
S = "PARTITION BY symbol, session_date ORDER BY ts"


def r4(x: str, name: str | None = None) -> str:
    return f"floor(({x}) * 10000 + 0.48713) / 10000 AS {name or x}"


def rows(names: str, *plain: str) -> str:
    return ", ".join([*plain, *(r4(c) for c in names.split())])


def lag(c: str, n: int = 1, w: str = W) -> str:
    return f"lag({c}, {n}) OVER ({w})"


def roll(agg: str, c: str, n: int, least: int | None = None, prior: bool = False, w: str = W) -> str:
    frame = f"{w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING" if prior else f"{w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    call = f"median({c})" if agg == "median" else f"{agg}({c})"
    return f"CASE WHEN count({c}) OVER ({frame}) >= {n if least is None else least} THEN {call} OVER ({frame}) END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def clip01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, {x})) END)"


def floor0(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, {x}) END)"


def zero(x: str) -> str:
    return f"coalesce({x}, 0.0)"


def yes(x: str) -> str:
    return f"coalesce({x}, false)"


def pct_rank(c: str, by: str) -> str:
    """Average-method percent rank among non-null values."""
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


LINES = "SELECT *, 50.0 + l_extendedprice / 2000.0 AS px, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS o FROM lineitem"
DAILY = f"""daily AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 5, '0') AS symbol, l_shipdate::DATE AS date, arg_min(px, o) AS open, max(px * (1.0 + l_discount)) AS high, min(px * (1.0 - l_tax)) AS low, arg_max(px, o) AS close, sum(l_quantity) * 1000.0 AS volume FROM ({LINES}) GROUP BY 1, 2)"""
UNIVERSE = """universe AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 5, '0') AS symbol, s_acctbal AS market_cap, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EVENTS = """ev AS (SELECT event_id, ts, 'E' || (user_id // 15) AS symbol, 20.0 + value / 10.0 AS px, coalesce(json_extract_string(props, '$.k')::DOUBLE, 0.0) AS k FROM events)"""
INTRADAY = f"""{EVENTS}, bars AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, min(ts::DATE) AS session_date, arg_min(px, event_id) AS open, max(px * (1.0 + 0.001 * (event_id % 7))) AS high, min(px * (1.0 - 0.001 * (event_id % 5))) AS low, arg_max(px, event_id) AS close, sum(k) AS volume FROM ev GROUP BY 1, 2)"""
RUNNING = f"""running AS (SELECT *, row_number() OVER ({S}) - 1 AS slot, sum(volume) OVER ({S}) AS cum_volume, first(open) OVER ({S}) AS session_open, max(high) OVER ({S}) AS session_high_so_far, min(low) OVER ({S}) AS session_low_so_far, lag(close) OVER ({S}) AS prev_bar_close FROM bars)"""
_SLOT = "PARTITION BY symbol, slot ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING"
SLOTTED = f"""slotted AS (SELECT *, volume / nullif(slot_volume_mean, 0) AS bar_vol_ratio, cum_volume / nullif(slot_cum_volume_mean, 0) AS cum_vol_ratio FROM (
  SELECT *, CASE WHEN count(volume) OVER p >= 5 THEN avg(volume) OVER p END AS slot_volume_mean, CASE WHEN count(volume) OVER p >= 5 THEN avg(cum_volume) OVER p END AS slot_cum_volume_mean FROM running WINDOW p AS ({_SLOT})))"""
ROLLED = """rolled AS (SELECT symbol, session_date AS date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"""


def features(source: str = "daily", out: str = "base", pivot: int = 20) -> str:
    tr = f"CASE WHEN {lag('close')} IS NULL THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
    first = f"SELECT *, {lag('close')} AS prev_close, {tr} AS tr, row_number() OVER ({W}) AS history_n, {div('high - low', 'close')} AS range_pct, {div('high - low', 'close')} AS hl, high / nullif(low, 0) - 1.0 AS hl1 FROM {source}"
    parts = [f"{roll('avg', 'tr', n)} AS atr{n}" for n in (5, 14, 20)] + [f"{roll('avg', 'close', n)} AS sma{n}" for n in (10, 20, 21, 50)] + [f"{roll('avg', 'volume', n)} AS vol{n}" for n in (5, 20)]
    parts += [f"({roll('max', 'high', n)}) - ({roll('min', 'low', n)}) AS range{n}" for n in (5, 20)]
    parts += [f"{roll('avg', 'hl', 20)} AS adr20_pct", f"{roll('avg', 'hl1', 20, 10)} AS adr20_alt", f"{roll('max', 'high', 3, 1, True)} AS rolling_high_3_pre", f"{roll('max', 'high', pivot, None, True)} AS pivot_high", f"{roll('max', 'high', 10, None, True)} AS high10"]
    parts += [f"{roll('min', 'low', 5, 3, True)} AS recent_low_5", f"{roll('max', 'high', 5, 3, True)} AS recent_high_5", f"{roll('min', 'low', 10, 5, True)} AS recent_low_10"]
    parts += [f"{div('close', lag('close', n))} - 1.0 AS roc{n}" for n in (21, 63, 126, 252)]
    parts += [f"{roll('median', 'range_pct', 10)} AS range_median10", "date = max(date) OVER (PARTITION BY symbol, date + ((5 - isodow(date) + 7) % 7)::INT) AS week_end", "history_n >= 126 AS history_ok"]
    return f"{out} AS (SELECT *, {floor0(div('recent_high_5 - prev_close', 'recent_high_5'))} AS pullback_depth FROM (SELECT *, {', '.join(parts)} FROM ({first})))"


def strength(source: str = "base", out: str = "rs") -> str:
    blend = " + ".join(f"{w} * {zero(f'100.0 * p{n}')}" for w, n in ((0.45, 21), (0.35, 63), (0.2, 126)))
    ranks = ", ".join(f"{pct_rank(f'roc{n}', 'date')} AS p{n}" for n in (21, 63, 126))
    return f"{out} AS (SELECT *, {lag('rs_today')} AS leader_score FROM (SELECT symbol, date, {blend} AS rs_today FROM (SELECT symbol, date, {ranks} FROM {source})))"


def diagonal(source: str = "base", out: str = "diag") -> str:
    """Swing highs (2 left, 2 right) and the line through the last two that are confirmed."""
    swing = " AND ".join([f"high > lag(high, {k}) OVER ({W})" for k in (1, 2)] + [f"high >= lead(high, {k}) OVER ({W})" for k in (1, 2)])
    return f"""{out}_a AS (SELECT *, row_number() OVER ({W}) AS i, coalesce({swing}, false) AS swing FROM {source})
, {out}_b AS (SELECT symbol, i AS i2, high AS p2, lag(i) OVER (PARTITION BY symbol ORDER BY i) AS i1, lag(high) OVER (PARTITION BY symbol ORDER BY i) AS p1 FROM {out}_a WHERE swing)
, {out}_c AS (SELECT a.*, b.i1, b.p1, b.i2, b.p2, (b.p2 - b.p1) / nullif(b.i2 - b.i1, 0) AS slope FROM {out}_a a ASOF LEFT JOIN {out}_b b ON a.symbol = b.symbol AND a.i - 2 >= b.i2)
, {out}_d AS (SELECT *, coalesce(i2 - i1 BETWEEN 2 AND 15 AND i - i2 <= 15 AND abs(slope) / nullif(abs(p2), 0) <= 0.01, false) AS diag_valid FROM {out}_c)
, {out} AS (SELECT * EXCLUDE (i, swing, i1, p1, i2, p2, slope), CASE WHEN diag_valid THEN slope END AS diag_slope, CASE WHEN diag_valid THEN p2 + slope * (i - i2) END AS diag_resistance, CASE WHEN diag_valid THEN p2 + slope * (i - i2) - slope END AS diag_resistance_prev FROM {out}_d)"""


def zigzag(source: str = "daily", out: str = "zz", order: int = 3) -> str:
    """Alternating extrema."""
    ks = range(1, order + 1)
    high = " AND ".join([f"high > coalesce(lag(high, {k}) OVER w, first(high) OVER all_w) AND high > coalesce(lead(high, {k}) OVER w, last(high) OVER all_w)" for k in ks])
    low = " AND ".join([f"low < coalesce(lag(low, {k}) OVER w, first(low) OVER all_w) AND low < coalesce(lead(low, {k}) OVER w, last(low) OVER all_w)" for k in ks])
    return f"""{out}_a AS (SELECT symbol, date, high, low, row_number() OVER w AS i, count(*) OVER all_w AS n, coalesce({high}, false) AS is_high, coalesce({low}, false) AS is_low FROM {source} WINDOW w AS ({W}), all_w AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
, {out}_b AS (SELECT symbol, date, i, n, 0 AS o, 'high' AS kind, high AS price FROM {out}_a WHERE is_high UNION ALL SELECT symbol, date, i, n, 1, 'low', low FROM {out}_a WHERE is_low)
, {out}_c AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY i, o) AS run FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY symbol ORDER BY i, o) <> kind, false)::INT AS fresh FROM {out}_b))
, {out}_d AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'high' THEN price ELSE -price END DESC, i) AS k FROM {out}_c)
, {out} AS (SELECT symbol, i, date, kind, price FROM {out}_d WHERE k = 1 AND i + {order} <= n)"""


def zigzag_lines(source: str = "base", pivots: str = "zz", out: str = "zline") -> str:
    return f"""{out}_b AS (SELECT symbol, i AS i2, price AS p2, lag(i) OVER v AS i1, lag(price) OVER v AS p1 FROM {pivots} WHERE kind = 'high' WINDOW v AS (PARTITION BY symbol ORDER BY i))
, {out}_c AS (SELECT a.*, b.i1, b.p1, b.i2, b.p2, (b.p2 - b.p1) / nullif(b.i2 - b.i1, 0) AS slope FROM (SELECT *, row_number() OVER ({W}) AS i FROM {source}) a ASOF LEFT JOIN {out}_b b ON a.symbol = b.symbol AND a.i - 1 >= b.i2)
, {out}_d AS (SELECT *, coalesce(p2 < p1 AND i2 - i1 BETWEEN 5 AND 40 AND abs(slope) / nullif(abs(p2), 0) <= 0.03, false) AS zigzag_line_valid FROM {out}_c)
, {out} AS (SELECT * EXCLUDE (i1, p1, i2, p2, slope, i), CASE WHEN zigzag_line_valid THEN i2 - i1 END AS zigzag_gap, CASE WHEN zigzag_line_valid THEN i - i2 END AS zigzag_age, CASE WHEN zigzag_line_valid THEN abs(slope) / nullif(abs(p2), 0) END AS zigzag_slope, CASE WHEN zigzag_line_valid THEN p2 + slope * (i - i2) END AS zigzag_line_value, CASE WHEN zigzag_line_valid THEN p2 + slope * (i - i2) - slope END AS zigzag_line_prev FROM {out}_d)"""


def zigzag_scores(source: str = "zline", out: str = "zscore") -> str:
    lists = ", ".join(f"list({c}) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS l_{c}" for c in ("high", "low", "volume"))
    tail = lambda c, k: f"l_{c}[greatest(1, len(l_{c}) - least(zigzag_age, {k}) + 1):]"
    dry = f"list_avg({tail('volume', 3)}) / greatest(vol20, 1e-9)"
    line = "greatest(zigzag_line_value, 1e-9)"
    score = " + ".join([
        "20.0",
        f"20.0 * {clip01(f'1.0 - abs((zigzag_line_value - close) / {line}) / 0.06')}",
        f"15.0 * {clip01('1.0 - abs(zigzag_gap - 12.0) / 18.0')}",
        f"15.0 * {clip01('1.0 - abs(zigzag_age - 8.0) / 12.0')}",
        f"10.0 * {clip01('1.0 - zigzag_slope / 0.03')}",
        f"10.0 * {clip01(f'1.0 - ((list_max({tail('high', 5)}) - list_min({tail('low', 5)})) / {line}) / 0.20')}",
        f"10.0 * {zero(f'CASE WHEN vol20 IS NOT NULL THEN {clip01(f'1.0 - ({dry} - 0.6) / 0.7')} END')}",
    ])
    return f"""{out}_a AS (SELECT *, {lists} FROM {source})
, {out}_b AS (SELECT *, CASE WHEN zigzag_line_valid THEN {score} END AS zigzag_setup_raw FROM {out}_a)
, {out} AS (SELECT *, {lag('zigzag_setup_raw')} AS zigzag_setup_pre, {lag('zigzag_line_value')} AS zigzag_line_prevday, coalesce({lag('zigzag_line_valid')}, false) AS zigzag_line_valid_pre FROM {out}_b)"""


def surf(ma: str, n: int, full: float, distance: float, deep: float, most: float) -> str:
    f = f"{W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    score = f"0.4 * {clip01(f'avg(coalesce(close >= {ma}, false)::INT::DOUBLE) OVER ({f}) / {full}')} + 0.35 * {clip01(f'1.0 - avg(abs(close - {ma}) / nullif(atr20, 0)) OVER ({f}) / {distance}')} + 0.25 * {clip01(f'1.0 - sum(coalesce(close < {deep} * {ma}, false)::INT::DOUBLE) OVER ({f}) / {most}')}"
    return f"CASE WHEN count({ma}) OVER ({f}) >= {n} AND count(atr20) OVER ({f}) >= {n} THEN {score} END"


def regime(fast: str, slow: str) -> str:
    return f"coalesce(close >= {fast} AND close >= {slow} AND {fast} > {lag(fast, 3)} AND {slow} > {lag(slow, 5)}, false)::INT::DOUBLE"


def scores(source: str = "diag", rs: str = "rs", out: str = "scored", history: int = 126) -> str:
    shrink = lambda a, b, low, width: clip01(f"1.0 - ({div(a, b)} - {low}) / {width}")
    diag_gap = "CASE WHEN diag_valid THEN diag_resistance / nullif(close, 0) - 1.0 END"
    a = [
        f"{regime('sma10', 'sma20')} AS regime", f"{surf('sma10', 10, 0.7, 0.8, 0.985, 2.0)} AS s10", f"{surf('sma20', 15, 0.73, 1.0, 0.98, 2.0)} AS s20",
        f"0.5 * {shrink('atr5', 'atr20', 0.6, 0.4)} + 0.5 * {shrink('range5', 'range20', 0.6, 0.4)} AS contraction", f"{shrink('vol5', 'vol20', 0.5, 0.5)} AS dry_up",
        f"{clip01(f'1.0 - {floor0(f'least(pivot_high / nullif(close, 0) - 1.0, {diag_gap})')} / 0.03')} AS near_resistance",
        f"{clip01(f'1.0 - {floor0('(high10 - close) / nullif(high10, 0)')} / 0.08')} AS shallow",
        f"CASE WHEN diag_valid THEN {clip01('1.0 - (abs(diag_slope) / nullif(abs(diag_resistance), 0)) / 0.01')} ELSE 0.0 END AS diag_quality",
        f"{lag('atr20')} AS lag_atr20",
    ]
    weights = (("regime", 18.0), ("surf", 24.0), ("contraction", 12.0), ("dry_up", 6.0), ("near_resistance", 20.0), ("shallow", 12.0), ("diag_quality", 8.0))
    band = f"greatest(0.04, {zero('1.75 * (lag_atr20 / nullif(prev_close, 0))')})"
    pre = clip01(f"1.0 - {floor0('least(pivot_high / nullif(rolling_high_3_pre, 0) - 1.0, CASE WHEN diag_valid THEN diag_resistance_prev / nullif(rolling_high_3_pre, 0) - 1.0 END)')} / {band}")
    now = " + ".join(f"{w} * {zero(k)}" for k, w in weights)
    before = " + ".join(f"{w} * {zero(pre if k == 'near_resistance' else lag(k))}" for k, w in weights)
    over = zero(floor0("close / nullif(resistance_used, 0) - 1.0"))
    trigger = " + ".join([
        f"35.0 * (0.7 * (breakout_type <> 'none')::INT + 0.3 * {clip01(f'{over} / 0.02')})",
        f"25.0 * {zero(clip01('(volume / nullif(vol20, 0)) / 1.5'))}",
        f"15.0 * (0.5 * {zero(clip01('(range_pct / nullif(atr20 / nullif(close, 0), 0)) / 1.2'))} + 0.5 * {zero(clip01('(close / nullif(open, 0) - 1.0) / 0.03'))})",
        f"15.0 * {zero(clip01('1.0 - ((close - low) / nullif(close, 0)) / nullif(atr20 / nullif(close, 0), 0)'))}",
        f"10.0 * (0.7 * {zero(clip01('((close - low) / nullif(high - low, 0) - 0.5) / 0.5'))} + 0.3 * {clip01(f'1.0 - {over} / 0.03')})",
    ])
    h = "coalesce(close >= pivot_high AND prev_close < pivot_high, false)"
    d = "coalesce(diag_valid AND close >= diag_resistance AND prev_close < diag_resistance_prev, false)"
    return f"""{out}_a AS (SELECT *, {', '.join(a)} FROM {source})
, {out}_b AS (SELECT *, CASE WHEN s10 IS NOT NULL AND s20 IS NOT NULL THEN greatest(s10, s20) END AS surf, {h} AS h_up, {d} AS d_up FROM {out}_a)
, {out}_c AS (SELECT *, {now} AS setup_score, {before} AS setup_score_pre, CASE WHEN h_up AND d_up THEN 'both' WHEN h_up THEN 'horizontal' WHEN d_up THEN 'diagonal' ELSE 'none' END AS breakout_type, CASE WHEN h_up AND d_up THEN greatest(pivot_high, diag_resistance) WHEN h_up THEN pivot_high WHEN d_up THEN diag_resistance END AS resistance_used FROM {out}_b)
, {out}_d AS (SELECT c.*, leader_score, {trigger} AS trigger_score_daily FROM {out}_c c JOIN {rs} USING (symbol, date))
, {out}_e AS (SELECT *, coalesce(leader_score >= 60, false) OR coalesce({lag('roc21')} >= 0.15 AND {lag('roc63')} >= 0.3 AND {lag('roc126')} >= 0.5, false) AS leader_pass, history_n >= {history} AS enough FROM {out}_d)
, {out} AS (SELECT *, enough AND leader_pass AND breakout_type <> 'none' AND (coalesce(setup_score_pre >= 60, false) OR coalesce(setup_score_pre >= 50 AND trigger_score_daily >= 85, false)) AS daily_signal, 0.4 * setup_score_pre + 0.35 * trigger_score_daily + 0.25 * {zero('leader_score')} AS total_score FROM {out}_e)"""


def vwap(source: str = "daily", out: str = "vwap") -> str:
    """VWAP since the first bar of the highest high of 63 bars."""
    return f"""{out}_t AS (SELECT *, (high + low + close) / 3.0 * volume AS pv, row_number() OVER ({W}) AS n FROM {source})
, {out}_m AS (SELECT *, max(high) OVER ({W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS m FROM {out}_t)
, {out}_a AS (SELECT t.symbol, t.date, t.n, (SELECT min(u.n) FROM {out}_t u WHERE u.symbol = t.symbol AND u.n BETWEEN t.n - 62 AND t.n AND u.high = m) AS anchor FROM {out}_m t)
, {out} AS (SELECT a.symbol, a.date, sum(t.pv) / nullif(sum(t.volume), 0) AS anchored_vwap FROM {out}_a a JOIN {out}_t t ON a.symbol = t.symbol AND t.n BETWEEN a.anchor AND a.n GROUP BY 1, 2)"""


def feature_history(out: str = "history") -> str:
    """Over base, vwap and universe: features as of the day and as of the day before."""
    rs = " + ".join(f"{w} * coalesce(roc{n}, 0)" for w, n in ((40.0, 21), (20.0, 63), (20.0, 126), (20.0, 252)))
    mean = lambda g, names: ", ".join(f"avg({c}) AS {g}_{n}" for n, c in names)
    before = lambda g, names: ", ".join(f"lag({g}_{n}) OVER (PARTITION BY {g} ORDER BY date) AS {g}_{n}_prev" for n, _ in names)
    of = {"sector": (("buy_pressure", "bp"),), "industry": (("buy_pressure", "bp"), ("rs", "rs_score"))}
    groups = "".join(f"""
, {out}_{g} AS (SELECT *, {before(g, names)} FROM (SELECT date, {g}, {mean(g, names)} FROM {out}_b WHERE {g} IS NOT NULL GROUP BY 1, 2))""" for g, names in of.items())
    own = {
        "daily_buy_pressure_prev": "bp", "prev_day_adr_pct": "adr20_alt", "daily_rrs_prev": "rrs", "daily_rs_score_prev": "rs_score",
        "distance_to_avwap_63_prev": "close / nullif(anchored_vwap, 0) - 1.0", "prev_day_close_vs_sma50": "close / nullif(sma50, 0) - 1.0",
        "prev_day_high": "high", "prev_day_atr14": "atr14",
    }
    return f"""{out}_a AS (SELECT b.*, anchored_vwap, sector, industry, ((close - low) - (high - close)) / nullif(high - low, 0) AS mf FROM base b JOIN vwap USING (symbol, date) LEFT JOIN universe USING (symbol))
, {out}_b AS (SELECT *, {roll('avg', 'mf', 20, 10)} AS bp, {rs} AS rs_score, ({rs}) / nullif(atr14 / nullif(close, 0), 0) AS rrs FROM {out}_a)
, {out}_c AS (SELECT *, {', '.join(f'{lag(x)} AS {name}' for name, x in own.items())} FROM {out}_b){groups}
, {out} AS (SELECT *, bp AS daily_buy_pressure_eod, adr20_alt AS adr_pct_20_eod, industry_buy_pressure AS industry_buy_pressure_eod, sector_buy_pressure AS sector_buy_pressure_eod,
    rrs AS daily_rrs_eod, rs_score AS daily_rs_score_eod, industry_rs AS industry_rs_eod
  FROM {out}_c LEFT JOIN {out}_sector USING (date, sector) LEFT JOIN {out}_industry USING (date, industry))"""


def fifo(out: str = "trips") -> str:
    """Round trips over every overlap of bought and effectively sold intervals."""
    w = "PARTITION BY symbol ORDER BY date, o"
    return f"""fills AS (SELECT l_shipdate::DATE AS date, 'P' || l_partkey AS symbol, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, l_quantity::BIGINT AS shares, px AS price, o FROM ({LINES}))
, f1 AS (SELECT *, sum(CASE WHEN side = 'buy' THEN shares ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING)::BIGINT AS bb, sum(CASE WHEN side = 'sell' THEN shares ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING)::BIGINT AS ss FROM fills)
, f2 AS (SELECT *, ss - greatest(0, max(ss - bb) OVER ({w} ROWS UNBOUNDED PRECEDING)) AS e FROM f1)
, f3 AS (SELECT *, coalesce(lag(e) OVER ({w}), 0) AS e0 FROM f2)
, {out} AS (SELECT b.symbol, b.date AS entry_date, s.date AS exit_date, b.price AS entry_price, s.price AS exit_price, least(b.bb, s.e) - greatest(b.bb - b.shares, s.e0) AS shares FROM f3 b JOIN f3 s ON b.symbol = s.symbol AND b.side = 'buy' AND s.side = 'sell' AND s.e > s.e0 AND b.bb - b.shares < s.e AND s.e0 < b.bb)"""


def stack(*parts: str, select: str) -> str:
    return "WITH " + "\n, ".join(parts) + "\n" + select

"""Pieces of the oracles' SQL, in DuckDB's dialect."""

from __future__ import annotations

from tessera.functions.series import HORIZONS

W = "PARTITION BY symbol ORDER BY d"
OHLC = "arg_min({p}, ({o}, {p})) AS open, max({p}) AS high, min({p}) AS low, arg_max({p}, ({o}, {p})) AS close"
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def roll(x: str, n: int) -> str:
    return f"{x} OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def past(x: str, n: int) -> str:
    return f"{x} OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def ahead(x: str, a: int, b: int) -> str:
    return f"{x} OVER ({W} ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING)"


def z(x: str, n: int, least: int) -> str:
    return f"CASE WHEN {roll(f'count({x})', n)} >= {least} THEN ({x} - {roll(f'avg({x})', n)}) / nullif({roll(f'stddev_samp({x})', n)}, 0) END"


def full(x: str, of: str, n: int) -> str:
    return f"CASE WHEN {roll(f'count({of})', n)} >= {n} THEN {x} END"


BARS = f"bars AS (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS d, {OHLC.format(p='l_extendedprice', o=LINE)}, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"
REGION_BARS = f"bars AS (SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS d, {OHLC.format(p='l_extendedprice', o=LINE)}, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"
HOURS = f"hours AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, {OHLC.format(p='value', o='ts, event_id')}, count(*) AS volume FROM (SELECT event_type, ts, event_id, value FROM events) GROUP BY event_type, date_trunc('hour', ts))"
FUNDING = "funding AS (SELECT l_returnflag AS symbol, CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 7 AS DATE) AS d, avg(l_discount) AS rate FROM lineitem GROUP BY 1, 2)"
VINTAGE = """orders_of AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, day(o_orderdate) AS dd, o_totalprice FROM orders),
vintage AS (SELECT series, period, CAST(last_day(period) + INTERVAL 14 DAY AS DATE) AS realtime_start, round(avg(o_totalprice), 4) AS value FROM orders_of WHERE dd <= 20 GROUP BY 1, 2 UNION ALL SELECT series, period, CAST(last_day(period) + INTERVAL 45 DAY AS DATE), round(avg(o_totalprice), 4) FROM orders_of GROUP BY 1, 2),
first_print AS (SELECT series, period, arg_min(value, realtime_start) AS value, min(realtime_start) AS published FROM vintage GROUP BY 1, 2)"""
CALENDAR = VINTAGE + """,
calendar AS (SELECT published AS d FROM first_print UNION SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16']))"""
SURPRISE = VINTAGE + """,
delta AS (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY published, period) AS delta FROM first_print),
moved AS (SELECT *, avg(delta) OVER b AS m, stddev_samp(delta) OVER b AS sd, count(delta) OVER b AS k, greatest(quantile_cont(abs(delta), 0.5) OVER (PARTITION BY series) * 0.01, 1e-12) AS floor FROM delta WINDOW b AS (PARTITION BY series ORDER BY published, period ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
surprise AS (SELECT series, published, arg_max(CASE WHEN k >= 6 AND sd > floor THEN (delta - m) / sd END, period) AS surprise FROM (SELECT * FROM moved) GROUP BY 1, 2)"""


def indicators(k: int = 1, of: str = "bars", p: str = "") -> str:
    """The indicators that bars give, at k bars a day: tables base, vol and ind, their names after p."""
    lag = lambda n: f"lag(close, {n}) OVER ({W})"
    low, high = roll("min(low)", 20 * k), roll("max(high)", 20 * k)
    low14, high14 = roll("min(low)", 14 * k), roll("max(high)", 14 * k)
    mean, sd = roll("avg(close)", 20 * k), roll("stddev_samp(close)", 20 * k)
    moved = f"least(abs(close - {lag(20 * k)}) / nullif({roll('sum(chg)', 20 * k)}, 0), 1.0)"
    return f"""{p}base AS (SELECT *, row_number() OVER ({W}) - 1 AS loc, count(*) OVER (PARTITION BY symbol) AS n_rows, close / lag(close) OVER ({W}) - 1 AS ret, (high - low) / nullif(close, 0) AS range_pct, abs(close - lag(close) OVER ({W})) AS chg FROM {of}),
{p}vol AS (SELECT *, CASE WHEN {roll('count(ret)', 20)} >= 10 THEN {roll('stddev_samp(ret)', 20)} END AS vol_20, CASE WHEN {roll('count(ret)', 5)} >= 5 THEN {roll('stddev_samp(ret)', 5)} END AS vol_5 FROM {p}base),
{p}ind AS (SELECT *, close / {lag(k)} - 1 AS close_return_1d, close / {lag(5 * k)} - 1 AS close_return_5d, range_pct AS daily_range_pct,
 {z('range_pct', 30 * k, 15 * k)} AS range_zscore_30d, -({z('vol_20', 180, 60)}) AS vol_compression_zscore, {z('vol_5', 252, 63)} AS shock_zscore, {z('volume', 30 * k, 15 * k)} AS volume_zscore_30d,
 {full(moved, 'chg', 20 * k)} AS efficiency_ratio_20d,
 {full(f"(close - {low}) / nullif({high} - {low}, 0)", 'close', 20 * k)} AS donchian_pct_20d,
 {full(f"(close - ({mean} - 2 * {sd})) / nullif(4 * {sd}, 0)", 'close', 20 * k)} AS bollinger_pctb_20d,
 {full(f"100 * (close - {low14}) / nullif({high14} - {low14}, 0)", 'close', 14 * k)} AS stochastic_k_14d FROM {p}vol)"""


IND = indicators()
EV = "ev AS (SELECT symbol, d AS trigger_d, loc + 1 AS entry_loc, entry_price, regime, year(d) AS period, " + ", ".join(f"best_{h} / entry_price - 1 AS mfe_{h}, worst_{h} / entry_price - 1 AS mae_{h}, fwd_{h}" for h in HORIZONS) + f" FROM (SELECT *, lead(open) OVER ({W}) AS entry_price, CASE WHEN shock_zscore >= 2 THEN 'shock' ELSE 'normal' END AS regime, " + ", ".join(f"{ahead('max(high)', 2, 1 + h)} AS best_{h}, {ahead('min(low)', 2, 1 + h)} AS worst_{h}, lead(close, {1 + h}) OVER ({W}) / lead(close, 1) OVER ({W}) - 1 AS fwd_{h}" for h in HORIZONS) + " FROM ind) WHERE coalesce(volume_zscore_30d >= 1.0, false) AND loc + 22 < n_rows AND entry_price > 0)"
LONG = "long_ev AS (" + " UNION ALL ".join(f"SELECT symbol, trigger_d, entry_loc, entry_price, period, {h} AS h, mfe_{h} AS mfe, mae_{h} AS mae, fwd_{h} AS fwd FROM ev" for h in HORIZONS) + ")"
FOLDS = "years AS (SELECT period, count(*) AS n_test FROM ev GROUP BY 1), folds AS (SELECT period AS fold, n_train, n_test FROM (SELECT *, row_number() OVER (ORDER BY period) AS k, coalesce(sum(n_test) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train FROM years) WHERE k > 3 AND n_train >= 20)"
FORWARD = "forward_of AS (" + " UNION ALL ".join(f"SELECT symbol, loc, {h} AS h, lead(close, {h}) OVER ({W}) / close - 1 AS base FROM ind" for h in HORIZONS) + ")"
TESTS = "tests AS (SELECT row_number() OVER (ORDER BY trigger_d, symbol) AS id, 'c' || CAST(entry_loc % 5 AS VARCHAR) AS candidate, symbol AS coin, trigger_d AS entry_d, CASE WHEN entry_loc % 11 = 0 THEN 'open' ELSE 'closed' END AS status, fwd_7 AS forward_return, mfe_7 AS mfe, abs(mae_7) AS mae, (entry_loc % 7) * 0.01 - 0.02 AS baseline_return FROM ev)"


def wilder(of: str = "bars", p: str = "") -> str:
    """Relative strength and true range of 14 rows, row after row."""
    return f"""{p}seq AS (SELECT *, row_number() OVER ({W}) AS n, close - lag(close) OVER ({W}) AS delta, lag(close) OVER ({W}) AS pc FROM {of}),
{p}tr AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM {p}seq),
{p}walk14 AS (SELECT symbol, d, n, close, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, tr AS t FROM {p}tr WHERE n = 1
 UNION ALL SELECT x.symbol, x.d, x.n, x.close, CASE WHEN w.g IS NULL THEN greatest(x.delta, 0) ELSE w.g * 13 / 14 + greatest(x.delta, 0) / 14 END, CASE WHEN w.l IS NULL THEN greatest(-x.delta, 0) ELSE w.l * 13 / 14 + greatest(-x.delta, 0) / 14 END, w.t * 13 / 14 + x.tr / 14 FROM {p}walk14 w JOIN {p}tr x ON x.symbol = w.symbol AND x.n = w.n + 1),
{p}wilder AS (SELECT symbol, d, CASE WHEN n > 14 THEN 100 * g / nullif(g + l, 0) END AS rsi_14d, CASE WHEN n >= 14 THEN t / close END AS atr_pct_14d FROM {p}walk14)"""


WILDER = wilder()
#: The histogram of 12, 26 and 9 rows and its sign, row after row.
MACD = f"""macd AS (SELECT symbol, d, n, close AS fast, close AS slow, 0.0::DOUBLE AS signal, 0 AS side FROM (SELECT symbol, d, close, row_number() OVER ({W}) AS n FROM bars) WHERE n = 1
 UNION ALL SELECT symbol, d, n, fast, slow, signal, CAST(sign(fast - slow - signal) AS INTEGER) FROM (SELECT symbol, d, n, fast, slow, s * 8 / 10 + (fast - slow) * 2 / 10 AS signal FROM (
  SELECT x.symbol, x.d, x.n, m.fast * 11 / 13 + x.close * 2 / 13 AS fast, m.slow * 25 / 27 + x.close * 2 / 27 AS slow, m.signal AS s FROM macd m JOIN (SELECT symbol, d, close, row_number() OVER ({W}) AS n FROM bars) x ON x.symbol = m.symbol AND x.n = m.n + 1)))"""
FUNDING_Z = FUNDING + f""", rated AS (SELECT b.symbol, b.d, last_value(rate IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM bars b LEFT JOIN funding f ON b.symbol = f.symbol AND b.d = f.d), fz AS (SELECT symbol, d, {z('rate', 30, 15)} AS funding_zscore_30d FROM rated)"""
#: All indicators of the registry; comes after BARS, SURPRISE, IND, WILDER and FUNDING_Z.
COMPLETE = """published AS (SELECT published AS d, max(surprise) FILTER (series = '1-URGENT') AS cpi_surprise, max(surprise) FILTER (series = '2-HIGH') AS rate_surprise, max(surprise) FILTER (series = '3-MEDIUM') AS jobless_claims_surprise FROM surprise GROUP BY 1),
days_of AS (SELECT published AS d FROM first_print UNION SELECT unnest([DATE '1996-01-31', DATE '1996-03-26', DATE '1997-05-20', DATE '1998-09-29', DATE '1999-11-16'])),
whole AS (SELECT ind.*, rsi_14d, atr_pct_14d, funding_zscore_30d, CAST(ind.d IN (SELECT d FROM days_of) AS INTEGER) AS is_macro_day, cpi_surprise, rate_surprise, jobless_claims_surprise FROM ind LEFT JOIN wilder USING (symbol, d) LEFT JOIN fz USING (symbol, d) LEFT JOIN published USING (d))"""
ALL = (BARS, SURPRISE, IND, WILDER, FUNDING_Z, COMPLETE)
BATTERY = "battery AS (SELECT p_partkey AS candidate, CAST(p_partkey * 31 % 60 AS BIGINT) AS n, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_partkey * 7919 % 10007 / 10007.0 / CASE WHEN p_partkey % 10 = 0 THEN 2000.0 ELSE 1.0 END END AS p, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 40 - 5) / 10.0 END AS sortino, p_partkey % 17 <> 0 AS ok, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS by_symbol, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_partkey % 7 = 0 END AS by_year, (p_partkey % 30 - 8) / 100.0 AS excess, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE (p_partkey % 25) / 12.0 END AS ratio, p_size AS weight, p_brand AS brand, CAST(DATE '2015-01-01' + CAST(p_partkey * 37 % 3000 AS INTEGER) AS DATE) AS first_tracked FROM part)"
STATUS = "CASE WHEN n <= 20 THEN 'insufficient_data' WHEN sortino IS NULL THEN 'rejected' WHEN NOT ok THEN 'watch' WHEN by_symbol IS NULL OR by_year IS NULL THEN 'watch' WHEN by_symbol OR by_year THEN 'watch' WHEN NOT coalesce(p < 0.1, false) OR excess <= 0 THEN 'rejected' WHEN ratio IS NULL OR ratio <= 1 THEN 'watch' ELSE 'accepted' END"


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def recursive(body: str, *parts: str) -> str:
    return sql(body, *parts).replace("WITH", "WITH RECURSIVE", 1)


def uniform(seed: str, *key: str) -> str:
    """The number in [0, 1) that `indicators.uniform` draws."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)

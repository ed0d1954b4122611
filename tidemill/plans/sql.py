"""Pieces of the DuckDB SQL that the oracle queries share."""

DAILY = """daily AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS a, max(l_extendedprice) AS h, min(l_extendedprice) AS l,
  sum(l_quantity) AS v, sum(l_extendedprice) / sum(l_quantity) AS unit, max(l_extendedprice / l_quantity) AS uh, min(l_extendedprice / l_quantity) AS ul
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM daily)),
grid AS (SELECT i, date, ticker FROM cal, (SELECT DISTINCT ticker FROM daily))"""
DENSE = DAILY + """,
dense AS (SELECT g.i, g.date, g.ticker, unit AS close, uh AS high, ul AS low, v AS volume FROM grid g LEFT JOIN daily USING (date, ticker))"""
PX = DAILY + """,
px AS MATERIALIZED (SELECT g.i, g.date, g.ticker, floor(avg(a) OVER w * 100 + 0.3719) / 100.0 AS close, floor(avg(h) OVER w * 100 + 0.3719) / 100.0 AS high, floor(avg(l) OVER w * 100 + 0.3719) / 100.0 AS low, floor(avg(v) OVER w * 100 + 0.3719) / 100.0 AS volume
  FROM grid g LEFT JOIN daily USING (date, ticker) WINDOW w AS (PARTITION BY g.ticker ORDER BY g.date ROWS 62 PRECEDING)),
fx AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS filled FROM px),
rx AS (SELECT *, filled / nullif(lag(filled) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM fx)"""
MARKET = PX + """,
mk AS (SELECT i, date, avg(close) AS close FROM px GROUP BY i, date)"""
TICKER = "PARTITION BY ticker ORDER BY date"


def roll(agg: str, x: str, n: int, least: int | None = None, part: str = TICKER) -> str:
    w = f"({part} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {w} >= {n if least is None else least} THEN {agg}({x}) OVER {w} END"


def lag(x: str, k: int, part: str = TICKER) -> str:
    return f"lag({x}, {k}) OVER ({part})"


def pct_rank(x: str, group: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {group} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {group}, {x}) - 1) / 2.0)"
            f" / count({x}) OVER (PARTITION BY {group}) END")


RAW = PX + f""",
f1 AS (SELECT *, filled / nullif({lag('filled', 21)}, 0) - 1 AS mom_1m, filled / nullif({lag('filled', 63)}, 0) - 1 AS mom_3m,
  filled / nullif({lag('filled', 126)}, 0) - 1 AS mom_6m, filled / nullif({lag('filled', 5)}, 0) - 1 AS mom_1w_rev,
  {lag('close', 21)} / nullif({lag('close', 252)}, 0) - 1 AS mom_12m_1m,
  {roll('stddev_samp', 'ret', 22)} AS vol_22, {roll('stddev_samp', 'ret', 63)} AS vol_63, {roll('stddev_samp', 'ret', 252)} AS vol_252,
  (close - {roll('avg', 'close', 5)}) / nullif(close, 0) AS dev_5, (close - {roll('avg', 'close', 22)}) / nullif(close, 0) AS dev_22,
  (close - {roll('avg', 'close', 63)}) / nullif(close, 0) AS dev_63, (close - {roll('avg', 'close', 252)}) / nullif(close, 0) AS dev_252,
  ({roll('avg', 'close', 50)} - {roll('avg', 'close', 200)}) / nullif(close, 0) AS ma_50_200 FROM rx),
f2 AS (SELECT *, vol_22 / nullif(vol_252, 0) AS vol_ratio_22_252, mom_3m - mom_12m_1m / 4.0 AS mom_acc_3_12, vol_22 / nullif(vol_63, 0) AS vol_change FROM f1)"""
BETA = RAW + f""",
mk AS (SELECT i, date, avg(close) AS close FROM px GROUP BY i, date),
m1 AS (SELECT date, last_value(close IGNORE NULLS) OVER (ORDER BY date) AS c FROM mk),
m2 AS (SELECT date, c / lag(c) OVER (ORDER BY date) - 1 AS mkt FROM m1),
m3 AS (SELECT date, mkt, mkt - {roll('avg', 'mkt', 252, part='ORDER BY date')} AS dev, {roll('var_samp', 'mkt', 252, part='ORDER BY date')} AS var FROM m2),
b1 AS (SELECT f2.*, mkt, dev, var, (ret - {roll('avg', 'ret', 252)}) * dev AS prod FROM f2 LEFT JOIN m3 USING (date)),
b2 AS (SELECT *, {roll('avg', 'prod', 252)} / nullif(var, 0) AS beta_252 FROM b1),
b3 AS (SELECT *, ret - beta_252 * mkt AS resid FROM b2),
b4 AS (SELECT *, {roll('sum', 'resid', 231)} AS rs, {roll('stddev_samp', 'resid', 63)} AS idio_vol_63 FROM b3),
b5 AS (SELECT *, {lag('rs', 21)} AS resid_mom_12m_1m FROM b4)"""
#: Month starts, the five best by one-month momentum on them, and the segment backtest of their equal weights.
BOOK = PX + f""",
f1 AS (SELECT *, filled / nullif({lag('filled', 21)}, 0) - 1 AS mom_1m FROM rx),
rb AS (SELECT min(date) AS rebal FROM cal GROUP BY date_trunc('month', date)),
sc AS (SELECT date AS rebal, ticker, round(mom_1m, 9) AS score FROM f1 JOIN rb ON date = rebal WHERE mom_1m IS NOT NULL),
tp AS (SELECT *, row_number() OVER (PARTITION BY rebal ORDER BY score DESC, ticker) AS rank FROM sc QUALIFY rank <= 5),
tg AS (SELECT rebal, ticker, 1.0 / count(*) OVER (PARTITION BY rebal) AS w FROM tp)"""
BACKTEST = BOOK + """,
ks AS (SELECT rebal, row_number() OVER (ORDER BY rebal) AS k FROM (SELECT DISTINCT rebal FROM tg)),
bk AS (SELECT k, rebal, ticker, w FROM tg JOIN ks USING (rebal)),
sg AS (SELECT k, rebal, sum(w) AS tot FROM bk GROUP BY k, rebal),
dy AS (SELECT date, coalesce(max(k) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cal LEFT JOIN ks ON date = rebal),
gr AS (SELECT date, ticker, coalesce(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0), 1.0) AS g FROM px),
hd AS (SELECT bk.k, gr.date, gr.ticker, bk.w * exp(sum(ln(g)) OVER (PARTITION BY bk.k, gr.ticker ORDER BY gr.date)) AS value FROM gr JOIN dy USING (date) JOIN bk ON bk.k = dy.k AND bk.ticker = gr.ticker),
vl AS (SELECT dy.date, dy.k, 1 - coalesce(any_value(tot), 0) + coalesce(sum(value), 0) AS v FROM dy LEFT JOIN sg USING (k) LEFT JOIN hd ON hd.k = dy.k AND hd.date = dy.date GROUP BY dy.date, dy.k),
od AS (SELECT sg.k, sg.rebal, hd.ticker, value / v AS w_old FROM hd JOIN sg ON hd.date = sg.rebal JOIN vl ON vl.k = hd.k AND vl.date = hd.date),
dr AS (SELECT coalesce(b.k, o.k) AS k, coalesce(b.rebal, o.rebal) AS rebal, coalesce(b.ticker, o.ticker) AS ticker, coalesce(w, 0) AS w_new, coalesce(w_old, 0) AS w_old
  FROM bk b FULL JOIN od o ON b.k = o.k AND b.ticker = o.ticker),
tv AS (SELECT k, rebal, sum(abs(w_new - w_old)) AS turnover FROM dr GROUP BY k, rebal),
e1 AS (SELECT vl.date, rebal, v, sum(CASE WHEN rebal IS NULL THEN 0 ELSE ln(v) + ln(1 - 0.001 * turnover) END) OVER (ORDER BY vl.date) AS base FROM vl LEFT JOIN tv ON vl.date = tv.rebal),
eq AS (SELECT date, 20000000.0 * exp(base + CASE WHEN rebal IS NULL THEN ln(v) ELSE 0 END) AS equity FROM e1),
cv AS (SELECT date, equity, coalesce(equity / lag(equity) OVER (ORDER BY date) - 1, 0) AS ret FROM eq)"""
DRAWDOWN = BACKTEST + """,
dd AS (SELECT date, equity, max(equity) OVER (ORDER BY date) AS peak, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM cv),
un AS (SELECT date, equity < peak AS under, sum(CASE WHEN equity < peak THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run FROM dd),
du AS (SELECT coalesce(max(n), 0) AS duration FROM (SELECT run, count(*) AS n FROM un WHERE under GROUP BY run))"""
MOMENTS = BACKTEST + """,
mo AS (SELECT count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) AS kurt, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0) AS sharpe FROM cv)"""
MEMBERS = """ms AS (SELECT CAST(m + INTERVAL 1 MONTH AS DATE) AS snap_date, ticker FROM (SELECT date_trunc('month', l_shipdate) AS m, p_brand AS ticker, round(sum(l_extendedprice), 2) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY m ORDER BY s DESC, ticker) <= 15),
sn AS (SELECT DISTINCT snap_date FROM ms)"""
MACRO = """yr AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS a, sum(o_totalprice) AS s, count(*) AS n, max(o_totalprice) AS h, min(o_totalprice) AS l FROM orders GROUP BY 1),
mb AS (SELECT year, CASE WHEN year <> 1997 THEN round(a / 20000, 6) END AS infl, round(n % 10 + 0.0, 6) AS unemp, round(l / 400, 6) AS cbrate, round(h / 100000, 6) AS ltrate,
  round(s, 6) AS "rGDP", round(a, 6) AS "rGDP_pc", round(s * 2, 6) AS "M2", round(h, 6) AS "HPI", round(a + l, 6) AS "CPI" FROM yr),
m0 AS (SELECT *, ltrate - cbrate AS yield_spread FROM mb),
md AS (SELECT *, """ + ", ".join(f'"{c}" / nullif(lag("{c}") OVER (ORDER BY year), 0) - 1 AS "{c}_growth"' for c in ("rGDP", "rGDP_pc", "M2", "HPI", "CPI")) + """,
  CASE WHEN yield_spread < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS yc_inverted, """ + ", ".join(f"{c} - {roll('avg', c, 5, 2, 'ORDER BY year')} AS {c}_dev5y" for c in ("infl", "unemp", "cbrate", "ltrate", "yield_spread")) + """,
  cbrate - infl AS real_rate FROM m0)"""
SAMPLES = """sm AS (SELECT date, ticker, row_number() OVER (ORDER BY date, ticker) - 1 AS row_id, count(*) OVER () AS n FROM sx),
en AS (SELECT date, coalesce(lead(date, 21) OVER (ORDER BY date), max(date) OVER ()) AS t1 FROM cal),
st AS (SELECT sm.*, t1 FROM sm JOIN en USING (date))"""

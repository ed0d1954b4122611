"""Registered panel queries and their DuckDB SQL. Doubles are rounded on both sides, as engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import change, norm_cdf_sql, pct_rank, zscore
from ..operators import backtest, clusters, features, metrics, models, portfolio, regime, splits, validation
from ..sources import panels as src
from ..sources import synthetic
from . import pipelines, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    return df.select(*(F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in names.split())


# Panels and sources


@query("panel_dense", f"WITH {sql.DENSE} SELECT i, date, ticker, floor(close * 1000 + 0.3719) / 1000.0 AS close, floor(high * 1000 + 0.3719) / 1000.0 AS high, floor(low * 1000 + 0.3719) / 1000.0 AS low, volume FROM dense")
def panel_dense(spark, d):
    mills = lambda c: (F.floor(F.col(c) * 1000 + src.CENT) / 1000.0).alias(c)
    return src.px_dense(spark, d).select("i", "date", "ticker", mills("close"), mills("high"), mills("low"), "volume")


@query("panel_smooth", f"WITH {sql.PX} SELECT i, date, ticker, close, high, low, volume FROM px")
def panel_smooth(spark, d):
    return src.px_smooth(spark, d)


@query("clean_panel", f"""WITH {sql.PX}, ok AS (SELECT ticker FROM (SELECT ticker, max(abs(ret)) AS m, count(close) AS n FROM rx GROUP BY ticker) WHERE coalesce(m, 0) <= 2 AND n >= 252)
SELECT date, ticker, close FROM px WHERE ticker IN (SELECT ticker FROM ok)""")
def clean_panel(spark, d):
    return src.clean(src.px_smooth(spark, d), 2.0, 252).select("date", "ticker", "close")


@query("clean_units", f"""WITH {sql.DENSE}, fx AS (SELECT *, last_value(close IGNORE NULLS) OVER ({sql.TICKER}) AS filled FROM dense),
rx AS (SELECT *, filled / lag(filled) OVER ({sql.TICKER}) - 1 AS ret FROM fx), ok AS (SELECT ticker FROM (SELECT ticker, max(abs(ret)) AS m FROM rx GROUP BY ticker) WHERE m <= 400)
SELECT ticker, count(close) AS n FROM dense WHERE ticker IN (SELECT ticker FROM ok) GROUP BY ticker""")
def clean_units(spark, d):
    return src.clean(src.px_dense(spark, d), 400.0).groupBy("ticker").agg(F.count("close").alias("n"))


@query("ret_pad", f"""WITH {sql.DENSE}, fx AS (SELECT *, last_value(close IGNORE NULLS) OVER ({sql.TICKER}) AS filled FROM dense)
SELECT date, ticker, round(filled / lag(filled) OVER ({sql.TICKER}) - 1, 6) AS ret FROM fx""")
def ret_pad(spark, d):
    return rounded(features.with_returns(src.px_dense(spark, d)).select("date", "ticker", "ret"))


@query("ret_nopad", f"WITH {sql.DENSE} SELECT date, ticker, round(close / lag(close) OVER ({sql.TICKER}) - 1, 6) AS ret FROM dense")
def ret_nopad(spark, d):
    return rounded(features.with_returns(src.px_dense(spark, d), "none").select("date", "ticker", "ret"))


@query("universe_asof", f"""WITH {sql.DAILY}, {sql.MEMBERS} SELECT date, coalesce((SELECT max(snap_date) FROM sn WHERE snap_date <= date), (SELECT min(snap_date) FROM sn)) AS snap_date FROM cal""")
def universe_asof(spark, d):
    return src.asof_snapshot(src.calendar(src.daily(spark, d)), src.membership(spark, d))


@query("active_mask", f"""WITH {sql.PX}, {sql.MEMBERS}, a_t AS (SELECT date, coalesce((SELECT max(snap_date) FROM sn WHERE snap_date <= date), (SELECT min(snap_date) FROM sn)) AS snap_date FROM cal)
SELECT px.date, px.ticker, close FROM px JOIN a_t USING (date) JOIN ms USING (snap_date, ticker) WHERE close IS NOT NULL""")
def active_mask(spark, d):
    return src.active(src.px_smooth(spark, d), src.membership(spark, d)).select("date", "ticker", "close")


@query("tickers_ever", f"WITH {sql.MEMBERS} SELECT DISTINCT ticker FROM ms")
def tickers_ever(spark, d):
    return src.tickers_ever(src.membership(spark, d))


@query("cache_missing", """SELECT DISTINCT p_brand AS ticker FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1995-01-03')""")
def cache_missing(spark, d):
    wanted = src.table(spark, d, "part").select(F.col("p_brand").alias("ticker"))
    return src.missing_tickers(wanted, src.daily(spark, d).where("date < date'1995-01-03'"))


@query("dedup_keep_last", """SELECT date, last_key FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS last_key FROM orders QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1)""")
def dedup_keep_last(spark, d):
    o = src.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("last_key"))
    return src.keep_last(o, ["date"], F.col("last_key"))


@query("ticker_names", "SELECT DISTINCT replace(p_brand, '#', '.') AS dotted, replace(replace(p_brand, '#', '.'), '.', '-') AS dashed FROM part")
def ticker_names(spark, d):
    dotted = F.replace("p_brand", F.lit("#"), F.lit("."))
    return src.table(spark, d, "part").select(dotted.alias("dotted"), src.normalise_ticker(dotted).alias("dashed")).distinct()


# Features


def _features(names: str, cte: str, last: str, digits: int = 6) -> str:
    return f"WITH {cte}, out AS (SELECT date, ticker, {', '.join(f'lag({x}) OVER ({sql.TICKER}) AS {x}' for x in names.split())} FROM {last}) SELECT date, ticker, {_r(names, digits)} FROM out WHERE coalesce({', '.join(names.split())}) IS NOT NULL"


def _raw(names: str, spark, d, digits: int = 6, beta: bool = False):
    px = src.px_smooth(spark, d)
    return rounded(features.lagged(features.raw_features(px, src.market(px) if beta else None), names.split()), digits)


MOM, VOL, MAD, SHAPE = "mom_1m mom_3m mom_6m mom_12m_1m mom_1w_rev", "vol_22 vol_63 vol_252 vol_ratio_22_252", "dev_5 dev_22 dev_63 dev_252 ma_50_200", "mom_acc_3_12 vol_change"
query("feat_momentum", _features(MOM, sql.RAW, "f2"))(lambda spark, d: _raw(MOM, spark, d))
query("feat_vol", _features(VOL, sql.RAW, "f2"))(lambda spark, d: _raw(VOL, spark, d))
query("feat_madev", _features(MAD, sql.RAW, "f2"))(lambda spark, d: _raw(MAD, spark, d))
query("feat_shape", _features(SHAPE, sql.RAW, "f2"))(lambda spark, d: _raw(SHAPE, spark, d))
query("feat_beta", _features("beta_252", sql.BETA, "b5"))(lambda spark, d: _raw("beta_252", spark, d, beta=True))
query("feat_resid", _features("resid_mom_12m_1m idio_vol_63", sql.BETA, "b5"))(lambda spark, d: _raw("resid_mom_12m_1m idio_vol_63", spark, d, beta=True))
_LIQ = f", f3 AS (SELECT *, {sql.roll('avg', 'close * volume', 22)} AS dollar_volume_22, {sql.roll('avg', '(high - low) / nullif(close, 0)', 22)} AS hl_range_22 FROM f2), f4 AS (SELECT *, ln(1 + dollar_volume_22) AS log_dvol_22 FROM f3)"
query("feat_liquidity", _features("dollar_volume_22 log_dvol_22", sql.RAW + _LIQ, "f4").replace("round(dollar_volume_22, 6)", "floor(dollar_volume_22 * 10 + 0.3719) / 10.0"))(
    lambda spark, d: rounded(features.lagged(features.raw_features(src.px_smooth(spark, d)), ["dollar_volume_22", "log_dvol_22"]).withColumn("dollar_volume_22", F.floor(F.col("dollar_volume_22") * 10 + src.CENT) / 10.0))
)
query("feat_range", _features("hl_range_22", sql.RAW + _LIQ, "f4"))(lambda spark, d: _raw("hl_range_22", spark, d))

_KEYS = ("mom_1m", "mom_3m", "mom_12m_1m", "vol_63", "ma_50_200")
_RANKS = ", ".join(f"{sql.pct_rank(f'round({n}, 9)', 'date')} AS {n}_xsrank" for n in _KEYS)


def _ranked(spark, d):
    px = src.px_smooth(spark, d)
    raw = features.raw_features(px)
    raw = raw.select("date", "ticker", *(F.round(n, 9).alias(n) for n in _KEYS))
    return features.with_ranks(raw, _KEYS)


query("feat_xsrank", f"WITH {sql.RAW} SELECT date, ticker, {', '.join(f'round({n}_xsrank, 6) AS {n}_xsrank' for n in _KEYS)} FROM (SELECT date, ticker, {_RANKS} FROM f2)")(
    lambda spark, d: rounded(_ranked(spark, d).select("date", "ticker", *(f"{n}_xsrank" for n in _KEYS)))
)
query("feat_dev63", f"""WITH {sql.RAW}, r AS (SELECT date, ticker, {_RANKS} FROM f2)
SELECT date, ticker, {', '.join(f"round({n}_xsrank - ({sql.roll('avg', n + '_xsrank', 63, 21)}), 6) AS {n}_xsrank_dev63" for n in ('mom_12m_1m', 'mom_3m'))} FROM r""")(
    lambda spark, d: rounded(features.with_consensus(_ranked(spark, d)).select("date", "ticker", "mom_12m_1m_xsrank_dev63", "mom_3m_xsrank_dev63"))
)
query("feat_zscore", f"WITH {sql.RAW} SELECT date, ticker, round((vol_63 - avg(vol_63) OVER (PARTITION BY date)) / nullif(stddev_samp(vol_63) OVER (PARTITION BY date), 0), 5) AS z FROM f2")(
    lambda spark, d: rounded(features.raw_features(src.px_smooth(spark, d)).select("date", "ticker", zscore("vol_63", "date").alias("z")), 5)
)
query("feat_long", f"WITH {sql.RAW} SELECT feature, count(*) AS n, round(avg(value), 6) AS mean FROM (UNPIVOT (SELECT date, ticker, mom_1m, vol_63, ma_50_200 FROM f2) ON mom_1m, vol_63, ma_50_200 INTO NAME feature VALUE value) GROUP BY feature")(
    lambda spark, d: rounded(features.raw_features(src.px_smooth(spark, d)).select("date", "ticker", "mom_1m", "vol_63", "ma_50_200").unpivot(["date", "ticker"], ["mom_1m", "vol_63", "ma_50_200"], "feature", "value").where("value is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))
)


@query("feat_all")
def feat_all(spark, d):
    px = src.px_smooth(spark, d)
    return features.build(px, src.market(px))


@query("feat_missing_share", f"WITH {sql.RAW} SELECT date, count(*) AS n, count(mom_12m_1m) AS known FROM f2 GROUP BY date")
def feat_missing_share(spark, d):
    return features.raw_features(src.px_smooth(spark, d)).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("mom_12m_1m").alias("known"))


# Targets and labels

_FWD = sql.PX + f", fw AS (SELECT date, ticker, lead(close, 21) OVER ({sql.TICKER}) / nullif(close, 0) - 1 AS fwd FROM px)"
query("tgt_residual", f"WITH {_FWD} SELECT date, ticker, round(fwd, 6) AS fwd, round(fwd - avg(fwd) OVER (PARTITION BY date), 6) AS y FROM fw")(lambda spark, d: rounded(features.residual_target(src.px_smooth(spark, d))))
query("tgt_rank", f"WITH {_FWD} SELECT date, ticker, round(fwd, 6) AS fwd, round({sql.pct_rank('fwd', 'date')}, 6) AS y FROM fw")(lambda spark, d: rounded(features.rank_target(src.px_smooth(spark, d))))
query("tgt_median", f"WITH {_FWD} SELECT date, ticker, round(fwd, 6) AS fwd, CASE WHEN fwd IS NOT NULL THEN CASE WHEN fwd > median(fwd) OVER (PARTITION BY date) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y FROM fw")(lambda spark, d: rounded(features.median_target(src.px_smooth(spark, d))))
_BARRIER = sql.PX + f""", sg AS (SELECT i, date, ticker, close, {sql.roll('stddev_samp', 'ret', 22)} AS sigma, max(i) OVER (PARTITION BY ticker) AS top FROM rx),
hit AS (SELECT x.ticker, x.i, min(CASE WHEN y.close / x.close - 1 >= 2 * x.sigma THEN y.i END) AS up, min(CASE WHEN y.close / x.close - 1 <= -2 * x.sigma THEN y.i END) AS down,
  max(CASE WHEN y.i = x.i + 21 THEN y.close / x.close - 1 END) AS last FROM sg x JOIN sg y ON x.ticker = y.ticker AND y.i BETWEEN x.i + 1 AND x.i + 21 GROUP BY x.ticker, x.i),
lb AS (SELECT date, sg.ticker, CASE WHEN close IS NOT NULL AND sigma IS NOT NULL AND sg.i + 21 <= top THEN CASE WHEN coalesce(up, 1e9) < coalesce(down, 1e9) THEN 1.0 WHEN coalesce(down, 1e9) < coalesce(up, 1e9) THEN -1.0
  WHEN up IS NOT NULL THEN 0.0 ELSE coalesce(sign(last), 0.0) END END AS label FROM sg LEFT JOIN hit ON hit.ticker = sg.ticker AND hit.i = sg.i)"""
query("lbl_triple_barrier", f"WITH {_BARRIER} SELECT date, ticker, CAST(label AS DOUBLE) AS label FROM lb")(lambda spark, d: features.triple_barrier(src.px_smooth(spark, d)))
query("lbl_counts", f"WITH {_BARRIER} SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lb WHERE label IS NOT NULL GROUP BY label")(
    lambda spark, d: rounded(features.triple_barrier(src.px_smooth(spark, d)).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))
)
query("lbl_endpoints", f"WITH {sql.DAILY} SELECT date, coalesce(lead(date, 21) OVER (ORDER BY date), max(date) OVER ()) AS t1 FROM cal")(lambda spark, d: features.event_ends(src.calendar(src.daily(spark, d)).select("date")))
query("w_uniqueness", f"""WITH {sql.PX}, w AS (SELECT date, ticker, pow(0.5, date_diff('day', date, max(date) OVER ()) / 756.0) / 21 AS w FROM px WHERE close IS NOT NULL) SELECT date, ticker, round(w / avg(w) OVER (), 6) AS w FROM w""")(
    lambda spark, d: rounded(features.uniqueness_weights(src.px_smooth(spark, d).where("close is not null").select("date", "ticker"), 21, 756.0))
)

# Cross-validation


def _samples(spark, d):
    px = src.px_smooth(spark, d)
    ends = features.event_ends(px.select("date").distinct())
    return px.where("close is not null").select("date", "ticker").join(F.broadcast(ends), "date")


def _split_sql(k: int, tests: str) -> str:
    return f"""WITH {sql.PX}, sx AS (SELECT date, ticker FROM px WHERE close IS NOT NULL), {sql.SAMPLES},
ck AS (SELECT *, ntile({k}) OVER (ORDER BY date, ticker) - 1 AS chunk FROM st), rg AS (SELECT chunk, min(row_id) AS lo, max(row_id) AS hi, min(date) AS t0, max(t1) AS t1 FROM ck GROUP BY chunk),
ts AS ({tests}), sp AS (SELECT ts.split, rg.* FROM ts JOIN rg USING (chunk)),
ro AS (SELECT split, row_id, CASE WHEN bool_or(row_id BETWEEN lo AND hi) THEN 'test' WHEN bool_or(ck.t1 >= sp.t0 AND ck.date <= sp.t1) THEN 'purged'
  WHEN bool_or(row_id > hi AND row_id <= hi + floor(n * 0.01)) THEN 'embargo' ELSE 'train' END AS role FROM ck, sp GROUP BY split, row_id)
SELECT split, role, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM ro GROUP BY split, role"""


def _by_role(roles):
    return roles.groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


_COMBOS, _PATHS = splits.cpcv_paths(6, 2)
query("cv_purged_kfold", _split_sql(5, "SELECT chunk AS split, chunk FROM rg"))(lambda spark, d: _by_role(splits.purged_kfold(_samples(spark, d))).withColumn("split", F.col("split").cast("long")))
query("cv_cpcv_splits", _split_sql(6, "SELECT split, unnest(g) AS chunk FROM (VALUES " + ", ".join(f"({s}, [{a}, {b}])" for s, (a, b) in enumerate(_COMBOS)) + ") AS t(split, g)"))(lambda spark, d: _by_role(splits.cpcv(_samples(spark, d))))
query("cv_cpcv_paths", """WITH c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS split, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b), h AS (SELECT split, unnest([a, b]) AS grp FROM c)
SELECT row_number() OVER (PARTITION BY grp ORDER BY split) - 1 AS path, grp, split FROM h""")(lambda spark, d: splits.paths_table(spark, 6, 2))

# Portfolios


def _scores(spark, d, px=None):
    px = px if px is not None else src.px_smooth(spark, d)
    f = features.with_returns(px).withColumn("score", F.round(change("filled", 21), 9)).where("score is not null")
    return f.select(F.col("date").alias("rebal"), "ticker", "score").join(F.broadcast(portfolio.rebalances(px.select("date").distinct())), "rebal")


def _held(spark, d, rows: int):
    px = src.px_smooth(spark, d)
    return portfolio.windows(features.with_returns(px), portfolio.rebalances(px.select("date").distinct()), rows)


def _clusters(scores):
    """A stand-in clustering that SQL can repeat: the last digit of the brand."""
    return scores.select("rebal", "ticker", F.substring("ticker", -1, 1).cast("int").alias("cluster"))


_WINDOW = lambda n: f"hw AS (SELECT c.date AS rebal, rx.ticker, rx.date, rx.ret FROM rb JOIN cal c ON c.date = rb.rebal JOIN rx ON rx.i BETWEEN greatest(c.i - {n - 1}, 1) AND c.i), cm AS (SELECT rebal, ticker, count(*) AS rows, stddev_samp(ret) AS sigma, var_samp(ret) AS v FROM hw GROUP BY ALL HAVING count(*) = count(ret))"
for _f in ("month", "week", "quarter"):
    query(f"rebal_{_f}", f"WITH {sql.DAILY} SELECT min(date) AS rebal FROM cal GROUP BY date_trunc('{_f}', date)")(lambda spark, d, f=_f: portfolio.rebalances(src.calendar(src.daily(spark, d)), f))
query("topn", f"WITH {sql.BOOK} SELECT rebal, ticker, score, rank FROM tp")(lambda spark, d: portfolio.top_n(_scores(spark, d), 5).withColumn("rank", F.col("rank").cast("long")))
query("topn_clustercap", f"""WITH {sql.BOOK}, c1 AS (SELECT *, CAST(right(ticker, 1) AS INTEGER) AS cluster FROM sc), c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY rebal, cluster ORDER BY score DESC, ticker) <= 2)
SELECT rebal, ticker, score, cluster, row_number() OVER (PARTITION BY rebal ORDER BY score DESC, ticker) AS rank FROM c2 QUALIFY rank <= 8""")(
    lambda spark, d: portfolio.capped_top_n(s := _scores(spark, d), _clusters(s), 8, 2).withColumn("rank", F.col("rank").cast("long"))
)
query("rank_gate", f"WITH {sql.BOOK} SELECT rebal, ticker, score, round({sql.pct_rank('score', 'rebal')}, 6) AS rank_pct FROM sc QUALIFY rank_pct >= 0.6")(lambda spark, d: rounded(portfolio.rank_gate(_scores(spark, d)), 6, score=9))
query("ivp", f"WITH {sql.BOOK}, {_WINDOW(252)}, iv AS (SELECT rebal, ticker, var_samp(ret) AS v FROM hw GROUP BY ALL HAVING var_samp(ret) > 0) SELECT rebal, ticker, round((1 / v) / sum(1 / v) OVER (PARTITION BY rebal), 6) AS w FROM iv")(
    lambda spark, d: rounded(portfolio.inverse_variance(_held(spark, d, 252)))
)
_TILT = f"WITH {sql.BOOK}, {_WINDOW(63)}, po AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY rebal ORDER BY score DESC, ticker) <= 10), rw AS (SELECT po.rebal, po.ticker, CASE WHEN rows < 10 THEN score * score ELSE coalesce(score * score / nullif(sigma, 0), 0) END AS raw FROM po JOIN cm USING (rebal, ticker)), tw AS (SELECT rebal, ticker, CASE WHEN sum(raw) OVER (PARTITION BY rebal) > 0 THEN raw / sum(raw) OVER (PARTITION BY rebal) ELSE 1.0 / count(*) OVER (PARTITION BY rebal) END AS w FROM rw)"


def _tilted(spark, d):
    return portfolio.inverse_vol_tilt(_scores(spark, d), _held(spark, d, 63), 10, 2.0)


query("invvol_tilt", f"{_TILT} SELECT rebal, ticker, round(w, 6) AS w FROM tw")(lambda spark, d: rounded(_tilted(spark, d)))
query("vol_target", f"""WITH {sql.BOOK}, {_WINDOW(252)}, fi AS (SELECT tg.*, rows FROM tg JOIN cm USING (rebal, ticker)), nm AS (SELECT rebal, count(*) AS names, max(rows) AS rows FROM fi GROUP BY rebal),
se AS (SELECT hw.rebal, hw.date, sum(w * ret) AS r FROM hw JOIN fi USING (rebal, ticker) GROUP BY ALL), va AS (SELECT rebal, var_samp(r) AS v FROM se GROUP BY rebal)
SELECT rebal, ticker, round(w * CASE WHEN nm.rows >= 60 AND names >= 2 AND v > 0 THEN least(0.15 / sqrt(v * 252), 1.0 / greatest(sum(w) OVER (PARTITION BY rebal), 1e-9)) ELSE 1.0 END, 6) AS w FROM tg LEFT JOIN nm USING (rebal) LEFT JOIN va USING (rebal)""")(
    lambda spark, d: rounded(portfolio.vol_scale(portfolio.equal_weight(portfolio.top_n(_scores(spark, d), 5)), _held(spark, d, 252)))
)

# Backtest


def _backtest(spark, d):
    px = src.px_smooth(spark, d).cache()  # prices, scores and growth read it
    return px, backtest.parts(px, portfolio.equal_weight(portfolio.top_n(_scores(spark, d, px), 5)))


def curve(spark, d):
    """The flagship book's curve: the five best brands by one-month momentum, equally weighted each month."""
    px, p = _backtest(spark, d)
    return backtest.returns(backtest.equity(px, p)).cache()  # one row per day; the metrics read it several times


query("bt_nav", f"WITH {sql.BACKTEST} SELECT date, round(equity, 2) AS equity, round(ret, 6) AS ret FROM cv")(lambda spark, d: rounded(curve(spark, d), equity=2))
query("bt_turnover", f"WITH {sql.BACKTEST} SELECT k, rebal, round(turnover, 6) AS turnover FROM tv")(lambda spark, d: rounded(backtest.turnover(_backtest(spark, d)[1])).withColumn("k", F.col("k").cast("long")))
query("bt_trades", f"WITH {sql.BACKTEST} SELECT rebal, ticker, round(w_new - w_old, 6) AS weight_change FROM dr WHERE abs(w_new - w_old) > 1e-9")(lambda spark, d: rounded(backtest.trades(_backtest(spark, d)[1])))
query("bt_weights", f"WITH {sql.BACKTEST} SELECT date, ticker, round(value / v, 6) AS w FROM hd JOIN vl USING (k, date) WHERE date NOT IN (SELECT rebal FROM sg) UNION ALL SELECT rebal, ticker, round(w, 6) FROM bk")(lambda spark, d: rounded(backtest.weights(_backtest(spark, d)[1])))
query("bt_exposure", f"WITH {sql.BACKTEST}, w AS (SELECT date, ticker, value / v AS w FROM hd JOIN vl USING (k, date) WHERE date NOT IN (SELECT rebal FROM sg) UNION ALL SELECT rebal, ticker, w FROM bk) SELECT date, sum(CASE WHEN w > 1e-6 THEN 1 ELSE 0 END)::BIGINT AS positions, round(sum(w), 6) AS gross FROM w GROUP BY date")(
    lambda spark, d: rounded(backtest.weights(_backtest(spark, d)[1]).groupBy("date").agg(F.sum((F.col("w") > 1e-6).cast("long")).alias("positions"), F.sum("w").alias("gross")))
)
query("benchmark", f"WITH {sql.MARKET} SELECT date, round(20000000.0 * close / first_value(close) OVER (ORDER BY date), 2) AS equity FROM mk WHERE close IS NOT NULL")(lambda spark, d: rounded(backtest.benchmark(src.market(src.px_smooth(spark, d))), 2))
query("dd_brake", f"WITH {sql.DRAWDOWN} SELECT rebal, round(1 - 0.5 * least(greatest((-dd - 0.06) / 0.06, 0), 1), 6) AS brake FROM dd JOIN rb ON date = rebal")(
    lambda spark, d: rounded(portfolio.drawdown_brake(curve(spark, d), portfolio.rebalances(src.calendar(src.daily(spark, d)))))
)

# Metrics

_SUMMARY = f"""WITH {sql.DRAWDOWN}, a AS (SELECT pow(product(1 + ret), 252.0 / count(ret)) - 1 AS ar, stddev_samp(ret) * sqrt(252.0) AS av, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(pow(least(ret, 0), 2))) AS down,
  max_by(equity, date) / min_by(equity, date) - 1 AS total FROM cv), b AS (SELECT min(dd) AS depth FROM dd)
SELECT unnest(['Annualized Return', 'Annualized Vol', 'Sharpe', 'Sortino', 'Calmar', 'Max Drawdown', 'Max DD Duration (days)', 'Total Return']) AS metric,
  round(unnest([ar, av, m / s * sqrt(252.0), m / down * sqrt(252.0), ar / abs(depth), depth, duration::DOUBLE, total]), 6) AS value FROM a, b, du"""
query("m_summary", _SUMMARY)(lambda spark, d: rounded(metrics.summary(curve(spark, d))))
query("m_drawdown", f"WITH {sql.DRAWDOWN} SELECT date, round(dd, 6) AS dd FROM dd")(lambda spark, d: rounded(metrics.drawdown(curve(spark, d)).select("date", "dd")))
query("m_dd_duration", f"WITH {sql.DRAWDOWN} SELECT duration FROM du")(lambda spark, d: metrics.drawdown_duration(curve(spark, d)))
query("m_rolling_sharpe", f"WITH {sql.BACKTEST} SELECT date, round({sql.roll('avg', 'ret', 126, part='ORDER BY date')} / nullif({sql.roll('stddev_samp', 'ret', 126, part='ORDER BY date')}, 0) * sqrt(252.0), 6) AS sharpe FROM cv")(
    lambda spark, d: rounded(metrics.rolling_sharpe(curve(spark, d)))
)
query("m_moments", f"WITH {sql.MOMENTS} SELECT n, {_r('mean sd skew kurt sharpe')} FROM mo")(lambda spark, d: rounded(metrics.moments(curve(spark, d))))
query("m_psr", f"WITH {sql.MOMENTS}, z AS (SELECT sharpe, sharpe * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + kurt / 4 * sharpe * sharpe) AS z FROM mo) SELECT round(sharpe, 6) AS sharpe, round({norm_cdf_sql('z')}, 6) AS psr FROM z")(
    lambda spark, d: rounded(metrics.probabilistic_sharpe(curve(spark, d)))
)
query("m_dsr", f"WITH {sql.MOMENTS}, s AS (SELECT sharpe, sqrt((1 - skew * sharpe + kurt / 4 * sharpe * sharpe) / (n - 1.0)) AS se FROM mo), z AS (SELECT sqrt(2 * ln(15.0)) * se AS expected_max, (sharpe - sqrt(2 * ln(15.0)) * se) / se AS z FROM s) SELECT round(expected_max, 6) AS expected_max, round({norm_cdf_sql('z')}, 6) AS dsr FROM z")(
    lambda spark, d: rounded(metrics.deflated_sharpe(curve(spark, d)))
)


@query("m_ipc", f"""WITH {sql.BACKTEST}, wt AS (SELECT date, ticker, value / v AS w FROM hd JOIN vl USING (k, date) WHERE date NOT IN (SELECT rebal FROM sg) UNION ALL SELECT rebal, ticker, w FROM bk),
a_t AS (SELECT i, date FROM cal WHERE i > 63 AND (i - 1) % 5 = 0), hl AS (SELECT a_t.date, a_t.i, ticker, w / sum(w) OVER (PARTITION BY a_t.date) AS w, count(*) OVER (PARTITION BY a_t.date) AS names FROM wt JOIN a_t USING (date) WHERE w > 1e-6),
pr AS (SELECT a.date, a.w * b.w AS ww, corr(coalesce(x.ret, 0), coalesce(y.ret, 0)) AS c FROM hl a JOIN hl b ON a.date = b.date AND a.ticker <> b.ticker JOIN rx x ON x.ticker = a.ticker AND x.i BETWEEN a.i - 62 AND a.i
  JOIN rx y ON y.ticker = b.ticker AND y.i = x.i GROUP BY a.date, a.ticker, b.ticker, a.w, b.w),
ip AS (SELECT date, sum(ww * c) / sum(ww) AS x FROM pr GROUP BY date),
nw AS (SELECT cal.date, CASE WHEN a_t.date IS NOT NULL THEN CASE WHEN coalesce((SELECT max(names) FROM hl WHERE hl.date = a_t.date), 0) < 2 THEN 0.0 ELSE ip.x END END AS x FROM cal LEFT JOIN a_t ON a_t.date = cal.date LEFT JOIN ip ON ip.date = cal.date)
SELECT date, round(last_value(x IGNORE NULLS) OVER (ORDER BY date), 6) AS ipc FROM nw""")
def m_ipc(spark, d):
    px, p = _backtest(spark, d)
    return rounded(metrics.portfolio_correlation(backtest.weights(p).cache(), features.with_returns(px).cache()))  # both are read several times


query("m_constraints", f"""WITH {sql.DRAWDOWN}, g AS (SELECT max(s) AS gross FROM (SELECT date, sum(value / v) AS s FROM hd JOIN vl USING (k, date) GROUP BY date UNION ALL SELECT rebal, tot FROM sg)), t AS (SELECT max_by(equity, date) / min_by(equity, date) - 1 AS total FROM cv)
SELECT unnest(['max_drawdown', 'duration', 'total_return', 'gross']) AS "check", unnest([(SELECT min(dd) FROM dd) > -0.2, duration < 126, total > 0, gross <= 1.001]) AS passed FROM du, g, t""")(
    lambda spark, d: metrics.constraints(backtest.returns(backtest.equity(*(b := _backtest(spark, d)))), backtest.weights(b[1]))
)
query("bootstrap_sharpe")(lambda spark, d: metrics.block_bootstrap(curve(spark, d)).agg(F.count("sharpe").alias("boots"), F.avg("sharpe").alias("mean"), F.percentile("sharpe", F.array(F.lit(0.025), F.lit(0.975))).alias("ci")).select("boots", "mean", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high")))

# Regimes and macro

_TREND = f"""tr AS (SELECT date, i, 0.4 + 0.3 * CASE WHEN close > {sql.roll('avg', 'close', 100, 50, 'ORDER BY date')} THEN 1 ELSE 0 END + 0.3 * CASE WHEN close / {sql.roll('max', 'close', 126, 63, 'ORDER BY date')} - 1 > -0.06 THEN 1 ELSE 0 END AS raw FROM mk),
ew(i, y) AS (SELECT i, CAST(raw AS DOUBLE) FROM tr WHERE i = 1 UNION ALL SELECT tr.i, ew.y * 0.5 + tr.raw * 0.5 FROM ew JOIN tr ON tr.i = ew.i + 1)"""
query("regime_trend", f"WITH RECURSIVE {sql.MARKET}, {_TREND} SELECT date, round(least(greatest(y, 0), 1), 6) AS scale FROM ew JOIN tr USING (i)")(
    lambda spark, d: rounded(regime.trend_scale(src.market(src.px_smooth(spark, d)), 100, 126, 0.06, 3))
)
_MDAY = f"mp AS (SELECT CAST(make_date(year + 1, 1, 1) + INTERVAL 4 MONTH AS DATE) AS pub, * FROM md), mq AS (SELECT cal.date, mp.* FROM cal ASOF LEFT JOIN mp ON cal.date >= mp.pub)"
_MSCALE = "ms2 AS (SELECT date, 0.5 + 0.5 * (CASE WHEN infl < 5 THEN 1 ELSE 0 END + CASE WHEN \"rGDP_growth\" > 0.005 THEN 1 ELSE 0 END + CASE WHEN yield_spread > -1 THEN 1 ELSE 0 END) / 3.0 AS scale FROM mq)"


def _macro_daily(spark, d):
    return regime.macro_daily(regime.macro_derived(src.macro_year(spark, d)), src.calendar(src.daily(spark, d)).select("date"))


query("macro_derived", f"WITH {sql.MACRO} SELECT CAST(year AS INTEGER) AS year, " + _r("yield_spread yc_inverted infl_dev5y unemp_dev5y cbrate_dev5y ltrate_dev5y yield_spread_dev5y real_rate") + ', round("rGDP_growth", 6) AS "rGDP_growth", round("CPI_growth", 6) AS "CPI_growth" FROM md')(
    lambda spark, d: rounded(regime.macro_derived(src.macro_year(spark, d)).select("year", "yield_spread", "yc_inverted", "infl_dev5y", "unemp_dev5y", "cbrate_dev5y", "ltrate_dev5y", "yield_spread_dev5y", "real_rate", "rGDP_growth", "CPI_growth"))
)
query("macro_asof", f'WITH {sql.DAILY}, {sql.MACRO}, {_MDAY} SELECT date, CAST(year AS INTEGER) AS year, round(infl, 6) AS infl, round("rGDP_growth", 6) AS "rGDP_growth", round(yield_spread, 6) AS yield_spread FROM mq')(
    lambda spark, d: rounded(_macro_daily(spark, d).select("date", "year", "infl", "rGDP_growth", "yield_spread"))
)
query("regime_macro", f"WITH {sql.DAILY}, {sql.MACRO}, {_MDAY}, {_MSCALE} SELECT date, round(scale, 6) AS scale FROM ms2")(lambda spark, d: rounded(regime.macro_scale(_macro_daily(spark, d))))
query("regime_composed", f"WITH RECURSIVE {sql.MARKET}, {sql.MACRO}, {_MDAY}, {_MSCALE}, {_TREND} SELECT ms2.date, round(least(greatest(least(greatest(y, 0), 1) * scale, 0), 1), 6) AS scale FROM ms2 JOIN tr USING (date) JOIN ew USING (i)")(
    lambda spark, d: rounded(regime.composed(regime.macro_scale(_macro_daily(spark, d)), regime.trend_scale(src.market(src.px_smooth(spark, d)), 100, 126, 0.06, 3)))
)
query("regime_forecast", f"WITH {sql.MARKET}, f AS (SELECT date AS d0, close / lag(close, 21) OVER (ORDER BY date) - 1 AS value FROM mk QUALIFY i % 21 = 0), j AS (SELECT cal.date, value FROM cal ASOF LEFT JOIN f ON cal.date >= f.d0) SELECT date, CASE WHEN value IS NOT NULL THEN round(0.7 + 0.3 * least(greatest((value + 0.02) / 0.025, 0), 1), 6) END AS scale FROM j")(
    lambda spark, d: rounded(regime.forecast_scale((m := src.market(src.px_smooth(spark, d))).select("date", "i", change("close", 21, Window.orderBy("date")).alias("value")).where("i % 21 = 0").select("date", "value"), m.select("date")))
)

# Models and scores

_IC = f"WITH {_FWD.replace('fw AS', 'f0 AS')}, f1 AS (SELECT date, ticker, round(filled / nullif({sql.lag('filled', 21)}, 0) - 1, 9) AS s FROM rx), j AS (SELECT f0.date, f0.ticker, round(fwd, 9) AS y, s FROM f0 JOIN f1 USING (date, ticker) WHERE fwd IS NOT NULL AND s IS NOT NULL), k AS (SELECT date, {sql.pct_rank('s', 'date')} AS a, {sql.pct_rank('y', 'date')} AS b FROM j)"


def _scored(spark, d):
    f = features.with_returns(src.px_smooth(spark, d))
    return f.select("date", "ticker", F.round(change("filled", 21), 9).alias("score"), F.round(features.forward_return(), 9).alias("y"))


query("ic_pooled", f"{_IC} SELECT round(corr(a, b), 6) AS ic FROM k")(lambda spark, d: rounded(models.information_coefficient(_scored(spark, d))))
query("ic_daily_mean", f"{_IC} SELECT round(avg(c), 6) AS ic FROM (SELECT date, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS c FROM k GROUP BY date)")(lambda spark, d: rounded(models.information_coefficient(_scored(spark, d), mode="daily_mean")))
_R_DESC = "round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS high"
_TWO = sql.RAW + ", g AS (SELECT date, ticker, round(mom_1m, 9) AS x, round(vol_63, 9) AS z, round(ma_50_200, 9) AS u FROM f2)"


def _two(spark, d):
    return features.raw_features(src.px_smooth(spark, d)).select("date", "ticker", F.round("mom_1m", 9).alias("x"), F.round("vol_63", 9).alias("z"), F.round("ma_50_200", 9).alias("u"))


query("ens_rank", f"WITH {_TWO} SELECT date, ticker, round((0.7 * {sql.pct_rank('x', 'date')} + 0.3 * {sql.pct_rank('z', 'date')}) / 1.0, 6) AS score FROM g")(lambda spark, d: rounded(models.ensemble(_two(spark, d), {"x": 0.7, "z": 0.3, "u": 0.0})))
query("factor_score", f"WITH {_TWO}, r AS (SELECT date, ticker, {sql.pct_rank('x', 'date')} AS a, {sql.pct_rank('z', 'date')} AS b FROM g), t AS (SELECT date, ticker, CASE WHEN coalesce(a, b) IS NOT NULL THEN round(coalesce(a, 0) + coalesce(b, 0), 9) END AS s FROM r) SELECT date, ticker, round({sql.pct_rank('s', 'date')}, 6) AS score FROM t")(
    lambda spark, d: rounded(_two(spark, d).select("date", "ticker", pct_rank("x", "date").alias("a"), pct_rank("z", "date").alias("b")).select("date", "ticker", F.when(F.coalesce("a", "b").isNotNull(), F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9)).alias("s")).select("date", "ticker", pct_rank("s", "date").alias("score")))
)
query("score_blend", f"WITH {_TWO}, r AS (SELECT date, ticker, {sql.pct_rank('x', 'date')} AS a, {sql.pct_rank('z', 'date')} AS b, {sql.pct_rank('u', 'date')} AS c FROM g) SELECT date, ticker, round(0.5 * a + 0.3 * b + 0.2 * c, 6) AS score FROM r")(
    lambda spark, d: rounded(models.blend(_two(spark, d).select("date", "ticker", *(pct_rank(k, "date").alias(n) for k, n in (("x", "a"), ("z", "b"), ("u", "c")))), {"a": 0.5, "b": 0.3, "c": 0.2}))
)
_PB = f"{_TWO}, p AS (SELECT date, ticker, 1 / (1 + exp(-20 * x)) AS p_base FROM g WHERE x IS NOT NULL)"


def _pbase(spark, d):
    return _two(spark, d).where("x is not null").select("date", "ticker", (1 / (1 + F.exp(-20 * F.col("x")))).alias("p_base"))


query("meta_features", f"WITH {_PB} SELECT date, ticker, round(p_base, 6) AS p_base, CASE WHEN p_base > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS base_side, round({sql.pct_rank('p_base', 'date')}, 6) AS p_base_rank FROM p")(lambda spark, d: rounded(models.meta_features(_pbase(spark, d))))
query("describe_features", f"WITH {_TWO}, l AS (UNPIVOT (SELECT x, z, u FROM g) ON x, z, u INTO NAME name VALUE v) SELECT name, count(v) AS n, {_R_DESC} FROM l GROUP BY name")(lambda spark, d: rounded(metrics.describe(_two(spark, d), ["x", "z", "u"])))
query("bet_size", f"WITH {_PB}, q AS (SELECT date, ticker, least(greatest(p_base, 1e-6), 1 - 1e-6) AS p FROM p), z AS (SELECT date, ticker, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM q) SELECT date, ticker, round(greatest(2 * {norm_cdf_sql('z')} - 1, 0), 6) AS bet FROM z")(
    lambda spark, d: rounded(_pbase(spark, d).select("date", "ticker", models.bet_size(F.col("p_base")).alias("bet")))
)
query("class_report", f"""WITH {_PB}, j AS (SELECT p_base, CAST(lead(close, 21) OVER ({sql.TICKER}) > close AS INTEGER) AS y FROM px LEFT JOIN p USING (date, ticker)), k AS (SELECT p_base AS s, y FROM j WHERE y IS NOT NULL AND p_base IS NOT NULL),
r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM k), a AS (SELECT sum(r) FILTER (y = 1) AS rs, sum(y) AS p, count(*) AS n, avg(CASE WHEN (s > 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS accuracy, sum(CASE WHEN s > 0.5 AND y = 1 THEN 1.0 ELSE 0 END) AS tp, sum(CASE WHEN s > 0.5 THEN 1.0 ELSE 0 END) AS h FROM r)
SELECT round((rs - p * (p + 1) / 2) / (p * (n - p)), 5) AS auc, round(accuracy, 5) AS accuracy, round(tp / h, 5) AS "precision", round(tp / p, 5) AS recall, round(2 * tp / (h + p), 5) AS f1 FROM a""")(
    lambda spark, d: rounded(models.classification_report(_pbase(spark, d).join(src.px_smooth(spark, d).select("date", "ticker", (F.lead("close", 21).over(Window.partitionBy("ticker").orderBy("date")) > F.col("close")).cast("int").alias("y")), ["date", "ticker"]), "p_base"), 5)
)


def _train(spark, d):
    """Three features, forward rank and direction; the first 70 % of dates train, the rest validate."""
    px = src.px_smooth(spark, d)
    f = features.lagged(features.raw_features(px), ["mom_1m", "vol_63", "ma_50_200"])
    y = features.rank_target(px).join(features.median_target(px).select("date", "ticker", F.col("y").alias("up")), ["date", "ticker"])
    rows = splits.elapsed(f.join(y, ["date", "ticker"]).na.drop(), "__p")
    rows = rows.select("date", "ticker", "mom_1m", "vol_63", "ma_50_200", "y", "up", (F.col("__p") < 0.7).alias("train")).cache()  # fits read it again and again
    return rows.where("train"), rows.where("not train")


_COLS = ["mom_1m", "vol_63", "ma_50_200"]
#: Rounds of boosting for the panel of 25 brands; the presets have more.
ROUNDS = 10
_RIDGE = f"""WITH {_TWO}, t AS (SELECT x, y FROM (SELECT date, ticker, x FROM g) JOIN (SELECT date, ticker, lead(close, 21) OVER ({sql.TICKER}) / close - 1 AS y FROM px) USING (date, ticker) WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS c FROM t) SELECT round(n * c / sx / (n + 1.0), 6) AS coefficient, round(my, 6) AS intercept FROM s"""


@query("ridge_fit", _RIDGE)
def ridge_fit(spark, d):
    rows = _two(spark, d).select("date", "ticker", "x").join(src.px_smooth(spark, d).select("date", "ticker", features.forward_return().alias("y")), ["date", "ticker"]).na.drop()
    m = models.fit_linear(rows, ["x"]).model
    return rounded(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "coefficient double, intercept double"))


query("elastic_net")(lambda spark, d: models.fit_linear((t := _train(spark, d))[0], _COLS, alpha=0.001, l1_ratio=0.3).predict(t[1]).select("date", "ticker", "score"))
query("gbt_reg")(lambda spark, d: models.fit_boosted((t := _train(spark, d))[0], _COLS, maxIter=ROUNDS).predict(t[1]).select("date", "ticker", "score"))
query("gbt_clf")(lambda spark, d: models.fit_boosted((t := _train(spark, d))[0], _COLS, "up", classify=True, maxIter=ROUNDS).predict(t[1]).select("date", "ticker", "score"))
query("two_stage")(lambda spark, d: models.fit_two_stage(*(t := _train(spark, d)), _COLS, "up", maxIter=ROUNDS).bets(t[1]).select("date", "ticker", "p_base", "p_meta", "bet"))
query("leaderboard")(lambda spark, d: models.compare(*_train(spark, d), _COLS, maxIter=ROUNDS)[0].drop("fit_time_s"))


query("ranker")(lambda spark, d: models.fit_boosted((t := _train(spark, d))[0], _COLS, preset="ranker", maxIter=ROUNDS).predict(t[1]).select("date", "ticker", pct_rank("score", "date").alias("score")))


@query("gbt_weighted")
def gbt_weighted(spark, d):
    """The classifier of the upper half, its rows weighted by age."""
    train, valid = _train(spark, d)
    return models.fit_boosted(features.uniqueness_weights(train, half_life=756.0), _COLS, "up", classify=True, weight="w", maxIter=ROUNDS).predict(valid).select("date", "ticker", "score")


def _checked(rows):
    return validation.samples_of(rows, features.event_ends(rows.select("date").distinct()))


#: Settings that a search draws from, for few rounds.
_SPACE = {"maxDepth": (2, 5), "maxIter": [3, 5], "stepSize": (0.01, 0.15), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 20)}


@query("hp_search")
def hp_search(spark, d):
    rows, _ = _train(spark, d)
    return validation.search(rows, splits.purged_kfold(_checked(rows), 2), _COLS, _SPACE, 3, rule=validation.MedianRule(2))


@query("hp_search_calls")
def hp_search_calls(spark, d):
    train, valid = _train(spark, d)
    scored = models.fit_boosted(train, _COLS, "up", classify=True, maxIter=3).predict(valid, "p_base")
    folds = lambda long: splits.purged_kfold(_checked(long), 2)
    return validation.search_calls(scored, folds, [*_COLS, "p_base", "p_base_rank"], _SPACE, 3, label="up", rule=validation.MedianRule(2, 1))


@query("cpcv_scores")
def cpcv_scores(spark, d):
    """All 15 splits of 2 of 6 groups, each with a ridge of its own."""
    rows, _ = _train(spark, d)
    return validation.evaluate(rows, splits.cpcv(_checked(rows)), lambda part: models.fit_linear(part, _COLS))


query("cpcv_spread")(lambda spark, d: validation.spread(cpcv_scores(spark, d)))
query("synthetic_panel")(lambda spark, d: synthetic.synthetic_panel(spark))


query("cluster_avg_linkage")(lambda spark, d: clusters.correlation_clusters(_held(spark, d, 252), 8))
query("hrp")(lambda spark, d: clusters.hrp_weights(_held(spark, d, 252)))
query("select_allocate")(lambda spark, d: clusters.select_and_allocate(_scores(spark, d), _held(spark, d, 252), 10))


query("pipeline_a")(lambda spark, d: pipelines.production(spark, d))
query("pipeline_b")(lambda spark, d: pipelines.two_stage(spark, d))
query("universe_size", f"WITH {sql.PX}, n AS (SELECT date, count(close) AS n FROM px WHERE close IS NOT NULL GROUP BY date) SELECT round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high FROM n")(lambda spark, d: rounded(pipelines.universe_size(src.px_smooth(spark, d))))
query("sharpe_uplift", f"WITH {sql.BACKTEST}, mk AS (SELECT date, avg(close) AS close FROM px GROUP BY date), mr AS (SELECT close / lag(close) OVER (ORDER BY date) - 1 AS r FROM mk WHERE close IS NOT NULL), b AS (SELECT avg(coalesce(r, 0)) / stddev_samp(coalesce(r, 0)) AS s FROM mr), a AS (SELECT avg(ret) / stddev_samp(ret) AS s FROM cv) SELECT round(a.s / b.s, 5) AS uplift FROM a, b")(
    lambda spark, d: rounded(pipelines.uplift(curve(spark, d), backtest.returns(backtest.benchmark(src.market(src.px_smooth(spark, d))))), 5)
)
query("forecast_line", f"""WITH {sql.MARKET}, rb AS (SELECT min(date) AS rebal FROM cal GROUP BY date_trunc('month', date)), z AS (SELECT date, count(close) OVER w AS n, regr_slope(ln(close), i) OVER w AS b FROM mk WINDOW w AS (ORDER BY date ROWS BETWEEN 1260 PRECEDING AND 1 PRECEDING))
SELECT date, round(CASE WHEN n >= 252 THEN exp(b * 21) - 1 ELSE 0.0 END, 5) AS value FROM z JOIN rb ON date = rebal""")(
    lambda spark, d: rounded(pipelines.trailing_forecast(m := src.market(src.px_smooth(spark, d)), portfolio.rebalances(m.select("date"))), 5)
)
query("ew_correlation")(lambda spark, d: pipelines.equal_weight_correlation(src.px_smooth(spark, d)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Brand panel, one-month momentum, monthly top five, segment backtest, summary."""
    return metrics.summary(curve(spark, d))

"""Panels from the order tables, and the readers and writers of the price cache, memberships and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import trailing

SMOOTH = 63
#: Means are cut to cents after adding this share of a cent: averages of few prices often lie on half cents, where the last bit would decide.
CENT = 0.3719
MEMBERS = 15
MACRO_BASE = (
    "infl", "unemp", "cbrate", "ltrate", "strate", "rGDP", "rGDP_pc", "M2", "HPI", "CPI", "USDfx", "REER",
    "gen_govdef_GDP", "gen_govdebt_GDP", "CA_GDP", "BankingCrisis", "SovDebtCrisis", "CurrencyCrisis",
)  # fmt: skip  fixed values: the macro columns that are kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> DataFrame:
    """One row per ticker and ship date: mean, highest and lowest price, volume, and the same per unit."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(key).cast("string").alias("ticker"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "date").agg(
        F.avg("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("h"), F.min("l_extendedprice").alias("l"), F.sum("l_quantity").alias("v"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("unit"), F.max(unit).alias("uh"), F.min(unit).alias("ul"),
    )


def calendar(rows: DataFrame) -> DataFrame:
    """The dates of a panel and their numbers from 1: a date-level table, so its window may be one partition."""
    return rows.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).cast("long").alias("i"))


def densify(rows: DataFrame) -> DataFrame:
    """Every ticker on every date, missing values null. The calendar is broadcast: it has one row per trading day, whatever the data's size."""
    grid = rows.select("ticker").distinct().join(F.broadcast(calendar(rows)))
    return grid.join(rows, ["date", "ticker"], "left")


def px_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit-price panel on the grid."""
    return densify(daily(spark, sf_dir)).select("i", "date", "ticker", F.col("unit").alias("close"), F.col("uh").alias("high"), F.col("ul").alias("low"), F.col("v").alias("volume"))


def px_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default panel: trailing means of the daily figures, to the cent."""
    w = trailing(SMOOTH)
    mean = lambda c, n: (F.floor(F.avg(c).over(w) * 100 + CENT) / 100.0).alias(n)
    return densify(daily(spark, sf_dir)).select("i", "date", "ticker", mean("a", "close"), mean("h", "high"), mean("l", "low"), mean("v", "volume"))


def market(panel: DataFrame) -> DataFrame:
    """The mean close of each date."""
    return panel.groupBy("i", "date").agg(F.avg("close").alias("close"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap_date, ticker): at each month's start the brands that sold most in the month before."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("m"), "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    sold = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("m", "ticker").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    best = Window.partitionBy("m").orderBy(F.col("s").desc(), "ticker")
    return sold.withColumn("r", F.row_number().over(best)).where(F.col("r") <= MEMBERS).select(F.add_months("m", 1).alias("snap_date"), "ticker")


def macro_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly macro columns made of order totals; 1997's inflation is null on purpose."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("a"), F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("h"), F.min("o_totalprice").alias("l"))
    col = lambda x, n: F.round(x, 6).alias(n)
    return o.select(
        "year", F.when(F.col("year") != 1997, F.round(F.col("a") / 20000, 6)).alias("infl"), col(F.col("n") % 10 + 0.0, "unemp"), col(F.col("l") / 400, "cbrate"), col(F.col("h") / 100000, "ltrate"),
        col(F.col("s"), "rGDP"), col(F.col("a"), "rGDP_pc"), col(F.col("s") * 2, "M2"), col(F.col("h"), "HPI"), col(F.col("a") + F.col("l"), "CPI"),
    )


# Readers and writers


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of `date,tickers` with comma-separated tickers: (snap_date, tickers), sorted by date."""
    raw = spark.read.csv(path, header=True, schema="date string, tickers string")
    return raw.select(F.to_date("date").alias("snap_date"), F.array_distinct(F.split("tickers", ",")).alias("tickers")).orderBy("snap_date")


def tickers_ever(snapshots: DataFrame) -> DataFrame:
    """All tickers of all snapshots, sorted."""
    return snapshots.select("ticker").distinct().orderBy("ticker")


def read_wide_cache(spark: SparkSession, path: str) -> DataFrame:
    """A wide cache (date and one column `Field|Ticker` each) as long rows with a column for each field."""
    wide = spark.read.parquet(path)
    named = [c for c in wide.columns if "|" in c]
    long = wide.select("date", *(F.col(f"`{c}`").cast("double").alias(c) for c in named)).unpivot("date", [F.col(f"`{c}`") for c in named], "name", "value")
    parts = F.split("name", r"\|")
    return long.select("date", parts[0].alias("field"), parts[1].alias("ticker"), "value").groupBy("date", "ticker").pivot("field").agg(F.first("value"))


def write_long_cache(panel: DataFrame, path: str) -> None:
    """Long rows, one folder for each year, so that date filters prune folders."""
    panel.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def missing_tickers(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Tickers that the cache does not hold."""
    return wanted.select("ticker").distinct().join(cached.select("ticker").distinct(), "ticker", "left_anti")


def merged_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows, the new ones winning on (date, ticker)."""
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["date", "ticker"], F.col("__seq")).drop("__seq")


def keep_last(rows: DataFrame, key: list[str], order) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(order if isinstance(order, list) else [order.desc()]))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def normalise_ticker(column, inverse: bool = False):
    """`.` as `-`, or back."""
    return F.replace(column, F.lit("-" if inverse else "."), F.lit("." if inverse else "-"))


def read_macro(spark: SparkSession, path: str, country: str = "USA") -> DataFrame:
    """One country's rows of a macro CSV with the known columns that it has."""
    raw = spark.read.csv(path, header=True).where(F.col("ISO3") == country)
    return raw.select(F.col("year").cast("int").alias("year"), *(F.col(c).cast("double").alias(c) for c in MACRO_BASE if c in raw.columns)).orderBy("year")


def pick_field(prices: DataFrame, first: str = "adj_close", second: str = "close") -> DataFrame:
    """close taken from the adjusted column where there is one; neither is an error."""
    have = [c for c in (first, second) if c in prices.columns]
    if not have:
        raise KeyError(f"neither {first} nor {second} among {prices.columns}")
    return prices.withColumn("close", F.col(have[0]))


def clean(panel: DataFrame, jump: float = 2.0, history: int = 0) -> DataFrame:
    """Zero prices as null; tickers with an implausible one-day move, without any price, or with fewer than `history` prices go."""
    from ..functions.exprs import change, ffill

    fixed = panel.withColumn("close", F.nullif("close", F.lit(0.0)))
    moved = fixed.withColumn("__f", ffill("close")).withColumn("__r", change("__f"))
    fine = moved.groupBy("ticker").agg(F.max(F.abs("__r")).alias("m"), F.count("close").alias("n")).where((F.coalesce("m", F.lit(0.0)) <= jump) & (F.col("n") > 0) & (F.col("n") >= history))
    return fixed.join(fine.select("ticker"), "ticker", "left_semi")


def asof_snapshot(dates: DataFrame, snaps: DataFrame) -> DataFrame:
    """(date, snap_date): the last snapshot at or before each date, the first one for earlier dates. Both tables are date-level."""
    marks = dates.select("date", F.lit(None).cast("date").alias("snap")).unionByName(snaps.select(F.col("snap_date").alias("date"), F.col("snap_date").alias("snap")).distinct())
    w = Window.orderBy("date", F.col("snap").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.select("date", "snap", F.last("snap", ignorenulls=True).over(w).alias("s"), F.min("snap").over(Window.partitionBy()).alias("low"))
    return filled.where(F.col("snap").isNull()).select("date", F.coalesce("s", "low").alias("snap_date"))


def active(panel: DataFrame, members: DataFrame) -> DataFrame:
    """The panel's rows of members with a price."""
    at = asof_snapshot(panel.select("date").distinct(), members.select("snap_date"))
    return panel.where(F.col("close").isNotNull()).join(F.broadcast(at), "date").join(members, ["snap_date", "ticker"], "left_semi")

"""Purged and combinatorial cross-validation as relations (split, row_id, role)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(samples: DataFrame) -> DataFrame:
    """Samples (date, ticker, t1) with row_id from 0 in the order of date and ticker. The number of a row is that of its date's first row plus its rank within the date, so no window spans the table."""
    sizes = samples.groupBy("date").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("date", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("date").orderBy("ticker")
    return samples.join(F.broadcast(firsts), "date").withColumn("row_id", (F.col("__first") + F.row_number().over(inside) - 1).cast("long")).drop("__first")


def elapsed(rows: DataFrame, name: str) -> DataFrame:
    """Adds `name`: the share of the other rows that lie on earlier dates, from counts by date, so no window spans the table."""
    sizes = rows.groupBy("date").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    share = F.coalesce(F.sum("__n").over(before), F.lit(0)) / F.greatest(F.sum("__n").over(Window.partitionBy()) - 1, F.lit(1))
    return rows.join(F.broadcast(sizes.select("date", share.alias(name))), "date")  # date-level


def chunk_of(row_id, n, k: int):
    """The contiguous chunk of a row when n rows are cut into k nearly equal runs, the longer ones first."""
    size, longer = F.floor(n / k), n % k
    edge = longer * (size + 1)
    return F.when(row_id < edge, F.floor(row_id / (size + 1))).otherwise(longer + F.floor((row_id - edge) / F.greatest(size, F.lit(1)))).cast("int")


def bounds(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows with chunk and n, one row per chunk: its first and last row, first date and last event end)."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    cut = rows.join(F.broadcast(total)).withColumn("chunk", chunk_of(F.col("row_id"), F.col("n"), k))  # one row
    ranges = cut.groupBy("chunk").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.min("date").alias("t0_lo"), F.max("t1").alias("t1_hi"))
    return cut, ranges


def cpcv_paths(n: int, k: int) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """All combinations of k of n groups, and for each path the split that tests each group: the p-th one holding it."""
    combos = list(combinations(range(n), k))
    holding = [[s for s, c in enumerate(combos) if g in c] for g in range(n)]
    return combos, [list(path) for path in zip(*holding)]


def paths_table(spark, n: int, k: int) -> DataFrame:
    _, paths = cpcv_paths(n, k)
    return spark.createDataFrame([(p, g, s) for p, path in enumerate(paths) for g, s in enumerate(path)], "path long, grp long, split long")


def _roles(cut: DataFrame, ranges: DataFrame, tests: DataFrame, embargo: float) -> DataFrame:
    """Rows by split and role. `tests` says which chunks each split tests; chunks and splits are few, so their table is broadcast."""
    spans = tests.join(ranges, "chunk").groupBy("split").agg(F.collect_list(F.struct("lo", "hi", "t0_lo", "t1_hi")).alias("spans"))
    at = cut.join(F.broadcast(spans))
    held = F.floor(F.col("n") * embargo)
    inside = F.exists("spans", lambda s: F.col("row_id").between(s["lo"], s["hi"]))
    overlaps = F.exists("spans", lambda s: (F.col("t1") >= s["t0_lo"]) & (F.col("date") <= s["t1_hi"]))
    shadow = F.exists("spans", lambda s: (F.col("row_id") > s["hi"]) & (F.col("row_id") <= s["hi"] + held))
    role = F.when(inside, "test").when(overlaps, "purged").when(shadow, "embargo").otherwise("train")
    return at.select("split", "row_id", "date", "ticker", role.alias("role"))


def purged_kfold(samples: DataFrame, k: int = 5, embargo: float = 0.01) -> DataFrame:
    """(split, row_id, date, ticker, role) with role test, train, purged or embargo."""
    cut, ranges = bounds(numbered(samples), k)
    tests = ranges.select(F.col("chunk").alias("split"), "chunk")
    return _roles(cut, ranges, tests, embargo)


def cpcv(samples: DataFrame, n: int = 6, k: int = 2, embargo: float = 0.01) -> DataFrame:
    """As purged_kfold(), for all combinations of k of n chunks."""
    cut, ranges = bounds(numbered(samples), n)
    combos, _ = cpcv_paths(n, k)
    tests = samples.sparkSession.createDataFrame([(s, g) for s, c in enumerate(combos) for g in c], "split int, chunk int")
    return _roles(cut, ranges, tests, embargo)

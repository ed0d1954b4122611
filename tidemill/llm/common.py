"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the corpus contracts, as a Java character class without brackets.
SPACE = r"\x20\x09-\x0D"

_tables: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once: a lambda variable is never inlined by the optimizer."""
    return F.transform(F.array(value), body)[0]


def unclashing(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def total(values: Column) -> Column:
    """The sum of an array of longs; 0 for an empty one."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def running_starts(sizes: Column, block: int = 256) -> Column:
    """For an array of sizes, where each item begins if they stand end to end: two levels of blocks, so long arrays stay near linear."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def joined(blocks: Column) -> Column:
        return let(sums(F.transform(blocks, lambda b: F.element_at(b, -1))), lambda first: F.flatten(F.transform(blocks, lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(first, k)))))

    numbers = F.sequence(F.lit(0), F.greatest((F.size(sizes) - 1) / block, F.lit(0)).cast("int"))
    return let(F.transform(numbers, lambda b: sums(F.slice(sizes, b * block + 1, F.lit(block)))), joined)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):  # a machine-local folder serves one machine only
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and reread: the lineage ends there, and the loss of an executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_drop_all)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of frames from saved() that no plan needs any more."""
    for df in frames:
        path = getattr(df, "saved_path", None)
        if path:
            _delete(df.sparkSession, path)
            _tables[:] = [x for x in _tables if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all() -> None:
    for spark, path in _tables:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def grouped_number(rows: DataFrame, group: list[str], order: list[str], bucket: Column, buckets: int, name: str) -> DataFrame:
    """`rows` with the column `name`: 0, 1, 2, ... without gaps in each group, with no group held by one task.

    A group is split into `buckets` by the expression `bucket` (0 to buckets - 1). Counts of (group, bucket) give each
    bucket its first number, rows are numbered inside their bucket, and the two are added. The order is by bucket, then
    by `order`. The table of first numbers has at most groups * buckets rows.
    """
    from pyspark.sql import Window

    b, first = "__bucket", "__first"
    keyed = rows.withColumn(b, bucket)
    sizes = keyed.groupBy(*group, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn(first, F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, b).orderBy(*order)
    numbered = keyed.withColumn("__at", F.row_number().over(inside))
    return numbered.join(firsts, [*group, b]).withColumn(name, (F.col(first) + F.col("__at") - 1).cast("long")).drop(b, first, "__at")

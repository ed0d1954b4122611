"""Tables that several plans of one job read, stored for as long as the job runs.

A cached frame keeps its whole logical plan, which every later plan contains again; in long jobs the planner then takes
longer than the work. A stored table starts a new plan, and the loss of an executor loses nothing of it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):  # a machine-local folder serves one machine only
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tidemill-")


@contextmanager
def kept(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """keep(rows): `rows` written as Parquet and read again. The tables go when the block ends, so only what was computed by then may leave it (see report)."""
    folder = f"{shared_folder(spark)}/tidemill-{uuid.uuid4().hex}"
    count = iter(range(1 << 30))

    def keep(rows: DataFrame) -> DataFrame:
        path = f"{folder}/{next(count)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    try:
        yield keep
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def report(rows: DataFrame) -> DataFrame:
    """A report of a few rows, computed now, so that nothing it was made from is needed any more."""
    return rows.sparkSession.createDataFrame([tuple(r) for r in rows.collect()], rows.schema)

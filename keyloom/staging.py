"""Where intermediate tables live.

Lineage is cut by writing a parquet table into the shared folder that the session
names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, never a
re-run of the rounds before. Parquet (rather than ``checkpoint()``) keeps column
pruning and size statistics for the jobs that read the table back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"

# Below this many rows a table is spread over the cores, because a small source is often
# one file with one row group, which Spark reads in one task. Larger tables keep the splits
# of their source: no shuffle is added.
SPREAD_BELOW = 20_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, as in tests on one machine, a
    folder in the session's warehouse; a cluster must name one. The session is not changed."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_keyloom"


class Stage:
    """A private sub-folder of the shared folder for one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/keyloom-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads the written table."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_counted(self, df: DataFrame, name: str, counted: Column) -> tuple[DataFrame, int]:
        """Like :meth:`put`; also the number of rows where ``counted`` holds, in the same job."""
        seen = Observation()
        staged = self.put(df.observe(seen, F.count_if(counted).alias("n")), name)
        return staged, seen.get.get("n", 0)

    def drop(self, path: str) -> None:
        """Delete what was written to ``path``; nothing may read it afterwards."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    def append(self, df: DataFrame, path: str) -> None:
        df.write.mode("append").parquet(path)


def spread(df: DataFrame, n_rows: int) -> DataFrame:
    """Spread a small table over the cores; leave a large one as its source splits it."""
    if n_rows >= SPREAD_BELOW:
        return df
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, n_rows)))

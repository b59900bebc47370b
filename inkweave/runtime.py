"""Session helpers: partition counts, and tables that cut lineage in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a side that may be broadcast; they are counted first.
SMALL = 200_000


def spread_count(spark: SparkSession) -> int:
    """Partitions for a stage that runs Python: at least one a core, else what the session asks for."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    return max(cores, min(shuffle, 4 * cores)) if shuffle >= 200 else max(cores, shuffle)


def spread(df: DataFrame, *keys: str | Column, count: int | None = None) -> DataFrame:
    """``df`` over a fixed number of partitions (hashed by ``keys``), which adaptive execution leaves alone."""
    return df.repartition(count or spread_count(df.sparkSession), *keys)


def parallel(df: DataFrame) -> DataFrame:
    """``df``, a table as it was read, itself where it has a partition a core, else spread over as many.

    Asked only of scans: to count the partitions of a table behind a shuffle would run what is before it.
    """
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else spread(df)


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session gets a folder of its own where it is unset; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        master = spark.sparkContext.master
        if held.isDefined():
            root = held.get()
        elif master == "local" or master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="inkweave-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written once in the shared folder and read again: a lost executor costs a re-read, not a recomputation.

    Tables stay until ``drop`` or the end of the Python process, since a lazily read result may still need them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/inkweave/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a table without lineage."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp that means UTC."""
    return F.unix_micros(c.cast("timestamp"))

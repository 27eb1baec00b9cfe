"""Tables written to the folder that driver and executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="splatlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Names written tables of one run and deletes the ones no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, partition_by: tuple[str, ...] = (), compression: str = "zstd") -> DataFrame:
        """Writes df as Parquet and reads it back."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._splatlake_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that keep() wrote; nothing may read them any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._splatlake_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame, keys: list[str], size: str, total: int, cells: int = 2000) -> DataFrame:
    """Of keys with their numbers of rows (size, of total): those with over a ``cells``-th of all, so fewer than ``cells``, and
    how many such shares they have."""
    share = max(1, total // cells)
    return counts.filter(F.col(size) > share).select(*keys, F.ceil(F.col(size) / share).cast("int").alias("__parts"))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """rows with the one row of table for their key; the rows of a hot key are dealt over its parts."""
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    spread = table.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(spread, [*keys, "__part"], how).drop("__part")

"""Restart state: a manifest beside the written tables of a conversion, and when it may be reused."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

# Options that do not change the written stages.
FREE = ("transform", "coordinate", "memory_budget", "clean", "self_test", "self_test_count", "spz_compression_level")
STAGES = ("scanned", "partitioned", "built", "done")


def fingerprint(path: str | None, options, n: int, checksum: str = "") -> str:
    """Of the input (size, time of change, checksum of its head and tail) and of the options that matter."""
    known = {k: v for k, v in asdict(options).items() if k not in FREE}
    if path and os.path.exists(path):
        stat = os.stat(path)
        with open(path, "rb") as f:
            head = f.read(1 << 20)
            f.seek(max(0, stat.st_size - (1 << 20)))
            known["input"] = [stat.st_size, stat.st_mtime_ns, hashlib.sha256(head + f.read()).hexdigest()]
    return hashlib.sha256(json.dumps([known, n, checksum], sort_keys=True).encode()).hexdigest()


class Manifest:
    """A JSON file of stages done; one write per stage, replaced atomically."""

    def __init__(self, folder: str, mark: str):
        self.path, self.mark, self.state = os.path.join(folder, "manifest.json"), mark, {"fingerprint": mark, "stages": {}}
        if os.path.exists(self.path):
            with open(self.path) as f:
                found = json.load(f)
            if found.get("fingerprint") == mark:
                self.state = found

    @property
    def reused(self) -> bool:
        return bool(self.state["stages"])

    def get(self, stage: str):
        return self.state["stages"].get(stage)

    def put(self, stage: str, value) -> None:
        self.state["stages"][stage] = value
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path + ".new", "w") as f:
            json.dump(self.state, f)
        os.replace(self.path + ".new", self.path)

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


def shared_dir(spark) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this machine only in local mode with none set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="splatlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Tables:
    """Writes tables as Parquet under the shared folder and reads them back: lineage ends there, lost executors cost nothing,
    and later scans read only the columns they need."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_at = path
        return out

    def drop(self, first: int, but: DataFrame) -> None:
        """Deletes the tables from the ``first``-th on, except one; nothing may read them any more."""
        for path in self.paths[first:]:
            if path != but.written_at:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

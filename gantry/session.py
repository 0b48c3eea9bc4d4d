"""Session construction and the shared folder for cut lineages."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "gantry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query assumes: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "gantry-" + uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Tables written under the shared folder: they cut the lineage and survive lost executors.

    drop() removes a table as soon as its readers are done; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def write(self, df: DataFrame) -> DataFrame:
        return self.keep(df)[0]

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before the driver's exit hooks run
            pass

    def close(self) -> None:
        self.drop(self.base)

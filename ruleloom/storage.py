"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the folder of setCheckpointDir.

    Only where there is neither, on one machine (tests), a temporary folder is made and kept in the session.
    """
    for key in ("spark.checkpoint.dir", "spark.ruleloom.scratch"):
        if root := spark.conf.get(key, None):
            return root.rstrip("/")
    if root := spark.sparkContext.getCheckpointDir():
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="ruleloom-")
    spark.conf.set("spark.ruleloom.scratch", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that Spark removes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: columns and rows can be left out of later scans."""
    spark, schema = df.sparkSession, df.schema
    # Parquet has no type for columns that are null throughout.
    void = [f.name for f in schema if isinstance(f.dataType, T.NullType)]
    path = shared_path(spark, name)
    df.drop(*void).write.parquet(path)
    kept = T.StructType([f for f in schema if f.name not in void])
    out = spark.read.schema(kept).parquet(path)
    return out.select(*[F.lit(None).alias(f.name) if f.name in void else F.col(f"`{f.name}`") for f in schema]) if void else out

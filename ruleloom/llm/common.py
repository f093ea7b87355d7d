"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_path


def written(df: DataFrame, name: str, large: bool = True) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage is cut and survives lost executors.

    Shuffle files are let go of after large tables; the small ones of a loop wait for the next. The driver's memory is
    tidied after each: plans and broadcast tables of a loop would pile up in its heap otherwise.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    del df  # with the caller's expression gone, nothing names the job's shuffle files
    if large:
        release(spark)
    else:
        tidy(spark)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        if files := df.inputFiles():
            folder = files[0].rpartition("/")[0]
            spark = df.sparkSession
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are over: it does once the objects that name them are collected.

    A session names its last query until another one runs, so a query of one row goes first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.range(1).collect()
    tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage and gives memory that its JVM and Python have freed back to the system.

    The C library keeps what they free (a few hundred MB in a long session) until it is told.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Returns the free native memory of the driver's JVM and Python; whether the JVM has a command for it (Linux, 17.0.9 on)."""
    sc = spark.sparkContext
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # not the GNU library
    jvm, new = sc._jvm, sc._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # The server's class is hidden from reflection, its interface is not.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args, given, kinds = new(jvm.Object, 4), new(jvm.Object, 1), new(jvm.String, 1)
        given[0], kinds[0] = new(jvm.String, 0), "[Ljava.lang.String;"
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = given, kinds
        call.invoke(server, args)
    except Py4JError:
        return False
    return True


def fields(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named expressions; what else the frame has (clashing names too) is left behind."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def own(df: DataFrame) -> list[Column]:
    """The frame's columns, bound to it: after a join they are told from equally named ones of the other side."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


def text_bytes(df: DataFrame, column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(df[column].cast("string"), F.lit("")).cast("binary")


def words(payload: bytes) -> list[bytes]:
    """Runs of other bytes than blank and 0x09-0x0D, with A-Z lower-cased."""
    return payload.lower().split()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def in_order(rows: pa.Table) -> pa.Table:
    """Rows of a block by (doc_id, body): Spark gives them in any order, another one when a block is made again."""
    return rows.sort_by([("doc_id", "ascending"), ("body", "ascending")])


def held_out(doc_id: Column, modulus: int) -> Column:
    """Remainder of crc32 of the id's text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2

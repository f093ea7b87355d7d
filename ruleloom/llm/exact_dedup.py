"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields


def exact_dedup(docs: DataFrame, normalise=None, keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (128-bit hash, whole text), so rows of one hash whose bytes differ fall apart into
    separate groups; partial aggregation leaves one row per distinct text and task, however large a group of
    copies is. The join back is on hashes only and can be split where a group is hot.
    keep: "smallest" or "largest" id of a group stays. normalise: Column -> Column, applied to the text first.
    Null texts count as empty. A null id stays only where its whole group has none. Rows that repeat both id and
    text: all of them say kept, a caller that needs one drops repeated rows. Other columns are ignored.
    """
    text: Column = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = fields(docs, doc_id=docs["doc_id"], text=normalise(text) if normalise else text)
    rows = rows.withColumns({"content_hash": F.md5("text"), "text_sha256": F.sha2("text", 256)})
    chosen = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    groups = (
        rows.groupBy("content_hash", "text_sha256", "text")
        .agg(chosen.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("content_hash").alias("h"), F.col("text_sha256").alias("s"), "keep_id", "group_size")
    )
    ids = rows.select("doc_id", "content_hash", "text_sha256")
    return ids.join(groups, (ids.content_hash == groups.h) & (ids.text_sha256 == groups.s)).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

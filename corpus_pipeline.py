"""A pipeline over `documents`: language ID, exact dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import held_out, own
from ruleloom.llm.exact_dedup import exact_dedup
from ruleloom.llm.minhash import near_dedup
from ruleloom.llm.mixing import mixed
from ruleloom.llm.pieces import encode
from ruleloom.llm.ppm import identify
from ruleloom.storage import shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted, with lang set to the prediction; `und` ones (no letters, no text) go.

    Here and later, documents are told by id and text: rows that share an id, or have none, are documents of their own.
    """
    found = identify(docs, docs.filter(~held_out(docs["doc_id"], 4))).filter("lang_pred <> 'und'")
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.min("lang_pred").alias("_lang"))
    both = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_key"]))
    return both.select(*[found["_lang"].alias(n) if n == "lang" else c for n, c in zip(docs.columns, own(docs))])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of smallest id."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (sha == kept["_sha"])).select(*own(docs)).dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8), that of smallest id."""
    gone = near_dedup(docs).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, score of each document taken, ids and score of its second best segmentation (null: none), and
    whether both decode to its text."""
    out = encode(docs, n_best=2)
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.element_at("scores", 1).alias("score"), F.try_element_at("alternatives", F.lit(1)).alias("ids_2"), F.try_element_at("scores", F.lit(2)).alias("score_2"), "decodes")


STAGES = [("language ID", language), ("exact dedup", exact), ("near-dedup", near), ("mixing", mixing), ("encoding", pieces)]

#: The prediction, the rounding and the segmentation are not to be had in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

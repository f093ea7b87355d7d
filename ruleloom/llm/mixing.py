"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, own, written

#: Documents that one step of the reduction tree takes; also the fan-in of its inner nodes.
FAN_IN = 1024
#: A table of sources is broadcast up to this many rows; beyond, it is joined.
BROADCAST_ROWS = 20_000


def word_count(text) -> "F.Column":
    """Runs of other characters than blank and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, n_docs, target of a table (source, size).

    Weights repeat over the sources by code point, null last. A target stops at `most` times its source's size and
    what is over goes to the others by weight: water filling, solved in one pass over sources ordered by the level at
    which each fills. The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = per.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("fills_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fills_at", "i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    laid = ranked.withColumns(
        {
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(whole) * share,
        }
    )
    # The level if this source and all that fill later stay below their caps.
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    laid = laid.withColumn("level", F.when(level <= F.col("fills_at"), level))
    laid = laid.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return laid.select("source", "source_size", "n_docs", target.alias("target"))


def _pivot(part: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Sequential pivotal rounding of column p; one row may stay fractional unless this is the last node of its source.

    Two fractional rows exchange mass counted in words, so the words expected of the two together stay what they were
    and each row's expected copies too; the larger rows come first, so what is left at the end is small.
    """
    part = part.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
    p, s = part["p"].to_numpy(float).copy(), part["size"].to_numpy(float)
    draw = np.random.default_rng(seed).random(len(p) + 1)
    p[(s == 0) & (p > 0)] = 0.0
    open_, rest = np.flatnonzero((p > 1e-12) & (p < 1 - 1e-12)), -1
    p[p <= 1e-12], p[p >= 1 - 1e-12] = 0.0, 1.0
    for j in open_:
        if rest < 0:
            rest = j
            continue
        i = rest
        give, take = min(p[i] * s[i], (1 - p[j]) * s[j]), min((1 - p[i]) * s[i], p[j] * s[j])
        if draw[j] * (give + take) < take:
            i_ends, j_ends = give >= p[i] * s[i], give >= (1 - p[j]) * s[j]
            p[i], p[j] = (0.0 if i_ends else p[i] - give / s[i]), (1.0 if j_ends else p[j] + give / s[j])
        else:
            i_ends, j_ends = take >= (1 - p[i]) * s[i], take >= p[j] * s[j]
            p[i], p[j] = (1.0 if i_ends else p[i] + take / s[i]), (0.0 if j_ends else p[j] - take / s[j])
        rest = -1 if i_ends and j_ends else j if i_ends else i
    if rest >= 0 and last:
        p[rest], rest = float(draw[-1] < p[rest]), -1
    fractional = np.zeros(len(p), bool)
    if rest >= 0:
        fractional[rest] = True
    return part.assign(p=p, open=fractional)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 20,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Copies of each document: doc_id, text_key, source, size, source_size, target, copies, taken.

    A document's expected copies are its source's target over the source's size, in [0, most]; the whole part is
    given, the rest is rounded pivotally: within nodes of about `fan_in` documents of a source (chosen by a hash, so
    a hot source has many nodes), then the residuals of `fan_in` nodes together, and so on up to one node per source.
    Rows equal in id, text and source are rounded as one, by the words of all, and share its copies as evenly as may be: so
    a group of any size is one row of a node. Draws come from a seed and the node's name: reruns agree. Null and empty
    texts have size 0 and take 0 words; a null source is a source of its own, last; an empty table gives no rows; rows
    of one id with different texts are rounded each on its own. text_key is a hash of the text, to tell such rows apart.
    """
    spark = docs.sparkSession
    sizes = fields(docs, doc_id=docs["doc_id"], source=docs["source"].cast("string"), size=word_count(docs["text"]), text_key=F.xxhash64(docs["text"]))
    sizes = written(sizes, "mix-sizes")
    sources = written(source_targets(sizes, weights, share, most), "mix-sources")
    n_sources, largest = sources.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    sizes = sizes.groupBy("doc_id", "text_key", "source", "size").agg(F.count(F.lit(1)).alias("equal"))
    if n_sources <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    per = sources.withColumnRenamed("source", "of")
    rows = sizes.join(per, sizes.source.eqNullSafe(per.of)).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    nodes = F.ceil(F.col("n_docs") / fan_in)
    rows = rows.withColumn("rate", rate * F.col("equal")).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "equal",
        F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), nodes).cast("long").alias("node"), nodes.cast("long").alias("nodes"),
    )
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", open boolean"

    def at(level: int):
        def step(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            name = f"{seed}/{level}/{key[0]}/{key[1]}"
            return _pivot(part, zlib.crc32(name.encode()), bool(part["nodes"].iloc[0] <= 1))

        return step

    done, level, width = None, 0, max(int(largest or 0), 1)
    while True:
        settled = rows.groupBy("source", "node").applyInPandas(at(level), schema)
        ended = settled.filter(~F.col("open")).drop("open")
        done = ended if done is None else done.unionByName(ended)
        width = -(-width // fan_in)
        if width <= 1:
            break
        rows = written(settled.filter("open").drop("open"), "mix-open") if level else settled.filter("open").drop("open")
        rows = rows.withColumns({"node": F.floor(F.col("node") / fan_in), "nodes": F.ceil(F.col("nodes") / fan_in)})
        level += 1
    copies = (F.col("whole") + F.round("p")).cast("long")
    # The n-th of equal rows gets what is left over after an even split, while it lasts.
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal"))).alias("nth")
    done = done.select("doc_id", "text_key", "source", "size", "source_size", "target", "equal", copies.alias("all"), nth)
    each = (F.floor(F.col("all") / F.col("equal")) + F.when(F.col("nth") <= F.col("all") % F.col("equal"), 1).otherwise(0)).cast("int")
    return done.select("doc_id", "text_key", "source", "size", "source_size", "target", each.alias("copies"), (each * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as mix() takes it. Columns stay, whatever their names.

    Rows equal in id, text and source stand for one another: one of them comes as often as mix() takes them all.
    """
    source, key = docs["source"].cast("string"), F.xxhash64(docs["text"])
    taken = mix(docs, **how).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("source").alias("_source"))
    taken = taken.agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    taken = written(taken, "mix-taken")
    once = taken.filter("_rows = 1")
    out = _repeated(docs, once, key, source)
    if taken.filter("_rows > 1").isEmpty():
        return out
    many = taken.filter("_rows > 1")
    # First one row of each group (the keys are told apart from the table's own columns by their places), then its copies.
    keys = docs.select(F.struct(*own(docs)).alias("row"), docs["doc_id"].alias("id"), key.alias("text"), source.alias("source"))
    keys = keys.join(many, keys["id"].eqNullSafe(many["_id"]) & (keys["text"] == many["_text"]) & keys["source"].eqNullSafe(many["_source"]))
    keys = keys.groupBy("id", "text", "source").agg(F.first("row").alias("row"), F.first("_copies").alias("_copies"))
    keys = keys.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.unionAll(keys.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def _repeated(docs: DataFrame, taken: DataFrame, key: Column, source: Column) -> DataFrame:
    copies = taken.select("_id", "_text", "_source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    same = docs["doc_id"].eqNullSafe(copies["_id"]) & (key == copies["_text"]) & source.eqNullSafe(copies["_source"])
    return docs.join(copies, same).select(*own(docs))

"""Truth maintenance: logical facts stand while one of their justifications does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forward import checkpointed


def cascade(facts: DataFrame, justifications: DataFrame, retracted: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """fact_id, round: what falls if the facts of `retracted` (fact_id) do; round 0 are those themselves.

    facts: (fact_id, explicit boolean). justifications: (just_id, fact_id, premise_id), a row per premise. A logical fact falls
    when each of its justifications has a fallen premise; an explicit one only if it is retracted itself. Rounds go on
    until nothing falls; each looks only at justifications that the last round touched.
    """
    gone = checkpointed(retracted.select("fact_id").distinct().withColumn("round", F.lit(0)))
    total = justifications.select("fact_id", "just_id").distinct().groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"))
    logical = checkpointed(facts.filter(~F.col("explicit")).select("fact_id").join(total, "fact_id"))
    broken, fresh = None, gone
    for turn in range(1, max_rounds + 1):
        hit = justifications.join(fresh.select(F.col("fact_id").alias("premise_id")), "premise_id").select("fact_id", "just_id").distinct()
        if broken is not None:
            hit = hit.join(broken, ["fact_id", "just_id"], "left_anti")
        hit = checkpointed(hit)
        if hit.isEmpty():
            break
        broken = hit if broken is None else broken.unionByName(hit)
        count = broken.join(hit.select("fact_id").distinct(), "fact_id", "left_semi").groupBy("fact_id").agg(F.count(F.lit(1)).alias("b"))
        falls = logical.join(count, "fact_id").filter("b >= n").select("fact_id").join(gone.select("fact_id"), "fact_id", "left_anti")
        fresh = checkpointed(falls.withColumn("round", F.lit(turn)))
        gone = gone.unionByName(fresh)
    return gone


def standing(facts: DataFrame, justifications: DataFrame, retracted: DataFrame) -> DataFrame:
    """The facts that remain."""
    return facts.join(cascade(facts, justifications, retracted).select("fact_id"), "fact_id", "left_anti")


def inserted(audited: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Facts and justifications that rules inserted (audited: run(audit=True)); key names the column that tells records.

    facts: fact_id (`Type:id`), value, explicit (false where every insertion is logical). justifications: just_id,
    fact_id, premise_id (the record, `record:key`), rule: a logical fact stands while a record stands that it was inserted for.
    """
    rows = audited.select(F.concat(F.lit("record:"), F.col(key).cast("string")).alias("premise_id"), F.explode("inserts").alias("i"))
    rows = rows.select("premise_id", F.concat_ws(":", "i.kind", "i.id").alias("fact_id"), "i.value", "i.rule", "i.logical")
    facts = rows.groupBy("fact_id").agg(F.max("value").alias("value"), F.bool_or(~F.col("logical")).alias("explicit"))
    why = rows.filter("logical").select(F.concat_ws("/", "rule", "premise_id", "fact_id").alias("just_id"), "fact_id", "premise_id", "rule").distinct()
    return facts, why


def premises(justified: DataFrame, facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Justifications from premises by description: (just_id, fact_id, field, value) of patterns meet the facts (premise_id,
    field, value) that are so; justified: just_id that are wanted."""
    return patterns.join(justified, "just_id", "left_semi").join(facts, ["field", "value"]).select("just_id", "fact_id", "premise_id")


def statistics(facts: DataFrame, justifications: DataFrame) -> DataFrame:
    j = justifications.agg(F.count_distinct("just_id").alias("justifications"), F.count_distinct("fact_id").alias("justified"))
    return facts.agg(F.count_if(F.col("explicit")).alias("explicit"), F.count_if(~F.col("explicit")).alias("logical")).crossJoin(j)

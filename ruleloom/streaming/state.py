"""Keyed state: a store over tables, and stateful operators over streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import CatalogError

PART_ROWS = 10_000


class StateTable:
    """key, value (text), created_ms, updated_ms, ttl_ms as a table; every change gives a new one.

    A value lives ttl_ms from when it was created; reads and updates do not prolong it, a new put does.
    """

    DDL = "key string, value string, created_ms long, updated_ms long, ttl_ms long"

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def empty(cls, spark) -> StateTable:
        return cls(spark.createDataFrame([], cls.DDL))

    def live(self, now: int) -> DataFrame:
        return self.df.filter(F.col("ttl_ms").isNull() | (F.col("created_ms") + F.col("ttl_ms") > now))

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        """key, value of the asked keys (key) that are live."""
        return self.live(now).join(keys.select("key").distinct(), "key", "left_semi").select("key", "value")

    def put(self, rows: DataFrame, now: int, ttl_ms: int | None = None) -> StateTable:
        new = rows.select("key", "value").withColumns({"created_ms": F.lit(now), "updated_ms": F.lit(now), "ttl_ms": F.lit(ttl_ms).cast("long")})
        return StateTable(self.df.join(new, "key", "left_anti").unionByName(new))

    def update(self, rows: DataFrame, now: int) -> StateTable:
        """Replaces values of live keys; keys that are missing or over are an error."""
        if not rows.join(self.live(now), "key", "left_anti").isEmpty():
            raise CatalogError("update of keys without state")
        new = rows.select("key", F.col("value").alias("_v"))
        out = self.df.join(new, "key", "left")
        fresh = F.col("_v").isNotNull()
        return StateTable(out.withColumns({"value": F.coalesce("_v", "value"), "updated_ms": F.when(fresh, F.lit(now)).otherwise(F.col("updated_ms"))}).drop("_v"))

    def delete(self, keys: DataFrame) -> StateTable:
        return StateTable(self.df.join(keys, "key", "left_anti"))

    def cleanup(self, now: int) -> StateTable:
        return StateTable(self.live(now))

    def checkpoint(self, path: str, form: str = "parquet") -> None:
        """form: any table format that Spark writes and reads with a schema (parquet, orc, json)."""
        self.df.write.mode("overwrite").format(form).save(path)

    def snapshot(self, root: str, number: int, keep: int = 10) -> str:
        """A numbered checkpoint under root; only the newest `keep` stay."""
        path = f"{root.rstrip('/')}/checkpoint-{number:020d}"
        self.checkpoint(path)
        for old in snapshots(self.df.sparkSession, root)[:-keep]:
            jpath = self.df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            jpath.getFileSystem(self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
        return path

    @classmethod
    def restore(cls, spark, path: str, form: str = "parquet") -> StateTable:
        return cls(spark.read.schema(cls.DDL).format(form).load(path))

    def statistics(self, now: int) -> DataFrame:
        over = F.col("ttl_ms").isNotNull() & (F.col("created_ms") + F.col("ttl_ms") <= now)
        return self.df.agg(F.count(F.lit(1)).alias("entries"), F.count_if(over).alias("expired"))


def snapshots(spark, root: str) -> list[str]:
    """Numbered checkpoints under root, the oldest first."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/checkpoint-*")
    found = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jpath)
    return sorted(f.getPath().toString() for f in found or [])


def stateful_batches(df: DataFrame, key: str, step: Callable[[tuple | None, pd.DataFrame], tuple[tuple, pd.DataFrame]], output: str, held: str, ttl_ms: int | None = None, order: list[str] | None = None) -> DataFrame:
    """step(state of the key or None, its events of a batch) -> (state, rows), over a running stream.

    held: the state's fields, as a DDL. The state lies typed in Spark's state store; a key's events of a batch come in one
    or more parts, each a frame, in any order. With order they come sorted by these columns, nulls last, within and across
    parts (so a key's events of a batch are held in memory); batches come as they arrive. With ttl_ms, state is dropped when
    a key has been idle that long in processing time.
    """

    def in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All sorted, again in parts: one frame of all would be held several times on its way out."""
        given = [x for x in parts if len(x)]
        if not given:
            return
        rows = pd.concat(given, ignore_index=True)
        del given
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        for at in range(0, len(rows), PART_ROWS):
            yield rows.iloc[at : at + PART_ROWS].reset_index(drop=True)

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        for part in in_order(parts) if order else parts:
            if len(part):
                now, rows = step(now, part)
                yield rows
        if now is not None:
            state.update(now)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, output, held, "append", timeout)


def stateful(df: DataFrame, key: str, process: Callable[[dict, dict], dict | None], output: str, ttl_ms: int | None = None) -> DataFrame:
    """process(state of the key, event) -> row or None, for each event of a stream in order of arrival within a batch.

    State is a JSON object per key in Spark's state store (checkpointed, restored after failures); with ttl_ms it is
    dropped when a key has been idle that long in processing time.
    """
    names = [x.split()[0] for x in output.split(",")]

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = []
        for part in parts:
            for event in part.to_dict("records"):
                if (row := process(held, event)) is not None:
                    rows.append(row)
        state.update((json.dumps(held),))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, output, "state string", "append", timeout)

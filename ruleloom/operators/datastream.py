"""A fluent API over event tables; batch tables and `readStream` tables alike."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates
from . import windows


#: Parts of a key that commuting folds are made in.
SALTS = 64


class DataStream:
    """Events with a time column and an id that orders ties; every step is lazy."""

    def __init__(self, df: DataFrame, time: str = "ts", id: str = "event_id"):
        self.df, self.time, self.id = df, time, id

    def _of(self, df: DataFrame) -> DataStream:
        return DataStream(df, self.time, self.id)

    @classmethod
    def from_events(cls, spark, rows: Iterable, schema, **how) -> DataStream:
        return cls(spark.createDataFrame(list(rows), schema), **how)

    def filter(self, predicate: Column | str) -> DataStream:
        return self._of(self.df.filter(predicate))

    def map(self, **columns: Column) -> DataStream:
        return self._of(self.df.withColumns(columns))

    def select(self, *columns) -> DataStream:
        return self._of(self.df.select(*columns))

    def flat_map(self, rows: Column, name: str = "value") -> DataStream:
        """rows: an array column; an event for each element."""
        return self._of(self.df.withColumn(name, F.explode(rows)))

    def union(self, other: DataStream) -> DataStream:
        return self._of(self.df.unionByName(other.df))

    def sort_by(self, *keys) -> DataStream:
        return self._of(self.df.orderBy(*keys, self.id))

    def take(self, n: int) -> DataStream:
        """The first n events by id (arrival)."""
        return self._of(self.df.orderBy(self.id).limit(n))

    def skip(self, n: int) -> DataStream:
        """All but the first n events by id: those beyond the n-th id, so only n ids pass through one task. Ids are unique."""
        if n <= 0:
            return self
        last = self.df.select(self.id).orderBy(self.id).limit(n).agg(F.max(self.id).alias("_last"))
        return self._of(self.df.crossJoin(F.broadcast(last)).filter(F.col(self.id) > F.col("_last")).drop("_last"))  # a single row

    def find(self, predicate: Column | str) -> DataFrame:
        return self.df.filter(predicate).orderBy(self.id).limit(1)

    def any(self, predicate: Column | str) -> DataFrame:
        p = F.expr(predicate) if isinstance(predicate, str) else predicate
        return self.df.agg(F.coalesce(F.bool_or(p), F.lit(False)).alias("value"))

    def all(self, predicate: Column | str) -> DataFrame:
        """True for no events."""
        p = F.expr(predicate) if isinstance(predicate, str) else predicate
        return self.df.agg(F.coalesce(F.bool_and(p), F.lit(True)).alias("value"))

    def for_each(self, handle: Callable[[DataFrame], None]) -> DataStream:
        """Hands the events to a function as a table, at once; a running stream is handed over batch by batch by `sink`."""
        handle(self.df)
        return self

    def sink(self, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
        """Starts a running stream whose batches go to handle(table, number); by default all there is, then it ends."""
        return self.df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def recent(self, n: int) -> DataStream:
        """The newest n events by id (arrival)."""
        return self._of(self.df.orderBy(F.col(self.id).desc()).limit(n))

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def collect(self) -> list:
        return self.df.orderBy(self.id).collect()

    def aggregate(self, **aggs: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in aggs.items()])

    def reduce(self, fold: Callable[[Column, Column], Column], zero: Column, value: Column, by: tuple[str, ...] = (), commutes: bool = False) -> DataFrame:
        """A left fold over a key's values in order of time and id, which gathers them.

        commutes: the fold is associative and commutative and zero its neutral element (sums, minima and the like): values
        are then folded in SALTS parts of a key first, so no task gathers a hot key.
        """
        if commutes:
            salt = F.pmod(F.xxhash64(self.id), F.lit(SALTS)).alias("_salt")
            part = F.aggregate(F.collect_list(value), zero, fold).alias("_part")
            parts = self.df.groupBy(*by, salt).agg(part)
            return parts.groupBy(*by).agg(F.aggregate(F.collect_list("_part"), zero, fold).alias("value"))
        items = F.array_sort(F.collect_list(F.struct(self.time, self.id, value.alias("v"))))
        out = F.aggregate(items, zero, lambda acc, x: fold(acc, x["v"])).alias("value")
        return self.df.groupBy(*by).agg(out)

    def count_by(self, column: str) -> DataFrame:
        """counts: a map of each value (as text, null as "null") and how often it occurs."""
        return self.key_by().count_by(column)

    def key_by(self, *keys: str) -> KeyedStream:
        return KeyedStream(self, keys)

    group_by = key_by

    def tumbling(self, ms: int, *keys: str) -> Windowed:
        return Windowed(windows.tumbling(self.df, self.time, ms), keys, self)

    def sliding(self, ms: int, *keys: str) -> Windowed:
        return Windowed(windows.sliding_anchored(self.df, self.time, ms, keys), keys, self)

    def session(self, ms: int, *keys: str) -> DataFrame:
        return windows.sessions(self.df, self.time, ms, keys)

    def matches(self, event_type: str | None = None, source: str | None = None, **fields) -> DataStream:
        """Events of a type and source whose fields have these values."""
        p = F.lit(True)
        for name, v in (("event_type", event_type), ("source", source), *fields.items()):
            if v is not None:
                p = p & F.coalesce(F.col(name) == v, F.lit(False))
        return self.filter(p)


def json_number(payload: Column, field: str) -> Column:
    """A numeric field of a JSON payload; numbers in quotes do not count."""
    raw, kind = _json(payload, field)
    return F.when(~kind.isin("STRING", "BOOLEAN"), raw.try_cast("double"))


def _json(payload: Column, field: str) -> tuple[Column, Column]:
    """A field of a JSON payload as text, and its kind."""
    parsed = F.try_parse_json(payload)
    return F.try_variant_get(parsed, f"$.{field}", "string"), F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant"))


def json_text(payload: Column, field: str) -> Column:
    """A text field of a JSON payload; null where it is of another kind."""
    raw, kind = _json(payload, field)
    return F.when(kind == "STRING", raw)


def json_flag(payload: Column, field: str) -> Column:
    """A boolean field of a JSON payload; null where it is of another kind."""
    raw, kind = _json(payload, field)
    return F.when(kind == "BOOLEAN", raw.cast("boolean"))


class KeyedStream:
    def __init__(self, stream: DataStream, keys: tuple[str, ...]):
        self.stream, self.keys = stream, keys

    def aggregate(self, **aggs: Column) -> DataFrame:
        return self.stream.df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])

    def count(self) -> DataFrame:
        return self.aggregate(count=F.count(F.lit(1)))

    def count_by(self, column: str) -> DataFrame:
        """keys, counts: a map of each value (as text, null as "null") and how often the key has it. Values are counted
        first, so a key's map is gathered from one row for each distinct value."""
        value = F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("_value")
        per = self.stream.df.groupBy(*self.keys, value).agg(F.count(F.lit(1)).alias("_n"))
        return per.groupBy(*self.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_value", "_n")))).alias("counts"))

    def key_values(self) -> DataFrame:
        return self.stream.df.select(*self.keys).distinct()

    def reduce(self, fold, zero: Column, value: Column, commutes: bool = False) -> DataFrame:
        return self.stream.reduce(fold, zero, value, self.keys, commutes)

    def percentile(self, column: str, p: float, name: str = "value") -> DataFrame:
        """Each key's nearest rank of a column, round(p / 100 * (n - 1)) with halves away from zero: from counts by value
        and their running sum, so that nothing gathers a key's events."""
        x = F.col(column).cast("double")
        per = self.stream.df.filter(x.isNotNull()).groupBy(*self.keys, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
        up, whole = Window.partitionBy(*self.keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*self.keys)
        per = per.withColumns({"_upto": F.sum("_n").over(up), "_all": F.sum("_n").over(whole)})
        rank = F.round(F.lit(p / 100) * (F.col("_all") - 1))
        return per.filter((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)).select(*self.keys, F.col("_x").alias(name))

    def first(self, *columns: str) -> DataFrame:
        """Each key's earliest event, by time and id."""
        return self._end(F.min_by, columns)

    def last(self, *columns: str) -> DataFrame:
        return self._end(F.max_by, columns)

    def _end(self, pick, columns) -> DataFrame:
        order = F.struct(self.stream.time, self.stream.id)
        return self.aggregate(row=pick(F.struct(*columns), order)).select(*self.keys, "row.*")

    def flatten(self) -> DataStream:
        return self.stream


class Windowed:
    """Events with window_start and window_end (ms) for each window they fall in."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...], stream: DataStream):
        self.df, self.keys, self.stream = df, keys, stream

    def aggregate(self, **aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.keys, "window_start", "window_end").agg(*[c.alias(n) for n, c in aggs.items()])

    def counts(self) -> DataFrame:
        return self.aggregate(count=F.count(F.lit(1)))

    def with_max_events(self, n: int) -> Windowed:
        """Only the newest n of each window, by arrival."""
        return Windowed(windows.newest(self.df, [*self.keys, "window_start"], n, self.stream.id), self.keys, self.stream)

    def reduce(self, fold, zero: Column, value: Column, commutes: bool = False) -> DataFrame:
        return DataStream(self.df, self.stream.time, self.stream.id).reduce(fold, zero, value, (*self.keys, "window_start"), commutes)

    def facts(self, *fields: str) -> DataFrame:
        return windows.window_facts(self.df, self.keys, fields)

    def flatten(self) -> DataFrame:
        return self.df


STREAM = aggregates.STREAM

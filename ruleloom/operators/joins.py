"""Joins of facts and of event streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import millis


class Pattern:
    """One pattern of a multi-pattern match: a fact table, tests on its fields, and variables bound to them."""

    def __init__(self, table: DataFrame):
        self.table, self.binds, self.tests = table, {}, []

    def where_field(self, test: Column | str) -> Pattern:
        self.table = self.table.filter(test)
        return self

    def bind(self, **variables: str) -> Pattern:
        """variable = field"""
        self.binds |= variables
        return self

    def where_var(self, field: str, op: str, variable: str) -> Pattern:
        """A test of a field against a variable bound by an earlier pattern."""
        self.tests.append((field, op, variable))
        return self


OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def match_all(*patterns: Pattern) -> DataFrame:
    """Bindings (columns named as variables) of all patterns, joined from the left on tests of bound variables."""
    out = None
    for n, p in enumerate(patterns):
        fields = {v: p.table[f].alias(v) for v, f in p.binds.items()}
        tested = {f"_t{n}_{i}": p.table[f].alias(f"_t{n}_{i}") for i, (f, _, _) in enumerate(p.tests)}
        right = p.table.select(*fields.values(), *tested.values())
        if out is None:
            out = right
            continue
        on = [out[v] == right[v] for v in p.binds if v in out.columns]
        for i, (_, op, v) in enumerate(p.tests):
            if v not in out.columns:
                return out.crossJoin(right).limit(0).drop(*tested)
            on.append(OPS[op](right[f"_t{n}_{i}"], out[v]))
        shared = [v for v in p.binds if v in out.columns]
        new = [c for c in right.columns if c not in shared and c not in tested]
        joined = out.join(right, on, "inner") if on else out.crossJoin(right)
        out = joined.select(*[out[c] for c in out.columns], *[right[c] for c in new])
    return out


def exists(df: DataFrame, table: DataFrame, on: Sequence[Column] | Column) -> DataFrame:
    return df.join(table, on, "left_semi")


def not_exists(df: DataFrame, table: DataFrame, on: Sequence[Column] | Column) -> DataFrame:
    return df.join(table, on, "left_anti")


def forall(df: DataFrame, table: DataFrame, on: Sequence[Column] | Column, holds: Column) -> DataFrame:
    """Rows none of whose partners fails; rows without partners are among them."""
    return df.join(table.filter(~F.coalesce(holds, F.lit(False))), on, "left_anti")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, ms: int, how: str = "inner", condition: Column | None = None, order: str = "within") -> DataFrame:
    """Events of equal keys at most ms apart: columns l_*, r_* and join_ts (the later time).

    order: "within" either way, "before": the left one first, "after": the right one. Null keys meet nothing. The time
    bounds are two range conditions beside the equal keys, so the same join runs on streams with watermarks.

    Over tables, stretches of time as long as ms are part of the equal keys, so a hot key is split: events of one side are
    sent to the two or three stretches that they can meet the other's in, where each pair meets once. The side that an
    outer join keeps is not copied; a full outer join, and streams, are joined on the keys alone.
    """
    one = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    two = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a, b, d = F.col(f"l_{time}"), F.col(f"r_{time}"), F.expr(f"INTERVAL {ms / 1000} SECOND")
    on = F.lit(True)
    split = how in ("inner", "left_outer", "right_outer") and not left.isStreaming and not right.isStreaming and ms > 0
    if split:
        at = lambda c, shift: F.floor((millis(c) + shift * ms) / ms)
        # A left event lies between an interval before the right one and an interval after it.
        back, ahead = (0 if order == "after" else -1), (0 if order == "before" else 1)
        if how == "right_outer":
            one, two = one.withColumn("_at", F.explode(F.sequence(at(a, -ahead), at(a, -back)))), two.withColumn("_meet", at(b, 0))
        else:
            one, two = one.withColumn("_at", at(a, 0)), two.withColumn("_meet", F.explode(F.sequence(at(b, back), at(b, ahead))))
        on = F.col("_at") == F.col("_meet")
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    if order != "after":
        on = on & (b <= a + d)
    if order != "before":
        on = on & (b >= a - d)
    if order == "before":
        on = on & (b > a)
    if order == "after":
        on = on & (b < a)
    if condition is not None:
        on = on & condition
    return one.join(two, on, how).drop("_at", "_meet").withColumn("join_ts", F.greatest(a, b))


def count_window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: int, order: str) -> DataFrame:
    """Each key's newest n events of either side, joined; a batch operation."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    last = lambda df, p: df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n").select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    one, two = last(left, "l"), last(right, "r")
    return one.join(two, [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys])


def chain(streams: dict[str, DataFrame], keys: Sequence[str], time: str, ms: int) -> DataFrame:
    """A join of several streams on equal keys, each event at most ms from the first stream's; columns are prefixed by name."""
    out, first = None, None
    for name, df in streams.items():
        df = df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        if out is None:
            out, first = df, name
            continue
        on = [F.col(f"{first}_{k}") == F.col(f"{name}_{k}") for k in keys]
        gap = millis(F.col(f"{name}_{time}")) - millis(F.col(f"{first}_{time}"))
        out = out.join(df, [*on, gap.between(-ms, ms)])
    return out


class JoinManager:
    """Named joins over named streams. Spark routes events: a stream that several joins name goes to each."""

    def __init__(self):
        self.joins: dict[str, tuple[str, str, dict]] = {}

    def of_stream(self, stream: str) -> list[str]:
        """Joins that a stream's events go to."""
        return [n for n, (a, b, _) in self.joins.items() if stream in (a, b)]

    def statistics(self, streams: dict[str, DataFrame]) -> DataFrame:
        """join, pairs, left_events, right_events (events that are in a pair), one row for each join."""
        out = None
        for n, df in self.run(streams).items():
            of = lambda side: F.struct(*[c for c in df.columns if c.startswith(f"{side}_")])
            both = F.col(f"l_{df.columns[0][2:]}").isNotNull() & F.col([c for c in df.columns if c.startswith("r_")][0]).isNotNull()
            one = df.filter(both).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(F.xxhash64(of("l"))).alias("left_events"), F.count_distinct(F.xxhash64(of("r"))).alias("right_events"))
            one = one.select(F.lit(n).alias("join"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def register(self, name: str, left: str, right: str, **how) -> None:
        self.joins[name] = (left, right, how)

    def unregister(self, name: str) -> None:
        del self.joins[name]

    def run(self, streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {n: interval_join(streams[a], streams[b], **how) for n, (a, b, how) in self.joins.items()}

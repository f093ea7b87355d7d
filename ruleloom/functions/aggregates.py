"""Five families of aggregates that differ in what they give for no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


#: Over streams: counts and sums are doubles, sums of nothing 0, the rest null.
STREAM: dict[str, Callable[[Column], Column]] = {
    "count": lambda c: F.count(F.lit(1)).cast("double"), "sum": lambda c: F.coalesce(F.sum(_d(c)), F.lit(0.0)), "average": lambda c: F.avg(_d(c)), "min": lambda c: F.min(_d(c)), "max": lambda c: F.max(_d(c)),
}


def std_dev(c: Column) -> Column:
    """Population standard deviation; null for fewer than two values."""
    return F.when(F.count(c) >= 2, F.stddev_pop(c))


def percentile(c: Column, p: float) -> Column:
    """Nearest rank: the value at round(p / 100 * (n - 1)), halves away from zero. Gathers a group's values; groups
    are windows or keys, not tables."""
    a = F.array_sort(F.collect_list(_d(c)))
    return F.try_element_at(a, (F.round(F.lit(p / 100) * (F.size(a) - 1)) + 1).cast("int"))


#: Over windows of a stream.
WINDOW: dict[str, Callable] = STREAM | {
    "count_distinct": lambda c: F.count_distinct(c), "std_dev": std_dev, "percentile": percentile,
    "first": lambda value, *order: F.min_by(value, F.struct(*order)), "last": lambda value, *order: F.max_by(value, F.struct(*order)),
}

#: In `accumulate`: nothing counts as 0 everywhere; what is no number is left out, but counted.
ACCUMULATE: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c.try_cast("double")), F.lit(0.0)), "count": lambda c: F.count(c), "average": lambda c: F.coalesce(F.avg(c.try_cast("double")), F.lit(0.0)), "avg": lambda c: F.coalesce(F.avg(c.try_cast("double")), F.lit(0.0)),
    "min": lambda c: F.coalesce(F.min(c.try_cast("double")), F.lit(0.0)), "max": lambda c: F.coalesce(F.max(c.try_cast("double")), F.lit(0.0)), "collect": lambda c: F.collect_list(c),
}

#: In goals: count 0, sum and avg 0.0, the rest null.
GOAL: dict[str, Callable[[Column], Column]] = {
    "count": lambda c: F.count(F.lit(1)), "sum": lambda c: F.coalesce(F.sum(c.try_cast("double")), F.lit(0.0)), "avg": lambda c: F.coalesce(F.avg(c.try_cast("double")), F.lit(0.0)),
    "min": lambda c: F.min(c), "max": lambda c: F.max(c), "first": lambda c: F.min(c), "last": lambda c: F.max(c),
}


def register_stream(name: str, build: Callable[[Column], Column]) -> None:
    """Adds an aggregate for streams and windows; a grouped-aggregate pandas_udf serves as well as built-ins."""
    STREAM[name] = WINDOW[name] = build


def register_accumulate(name: str, build: Callable[[Column], Column]) -> None:
    """Adds a function for `accumulate`; a grouped-aggregate pandas_udf serves as well as built-ins."""
    ACCUMULATE[name] = build

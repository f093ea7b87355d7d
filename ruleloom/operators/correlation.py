"""Stream patterns of the rule language as joins and filters, and rules over what they match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BindError
from ..lang import ir, parser
from ..plans.compiler import Scope, condition
from ..plans.forward import Forward
from .windows import millis


def _split(c) -> tuple[list, list]:
    """Stream patterns and other parts of a conjunction."""
    parts = list(c.parts) if isinstance(c, ir.And) else [c]
    flat = []
    for p in parts:
        flat += list(p.parts) if isinstance(p, ir.And) else [p]
    return [p for p in flat if isinstance(p, ir.StreamPattern)], [p for p in flat if not isinstance(p, ir.StreamPattern)]


def _source(p: ir.StreamPattern, streams: dict[str, DataFrame], time: str, type_column: str) -> DataFrame:
    if p.stream not in streams:
        raise BindError(f"no stream {p.stream!r}")
    df = streams[p.stream]
    if p.type:
        df = df.filter(F.col(type_column) == p.type)
    return df.select(*[F.col(c).alias(f"{p.variable}_{c}") for c in df.columns])


def _near(a: ir.StreamPattern, b: ir.StreamPattern, time: str) -> Column | None:
    """Both in one window: the same one of tumbling windows, or no farther apart than a sliding one is long."""
    spans = [p.window_ms for p in (a, b) if p.window_ms is not None]
    if not spans:
        return None
    ms, x, y = min(spans), millis(F.col(f"{a.variable}_{time}")), millis(F.col(f"{b.variable}_{time}"))
    if "tumbling" in (a.window_kind, b.window_kind):
        return F.floor(x / ms) == F.floor(y / ms)
    return F.abs(x - y) <= ms


def correlate(pattern, streams: dict[str, DataFrame], time: str = "ts", type_column: str = "event_type") -> DataFrame:
    """Matches of a condition with stream patterns: columns <variable>_<field>.

    `a: view from stream("s") over window(10 min, sliding) && b: buy from stream("s") && a.user_id == b.user_id` is an
    equi-join with a time bound; parts that name one pattern only filter it before the join, and the rest filters what
    is joined. A single pattern is a filter.
    """
    c = parser.parse_condition(pattern) if isinstance(pattern, str) else pattern
    patterns, rest = _split(c)
    if not patterns:
        raise BindError("no stream pattern")
    tables = {p.variable: _source(p, streams, time, type_column) for p in patterns}
    roots = lambda x: {q.split(".")[0] for q in ir.paths(x)}
    later = []
    for x in rest:
        own = roots(x)
        if len(own) == 1 and (v := next(iter(own))) in tables:
            tables[v] = tables[v].filter(condition(x, Scope(tables[v].schema)))
        else:
            later.append(x)
    out, seen = tables[patterns[0].variable], [patterns[0]]
    for p in patterns[1:]:
        on, known = [], {q.variable for q in seen}
        for x in list(later):
            simple = isinstance(x, ir.Cmp) and x.op == "==" and isinstance(x.left, ir.Path) and isinstance(x.right, ir.Path)
            if simple and p.variable in roots(x) and roots(x) - {p.variable} <= known:
                on.append(F.col(x.left.name.replace(".", "_")) == F.col(x.right.name.replace(".", "_")))
                later.remove(x)
        if (near := _near(seen[0], p, time)) is not None:
            on.append(near)
        out = out.join(tables[p.variable], on) if on else out.crossJoin(tables[p.variable])
        seen.append(p)
    for x in later:
        out = out.filter(condition(x, Scope(out.schema)))
    return out


def run_rules(rules: list[ir.Rule], streams: dict[str, DataFrame], time: str = "ts", type_column: str = "event_type", **how) -> dict[str, DataFrame]:
    """Rules whose conditions hold stream patterns: for each, its matches with the fields that it sets."""
    out = {}
    for r in rules:
        matches = correlate(r.when, streams, time, type_column)
        patterns, _ = _split(r.when)
        every = ir.Rule(r.name, ir.Cmp("==", ir.Lit(True), ir.Lit(True)), r.then, no_loop=True)
        out[r.name] = Forward([every], roots=("Match",), **how).run(matches)
    return out

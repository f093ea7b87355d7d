"""Backward chaining: goals answered from facts and from what rules derive, as views over tables."""

from __future__ import annotations

import html
import json
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GoalError
from ..functions import aggregates
from ..lang import ir, parser, printer
from .compiler import Scope, condition, expression
from .forward import AUDIT, Forward, checkpointed, reads, writes

MAX_DEPTH = 10
#: Answers that are kept by their goals; the oldest gives way.
MEMO = 64
#: How goals may be asked to be searched. All give the same answers here: a goal is one plan, made of the rules that it
#: depends on up to a depth, which Spark orders as it sees fit.
STRATEGIES = ("depth-first", "breadth-first", "iterative")
OPTIONS = {"strategy", "max-depth", "max-solutions", "enable-memoization", "enable-optimization"}


def candidates(goal, rules: list[ir.Rule], depth: int = MAX_DEPTH) -> list[ir.Rule]:
    """Rules that the goal can depend on: those that write what it reads, and so on, up to a depth."""
    wanted, chosen = {p.rsplit(".", 1)[-1] for p in ir.paths(goal)}, []
    for _ in range(depth):
        new = [r for r in rules if r not in chosen and {p.rsplit(".", 1)[-1] for p in writes(r)} & wanted]
        if not new:
            break
        chosen += new
        wanted |= {p.rsplit(".", 1)[-1] for r in new for p in reads(r)}
    return [r for r in rules if r in chosen]


def static_search(goal: str, rules: list[ir.Rule], depth: int = MAX_DEPTH) -> list[tuple[int, str]]:
    """(layer, rule) of the rules that a goal can depend on, found without running any: layer 1 writes what the goal reads."""
    parsed, out, before = parser.parse_goal(goal), [], set()
    for layer in range(1, depth + 1):
        now = {r.name for r in candidates(parsed, rules, layer)}
        if now == before:
            break
        out += [(layer, r.name) for r in rules if r.name in now - before]
        before = now
    return out


def atoms(c) -> list:
    if isinstance(c, (ir.And, ir.Or)):
        return [a for p in c.parts for a in atoms(p)]
    return [c]


class Backward:
    """Answers goals over a table of records; rules derive fields on demand.

    A goal is a condition; negation is by failure (closed world). A record's base facts count as a solution. Only rules
    that the goal depends on run, so a goal is a slice of the forward program. Answers of a text goal are kept until
    the facts are replaced.
    """

    def __init__(self, rules: list[ir.Rule], facts: DataFrame, roots: tuple[str, ...] = (), **how):
        self.rules, self.roots, self.how = rules, roots, how
        self.replace(facts)

    def replace(self, facts: DataFrame) -> None:
        """Other facts; what was kept of the old ones is let go of."""
        for df in getattr(self, "memo", {}).values():
            df.unpersist()
        self.facts, self.memo, self.hits, self.misses = facts, OrderedDict(), 0, 0

    def statistics(self) -> dict:
        """Answers kept, and how often one was found and not found."""
        return {"kept": len(self.memo), "hits": self.hits, "misses": self.misses}

    def derived(self, goal, depth: int = MAX_DEPTH) -> DataFrame:
        used = candidates(goal, self.rules, depth)
        engine = Forward(used, self.roots, **self.how)
        df = engine.run(self.facts, audit=True) if used else self.facts
        proof = [F.when(F.col(f"`fires_{r.name}`") > 0, F.lit(r.name)) for r in engine.rules] if used else []
        df = df.withColumn("proof", F.array_compact(F.array(*proof)) if proof else F.array().cast("array<string>"))
        return df.drop(*[f"fires_{r.name}" for r in engine.rules], *AUDIT)

    def deepened(self, goal: str, keys: list[str], limit: int = MAX_DEPTH) -> DataFrame:
        """keys, depth: for each record that satisfies the goal, the least number of rule layers that prove it (0: facts).

        Iterative deepening: one plan for each depth that adds rules, up to a limit.
        """
        parsed, out, before = parser.parse_goal(goal), None, None
        for depth in range(limit + 1):
            used = [r.name for r in candidates(parsed, self.rules, depth)]
            if used == before:
                break
            before = used
            found = self.query(parsed, depth).filter("provable").select(*keys, F.lit(depth).alias("depth"))
            out = found if out is None else out.unionByName(found)
        return out.groupBy(*keys).agg(F.min("depth").alias("depth"))

    def query(self, goal: str | object, depth: int = MAX_DEPTH, max_solutions: int | None = None, keep: bool = False) -> DataFrame:
        """All records with provable, proof (rules that fired for it) and missing (atoms of the goal that fail).

        Text goals are remembered: the plan, and with keep=True its rows once they are computed.
        """
        key = (goal, depth, max_solutions) if isinstance(goal, str) else None
        if key in self.memo:
            self.hits += 1
            self.memo.move_to_end(key)
            return self.memo[key]
        self.misses += key is not None
        parsed = parser.parse_goal(goal) if isinstance(goal, str) else goal
        df = self.derived(parsed, depth)
        scope = Scope(df.schema, "backward", self.how.get("functions"))
        failed = [F.when(~condition(a, scope), F.lit(printer.condition(a))) for a in atoms(parsed)]
        out = df.withColumns({"provable": condition(parsed, scope), "missing": F.array_compact(F.array(*failed))})
        if max_solutions is not None:
            out = out.filter("provable").limit(max_solutions)
        if key:
            self.memo[key] = out = out.persist() if keep else out
            while len(self.memo) > MEMO:
                self.memo.popitem(last=False)[1].unpersist()
        return out

    def solutions(self, goal: str | object, **how) -> DataFrame:
        return self.query(goal, **how).filter("provable").drop("provable", "missing")

    def any_of(self, goals: list[str], keys: list[str]) -> DataFrame:
        """Distinct keys of the records that satisfy one of the goals."""
        return self.solutions(ir.Or(tuple(parser.parse_goal(g) for g in goals))).select(*keys).distinct()

    def aggregate(self, text: str, by: list[str] | None = None) -> DataFrame:
        """`fn(?v) WHERE pattern AND filter`: a record binds ?v through `path == ?v`; result in column value."""
        goal = parser.parse_goal(text)
        if not (isinstance(goal, tuple) and goal[0] == "aggregate"):
            raise GoalError(f"no aggregate: {text!r}")
        return self._aggregated(goal, by)

    def _aggregated(self, goal: tuple, by: list[str] | None) -> DataFrame:
        _, function, variable, pattern = goal
        binds = [a for a in atoms(pattern) if isinstance(a, ir.Cmp) and a.op == "==" and isinstance(a.right, ir.Var)]
        bound = {a.right.name: a.left for a in binds}
        rest = tuple(a for a in atoms(pattern) if a not in binds)
        df = self.derived(ir.And(rest + tuple(ir.Cmp("==", x, x) for x in bound.values())))
        scope = Scope(df.schema, "backward", self.how.get("functions"))
        # A filter may name a bound variable.
        rest = tuple(_bind(a, bound) for a in rest)
        df = df.filter(condition(ir.And(rest), scope)) if rest else df
        value = expression(bound[variable], scope) if variable in bound else F.lit(1)
        df = df.filter(value.isNotNull())
        agg = aggregates.GOAL[function](value).alias("value")
        return df.groupBy(*by).agg(agg) if by else df.agg(agg)

    def execute(self, q: ir.Query) -> DataFrame:
        """A query block: its goal, and its actions' assignments as columns where it holds (or fails, or lacks facts).

        An aggregate goal gives one row with column value. Options: max-depth, max-solutions, enable-memoization (rows are
        kept for the same goal), strategy and enable-optimization, which change nothing in what is found; others are errors.
        """
        if unknown := set(q.options) - OPTIONS:
            raise GoalError(f"unknown options {sorted(unknown)}")
        if (strategy := q.options.get("strategy", STRATEGIES[0])) not in STRATEGIES:
            raise GoalError(f"no strategy {strategy!r}")
        if isinstance(q.goal, tuple):
            return self._aggregated(q.goal, None)
        depth = int(q.options.get("max-depth", MAX_DEPTH))
        df = self.query(printer.condition(q.goal), depth, keep=True) if q.options.get("enable-memoization") is True else self.query(q.goal, depth)
        if q.when is not None:
            df = df.filter(condition(q.when, Scope(df.schema, "backward")))
        for flag, actions in ((F.col("provable"), q.on_success), (~F.col("provable"), q.on_failure), (~F.col("provable") & (F.size("missing") > 0), q.on_missing)):
            for a in actions:
                if isinstance(a, ir.Assign):
                    name = a.path.replace(".", "_")
                    old = F.col(name) if name in df.columns else F.lit(None)
                    df = df.withColumn(name, F.when(flag, expression(a.value, Scope(df.schema))).otherwise(old))
        n = q.options.get("max-solutions")
        return df.filter("provable").limit(int(n)) if n else df


    def execute_all(self, text: str) -> dict[str, DataFrame]:
        """The query blocks of a text, by name; one that cannot be read is an error, not left out."""
        return {q.name: self.execute(q) for q in parser.parse_program(text).queries}


def _bind(c, bound: dict):
    if isinstance(c, ir.Var):
        return bound[c.name]
    if isinstance(c, tuple):
        return tuple(_bind(x, bound) for x in c)
    if hasattr(c, "__dataclass_fields__"):
        return type(c)(**{f: _bind(getattr(c, f), bound) for f in c.__dataclass_fields__})
    return c


def conjunction(*patterns: DataFrame) -> DataFrame:
    """Joins tables of bindings (columns named as variables) on the variables they share."""
    out = patterns[0]
    for p in patterns[1:]:
        shared = [c for c in p.columns if c in out.columns]
        out = out.join(p, shared) if shared else out.crossJoin(p)
    return out


def without(bindings: DataFrame, refuted: DataFrame) -> DataFrame:
    """Negation as failure: bindings that match no row of the other table on shared variables."""
    return bindings.join(refuted, [c for c in refuted.columns if c in bindings.columns], "left_anti")


def reachable(edges: DataFrame, source: str, target: str, max_depth: int | None = None) -> DataFrame:
    """source, target, depth: transitive closure, each pair at its least depth; only new pairs are extended each round.

    Rounds go on until no new pair appears; where pairs lie deeper than a given max_depth, that is an error.
    """
    base = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct()
    seen = fresh = checkpointed(base.withColumn("depth", F.lit(1)))
    depth = 1
    while True:
        depth += 1
        step = fresh.select("source", F.col("target").alias("via")).join(base.select(F.col("source").alias("via"), F.col("target")), "via")
        step = step.select("source", "target").distinct().join(seen, ["source", "target"], "left_anti")
        fresh = checkpointed(step.withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise GoalError(f"pairs lie deeper than {max_depth}")
        seen = seen.unionByName(fresh)


def explain(row, goal: str) -> str:
    """A record's answer in words."""
    if row["provable"]:
        return f"{goal} holds" + (f", by {' -> '.join(row['proof'])}" if row["proof"] else ", from facts")
    return f"{goal} fails: {'; '.join(row['missing'])}"


def explained(goal: str) -> Column:
    """explain() as a column over what query() gives."""
    by = F.when(F.size("proof") > 0, F.concat(F.lit(", by "), F.array_join("proof", " -> "))).otherwise(F.lit(", from facts"))
    return F.when(F.col("provable"), F.concat(F.lit(f"{goal} holds"), by)).otherwise(F.concat(F.lit(f"{goal} fails: "), F.array_join("missing", "; ")))


def export_proof(row, goal: str, form: str = "json") -> str:
    """One record's proof as a document: "json", "markdown" or "html"."""
    rules, missing = list(row["proof"]), list(row["missing"])
    if form == "json":
        return json.dumps({"goal": goal, "provable": row["provable"], "rules": rules, "missing": missing})
    title, items = ("Proven by", rules or ["facts"]) if row["provable"] else ("Not proven, lacking", missing)
    if form == "markdown":
        return "\n".join([f"## `{goal}`", "", f"{title}:", "", *[f"{i}. {x}" for i, x in enumerate(items, 1)]])
    if form == "html":
        return f"<h2>{html.escape(goal)}</h2><p>{title}:</p><ol>{''.join(f'<li>{html.escape(x)}</li>' for x in items)}</ol>"
    raise GoalError(f"no form {form!r}")


def proof_edges(df: DataFrame, key: str, rules: list[ir.Rule]) -> DataFrame:
    """key, rule, premise, conclusion: the derivation of each provable record as edges."""
    table = [(r.name, p, w) for r in rules for p in sorted(ir.paths(r.when)) for w in sorted(writes(r))]
    of = df.sparkSession.createDataFrame(table, "rule string, premise string, conclusion string")
    return df.filter("provable").select(key, F.explode("proof").alias("rule")).join(F.broadcast(of), "rule")  # one row per rule and field

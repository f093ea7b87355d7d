"""Knowledge bases, modules, rule templates, workflows, and reports on rules."""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..lang import ir, parser, printer
from .forward import AUDIT, Forward, conflicts, effective, reads, writes


class KnowledgeBase:
    def __init__(self, name: str):
        self.name, self.version, self.rules = name, 0, {}

    def add(self, rule: ir.Rule) -> None:
        if rule.name in self.rules:
            raise CatalogError(f"rule {rule.name!r} exists")
        self.rules[rule.name] = rule
        self.version += 1

    def add_text(self, text: str) -> int:
        rules = parser.parse_rules(text)
        for r in rules:
            self.add(r)
        return len(rules)

    def remove(self, name: str) -> None:
        if self.rules.pop(name, None) is None:
            raise CatalogError(f"no rule {name!r}")
        self.version += 1

    def enable(self, name: str, on: bool = True) -> None:
        self.rules[name].enabled = on

    def get(self, name: str) -> ir.Rule | None:
        return self.rules.get(name)

    def clear(self) -> None:
        self.rules.clear()
        self.version += 1

    def by_salience(self) -> list[ir.Rule]:
        return sorted(self.rules.values(), key=lambda r: -r.salience)

    def statistics(self) -> dict:
        return {"rules": len(self.rules), "enabled": sum(r.enabled for r in self.rules.values()), "version": self.version}

    def export(self) -> str:
        return "\n".join(map(printer.rule, self.by_salience()))


class Modules:
    """Named groups of rules with exports and imports."""

    def __init__(self):
        self.defs: dict[str, ir.ModuleDef] = {"MAIN": ir.ModuleDef("MAIN", "all")}
        self.rules: dict[str, list[str]] = {"MAIN": []}
        self.focus = "MAIN"

    def define(self, m: ir.ModuleDef) -> None:
        if m.name in self.defs and m.name != "MAIN":
            raise CatalogError(f"module {m.name!r} exists")
        self.defs[m.name] = m
        self.rules.setdefault(m.name, [])
        if self._cycle(m.name):
            del self.defs[m.name]
            raise CatalogError(f"module {m.name!r} imports itself")

    def _cycle(self, start: str) -> bool:
        seen, todo = set(), [s for s, _ in self.defs[start].imports]
        while todo:
            n = todo.pop()
            if n == start:
                return True
            if n in self.defs and n not in seen:
                seen.add(n)
                todo += [s for s, _ in self.defs[n].imports]
        return False

    def add_rule(self, module: str, rule: str) -> None:
        if module not in self.defs:
            raise CatalogError(f"no module {module!r}")
        self.rules[module].append(rule)

    def exported(self, module: str) -> list[str]:
        e, own = self.defs[module].export, self.rules[module]
        names = own + [r for s, items in self.defs[module].imports for r in self.exported(s) if any(k == "reexport" for k, _ in items)]
        if e == "all":
            return names
        return [] if e == "none" else [r for r in names if any(fnmatch.fnmatch(r, p) for p in ([e] if isinstance(e, str) else e))]

    def visible(self, module: str) -> list[str]:
        """A module's own rules and those it imports of what others export."""
        out = list(self.rules[module])
        for source, items in self.defs[module].imports:
            if source not in self.defs:
                raise CatalogError(f"no module {source!r}")
            out += [r for r in self.exported(source) if any(k in ("rules", "reexport") and fnmatch.fnmatch(r, p) for k, p in items)]
        return list(dict.fromkeys(out))

    def validate(self) -> list[str]:
        return [f"{m} imports missing {s}" for m, d in self.defs.items() for s, _ in d.imports if s not in self.defs]


class RuleTemplate:
    """Rule text with {{parameters}}."""

    def __init__(self, text: str, defaults: dict | None = None):
        self.text, self.defaults = text, defaults or {}
        self.parameters = sorted(set(re.findall(r"\{\{(\w+)\}\}", text)))

    def build(self, **values) -> list[ir.Rule]:
        given = self.defaults | values
        if missing := [p for p in self.parameters if p not in given]:
            raise CatalogError(f"no value for {missing}")
        return parser.parse_rules(re.sub(r"\{\{(\w+)\}\}", lambda m: str(given[m[1]]), self.text))

    def bulk(self, many: list[dict]) -> list[ir.Rule]:
        return [r for v in many for r in self.build(**v)]

    def to_json(self) -> str:
        return json.dumps({"text": self.text, "defaults": self.defaults})

    @classmethod
    def from_json(cls, text: str) -> RuleTemplate:
        return cls(**json.loads(text))


@dataclass
class Plugin:
    """Functions for conditions and handlers for actions under a name and version."""

    name: str
    version: str = "1"
    functions: dict[str, Callable] = field(default_factory=dict)
    handlers: dict[str, Callable] = field(default_factory=dict)
    needs: tuple[str, ...] = ()


class Plugins:
    """Loaded plugins; what they hold goes to Forward as `Forward(rules, **plugins.parts())`."""

    def __init__(self, limit: int = 50):
        self.limit, self.loaded = limit, {}

    def load(self, plugin: Plugin) -> None:
        if plugin.name in self.loaded:
            raise CatalogError(f"plugin {plugin.name!r} is loaded")
        if len(self.loaded) >= self.limit:
            raise CatalogError(f"more than {self.limit} plugins")
        if lacking := [n for n in plugin.needs if n not in self.loaded]:
            raise CatalogError(f"plugin {plugin.name!r} needs {lacking}")
        self.loaded[plugin.name] = plugin

    def unload(self, name: str) -> None:
        if name not in self.loaded:
            raise CatalogError(f"no plugin {name!r}")
        if users := [p.name for p in self.loaded.values() if name in p.needs]:
            raise CatalogError(f"plugin {name!r} is needed by {users}")
        del self.loaded[name]

    def reload(self, plugin: Plugin) -> None:
        """Takes the place of the plugin of the same name."""
        if plugin.name not in self.loaded:
            raise CatalogError(f"no plugin {plugin.name!r}")
        self.loaded[plugin.name] = plugin

    def parts(self) -> dict[str, dict[str, Callable]]:
        out: dict = {"functions": {}, "handlers": {}}
        for p in self.loaded.values():
            out["functions"] |= p.functions
            out["handlers"] |= p.handlers
        return out


def run_workflow(engine: Forward, df: DataFrame, steps: list[str], as_of: dt.datetime | None = None, max_cycles: int = 100) -> tuple[DataFrame, list[str]]:
    """Agenda groups one after the other, up to the first in which nothing fires; the table, and the steps that fired."""
    done = []
    for s in steps:
        part = Forward([r for r in engine.rules if r.agenda_group == s], engine.roots, engine.facts, engine.functions, engine.handlers, engine.missing)
        out = part.run(df, as_of, max_cycles, agenda=s, audit=True)
        flags = [c for c in out.columns if c.startswith("fires_")]
        if out.filter(" or ".join(f"`{c}` > 0" for c in flags)).isEmpty() if flags else True:
            break
        df = out.select(*[c for c in out.columns if c not in flags and c not in AUDIT and not c.startswith("retracted_")])
        done.append(s)
    return df, done


def rule_metrics(audited: DataFrame) -> DataFrame:
    """rule, fires (in all), records (on which it fired) of a table made with audit=True; one pass."""
    flags = [c for c in audited.columns if c.startswith("fires_")]
    one = audited.agg(*[F.struct(F.sum(f"`{c}`").alias("fires"), F.count_if(F.col(f"`{c}`") > 0).alias("records")).alias(c[6:]) for c in flags])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c[6:]).alias("rule"), F.col(f"`{c[6:]}`.fires"), F.col(f"`{c[6:]}`.records")) for c in flags])).alias("m")).select("m.*")


def profile(engine: Forward, df: DataFrame, fraction: float = 1.0, seed: int = 0, as_of: dt.datetime | None = None) -> DataFrame:
    """rule, records (on which its condition holds), ms (to evaluate it alone), over a share of the rows: a job a rule."""
    if fraction < 1:
        df = df.sample(fraction, seed)
    rows = []
    for r in engine.rules:
        if not effective(r, as_of):
            continue
        alone = Forward([r], engine.roots, engine.facts, engine.functions, engine.handlers, engine.missing)
        start = time.monotonic()
        n = alone.matches(df, r).count()
        rows.append((r.name, n, (time.monotonic() - start) * 1000))
    return df.sparkSession.createDataFrame(rows, "rule string, records long, ms double")


def slowest(profiled: DataFrame, k: int) -> DataFrame:
    return profiled.orderBy(F.desc("ms"), "rule").limit(k)


def most_fired(audited: DataFrame, k: int) -> DataFrame:
    return rule_metrics(audited).orderBy(F.desc("fires"), "rule").limit(k)


def recommendations(metrics: DataFrame, records: int) -> DataFrame:
    """rule, advice for rules that never fire, that fire on every record, or that fire again and again on the same ones."""
    share = F.col("records") / F.lit(max(records, 1))
    advice = F.when(F.col("fires") == 0, "never fires").when(share >= 1, "fires on every record").when(F.col("fires") > 5 * F.col("records"), "fires repeatedly: is no-loop missing?")
    return metrics.select("rule", advice.alias("advice")).filter("advice is not null")


class CachedAggregates:
    """Rows of small aggregates, kept on the driver for a time by name."""

    def __init__(self, ttl_s: float, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl_s, clock, {}

    def get(self, name: str, build: Callable[[], DataFrame]):
        """The single row of build(), computed again once it is older than the time to live."""
        at, row = self.held.get(name, (None, None))
        if at is None or self.clock() - at >= self.ttl:
            at, row = self.clock(), build().first()
            self.held[name] = (at, row)
        return row


def dependency_report(rules: list[ir.Rule]) -> list[tuple[str, str, list[str]]]:
    """Pairs of rules of equal salience that touch each other's fields."""
    return [(a.name, b.name, sorted(c)) for i, a in enumerate(rules) for b in rules[i + 1 :] if a.salience == b.salience and (c := conflicts(a, b))]


def _beside(v) -> list:
    """Values next to a bound on both sides; text gets a longer one, as no text lies between."""
    if isinstance(v, bool):
        return [not v]
    if isinstance(v, (int, float)):
        return [v - 1, v + 1]
    return [f"{v}~"] if isinstance(v, str) else [None]


def coverage_facts(rule: ir.Rule) -> list[dict]:
    """Facts at the bounds of a rule's comparisons: for each, a record at the bound and records just beside it."""
    out = []

    def walk(c):
        if isinstance(c, (ir.And, ir.Or)):
            for p in c.parts:
                walk(p)
        elif isinstance(c, ir.Not):
            walk(c.part)
        elif isinstance(c, ir.Cmp) and isinstance(c.left, ir.Path) and isinstance(c.right, ir.Lit):
            out.extend({c.left.name: v} for v in (c.right.value, *_beside(c.right.value)))

    walk(rule.when)
    return out


def affected(rules: list[ir.Rule], kind: str) -> list[ir.Rule]:
    """Rules that read a fact type."""
    return [r for r in rules if any(p.split(".")[0] == kind for p in reads(r) | writes(r))]


STRATEGIES = {
    "salience": lambda r, i: (-r.salience, i), "depth": lambda r, i: (-r.salience, -i), "breadth": lambda r, i: (-r.salience, i), "lex": lambda r, i: (-r.salience, -i, -len(ir.paths(r.when))),
    "mea": lambda r, i: (-r.salience, min(ir.paths(r.when), default=""), -i), "simplicity": lambda r, i: (-r.salience, len(ir.paths(r.when)), i), "complexity": lambda r, i: (-r.salience, -len(ir.paths(r.when)), i),
}


def ordered(rules: list[ir.Rule], strategy: str = "salience", seed: int = 0) -> list[ir.Rule]:
    """Activation order; a later rule is the more recent one. "random" shuffles rules of equal salience, alike for a seed."""
    if strategy == "random":
        return sorted(random.Random(seed).sample(rules, len(rules)), key=lambda r: -r.salience)
    return [r for _, r in sorted(enumerate(rules), key=lambda x: STRATEGIES[strategy](x[1], x[0]))]

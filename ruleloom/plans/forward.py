"""Forward chaining: rules as guarded updates of every row of a table, in order of salience, until nothing fires."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError
from ..functions import aggregates, library
from ..lang import ir
from ..storage import table
from .compiler import Scope, condition, expression

MAX_CYCLES = 100
HIDDEN = "_rl_"
#: Columns that audit=True adds beside fires_<rule> and retracted_<type>.
AUDIT = ("log", "agenda", "workflow", "scheduled", "timers", "inserts")
TIMERS, INSERTS = "array<struct<ms:bigint,rule:string>>", "array<struct<kind:string,id:string,value:string,rule:string,logical:boolean>>"


def parse_time(s: str) -> dt.datetime:
    for f in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d-%b-%Y", "%d/%m/%Y"):
        try:
            return dt.datetime.strptime(s, f)
        except ValueError:
            continue
    raise BindError(f"no date: {s!r}")


def effective(r: ir.Rule, as_of: dt.datetime | None) -> bool:
    """Enabled, and in [effective, expires) at that time."""
    if not r.enabled:
        return False
    now = as_of or dt.datetime.now()
    return not (r.date_effective and now < parse_time(r.date_effective)) and not (r.date_expires and now >= parse_time(r.date_expires))


def writes(r: ir.Rule) -> set[str]:
    out = set()
    for a in r.then:
        if isinstance(a, (ir.Assign, ir.Append)):
            out.add(a.path)
        elif isinstance(a, ir.Retract):
            out.add(f"{HIDDEN}retracted_{a.target}")
        elif isinstance(a, ir.Method):
            out.add(f"{a.target}.{a.name[3:]}" if a.name.startswith("set") else a.target)
        elif isinstance(a, ir.Do):
            out |= {x.name for x in a.args if isinstance(x, ir.Path)} | {f"{HIDDEN}{a.name}"}
    return out


def reads(r: ir.Rule) -> set[str]:
    values = [a.value for a in r.then if isinstance(a, (ir.Assign, ir.Append))] + [x for a in r.then if isinstance(a, (ir.Method, ir.Do)) for x in a.args]
    return ir.paths(r.when) | ir.paths(values) | {a.path for a in r.then if isinstance(a, ir.Append)} | {f"{HIDDEN}retracted_{p.split('.')[0]}" for p in ir.paths(r.when)}


def _tail(paths: set[str]) -> set[str]:
    return {p.rsplit(".", 1)[-1] for p in paths}


def conflicts(a: ir.Rule, b: ir.Rule) -> set[str]:
    """Fields that one of two rules writes and the other reads or writes, by their last names."""
    return (_tail(writes(a)) & (_tail(writes(b)) | _tail(reads(b)))) | (_tail(writes(b)) & _tail(reads(a)))


def fused(rules: list[ir.Rule]) -> list[list[ir.Rule]]:
    """Runs of rules, in order, that can share one projection: none reads or writes what an earlier one of its run writes."""
    out: list[list[ir.Rule]] = []
    for r in rules:
        run = out[-1] if out else None
        simple = not any(isinstance(a, (ir.Do, ir.Retract)) for a in r.then) and not r.activation_group and not r.agenda_group
        if run and simple and all(not any(isinstance(a, (ir.Do, ir.Retract)) for a in x.then) and not x.activation_group and not x.agenda_group and not (_tail(writes(x)) & (_tail(reads(r)) | _tail(writes(r)))) for x in run):
            run.append(r)
        else:
            out.append([r])
    return out


def settles_at_once(rules: list[ir.Rule]) -> bool:
    """Whether a second cycle can change nothing: every rule is no-loop, and none reads what it or a later rule writes."""
    if any(not r.no_loop or r.agenda_group for r in rules):
        return False
    return not any(_tail(reads(r)) & _tail(writes(x)) for i, r in enumerate(rules) for x in rules[i:])


def plain(rules: list[ir.Rule]) -> bool:
    """Whether all that rules do is set and append fields: nothing else has to be remembered of a firing."""
    return not any(
        r.activation_group or r.agenda_group or r.lock_on_active or isinstance(a, (ir.Retract, ir.Log))
        or isinstance(a, ir.Do) and a.name != "set" and a.name not in library.ACTIONS or isinstance(a, ir.Method) and not a.name.startswith("set")
        for r in rules for a in r.then
    )


class Forward:
    """Runs rules over a table whose rows are fact records.

    roots: names by which rules mean the row itself (`Order.total` is then column total). facts: tables of other fact
    types for exists, forall and accumulate, either a DataFrame or (DataFrame, {its column: the row's column}) for the
    rows that belong to a record. ruleflow: the groups that are under way; rules of others take no part. handlers: name -> (df, fired column, arguments as columns, paths) -> df.
    """

    def __init__(self, rules: list[ir.Rule], roots: tuple[str, ...] = (), facts: dict | None = None, functions: dict | None = None, handlers: dict[str, Callable] | None = None, missing: str = "native", fuse: bool = True, ruleflow: tuple[str, ...] = ()):
        rules = [r for r in rules if r.ruleflow_group is None or r.ruleflow_group in ruleflow]
        self.rules = [r for _, r in sorted(enumerate(rules), key=lambda x: (-x[1].salience, x[0]))]
        self.roots, self.facts, self.functions, self.handlers, self.missing, self.fuse = roots, facts or {}, functions, handlers or {}, missing, fuse

    # -- conditions over other tables

    def _related(self, df: DataFrame, kind: str, column: Column, name: str, nothing) -> DataFrame:
        """Adds an aggregate over a fact type's rows: one value, or one for each record's own rows."""
        table, on = self.facts[kind] if isinstance(self.facts[kind], tuple) else (self.facts[kind], None)
        if on is None:
            return df.crossJoin(F.broadcast(table.agg(F.coalesce(column, F.lit(nothing)).alias(name))))  # a single row
        keys = {k: f"{name}_{i}" for i, k in enumerate(on)}
        per = table.groupBy(*[F.col(k).alias(v) for k, v in keys.items()]).agg(column.alias(name))
        out = df.join(per, [df[own] == per[keys[k]] for k, own in on.items()], "left").drop(*keys.values())
        return out.withColumn(name, F.coalesce(F.col(name), F.lit(nothing)))

    def _prepare(self, df: DataFrame, c, made: dict) -> tuple[DataFrame, object]:
        """Replaces quantifiers and accumulations by columns of df."""
        if isinstance(c, (ir.And, ir.Or)):
            parts = []
            for p in c.parts:
                df, p = self._prepare(df, p, made)
                parts.append(p)
            return df, type(c)(tuple(parts))
        if isinstance(c, ir.Not):
            df, p = self._prepare(df, c.part, made)
            return df, ir.Not(p)
        if isinstance(c, ir.Quantified):
            kind = sorted(p.split(".")[0] for p in ir.paths(c.part))[0]
            if kind in self.facts:
                name = made.setdefault(c, f"{HIDDEN}q{len(made)}")
                if name not in df.columns:
                    table = self.facts[kind][0] if isinstance(self.facts[kind], tuple) else self.facts[kind]
                    holds = condition(c.part, Scope(table.schema, self.missing, self.functions))
                    df = self._related(df, kind, (F.bool_or if c.kind == "exists" else F.bool_and)(holds), name, c.kind == "forall")
                return df, ir.Cmp("==", ir.Path(name), ir.Lit(True))
            # Instances of a type are the record's structs whose names start with it.
            same = [f.name for f in df.schema if f.name.startswith(kind) and isinstance(f.dataType, T.StructType)]
            parts = tuple(_renamed(c.part, kind, s) for s in same)
            if not parts:
                return df, ir.Cmp("==", ir.Lit(c.kind == "forall"), ir.Lit(True))
            return df, (ir.Or if c.kind == "exists" else ir.And)(parts)
        if isinstance(c, ir.Accumulate):
            name = f"{c.type}_{c.function}"
            if name not in df.columns:
                table = self.facts[c.type][0] if isinstance(self.facts[c.type], tuple) else self.facts[c.type]
                scope = Scope(table.schema, self.missing, self.functions)
                keep = condition(ir.And(c.conditions), scope) if c.conditions else F.lit(True)
                value = scope.column(c.field) if c.field else F.lit(1)
                agg = aggregates.ACCUMULATE[c.function](F.when(keep, value))
                df = self._related(df, c.type, agg, name, 0 if c.function == "count" else 0.0)
            return df, ir.Cmp("==", ir.Lit(True), ir.Lit(True))
        return df, c

    # -- effects

    def _target(self, path: str, schema: T.StructType) -> tuple[str, str | None]:
        """Column, and field within it if the column is a struct."""
        root, _, rest = path.partition(".")
        if rest and root in self.roots:
            return rest.replace(".", "_"), None
        if not rest:
            return path, None
        if root in schema.names and not isinstance(schema[root].dataType, T.StructType):
            return path.replace(".", "_"), None
        return root, rest

    def _set(self, changes: dict[str, Column], schema: T.StructType, path: str, fired: Column, value: Column) -> None:
        column, field = self._target(path, schema)
        scope = Scope(schema)
        if field is None:
            if column in schema.names:
                old = changes.get(column, F.col(f"`{column}`"))
                changes[column] = F.when(fired, value.cast(schema[column].dataType)).otherwise(old)
            else:
                changes[column] = F.when(fired, value).otherwise(changes.get(column, F.lit(None)))
        elif column in schema.names or column in changes:
            old = changes.get(column, F.col(f"`{column}`"))
            kind = scope.type(path)
            new = F.when(fired, value.cast(kind) if kind is not None else value)
            changes[column] = old.withField(field, new.otherwise(old.getField(field)) if kind is not None else new)
        else:
            changes[column] = F.struct(F.when(fired, value).alias(field))

    def _effect(self, df: DataFrame, rules: list[tuple[ir.Rule, str | Column]]) -> DataFrame:
        """Effects of fired rules that do not touch each other, as one projection. A rule comes with the column, or its name,
        that tells where it fired (handlers need the name)."""
        changes: dict[str, Column] = {}
        schema = df.schema
        scope = Scope(schema, self.missing, self.functions)
        later: list[tuple[Callable, str, tuple]] = []
        for r, flag in rules:
            fired, before = F.col(flag) if isinstance(flag, str) else flag, set(changes)
            for a in r.then:
                # Later statements of a rule see what earlier ones wrote.
                own = {c: v for c, v in changes.items() if c not in before}
                scope.replaced = {**own, **{f"{root}.{c}": v for root in self.roots for c, v in own.items()}}
                if isinstance(a, ir.Assign):
                    self._set(changes, schema, a.path, fired, expression(a.value, scope))
                elif isinstance(a, ir.Append):
                    old, item = scope.column(a.path), F.array(expression(a.value, scope))
                    self._set(changes, schema, a.path, fired, item if old is None else F.concat(F.coalesce(old, F.slice(item, 1, 0)), item))
                elif isinstance(a, ir.Retract):
                    changes[f"{HIDDEN}retracted_{a.target}"] = fired | changes.get(f"{HIDDEN}retracted_{a.target}", F.col(f"{HIDDEN}retracted_{a.target}"))
                elif isinstance(a, ir.Log):
                    old = changes.get(f"{HIDDEN}log", F.col(f"{HIDDEN}log"))
                    changes[f"{HIDDEN}log"] = F.when(fired, F.array_append(old, expression(a.message, scope).cast("string"))).otherwise(old)
                elif isinstance(a, ir.Method):
                    if a.name.startswith("set") and a.args:
                        self._set(changes, schema, f"{a.target}.{a.name[3:]}", fired, expression(a.args[0], scope))
                    elif a.name in self.handlers:
                        later.append((self.handlers[a.name], flag, a.args))
                elif a.name == "set" and a.name not in self.handlers:
                    self._set(changes, schema, a.args[0].name, fired, expression(a.args[1], scope))
                elif a.name == "ActivateAgendaGroup":
                    # The group in focus goes below the new one, and comes back when nothing of that fires.
                    old, stack = (changes.get(c, F.col(c)) for c in (f"{HIDDEN}agenda", f"{HIDDEN}focus"))
                    changes[f"{HIDDEN}agenda"] = F.when(fired, expression(a.args[0], scope)).otherwise(old)
                    changes[f"{HIDDEN}focus"] = F.when(fired, F.array_append(stack, old)).otherwise(stack)
                    for i, x in enumerate(self.rules):
                        if x.lock_on_active:
                            changes[f"{HIDDEN}lock{i}"] = ~fired & changes.get(f"{HIDDEN}lock{i}", F.col(f"{HIDDEN}lock{i}"))
                elif a.name == "ScheduleRule":
                    old = changes.get(f"{HIDDEN}scheduled", F.col(f"{HIDDEN}scheduled"))
                    name = expression(a.args[1], scope).cast("string")
                    changes[f"{HIDDEN}scheduled"] = F.when(fired, F.array_append(old, name)).otherwise(old)
                    timers = changes.get(f"{HIDDEN}timers", F.col(f"{HIDDEN}timers"))
                    timer = F.struct(expression(a.args[0], scope).cast("long").alias("ms"), name.alias("rule"))
                    changes[f"{HIDDEN}timers"] = F.when(fired, F.array_append(timers, timer)).otherwise(timers)
                elif a.name in ("Insert", "InsertLogical"):
                    old = changes.get(f"{HIDDEN}inserts", F.col(f"{HIDDEN}inserts"))
                    kind, id_, value = [*(expression(x, scope).cast("string") for x in a.args), F.lit(None).cast("string")][:3]
                    fact = F.struct(kind.alias("kind"), id_.alias("id"), value.alias("value"), F.lit(r.name).alias("rule"), F.lit(a.name == "InsertLogical").alias("logical"))
                    changes[f"{HIDDEN}inserts"] = F.when(fired, F.array_append(old, fact)).otherwise(old)
                elif a.name in ("CompleteWorkflow", "SetWorkflowData"):
                    old = changes.get(f"{HIDDEN}workflow", F.col(f"{HIDDEN}workflow"))
                    key, value = (F.concat(expression(a.args[0], scope), F.lit(".complete")), F.lit("true")) if a.name == "CompleteWorkflow" else (expression(a.args[0], scope), expression(a.args[1], scope).cast("string"))
                    changes[f"{HIDDEN}workflow"] = F.when(fired, library.object_merge(old, F.create_map(key, value))).otherwise(old)
                elif a.name in self.handlers:
                    later.append((self.handlers[a.name], flag, a.args))
                elif a.name in library.ACTIONS:
                    *given, out = a.args
                    given = [x.value if i in library.PLAIN.get(a.name, ()) and isinstance(x, ir.Lit) else expression(x, scope) for i, x in enumerate(given)]
                    self._set(changes, schema, out.name, fired, library.ACTIONS[a.name](*given))
                else:
                    raise BindError(f"no handler for action {a.name!r}")
        df = df.withColumns(changes) if changes else df
        for handler, flag, args in later:
            scope = Scope(df.schema, self.missing, self.functions)
            df = handler(df, flag, [expression(x, scope) for x in args], [getattr(x, "name", None) for x in args])
        return df

    def matches(self, df: DataFrame, rule: ir.Rule) -> DataFrame:
        """Rows on which a rule's condition holds."""
        prepared, c = self._prepare(df, rule.when, {})
        return prepared.filter(condition(c, Scope(prepared.schema, self.missing, self.functions))).select(*[F.col(f"`{x}`") for x in df.columns])

    # -- cycles

    def start(self, df: DataFrame, agenda: str = "MAIN") -> DataFrame:
        hidden = {f"{HIDDEN}n{i}": F.lit(0) for i in range(len(self.rules))}
        hidden |= {f"{HIDDEN}lock{i}": F.lit(False) for i, r in enumerate(self.rules) if r.lock_on_active}
        hidden |= {f"{HIDDEN}retracted_{a.target}": F.lit(False) for r in self.rules for a in r.then if isinstance(a, ir.Retract)}
        text = F.array().cast("array<string>")
        hidden |= {f"{HIDDEN}focus": text, f"{HIDDEN}timers": F.array().cast(TIMERS), f"{HIDDEN}inserts": F.array().cast(INSERTS)}
        hidden |= {f"{HIDDEN}agenda": F.lit(agenda), f"{HIDDEN}log": text, f"{HIDDEN}scheduled": text, f"{HIDDEN}workflow": F.map_from_arrays(text, text)}
        return df.withColumns(hidden)

    def once(self, df: DataFrame, rules: list[ir.Rule]) -> DataFrame:
        """One pass over plain rules, with nothing remembered: a projection for each run of them."""
        made: dict = {}
        for run in fused(rules) if self.fuse else [[r] for r in rules]:
            conditions = []
            for r in run:
                df, c = self._prepare(df, r.when, made)
                conditions.append(c)
            scope = Scope(df.schema, self.missing, self.functions)
            df = self._effect(df, [(r, condition(c, scope)) for r, c in zip(run, conditions)])
        return df.drop(*made.values())

    def cycle(self, df: DataFrame, as_of: dt.datetime | None = None, guards: dict[str, Column] | None = None) -> DataFrame:
        """One pass over the rules; later ones see what earlier ones wrote. Adds `_rl_fired`: whether any fired.

        guards: only rules named there fire, and only where the guard holds, whatever group is in focus.
        """
        made: dict = {}
        active = [r for r in self.rules if effective(r, as_of)]
        flags, used = [], set()
        for run in fused(active) if self.fuse else [[r] for r in active]:
            conditions = []
            for r in run:
                df, c = self._prepare(df, r.when, made)
                conditions.append(c)
            scope, fired, ran = Scope(df.schema, self.missing, self.functions), {}, []
            for r, c in zip(run, conditions):
                i = self.rules.index(r)
                on = condition(c, scope)
                if r.no_loop:
                    on = on & (F.col(f"{HIDDEN}n{i}") == 0)
                if r.lock_on_active:
                    on = on & ~F.col(f"{HIDDEN}lock{i}")
                if guards is None:
                    on = on & (F.col(f"{HIDDEN}agenda") == (r.agenda_group or "MAIN"))
                else:
                    on = on & guards.get(r.name, F.lit(False))
                for t in {p.split(".")[0] for p in ir.paths(r.when)}:
                    if f"{HIDDEN}retracted_{t}" in df.columns:
                        on = on & ~F.col(f"{HIDDEN}retracted_{t}")
                if r.activation_group and r.activation_group in used:
                    on = on & ~F.col(f"{HIDDEN}group_{r.activation_group}")
                fired[f"{HIDDEN}f{i}"] = on
                ran.append((r, f"{HIDDEN}f{i}"))
            df = self._effect(df.withColumns(fired), ran)
            after = {}
            for r, flag in ran:
                i = self.rules.index(r)
                after[f"{HIDDEN}n{i}"] = F.col(f"{HIDDEN}n{i}") + F.col(flag).cast("int")
                if r.lock_on_active:
                    after[f"{HIDDEN}lock{i}"] = F.col(f"{HIDDEN}lock{i}") | F.col(flag)
                if r.activation_group:
                    name = f"{HIDDEN}group_{r.activation_group}"
                    after[name] = (F.col(name) | F.col(flag)) if r.activation_group in used else F.col(flag)
                    used.add(r.activation_group)
                flags.append(flag)
            df = df.withColumns(after)
        any_fired = F.lit(False)
        for f in flags:
            any_fired = any_fired | F.col(f)
        df = df.withColumn(f"{HIDDEN}fired", any_fired)
        return df.drop(*flags, *made.values(), *[f"{HIDDEN}group_{g}" for g in used])

    def run(self, df: DataFrame, as_of: dt.datetime | None = None, max_cycles: int = MAX_CYCLES, agenda: str = "MAIN", audit: bool = False) -> DataFrame:
        """df after all cycles. audit: keeps fires_<rule> (times it fired on the row), log, agenda and retracted_<type>.

        Rules that cannot see each other's writes a cycle later need one cycle and no job; if they only set fields and
        nothing is audited, that is a projection without flags or counters. Otherwise each cycle's table is written to the
        shared folder (lineage does not grow), and only rows on which a rule fired go on to the next cycle: the others
        are as they will stay, as rules see nothing but their row and tables that do not change. Handlers may look at
        other rows, so with handlers all rows go on. Where nothing of the group in focus fires, the group below it
        comes back into focus.
        """
        active = [r for r in self.rules if effective(r, as_of)]
        at_once = settles_at_once(active)
        if at_once and not audit and not self.handlers and agenda == "MAIN" and plain(active):
            out = self.once(df, active)
            return out.select(*[F.col(f"`{c}`") for c in out.columns if not c.startswith(HIDDEN)])
        now = self.start(df, agenda)
        if at_once:
            now = self.cycle(now, as_of)
        else:
            done = []
            for _ in range(max_cycles):
                now = table(self._refocus(self.cycle(now, as_of)), "cycle")
                fired = now.filter(f"{HIDDEN}fired")
                if not self.handlers:
                    done.append(now.filter(f"not {HIDDEN}fired"))
                    now = fired
                if fired.isEmpty():
                    break
            for part in done:
                now = now.unionByName(part, allowMissingColumns=True)
        keep = [c for c in now.columns if not c.startswith(HIDDEN)]
        out = [F.col(f"`{c}`") for c in keep]
        if audit:
            out += [F.col(f"{HIDDEN}n{i}").alias(f"fires_{r.name}") for i, r in enumerate(self.rules)]
            out += [F.col(f"{HIDDEN}{c}").alias(c) for c in AUDIT]
            out += [F.col(c).alias(c[len(HIDDEN) :]) for c in now.columns if c.startswith(f"{HIDDEN}retracted_")]
        return now.select(*out)

    def _refocus(self, df: DataFrame) -> DataFrame:
        """Rows on which nothing fired go back to the group that was in focus before, and on to another cycle."""
        if not any(isinstance(a, ir.Do) and a.name == "ActivateAgendaGroup" for r in self.rules for a in r.then):
            return df
        back = ~F.col(f"{HIDDEN}fired") & (F.size(f"{HIDDEN}focus") > 0)
        stack, top = F.col(f"{HIDDEN}focus"), F.element_at(f"{HIDDEN}focus", -1)
        return df.withColumns(
            {
                f"{HIDDEN}agenda": F.when(back, top).otherwise(F.col(f"{HIDDEN}agenda")),
                f"{HIDDEN}focus": F.when(back, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack),
                f"{HIDDEN}fired": F.col(f"{HIDDEN}fired") | back,
            }
        )

    def due(self, audited: DataFrame, elapsed_ms: int, as_of: dt.datetime | None = None) -> DataFrame:
        """Runs the rules that ScheduleRule(ms, rule) put off by no more than elapsed_ms, on the rows that did, once each.

        audited: what run(audit=True) gave; timers that are not due stay in its column timers.
        """
        extra = [c for c in audited.columns if c.startswith(("fires_", "retracted_"))]
        df = self.start(audited.withColumnRenamed("timers", f"{HIDDEN}pending").drop(*AUDIT, *extra))
        ready = lambda x: x["ms"] <= elapsed_ms
        named = lambda name: F.exists(f"{HIDDEN}pending", lambda x: ready(x) & (x["rule"] == name))
        guards = {r.name: named(r.name) for r in self.rules}
        out = self.cycle(df, as_of, guards)
        left = F.concat(F.filter(f"{HIDDEN}pending", lambda x: ~ready(x)), F.col(f"{HIDDEN}timers"))
        return out.select(*[F.col(f"`{c}`") for c in out.columns if not c.startswith(HIDDEN)], left.alias("timers"))


def _renamed(c, old: str, new: str):
    if isinstance(c, ir.Path):
        root, dot, rest = c.name.partition(".")
        return ir.Path(new + dot + rest) if root == old else c
    if isinstance(c, tuple):
        return tuple(_renamed(x, old, new) for x in c)
    if hasattr(c, "__dataclass_fields__"):
        return type(c)(**{f: _renamed(getattr(c, f), old, new) for f in c.__dataclass_fields__})
    return c


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    return table(df, "checkpoint")

"""Rules back to text; what is printed parses to the same rule."""

from __future__ import annotations

import json

from . import ir


def value(x) -> str:
    if isinstance(x, ir.Lit):
        v = x.value
        if isinstance(v, tuple):
            return "[" + ", ".join(value(i if hasattr(i, "__dataclass_fields__") else ir.Lit(i)) for i in v) + "]"
        return json.dumps(v, ensure_ascii=False)
    if isinstance(x, ir.Path):
        return x.name
    if isinstance(x, ir.Var):
        return f"?{x.name}"
    if isinstance(x, ir.Call):
        return f"{x.name}({', '.join(map(value, x.args))})"
    return f"({value(x.left)} {x.op} {value(x.right)})"


OPS = {"starts_with": "startsWith", "ends_with": "endsWith"}


def condition(c) -> str:
    if isinstance(c, ir.Cmp):
        return f"{value(c.left)} {OPS.get(c.op, c.op)} {value(c.right)}"
    if isinstance(c, (ir.And, ir.Or)):
        return "(" + (" && " if isinstance(c, ir.And) else " || ").join(map(condition, c.parts)) + ")"
    if isinstance(c, ir.Not):
        return f"!({condition(c.part)})"
    if isinstance(c, ir.Test):
        return f"test({condition(c.call) if isinstance(c.call, (ir.Cmp, ir.And, ir.Or, ir.Not)) else value(c.call)})"
    if isinstance(c, ir.Quantified):
        return f"{c.kind}({condition(c.part)})"
    if isinstance(c, ir.Accumulate):
        inside = ([f"$v: {c.field}"] if c.field else []) + [condition(x) for x in c.conditions]
        return f"accumulate({c.type}({', '.join(inside)}), {c.function}({'$v' if c.field else ''}))"
    if isinstance(c, ir.Multi):
        if c.kind == "collect":
            return f"{c.path} $?{c.variable}"
        if c.kind == "count":
            return f"{c.path} count {c.op} {value(c.value)}"
        return f"{c.path} {c.kind}" + (f" ${c.variable}" if c.variable else "")
    if isinstance(c, ir.Typed):
        return f"${c.variable} : {c.type}({condition(c.part)})"
    over = f" over window({c.window_ms} ms, {c.window_kind})" if c.window_ms else ""
    return f"{c.variable}: {(c.type + ' ') if c.type else ''}from stream({json.dumps(c.stream)}){over}"


def action(a) -> str:
    if isinstance(a, ir.Assign):
        return f"{a.path} = {value(a.value)}"
    if isinstance(a, ir.Append):
        return f"{a.path} += {value(a.value)}"
    if isinstance(a, ir.Retract):
        return f"retract(${a.target})"
    if isinstance(a, ir.Log):
        return f"Log({value(a.message)})"
    if isinstance(a, ir.Method):
        return f"${a.target}.{a.name}({', '.join(map(value, a.args))})"
    return f"{a.name}({', '.join(map(value, a.args))})"


def rule(r: ir.Rule) -> str:
    attrs = [f"salience {r.salience}"] if r.salience else []
    attrs += [n for n, on in (("no-loop", r.no_loop), ("lock-on-active", r.lock_on_active)) if on]
    attrs += [f"{n} {json.dumps(v)}" for n, v in (("agenda-group", r.agenda_group), ("activation-group", r.activation_group), ("ruleflow-group", r.ruleflow_group), ("date-effective", r.date_effective), ("date-expires", r.date_expires)) if v]
    if r.description:
        attrs.append(json.dumps(r.description))
    body = "".join(f"        {action(a)};\n" for a in r.then)
    return f"rule {json.dumps(r.name)} {' '.join(attrs)} {{\n    when\n        {condition(r.when)}\n    then\n{body}}}\n"

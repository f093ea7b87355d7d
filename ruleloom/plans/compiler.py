"""Conditions and expressions of the rule language to Catalyst columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError
from ..functions import library
from ..lang import ir

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Scope:
    """Resolves paths against a schema, each path to a column or to none.

    missing: what a condition on an absent or null field is: "native" (the field is null), "backward" (only != holds) or
    "rete" (nothing holds).
    """

    def __init__(self, schema: T.StructType, missing: str = "native", functions: dict[str, Callable] | None = None, prefix: str = "", replaced: dict[str, Column] | None = None):
        self.schema, self.missing, self.prefix = schema, missing, prefix
        self.functions = {**library.FUNCTIONS, **(functions or {})}
        self.replaced = replaced or {}

    def type(self, path: str) -> T.DataType | None:
        here: T.DataType = self.schema
        for part in path.split("."):
            if not isinstance(here, T.StructType) or part not in here.names:
                return None
            here = here[part].dataType
        return here

    def bound(self, path: str) -> str | None:
        """The schema's spelling of a path: as it is, without its fact type, or flattened."""
        for p in (path, path.split(".", 1)[-1], path.replace(".", "_")):
            if self.type(p) is not None:
                return p
        return None

    def column(self, path: str) -> Column | None:
        if path in self.replaced:
            return self.replaced[path]
        p = self.bound(path)
        if p is None:
            return None
        return F.col(self.prefix + ".".join(f"`{x}`" for x in p.split(".")))


def _is(kind: T.DataType | None, *types) -> bool:
    return kind is not None and isinstance(kind, types)


def static_type(x, scope: Scope) -> T.DataType | None:
    if isinstance(x, ir.Path):
        p = scope.bound(x.name)
        return T.StringType() if p is None else scope.type(p)
    if isinstance(x, ir.Lit):
        v = x.value
        return T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType() if isinstance(v, str) else T.ArrayType(T.StringType()) if isinstance(v, tuple) else None
    if isinstance(x, ir.Arith):
        a, b = static_type(x.left, scope), static_type(x.right, scope)
        if x.op == "+" and _is(a, T.StringType) and _is(b, T.StringType):
            return T.StringType()
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if x.op != "/" and _is(a, *whole) and _is(b, *whole) else T.DoubleType()
    return None


def expression(x, scope: Scope) -> Column:
    """Missing paths are text if they are plain names (an unquoted word), else null."""
    if isinstance(x, ir.Lit):
        if isinstance(x.value, tuple):
            return F.array(*[F.lit(v) for v in x.value])
        if isinstance(x.value, str):
            ref = scope.column(x.value) if "." in x.value and re.fullmatch(r"\w+(\.\w+)+", x.value) else None
            return F.lit(x.value) if ref is None else ref
        return F.lit(x.value)
    if isinstance(x, ir.Path):
        c = scope.column(x.name)
        return c if c is not None else F.lit(None if "." in x.name else x.name)
    if isinstance(x, ir.Call):
        if x.name not in scope.functions:
            raise BindError(f"no function {x.name!r}")
        call = scope.functions[x.name]
        if x.args and call is library.FUNCTIONS.get(x.name):
            kind = static_type(x.args[0], scope)
            typed = library.ARRAY_FUNCTIONS if _is(kind, T.ArrayType) else library.MAP_FUNCTIONS if _is(kind, T.MapType) else {}
            call = typed.get(x.name, call)
        return call(*[expression(a, scope) for a in x.args])
    if isinstance(x, ir.Arith):
        a, b = expression(x.left, scope), expression(x.right, scope)
        kind = static_type(x, scope)
        if _is(kind, T.StringType):
            # Strings add as numbers where both are.
            both = a.try_cast("double") + b.try_cast("double")
            return F.coalesce(library.number_text(both), F.concat(a, b))
        if not _is(static_type(x.left, scope), *NUMERIC):
            a = a.try_cast("double")
        if not _is(static_type(x.right, scope), *NUMERIC):
            b = b.try_cast("double")
        if x.op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if x.op == "%":
            return F.try_mod(a, b)
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[x.op](a, b)
    raise BindError(f"not a value: {x}")


def wildcard(pattern: str) -> str:
    """* and ? as an anchored regular expression."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _alike(c: Column, kind: T.DataType | None, x, other: T.DataType | None) -> tuple[Column, T.DataType | None]:
    if isinstance(x, ir.Call) and _is(other, T.StringType):
        return c.cast("string"), T.StringType()
    if isinstance(x, ir.Call) and _is(other, *NUMERIC):
        return c.cast("string").try_cast("double"), T.DoubleType()
    return c, kind


def compare(op: str, left, right, scope: Scope) -> Column:
    a, b = expression(left, scope), expression(right, scope)
    ta, tb = static_type(left, scope), static_type(right, scope)
    if op in ("==", "!="):
        # A call's type is known to Catalyst only: it is compared as what the other side is.
        a, ta = _alike(a, ta, left, tb)
        b, tb = _alike(b, tb, right, ta)
    false = lambda c: F.coalesce(c, F.lit(False))
    null_left = isinstance(left, ir.Path) and scope.missing != "native"
    if op in ("==", "!="):
        if _is(ta, *NUMERIC) and _is(tb, T.StringType):
            same = F.coalesce(a.eqNullSafe(b.try_cast("double")) & b.isNotNull(), F.lit(False)) | (a.isNull() & (b.isNull() | (b == "null")))
        elif _is(ta, T.StringType) and _is(tb, *NUMERIC):
            same = F.coalesce(a.try_cast("double") == b, F.lit(False))
        elif _is(ta, T.BooleanType) != _is(tb, T.BooleanType) and ta is not None and tb is not None:
            same = a.isNull() & b.isNull()
        else:
            same = a.eqNullSafe(b)
            if _is(ta, T.StringType) and tb is None:
                same = a.isNull() | (a == "null")
            elif ta is None and _is(tb, T.StringType):
                same = b.isNull() | (b == "null")
            elif _is(ta, T.StringType) and _is(tb, T.StringType) and isinstance(right, ir.Lit) and right.value == "null":
                same = a.isNull() | (a == "null")
        same = false(same)
        out = same if op == "==" else ~same
        if null_left:
            out = F.when(a.isNull(), F.lit(op == "!=" and scope.missing == "backward")).otherwise(out)
        return out
    if op in (">", ">=", "<", "<="):
        x = a if _is(ta, *NUMERIC) else a.try_cast("double") if not _is(ta, T.BooleanType, T.ArrayType, T.StructType) else F.lit(None).cast("double")
        y = b if _is(tb, *NUMERIC) else b.try_cast("double") if not _is(tb, T.BooleanType, T.ArrayType, T.StructType) else F.lit(None).cast("double")
        return false({">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op])
    if op == "in":
        values = right.value if isinstance(right, ir.Lit) and isinstance(right.value, tuple) else None
        return false(a.isin(*values) if values is not None else F.array_contains(b, a)) if values != () else F.lit(False)
    if op in ("contains", "not_contains"):
        if _is(ta, T.ArrayType):
            has = false(F.array_contains(a, b))
        elif ta is None or _is(ta, T.StringType):
            has = F.contains(a, b)
        else:
            return F.lit(False)
        return false(has if op == "contains" else ~has)
    if not _is(ta, T.StringType) and ta is not None:
        return F.lit(False)
    if op == "matches":
        if isinstance(right, ir.Lit) and isinstance(right.value, str):
            return false(a.rlike(wildcard(right.value)))
        return false(F.contains(a, b))
    return false(F.startswith(a, b) if op == "starts_with" else F.endswith(a, b))


def truth(c: Column, kind: T.DataType | None) -> Column:
    if _is(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    text = c.cast("string")
    return F.coalesce(F.when(text.isin("true", "false"), text == "true").otherwise(F.coalesce(text.try_cast("double") != 0, text != "")), F.lit(False))


def condition(c, scope: Scope) -> Column:
    """A total boolean: never null."""
    if isinstance(c, ir.Cmp):
        return compare(c.op, c.left, c.right, scope)
    if isinstance(c, (ir.And, ir.Or)):
        out = condition(c.parts[0], scope)
        for p in c.parts[1:]:
            out = out & condition(p, scope) if isinstance(c, ir.And) else out | condition(p, scope)
        return out
    if isinstance(c, ir.Not):
        return ~condition(c.part, scope)
    if isinstance(c, ir.Typed):
        return condition(c.part, scope)
    if isinstance(c, ir.Test):
        if isinstance(c.call, (ir.Cmp, ir.And, ir.Or, ir.Not)):
            return condition(c.call, scope)
        return truth(expression(c.call, scope), static_type(c.call, scope))
    if isinstance(c, ir.Multi):
        return multifield(c, scope)
    if isinstance(c, ir.Accumulate):
        return F.lit(True)
    if isinstance(c, ir.StreamPattern):
        raise BindError("rules over streams are run by operators.correlation.run_rules")
    if isinstance(c, ir.Quantified):
        return condition(c.part, scope)
    raise BindError(f"not a condition: {c}")


def multifield(c: ir.Multi, scope: Scope) -> Column:
    a = scope.column(c.path)
    if a is None:
        return F.lit(c.kind == "empty" and scope.missing == "rete")
    if c.kind == "collect":
        return a.isNotNull()
    if c.kind == "count":
        n = F.coalesce(F.size(a), F.lit(0))
        v = expression(c.value, scope)
        return F.coalesce({"==": n == v, "!=": n != v, ">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v, None: n > 0}[c.op], F.lit(False))
    some = F.coalesce(F.size(a) > 0, F.lit(False))
    if c.kind == "empty":
        return F.coalesce(F.size(a) == 0, F.lit(scope.missing == "rete"))
    return some


# Multifield values, for projections.
def mf_count(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def mf_first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def mf_last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def mf_index(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def mf_slice(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, max(end - start, 0))


def mf_contains(a: Column, v) -> Column:
    return F.coalesce(F.array_contains(a, v), F.lit(False))

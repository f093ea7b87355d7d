"""Scalar functions and field actions, as columns; bad input gives null instead of an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of a mail address, and the forms of dates in the order in which they are tried.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy")
#: strftime directives and their patterns.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%p": "a", "%I": "hh"}
REPEAT_LIMIT = 1000


def number_text(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def _num(c: Column) -> Column:
    return c.cast("string").try_cast("double")


# -- strings


def concat(*cs: Column) -> Column:
    return F.concat(*[c.cast("string") for c in cs])


def repeat(s: Column, n: Column) -> Column:
    return F.when((n >= 0) & (n <= REPEAT_LIMIT), F.repeat(s, n.cast("int")))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """From a position counted from 0; past the end it is empty."""
    return F.substring(s, start.cast("int") + 1, F.lit(2**31 - 1) if length is None else length.cast("int"))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


# -- numbers


def smallest(*cs: Column) -> Column:
    return F.least(*map(_num, cs)) if len(cs) > 1 else _num(cs[0])


def largest(*cs: Column) -> Column:
    return F.greatest(*map(_num, cs)) if len(cs) > 1 else _num(cs[0])


def total(*cs: Column) -> Column:
    out = F.lit(0.0)
    for c in cs:
        out = out + _num(c)
    return out


def mean(*cs: Column) -> Column:
    return total(*cs) / len(cs) if cs else F.lit(None).cast("double")


def square_root(x: Column) -> Column:
    return F.when(_num(x) >= 0, F.sqrt(_num(x)))


# -- dates


def parse_date(d: Column) -> Column:
    """A timestamp from text in the first of the known formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(d.cast("string"), F.lit(f)) for f in DATE_FORMATS])


def format_date(d: Column, pattern: str) -> Column:
    """The pattern is text, not a column."""
    for k, v in STRFTIME.items():
        pattern = pattern.replace(k, v)
    return F.date_format(parse_date(d), pattern)


def add_days(d: Column, n: Column) -> Column:
    return F.date_format(F.date_add(parse_date(d).cast("date"), n.cast("int")), "yyyy-MM-dd")


# -- collections


def array_slice(a: Column, start: Column, end: Column | None = None) -> Column:
    stop = F.size(a) if end is None else F.least(end.cast("int"), F.size(a))
    return F.slice(a, start.cast("int") + 1, F.greatest(stop - start.cast("int"), F.lit(0)))


def array_sort(a: Column, ascending: bool = True) -> Column:
    return F.sort_array(a, ascending)


def array_filter(a: Column, field: str, value) -> Column:
    """Elements whose field equals value; the field `_value` is the element itself."""
    return F.filter(a, lambda x: (x if field == "_value" else x[field]).eqNullSafe(value))


def array_find(a: Column, field: str, value) -> Column:
    return F.try_element_at(array_filter(a, field, value), F.lit(1))


def joined(a: Column, separator: Column) -> Column:
    """An array's elements as text with a separator, which may be a column."""
    return F.call_function("array_join", F.transform(a, lambda x: x.cast("string")), separator)


def sorted_keys(m: Column) -> Column:
    """A map's keys in order, so that equal maps give equal arrays."""
    return F.array_sort(F.map_keys(m))


def sorted_values(m: Column) -> Column:
    """A map's values in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"])


def object_merge(a: Column, b: Column) -> Column:
    """Map with the entries of both, of equal keys those of b."""
    left = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(left, b)


# -- validation


def is_email(s: Column) -> Column:
    return F.coalesce(s.rlike(EMAIL), F.lit(False))


def is_phone(s: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(s, "[^0-9]", "")).between(10, 15), F.lit(False))


def is_url(s: Column) -> Column:
    return F.coalesce(s.startswith("http://") | s.startswith("https://") | s.startswith("ftp://"), F.lit(False))


def is_numeric(s: Column) -> Column:
    """Text of a number: digits with a sign, a fraction and an exponent as may be, or inf and nan by name."""
    return F.coalesce(F.lower(s.cast("string")).rlike(r"^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity|nan)$"), F.lit(False))


def is_empty(s: Column) -> Column:
    return s.isNull() | (trim(s.cast("string")) == "")


def in_range(v: Column, low: Column, high: Column) -> Column:
    return F.coalesce(_num(v).between(_num(low), _num(high)), F.lit(False))


def format_text(pattern: Column, *args: Column) -> Column:
    """{0}, {1}, ... replaced by the arguments."""
    for i, a in enumerate(args):
        pattern = F.replace(pattern, F.lit("{%d}" % i), a.cast("string"))
    return pattern


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "concat": concat, "repeat": repeat, "substring": substring, "min": smallest, "max": largest, "sqrt": square_root, "sum": total, "avg": mean,
    "now": lambda: F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "today": lambda: F.date_format(F.current_date(), "yyyy-MM-dd"),
    "dayOfWeek": lambda d: F.weekday(parse_date(d)) + 1, "year": lambda d: F.year(parse_date(d)), "month": lambda d: F.month(parse_date(d)), "day": lambda d: F.dayofmonth(parse_date(d)),
    "length": F.octet_length, "len": F.octet_length, "contains": F.contains, "first": lambda s: F.left(s, F.lit(1)), "last": lambda s: F.right(s, F.lit(1)), "reverse": F.reverse,
    "join": joined, "slice": array_slice, "keys": sorted_keys, "values": sorted_values,
    "isEmail": is_email, "isPhone": is_phone, "isUrl": is_url, "isNumeric": is_numeric, "isEmpty": is_empty, "inRange": in_range,
    "exists": F.isnotnull, "notExists": F.isnull, "not_exists": F.isnull, "is_empty": is_empty, "size": F.octet_length,
    "format": format_text, "round": lambda x: F.round(_num(x)), "floor": lambda x: F.floor(_num(x)), "ceil": lambda x: F.ceil(_num(x)), "abs": lambda x: F.abs(_num(x)),
    "startswith": F.startswith, "endswith": F.endswith, "lowercase": F.lower, "uppercase": F.upper, "trim": trim, "split": lambda s, d: F.split(s, d), "random": F.rand,
}

#: What functions mean where the first argument is an array, or a map.
ARRAY_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "length": F.size, "len": F.size, "size": F.size, "contains": lambda a, v: F.coalesce(F.array_contains(a, v), F.lit(False)),
    "first": lambda a: F.try_element_at(a, F.lit(1)), "last": lambda a: F.try_element_at(a, F.lit(-1)),
    "isEmpty": lambda a: F.coalesce(F.size(a) == 0, F.lit(True)), "is_empty": lambda a: F.coalesce(F.size(a) == 0, F.lit(True)),
}
MAP_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "length": F.size, "len": F.size, "size": F.size, "contains": lambda m, k: F.coalesce(F.map_contains_key(m, k), F.lit(False)),
    "isEmpty": ARRAY_FUNCTIONS["isEmpty"], "is_empty": ARRAY_FUNCTIONS["is_empty"],
}

#: Field actions Name(input, .., output): the column for the output.
ACTIONS: dict[str, Callable[..., Column]] = {
    "ToUpperCase": F.upper, "ToLowerCase": F.lower, "StringLength": F.octet_length, "StringContains": F.contains, "StringTrim": trim, "StringReplace": F.replace,
    "StringSplit": lambda s, d: F.split(s, d), "StringJoin": joined,
    "Add": lambda a, b: _num(a) + _num(b), "Subtract": lambda a, b: _num(a) - _num(b), "Multiply": lambda a, b: _num(a) * _num(b), "Divide": lambda a, b: F.try_divide(_num(a), _num(b)),
    "Modulo": lambda a, b: F.try_mod(_num(a), _num(b)), "Power": lambda a, b: F.pow(_num(a), _num(b)), "Abs": lambda a: F.abs(_num(a)), "Round": lambda a: F.round(_num(a)), "Ceil": lambda a: F.ceil(_num(a)), "Floor": lambda a: F.floor(_num(a)),
    "CurrentDate": lambda: F.date_format(F.current_date(), "yyyy-MM-dd"), "CurrentTime": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    "AddDays": add_days, "IsWeekend": lambda d: F.weekday(parse_date(d)) >= 5,
    "ArrayLength": F.size, "ArrayPush": F.array_append, "ArrayPop": lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), "ArraySort": array_sort,
    "ArrayFilter": array_filter, "ArrayFind": array_find, "FormatDate": format_date,
    "ObjectKeys": sorted_keys, "ObjectValues": sorted_values, "ObjectMerge": object_merge,
    "ValidateEmail": is_email, "ValidatePhone": is_phone, "ValidateUrl": is_url, "ValidateRegex": lambda s, p: F.coalesce(F.rlike(s, p), F.lit(False)), "ValidateRange": in_range,
    "ValidateLength": lambda s, a, b: F.coalesce(F.octet_length(s).between(a, b), F.lit(False)), "ValidateNotEmpty": lambda s: ~is_empty(s),
}

#: Arguments of actions (by place) that are plain values, not columns, where the rule gives them as literals.
PLAIN: dict[str, tuple[int, ...]] = {"FormatDate": (1,), "ArrayFilter": (1, 2), "ArrayFind": (1, 2), "ArraySort": (1,)}

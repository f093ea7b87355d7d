"""Goals over several fact tables: joins, alternatives, negation and sub-goals, written as text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GoalError
from ..functions import aggregates

TOKEN = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|-?\d+(?:\.\d+)?|\?\w+|[A-Za-z_]\w*|>=|<=|!=|==|[(),<>])""")
COMPARE = {"==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


class Facts:
    """Tables of facts by predicate; the arguments of a predicate are its table's columns in order.

    find("grand(?x, ?z) WHERE parent(?x, ?y) AND parent(?y, ?z)") gives the bindings of ?x and ?z, each once. After WHERE:

        predicate(?x, "text", 3)      rows whose columns equal the constants; variables are bound to the rest
        ?x > 3, ?x != ?y              tests of bound variables
        A AND B, A OR B, (A), NOT A   OR binds what all of its branches bind; NOT is by failure, on shared variables
        (head(?x) WHERE A)            a sub-goal: only its head's variables are seen outside

    Conjunctions are equi-joins on shared variables, negations anti-joins, alternatives unions: their order is Spark's
    to choose, but negations and tests come after what binds their variables. A conjunction whose parts share no variable
    is an error unless cross=True.
    """

    def __init__(self, tables: dict[str, DataFrame], cross: bool = False):
        self.tables, self.cross = tables, cross

    def find(self, text: str) -> DataFrame:
        """Distinct bindings of the head's variables; an aggregate head, as count(?x), gives one row with column value."""
        self.tokens, self.at = self._cut(text), 0
        name, arguments = self._head()
        self._take("WHERE")
        body = self._either()
        if self.at < len(self.tokens):
            raise GoalError(f"unexpected {self.tokens[self.at]!r}")
        if name in aggregates.GOAL and name not in self.tables:
            column = F.col(arguments[0][1:])
            return body.filter(column.isNotNull()).agg(aggregates.GOAL[name](column).alias("value"))
        return self._project(body, arguments)

    # -- text

    @staticmethod
    def _cut(text: str) -> list[str]:
        out, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise GoalError(f"cannot read {text[at:at + 20]!r}")
            out.append(m[1])
            at = m.end()
        return out

    def _peek(self, ahead: int = 0) -> str:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else ""

    def _take(self, wanted: str | None = None) -> str:
        t = self._peek()
        if not t or wanted is not None and t.upper() != wanted:
            raise GoalError(f"expected {wanted or 'more'}, found {t!r}")
        self.at += 1
        return t

    def _head(self) -> tuple[str, list[str]]:
        name, out = self._take(), []
        self._take("(")
        while self._peek() != ")":
            out.append(self._take())
            if self._peek() == ",":
                self._take()
        self._take(")")
        return name, out

    @staticmethod
    def _literal(t: str):
        if t[0] in "\"'":
            return re.sub(r"\\(.)", r"\1", t[1:-1])
        if t in ("true", "false"):
            return t == "true"
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        raise GoalError(f"not a value: {t!r}")

    # -- goals

    @staticmethod
    def _project(df: DataFrame, arguments: list[str]) -> DataFrame:
        names = [a[1:] for a in arguments]
        if missing := [n for n in names if n not in df.columns]:
            raise GoalError(f"nothing binds {missing}")
        return df.select(*dict.fromkeys(names)).distinct()

    def _either(self) -> DataFrame:
        branches = [self._all()]
        while self._peek().upper() == "OR":
            self._take()
            branches.append(self._all())
        if len(branches) == 1:
            return branches[0]
        shared = [c for c in branches[0].columns if all(c in b.columns for b in branches)]
        return reduce(DataFrame.unionByName, [b.select(*shared) for b in branches]).distinct()

    def _all(self) -> DataFrame:
        bound: list[DataFrame] = []
        refuted: list[DataFrame] = []
        tests: list[tuple[str, str, str]] = []
        while True:
            self._part(bound, refuted, tests)
            if self._peek().upper() != "AND":
                break
            self._take()
        if not bound:
            raise GoalError("negations and tests need something that binds their variables")
        out, waiting = bound[0], bound[1:]
        while waiting:
            # Parts that share a variable come first, so that none is crossed that need not be.
            p = next((p for p in waiting if set(p.columns) & set(out.columns)), None)
            if p is None and not self.cross:
                raise GoalError("parts of the goal share no variable")
            p = waiting[0] if p is None else p
            waiting = [q for q in waiting if q is not p]
            shared = [c for c in p.columns if c in out.columns]
            out = out.join(p, shared) if shared else out.crossJoin(p)
        for left, op, right in tests:
            sides = [F.col(t[1:]) if t[0] == "?" else F.lit(self._literal(t)) for t in (left, right)]
            if missing := [t for t in (left, right) if t[0] == "?" and t[1:] not in out.columns]:
                raise GoalError(f"nothing binds {missing}")
            out = out.filter(COMPARE[op](*sides))
        for p in refuted:
            shared = [c for c in p.columns if c in out.columns]
            if not shared:
                raise GoalError("a negation shares no variable")
            out = out.join(p.select(*shared).distinct(), shared, "left_anti")
        return out

    def _part(self, bound: list, refuted: list, tests: list) -> None:
        if self._peek().upper() == "NOT":
            self._take()
            inner: list = []
            self._part(inner, refuted, tests)
            if not inner:
                raise GoalError("NOT takes a predicate or a goal in parentheses")
            refuted += inner
        elif self._peek(1) in COMPARE:
            tests.append((self._take(), self._take(), self._take()))
        elif self._peek() == "(":
            self._take()
            start = self.at
            if re.match(r"[A-Za-z_]", self._peek()) and self._peek(1) == "(":
                _, arguments = self._head()
                if self._peek().upper() == "WHERE":
                    self._take()
                    bound.append(self._project(self._either(), arguments))
                    self._take(")")
                    return
                self.at = start
            bound.append(self._either())
            self._take(")")
        else:
            bound.append(self._predicate())

    def _predicate(self) -> DataFrame:
        name, arguments = self._head()
        if name not in self.tables:
            raise GoalError(f"no facts {name!r}")
        df = self.tables[name]
        if len(arguments) > len(df.columns):
            raise GoalError(f"{name!r} has {len(df.columns)} arguments")
        columns: dict[str, Column] = {}
        for c, a in zip(df.columns, arguments):
            if a[0] == "?":
                if a[1:] in columns:
                    df = df.filter(columns[a[1:]] == df[c])
                else:
                    columns[a[1:]] = df[c]
            elif a != "_":
                df = df.filter(df[c] == F.lit(self._literal(a)))
        return df.select(*[c.alias(n) for n, c in columns.items()])

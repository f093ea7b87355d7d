"""Rules, goals and stream patterns as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field


# -- expressions


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


# -- conditions


@dataclass(frozen=True)
class Cmp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Test:
    call: object


@dataclass(frozen=True)
class Quantified:
    """exists / forall over the rows of a fact type."""

    kind: str
    part: object


@dataclass(frozen=True)
class Accumulate:
    type: str
    field: str | None
    conditions: tuple
    function: str


@dataclass(frozen=True)
class Multi:
    """A multifield test: collect, count, first, last, empty, not_empty."""

    kind: str
    path: str
    op: str | None = None
    value: object = None
    variable: str | None = None


@dataclass(frozen=True)
class Typed:
    """$v : Type(conditions)"""

    variable: str
    type: str
    part: object


@dataclass(frozen=True)
class StreamPattern:
    variable: str
    type: str | None
    stream: str
    window_ms: int | None = None
    window_kind: str | None = None


# -- actions


@dataclass(frozen=True)
class Assign:
    path: str
    value: object


@dataclass(frozen=True)
class Append:
    path: str
    value: object


@dataclass(frozen=True)
class Retract:
    target: str


@dataclass(frozen=True)
class Log:
    message: object


@dataclass(frozen=True)
class Method:
    target: str
    name: str
    args: tuple


@dataclass(frozen=True)
class Do:
    """A named action with arguments: a handler's, or one of ActivateAgendaGroup, ScheduleRule, CompleteWorkflow, SetWorkflowData."""

    name: str
    args: tuple


@dataclass
class Rule:
    name: str
    when: object
    then: list
    salience: int = 0
    no_loop: bool = False
    lock_on_active: bool = False
    agenda_group: str | None = None
    activation_group: str | None = None
    ruleflow_group: str | None = None
    date_effective: str | None = None
    date_expires: str | None = None
    description: str | None = None
    enabled: bool = True
    module: str = "MAIN"


@dataclass
class Query:
    name: str
    goal: object
    options: dict = field(default_factory=dict)
    when: object = None
    on_success: list = field(default_factory=list)
    on_failure: list = field(default_factory=list)
    on_missing: list = field(default_factory=list)


@dataclass
class ModuleDef:
    name: str
    export: str | tuple = "none"
    imports: list = field(default_factory=list)


@dataclass
class Program:
    rules: list = field(default_factory=list)
    modules: list = field(default_factory=list)
    queries: list = field(default_factory=list)


def paths(node) -> set[str]:
    """Field paths that an expression or condition reads."""
    if isinstance(node, Path):
        return {node.name}
    if isinstance(node, Multi):
        return {node.path} | paths(node.value)
    if isinstance(node, Accumulate):
        return {f"{node.type}.{p}" for c in node.conditions for p in paths(c)} | ({f"{node.type}.{node.field}"} if node.field else set())
    if isinstance(node, (tuple, list)):
        return set().union(*map(paths, node)) if node else set()
    if hasattr(node, "__dataclass_fields__"):
        return set().union(set(), *(paths(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()

"""The algebra a query is parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import IRI, BlankNode, Literal, Variable

Node = IRI | BlankNode | Literal | Variable


# Property paths: an IRI, or one of these.
@dataclass(frozen=True)
class PathOp:
    """op: ``/`` ``|`` ``^`` ``+`` ``*`` ``?`` ``!`` (args: IRIs, or ("^", IRI) pairs)."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: Node
    p: object  # IRI, Variable or PathOp
    o: Node


# Expressions.
@dataclass(frozen=True)
class Const:
    term: IRI | Literal


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Op:
    """Operators and built-in calls; names in upper case: ``OR AND = < > <= >= + - * / NEG POS NOT IN IF COALESCE BOUND SUBSTR ...``."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    iri: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    pattern: object


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None  # None: COUNT(*)
    distinct: bool = False
    separator: str = " "


# Patterns.
@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    condition: object | None = None


@dataclass(frozen=True)
class Filter:
    condition: object
    inner: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Graph:
    name: IRI | Variable
    inner: object


@dataclass(frozen=True)
class Service:
    name: IRI | Variable
    inner: object
    silent: bool


@dataclass(frozen=True)
class Extend:
    inner: object
    var: str
    expr: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple, ...]  # terms, or None for UNDEF


@dataclass(frozen=True)
class OrderBy:
    inner: object
    keys: tuple[tuple[object, bool], ...]  # expression, ascending


@dataclass(frozen=True)
class Project:
    inner: object
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    inner: object


@dataclass(frozen=True)
class Reduced:
    inner: object


@dataclass(frozen=True)
class Slice:
    inner: object
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Group:
    inner: object
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...] = field(default=())


def in_scope(p: object) -> list[str]:
    """Variables a pattern can bind, in order of appearance, without those made by the parser."""
    match p:
        case BGP(triples):
            names = [x.name for t in triples for x in (t.s, t.p, t.o) if isinstance(x, Variable)]
        case Join(a, b) | LeftJoin(a, b, _) | Union(a, b):
            names = in_scope(a) + in_scope(b)
        case Minus(a, _):
            names = in_scope(a)
        case Filter(_, inner) | OrderBy(inner, _) | Distinct(inner) | Reduced(inner) | Slice(inner, _, _):
            names = in_scope(inner)
        case Graph(name, inner):
            names = ([name.name] if isinstance(name, Variable) else []) + in_scope(inner)
        case Service(_, inner, _):
            names = in_scope(inner)
        case Extend(inner, var, _):
            names = [*in_scope(inner), var]
        case Values(vs, _):
            names = list(vs)
        case Project(_, vs):
            names = list(vs)
        case Group(_, keys, aggs):
            names = [*keys, *(n for n, _ in aggs)]
        case _:
            names = []
    return [n for n in dict.fromkeys(names) if not n.startswith(".")]


def expression_vars(e: object) -> set[str]:
    match e:
        case Var(name):
            return {name}
        case Op(_, args) | Call(_, args):
            return set().union(*map(expression_vars, args)) if args else set()
        case Aggregate(_, arg, _, _):
            return expression_vars(arg) if arg is not None else set()
        case Exists(p):
            return set(in_scope(p))
    return set()

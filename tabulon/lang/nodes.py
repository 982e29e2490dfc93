"""The syntax tree. Every node knows its place in the text."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

Place = tuple[int, int]


@dataclass(frozen=True)
class Node:
    at: Place = field(default=(0, 0), compare=False, kw_only=True)


@dataclass(frozen=True)
class Literal(Node):
    #: int, Decimal, str or bool
    value: Any


@dataclass(frozen=True)
class ColumnRef(Node):
    """table is None for a bare [name]."""

    table: str | None
    name: str


@dataclass(frozen=True)
class TableRef(Node):
    name: str


@dataclass(frozen=True)
class Call(Node):
    """name is upper-cased."""

    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class TableConstructor(Node):
    rows: tuple[tuple[Node, ...], ...]


@dataclass(frozen=True)
class OrderKey(Node):
    expr: Node
    descending: bool = False


@dataclass(frozen=True)
class Var(Node):
    name: str
    expr: Node


@dataclass(frozen=True)
class MeasureDef(Node):
    table: str
    name: str
    expr: Node


@dataclass(frozen=True)
class Query(Node):
    measures: tuple[MeasureDef, ...]
    variables: tuple[Var, ...]
    table: Node
    order: tuple[OrderKey, ...] = ()
    start: tuple[Node, ...] = ()


def children(n: Node) -> tuple[Node, ...]:
    match n:
        case Call():
            return n.args
        case Binary():
            return (n.left, n.right)
        case Unary():
            return (n.arg,)
        case TableConstructor():
            return tuple(x for r in n.rows for x in r)
        case OrderKey() | Var():
            return (n.expr,)
    return ()


def walk(n: Node):
    yield n
    for c in children(n):
        yield from walk(c)


def rebuilt(n: Node, new: tuple[Node, ...]) -> Node:
    """The node with other children."""
    match n:
        case Call():
            return replace(n, args=new)
        case Binary():
            return replace(n, left=new[0], right=new[1])
        case Unary():
            return replace(n, arg=new[0])
    return n

"""Predicate tree: fields, comparisons, boolean nodes. Build it with field("x") > 3, F-style lambdas or keyword filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

FUZZY_THRESHOLD = 0.4


class Node:
    """A predicate; `&`, `|` and `~` combine. Nulls never satisfy a comparison, and `~` is true where its operand is not."""

    def __and__(self, other: Node) -> Node:
        return And((self, other))

    def __or__(self, other: Node) -> Node:
        return Or((self, other))

    def __invert__(self) -> Node:
        return Not(self)

    and_, or_ = __and__, __or__


@dataclass(frozen=True)
class Compare(Node):
    """op: eq ne gt gte lt lte contains starts_with ends_with."""

    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class In(Node):
    field: str
    values: tuple


@dataclass(frozen=True)
class Null(Node):
    field: str
    is_null: bool = True


@dataclass(frozen=True)
class Between(Node):
    """Inclusive; a missing bound is open, without bounds it is always true."""

    field: str
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str
    text: str
    threshold: float = FUZZY_THRESHOLD
    prefilter: bool = False


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True, eq=False)
class Field:
    """A named top-level field whose operators make predicates."""

    name: str

    def __eq__(self, value: object) -> Node:  # type: ignore[override]
        return Compare(self.name, "eq", value)

    def __ne__(self, value: object) -> Node:  # type: ignore[override]
        return Compare(self.name, "ne", value)

    __hash__ = None  # type: ignore[assignment]

    def __gt__(self, value: Any) -> Node:
        return Compare(self.name, "gt", value)

    def __ge__(self, value: Any) -> Node:
        return Compare(self.name, "gte", value)

    def __lt__(self, value: Any) -> Node:
        return Compare(self.name, "lt", value)

    def __le__(self, value: Any) -> Node:
        return Compare(self.name, "lte", value)

    def eq(self, value: Any) -> Node:
        return self == value

    def not_eq(self, value: Any) -> Node:
        return self != value

    def contains(self, text: str) -> Node:
        return Compare(self.name, "contains", text)

    def starts_with(self, text: str) -> Node:
        return Compare(self.name, "starts_with", text)

    def ends_with(self, text: str) -> Node:
        return Compare(self.name, "ends_with", text)

    def is_in(self, values: Sequence) -> Node:
        return In(self.name, tuple(values))

    def is_null(self) -> Node:
        return Null(self.name)

    def is_not_null(self) -> Node:
        return Null(self.name, False)

    def between(self, low: Any = None, high: Any = None) -> Node:
        return Between(self.name, low, high)

    def fuzzy(self, text: str, threshold: float = FUZZY_THRESHOLD, prefilter: bool = False) -> Node:
        return Fuzzy(self.name, text, threshold, prefilter)


def fields_of(node: Node) -> list[str]:
    """The field of every comparison in a predicate, in order."""
    match node:
        case And(parts) | Or(parts):
            return [f for p in parts for f in fields_of(p)]
        case Not(part):
            return fields_of(part)
    return [node.field]


class Proxy:
    """The argument of lambda predicates: every attribute is a field."""

    def __getattr__(self, name: str) -> Field:
        return Field(name)

    def __getitem__(self, name: str) -> Field:
        return Field(name)


field = Field

_KEYWORDS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with")


def from_keywords(name: str, **ops: Any) -> Node:
    """where("age", gte=18, lt=65): all given operators on one field; an operator whose value is None is dropped, but
    in_values and is_null."""
    parts: list[Node] = [Compare(name, op, ops.pop(op)) for op in _KEYWORDS if ops.get(op) is not None]
    if ops.get("in_values") is not None:
        parts.append(In(name, tuple(ops["in_values"])))
    if ops.get("is_null") is not None:
        parts.append(Null(name, bool(ops["is_null"])))
    if ops.get("between_start") is not None or ops.get("between_end") is not None:
        parts.append(Between(name, ops.get("between_start"), ops.get("between_end")))
    if ops.get("fuzzy") is not None:
        parts.append(Fuzzy(name, ops["fuzzy"], ops.get("fuzzy_threshold") or FUZZY_THRESHOLD))
    known = {*_KEYWORDS, "in_values", "is_null", "between_start", "between_end", "fuzzy", "fuzzy_threshold"}
    if unknown := set(ops) - known:
        raise TypeError(f"unknown operators: {sorted(unknown)}")
    return And(tuple(parts))

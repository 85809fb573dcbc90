"""Typed predicates and measures, and their Spark columns.

The trees are small and closed: comparisons, null tests, lists and and/or/not over columns,
literals, value-set members and named parameters; six aggregates and ratios of measures. They
turn into built-in expressions only, so everything stays within whole-stage code generation.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeplan.plans.errors import Reason, Refused


@dataclass(frozen=True)
class Col:
    id: str


@dataclass(frozen=True)
class Lit:
    value: Any
    type: str = "string"  # string, boolean, integer, decimal, instant, date


@dataclass(frozen=True)
class Member:
    value_set: str
    name: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool = False


@dataclass(frozen=True)
class In:
    left: Any
    members: tuple
    negated: bool = False


@dataclass(frozen=True)
class Bool:
    op: str  # and, or, not
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    operand: Col | None = None


@dataclass(frozen=True)
class Ratio:
    numerator: Any
    denominator: Any
    zero_denominator: str = "null"  # null, zero, error


COMPARISONS: dict[str, Callable] = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
AGGREGATES = ("sum", "count", "count_distinct", "avg", "min", "max")
ADDITIVE = ("sum", "avg")


def literal(value: Any, kind: str) -> Column:
    """A typed literal; instants without an offset are UTC."""
    match kind:
        case "boolean":
            return F.lit(value if isinstance(value, bool) else str(value).lower() == "true")
        case "integer":
            return F.lit(int(value)).cast("long")
        case "decimal":
            return F.lit(Decimal(str(value)))
        case "instant":
            return F.lit(instant(value))
        case "date":
            return F.lit(value if isinstance(value, date) else date.fromisoformat(value))
        case "string":
            return F.lit(None if value is None else str(value))
    raise Refused(Reason.UNSUPPORTED_OPERATOR, f"literal type {kind!r}")


def instant(value: str | datetime) -> datetime:
    """An ISO instant; without an offset it is UTC."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class Context:
    """What operands resolve against: columns by id, members of value sets, parameters."""

    column: Callable[[str], Column]
    value_sets: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    params: Mapping[str, Any] = field(default_factory=dict)

    def operand(self, node: Any) -> Column:
        match node:
            case Col(id):
                return self.column(id)
            case Lit(value, kind):
                return literal(value, kind)
            case Member(value_set, name):
                if name not in self.value_sets.get(value_set, {}):
                    raise Refused(Reason.OBJECT_NOT_FOUND, f"{value_set} has no member {name!r}")
                return F.lit(self.value_sets[value_set][name])
            case Param(name):
                if name not in self.params:
                    raise Refused(Reason.UNRESOLVED_REFERENCE, f"parameter {name!r} has no value")
                return F.lit(self.params[name])
        raise Refused(Reason.UNSUPPORTED_OPERATOR, f"operand {node!r}")

    def predicate(self, node: Any) -> Column:
        """The condition as a column, with SQL's three-valued logic."""
        match node:
            case Compare(op, left, right) if op in COMPARISONS:
                return COMPARISONS[op](self.operand(left), self.operand(right))
            case IsNull(operand, negated):
                return self.operand(operand).isNotNull() if negated else self.operand(operand).isNull()
            case In(left, members, negated) if members:
                found = self.operand(left).isin(*[self.operand(m) for m in members])
                return ~found if negated else found
            case Bool("not", (arg,)):
                return ~self.predicate(arg)
            case Bool("and" | "or" as op, args) if args:
                return reduce(operator.and_ if op == "and" else operator.or_, map(self.predicate, args))
        raise Refused(Reason.UNSUPPORTED_OPERATOR, f"predicate {node!r}")

    def measure(self, node: Any) -> Column:
        """The aggregate of a group. Decimal sums widen, averages are doubles, ratios follow
        their rule for a denominator of zero."""
        match node:
            case Aggregate("count", None):
                return F.count(F.lit(1))
            case Aggregate("sum", Col(id)):
                return F.sum(self.column(id))
            case Aggregate("avg", Col(id)):
                return F.avg(self.column(id).cast("double"))
            case Aggregate("count", Col(id)):
                return F.count(self.column(id))
            case Aggregate("count_distinct", Col(id)):
                return F.count_distinct(self.column(id))
            case Aggregate("min", Col(id)):
                return F.min(self.column(id))
            case Aggregate("max", Col(id)):
                return F.max(self.column(id))
            case Ratio(numerator, denominator, zero):
                top, bottom = self.measure(numerator).cast("double"), self.measure(denominator).cast("double")
                quotient = F.when(bottom != 0, top / bottom)
                if zero == "zero":
                    return quotient.when(bottom == 0, F.lit(0.0))
                if zero == "error":
                    return quotient.when(bottom == 0, F.raise_error(F.lit("division by zero in a ratio")).cast("double"))
                return quotient
        raise Refused(Reason.UNSUPPORTED_OPERATOR, f"measure {node!r}")


def columns_in(node: Any) -> frozenset[str]:
    """All column ids a tree names."""
    match node:
        case None | Lit() | Member() | Param():
            return frozenset()
        case Col(id):
            return frozenset([id])
        case Compare(_, left, right):
            return columns_in(left) | columns_in(right)
        case IsNull(operand, _) | Aggregate(_, operand):
            return columns_in(operand)
        case In(left, members, _):
            return frozenset().union(columns_in(left), *map(columns_in, members))
        case Bool(_, args):
            return frozenset().union(*map(columns_in, args))
        case Ratio(numerator, denominator, _):
            return columns_in(numerator) | columns_in(denominator)
    raise Refused(Reason.UNSUPPORTED_OPERATOR, f"node {node!r}")


def aggregates_in(node: Any) -> list[Aggregate]:
    """The aggregates of a measure, those inside ratios included."""
    if isinstance(node, Ratio):
        return aggregates_in(node.numerator) + aggregates_in(node.denominator)
    return [node]


def conjuncts(node: Any) -> list:
    """The parts of a conjunction, nested ones taken apart."""
    if isinstance(node, Bool) and node.op == "and":
        return [c for arg in node.args for c in conjuncts(arg)]
    return [] if node is None else [node]


def from_json(node: Any) -> Any:
    """A tree from its JSON form (``kind`` tells the node); a lone object counts as a list of one."""
    if node is None:
        return None
    many = lambda x: tuple(from_json(y) for y in (x if isinstance(x, list) else [x]))
    match node:
        case {"kind": "column", "column_ref": id}:
            return Col(id)
        case {"kind": "literal", "value": value}:
            return Lit(value, node.get("type", "string"))
        case {"kind": "enum", "value_set_ref": value_set, "member": name}:
            return Member(value_set, name)
        case {"kind": "parameter", "name": name}:
            return Param(name)
        case {"kind": "compare", "op": op, "left": left, "right": right}:
            return Compare(op.lower(), from_json(left), from_json(right))
        case {"kind": "is_null", "operand": operand}:
            return IsNull(from_json(operand), bool(node.get("negated")))
        case {"kind": "in", "left": left, "members": members}:
            return In(from_json(left), many(members), bool(node.get("negated")))
        case {"kind": "bool", "op": op, "args": args}:
            return Bool(op.lower(), many(args))
        case {"kind": "aggregate", "op": op}:
            return Aggregate(op.lower(), from_json(node.get("operand")))
        case {"kind": "ratio", "numerator": numerator, "denominator": denominator}:
            return Ratio(from_json(numerator), from_json(denominator), node.get("zero_denominator", "null"))
    raise Refused(Reason.UNSUPPORTED_OPERATOR, f"JSON node {node!r}")


def to_json(node: Any) -> Any:
    """The JSON form that :func:`from_json` reads."""
    match node:
        case None:
            return None
        case Col(id):
            return {"kind": "column", "column_ref": id}
        case Lit(value, kind):
            return {"kind": "literal", "type": kind, "value": value if isinstance(value, (str, bool, int, float, type(None))) else str(value)}
        case Member(value_set, name):
            return {"kind": "enum", "value_set_ref": value_set, "member": name}
        case Param(name):
            return {"kind": "parameter", "name": name}
        case Compare(op, left, right):
            return {"kind": "compare", "op": op, "left": to_json(left), "right": to_json(right)}
        case IsNull(operand, negated):
            return {"kind": "is_null", "operand": to_json(operand), "negated": negated}
        case In(left, members, negated):
            return {"kind": "in", "left": to_json(left), "members": [to_json(m) for m in members], "negated": negated}
        case Bool(op, args):
            return {"kind": "bool", "op": op, "args": [to_json(a) for a in args]}
        case Aggregate(op, operand):
            return {"kind": "aggregate", "op": op, "operand": to_json(operand)}
        case Ratio(numerator, denominator, zero):
            return {"kind": "ratio", "numerator": to_json(numerator), "denominator": to_json(denominator), "zero_denominator": zero}
    raise Refused(Reason.UNSUPPORTED_OPERATOR, f"node {node!r}")

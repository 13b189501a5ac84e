"""Typed expression operators: each takes (column, kind) pairs and gives one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, InvalidOperation, TypeMismatch
from ..types import NUMERIC, SPARK_TYPES, TEMPORAL, Kind

Typed = tuple[Column, Kind]

COMPARISONS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}


def widened(value: Typed) -> Column:
    """Integers as bigint and fractions as double, whatever the width they are stored in."""
    column, kind = value
    return column.cast(SPARK_TYPES[kind]) if kind in NUMERIC else column


def arithmetic_kind(op: str, left: Kind, right: Kind) -> Kind:
    """Integers stay integers, % takes integers only, text + text joins."""
    kinds = {left, right}
    if op == "+" and kinds <= {Kind.TEXT, Kind.NULL} and Kind.TEXT in kinds:
        return Kind.TEXT
    if not kinds <= {*NUMERIC, Kind.NULL} or (op == "%" and Kind.FLOAT in kinds):
        raise TypeMismatch(f"{left.value} {op} {right.value}")
    return Kind.FLOAT if Kind.FLOAT in kinds else Kind.INTEGER


def comparison_kind(op: str, left: Kind, right: Kind) -> Kind:
    """Numbers compare with numbers, dates and timestamps with each other and with ISO text, all else within its kind."""
    kinds = {left, right}
    alike = left is right or Kind.NULL in kinds or kinds <= set(NUMERIC) or kinds <= set(TEMPORAL) or (Kind.TEXT in kinds and kinds & set(TEMPORAL))
    if not alike or (left is Kind.BLOB and op not in ("=", "<>")):
        raise TypeMismatch(f"{left.value} {op} {right.value}")
    return Kind.BOOLEAN


def condition_kind(kind: Kind) -> Kind:
    if kind not in (Kind.BOOLEAN, Kind.NULL):
        raise TypeMismatch(f"a condition must be BOOLEAN, not {kind.value}")
    return Kind.BOOLEAN


def number_kind(of: str, kind: Kind) -> Kind:
    """The kind of what takes one number and gives one; NULL counts as an integer."""
    if kind not in (*NUMERIC, Kind.NULL):
        raise TypeMismatch(f"{of}({kind.value})")
    return Kind.INTEGER if kind is Kind.NULL else kind


def call_kind(name: str, arguments: list[Kind]) -> Kind:
    if name not in ("UPPER", "LOWER", "ABS"):
        raise ColumnNotFound(f"unknown function {name}")
    if len(arguments) != 1:
        raise InvalidOperation(f"{name} expected 1 argument, got {len(arguments)}")
    if name == "ABS":
        return number_kind(name, arguments[0])
    if arguments[0] not in (Kind.TEXT, Kind.NULL):
        raise TypeMismatch(f"{name}({arguments[0].value})")
    return Kind.TEXT


def aggregate_kind(name: str, argument: Kind | None) -> Kind:
    if name == "COUNT":
        return Kind.INTEGER
    if argument is None:
        raise InvalidOperation(f"{name}(*)")
    if name in ("SUM", "AVG"):
        kind = number_kind(name, argument)
        return Kind.FLOAT if name == "AVG" else kind
    return argument


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    """+ - * / %, / truncating between integers."""
    kind = arithmetic_kind(op, left[1], right[1])
    if kind is Kind.TEXT:
        return F.concat(left[0], right[0]), kind
    a, b = (x[0].cast(SPARK_TYPES[kind]) for x in (left, right))
    match op:
        case "+":
            return a + b, kind
        case "-":
            return a - b, kind
        case "*":
            return a * b, kind
        case "%":
            return a % b, kind
        case "/":
            return (F.call_function("div", a, b) if kind is Kind.INTEGER else a / b), kind
    raise InvalidOperation(op)


def comparison(op: str, left: Typed, right: Typed) -> Typed:
    """A comparison of two values that may be compared; numbers meet at the wider width, text becomes a date or timestamp."""
    (a, ka), (b, kb) = left, right
    kind = comparison_kind(op, ka, kb)
    if ka in NUMERIC and kb in NUMERIC:
        a, b = widened(left), widened(right)
        if ka is not kb:
            a, b = a.cast("double"), b.cast("double")
    elif ka is Kind.TEXT and kb in TEMPORAL:
        a = a.cast(SPARK_TYPES[kb])
    elif kb is Kind.TEXT and ka in TEMPORAL:
        b = b.cast(SPARK_TYPES[ka])
    return COMPARISONS[op](a, b), kind


def truth(value: Typed) -> Column:
    """A condition; anything but BOOLEAN or NULL is an error."""
    column, kind = value
    condition_kind(kind)
    return column.cast("boolean")


def common_kind(kinds: list[Kind]) -> Kind:
    """The kind of a CASE whose results have these kinds."""
    known = [k for k in dict.fromkeys(kinds) if k is not Kind.NULL]
    if not known:
        return Kind.NULL
    if len(known) == 1:
        return known[0]
    if set(known) <= set(NUMERIC):
        return Kind.FLOAT
    raise TypeMismatch("CASE results: " + ", ".join(k.value for k in known))


def call(name: str, arguments: list[Typed]) -> Typed:
    """UPPER, LOWER and ABS."""
    kind = call_kind(name, [k for _, k in arguments])
    column = arguments[0][0].cast(SPARK_TYPES[kind])
    return {"ABS": F.abs, "UPPER": F.upper, "LOWER": F.lower}[name](column), kind


def aggregate(name: str, argument: Typed | None, distinct: bool = False) -> Typed:
    """COUNT, SUM, AVG, MIN and MAX; SUM keeps integers as bigint and raises when they overflow."""
    kind = aggregate_kind(name, argument and argument[1])
    if name == "COUNT":
        if argument is None:
            return F.count(F.lit(1)), kind
        return (F.count_distinct if distinct else F.count)(argument[0]), kind
    column, given = argument
    if name in ("SUM", "AVG"):
        column = column.cast(SPARK_TYPES[number_kind(name, given)])
        if name == "AVG":
            if distinct:
                raise InvalidOperation("AVG(DISTINCT)")
            return F.avg(column), kind
        return (F.sum_distinct if distinct else F.sum)(column), kind
    return (F.min if name == "MIN" else F.max)(column), kind

"""SQL types of the dialect, their Spark types, and the conversions between them."""

from __future__ import annotations

import datetime as dt
import re
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NumericOverflow, TypeMismatch


class Kind(Enum):
    """What the dialect knows about a value's type."""

    INTEGER = "INTEGER"
    FLOAT = "FLOAT"
    TEXT = "TEXT"
    BOOLEAN = "BOOLEAN"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"
    BLOB = "BLOB"
    NULL = "NULL"
    OTHER = "OTHER"


SPARK_TYPES: dict[Kind, T.DataType] = {
    Kind.INTEGER: T.LongType(),
    Kind.FLOAT: T.DoubleType(),
    Kind.TEXT: T.StringType(),
    Kind.BOOLEAN: T.BooleanType(),
    Kind.DATE: T.DateType(),
    Kind.TIMESTAMP: T.TimestampNTZType(),
    Kind.BLOB: T.BinaryType(),
}

#: Spellings that CREATE TABLE and ALTER TABLE accept. TIME has no type of its own and is kept as text.
SPELLINGS = {
    "INTEGER": Kind.INTEGER,
    "INT": Kind.INTEGER,
    "BIGINT": Kind.INTEGER,
    "FLOAT": Kind.FLOAT,
    "REAL": Kind.FLOAT,
    "DOUBLE": Kind.FLOAT,
    "TEXT": Kind.TEXT,
    "VARCHAR": Kind.TEXT,
    "CHAR": Kind.TEXT,
    "STRING": Kind.TEXT,
    "BOOLEAN": Kind.BOOLEAN,
    "BOOL": Kind.BOOLEAN,
    "DATE": Kind.DATE,
    "TIME": Kind.TEXT,
    "TIMESTAMP": Kind.TIMESTAMP,
    "DATETIME": Kind.TIMESTAMP,
    "BLOB": Kind.BLOB,
    "BINARY": Kind.BLOB,
}

NUMERIC = (Kind.INTEGER, Kind.FLOAT)
TEMPORAL = (Kind.DATE, Kind.TIMESTAMP)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def kind_of(spark_type: T.DataType) -> Kind:
    match spark_type:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return Kind.INTEGER
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return Kind.FLOAT
        case T.StringType() | T.VarcharType() | T.CharType():
            return Kind.TEXT
        case T.BooleanType():
            return Kind.BOOLEAN
        case T.DateType():
            return Kind.DATE
        case T.TimestampType() | T.TimestampNTZType():
            return Kind.TIMESTAMP
        case T.BinaryType():
            return Kind.BLOB
        case T.NullType():
            return Kind.NULL
    return Kind.OTHER


def stored_value(value: object, kind: Kind) -> object:
    """The Python value that INSERT stores for a literal in a column of this kind; raises for what it must not accept.

    Integers widen to FLOAT and fractions truncate to INTEGER; text is parsed for numbers, booleans (true and false
    only), dates and timestamps in ISO form; booleans may become text; nothing else converts.
    """
    if value is None:
        return None
    refuse = TypeMismatch(f"cannot store {value!r} as {kind.value}")
    if isinstance(value, bool):
        if kind is Kind.BOOLEAN:
            return value
        if kind is Kind.TEXT:
            return "true" if value else "false"
        raise refuse
    if isinstance(value, int):
        if kind is Kind.INTEGER:
            if not LONG_MIN <= value <= LONG_MAX:
                raise NumericOverflow(str(value))
            return value
        if kind is Kind.FLOAT:
            return float(value)
        raise refuse
    if isinstance(value, float):
        if kind is Kind.FLOAT:
            return value
        if kind is Kind.INTEGER:
            if not LONG_MIN <= value <= LONG_MAX:
                raise NumericOverflow(str(value))
            return int(value)
        raise refuse
    if not isinstance(value, str):
        raise refuse
    try:
        match kind:
            case Kind.TEXT:
                return value
            case Kind.INTEGER:
                if not re.fullmatch(r"[+-]?\d+", value):
                    raise refuse
                return stored_value(int(value), kind)
            case Kind.FLOAT:
                return float(value)
            case Kind.BOOLEAN:
                if value.lower() not in ("true", "false"):
                    raise refuse
                return value.lower() == "true"
            case Kind.DATE:
                return dt.date.fromisoformat(value)
            case Kind.TIMESTAMP:
                return dt.datetime.fromisoformat(value)
            case Kind.BLOB:
                return bytearray.fromhex(value)
    except ValueError:
        raise refuse from None
    raise refuse


def cast_column(column: Column, source: Kind, target: Kind) -> Column:
    """A strict cast for UPDATE, ALTER TYPE and text defaults: what does not convert raises when the rows are read."""
    if source is target:
        return column.cast(SPARK_TYPES[target])
    if source is Kind.TEXT and target is Kind.BOOLEAN:
        low = F.lower(column)
        wrong = F.raise_error(F.concat(F.lit("[CAST_INVALID_INPUT] not a boolean: "), column))
        return (
            F.when(column.isNull(), F.lit(None).cast("boolean"))
            .when(low.isin("true", "t", "1"), F.lit(True))
            .when(low.isin("false", "f", "0"), F.lit(False))
            .otherwise(wrong.cast("boolean"))
        )
    if source is Kind.TEXT and target in NUMERIC:
        # Spark would trim: spaces are no part of a number here.
        wrong = F.raise_error(F.concat(F.lit("[CAST_INVALID_INPUT] not a number: "), column))
        spaced = column.rlike(r"^\s|\s$")
        return F.when(spaced, wrong.cast(SPARK_TYPES[target])).otherwise(column.cast(SPARK_TYPES[target]))
    allowed = {
        Kind.INTEGER: (Kind.FLOAT, Kind.TEXT, Kind.BOOLEAN),
        Kind.FLOAT: (Kind.INTEGER, Kind.TEXT),
        Kind.TEXT: (Kind.DATE, Kind.TIMESTAMP, Kind.BLOB),
        Kind.BOOLEAN: (Kind.TEXT, Kind.INTEGER),
        Kind.DATE: (Kind.TEXT, Kind.TIMESTAMP),
        Kind.TIMESTAMP: (Kind.TEXT, Kind.DATE),
        Kind.NULL: tuple(SPARK_TYPES),
    }
    if target not in allowed.get(source, ()):
        raise TypeMismatch(f"cannot convert {source.value} to {target.value}")
    return column.cast(SPARK_TYPES[target])

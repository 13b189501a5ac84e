"""Error kinds of the engine, and how Spark's error classes map to them."""

from __future__ import annotations


class QueryError(Exception):
    """Base of every error that a statement can raise; ``prefix`` opens its message."""

    prefix = "Query error"

    def __init__(self, detail: str = "") -> None:
        super().__init__(f"{self.prefix}: {detail}" if detail else self.prefix)
        self.detail = detail


class ParseError(QueryError):
    prefix = "Parse error"


class StorageError(QueryError):
    prefix = "Storage error"


class ExecutionError(QueryError):
    prefix = "Execution error"


class TypeMismatch(QueryError):
    prefix = "Type error"


class PlanningError(QueryError):
    prefix = "Planning error"


class TableNotFound(QueryError):
    prefix = "Table not found"


class ColumnNotFound(QueryError):
    prefix = "Column not found"


class SchemaNotFound(QueryError):
    prefix = "Schema not found"


class TableAlreadyExists(QueryError):
    prefix = "Table already exists"


class DuplicateColumn(QueryError):
    prefix = "Duplicate column"


class CatalogError(QueryError):
    prefix = "Catalog error"


class TransactionError(QueryError):
    prefix = "Transaction error"


class InvalidOperation(QueryError):
    prefix = "Invalid operation"


class NumericOverflow(QueryError):
    prefix = "Numeric overflow"


class DivisionByZero(QueryError):
    prefix = "Division by zero"


#: Spark's error classes, by their first words, and the kind that each becomes.
_BY_CONDITION: list[tuple[str, type[QueryError]]] = [
    ("DIVIDE_BY_ZERO", DivisionByZero),
    ("REMAINDER_BY_ZERO", DivisionByZero),
    ("ARITHMETIC_OVERFLOW", NumericOverflow),
    ("BINARY_ARITHMETIC_OVERFLOW", NumericOverflow),
    ("CAST_OVERFLOW", NumericOverflow),
    ("CAST_INVALID_INPUT", TypeMismatch),
    ("DATATYPE_MISMATCH", TypeMismatch),
    ("UNRESOLVED_COLUMN", ColumnNotFound),
    ("TABLE_OR_VIEW_NOT_FOUND", TableNotFound),
    ("SCHEMA_NOT_FOUND", SchemaNotFound),
    ("TABLE_OR_VIEW_ALREADY_EXISTS", TableAlreadyExists),
    ("PATH_NOT_FOUND", StorageError),
]


def translated(error: Exception) -> QueryError:
    """The engine's error for one that Spark raised while planning or running."""
    if isinstance(error, QueryError):
        return error
    condition = ""
    for getter in ("getCondition", "getErrorClass"):
        if hasattr(error, getter):
            condition = getattr(error, getter)() or ""
            break
    text = str(error)
    for name, kind in _BY_CONDITION:
        if condition.startswith(name) or f"[{name}" in text:
            return kind(text.splitlines()[0][:500])
    return ExecutionError(text.splitlines()[0][:500] if text else type(error).__name__)

"""INSERT, UPDATE, DELETE, CREATE TABLE and ALTER TABLE as transformations of one snapshot into the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateColumn, InvalidOperation, StorageError
from ..functions import scalar
from ..sources.tables import ColumnDef, TableDef, TableStore, new_column
from ..types import SPARK_TYPES, cast_column, stored_value
from . import syntax as s
from .lowering import Scope, Slot, literal_value, lowered, resolved


def _row_scope(table: TableDef) -> Scope:
    return Scope(tuple((table.name, c.name, Slot(c.name, c.kind, c.name)) for c in table.columns))


def _condition(table: TableDef, where: s.Expression | None) -> Column:
    """True where the statement applies; null counts as false."""
    if where is None:
        return F.lit(True)
    return F.coalesce(scalar.truth(lowered(resolved(where, _row_scope(table)))), F.lit(False))


def _refuse_null(column: ColumnDef, value: object) -> None:
    if value is None and not column.nullable:
        raise InvalidOperation(f"NULL in NOT NULL column {column.name}")


def _spec_column(spec: s.ColumnSpec) -> ColumnDef:
    if spec.default is None:
        return new_column(spec.name, spec.kind, spec.nullable, spec.primary_key)
    value = literal_value(spec.default)
    stored_value(value, spec.kind)  # a default that cannot be stored is an error at once
    return new_column(spec.name, spec.kind, spec.nullable, spec.primary_key, True, value)


def create_table(store: TableStore, statement: s.CreateTable) -> TableDef:
    names = [c.name.lower() for c in statement.columns]
    for name in names:
        if names.count(name) > 1:
            raise DuplicateColumn(name)
    return store.create(TableDef(statement.table, tuple(map(_spec_column, statement.columns))))


def insert(store: TableStore, statement: s.Insert) -> int:
    """Adds rows as new files. An omitted column takes its default; an explicit NULL stays NULL."""
    table = store.load(statement.table)
    columns = [table.column(n) for n in statement.columns] if statement.columns else list(table.columns)
    if len({c.name for c in columns}) < len(columns):
        raise DuplicateColumn("in the column list")
    rows = []
    for values in statement.rows:
        if len(values) != len(columns):
            raise InvalidOperation(f"{len(values)} values for {len(columns)} columns")
        given = {c.name: stored_value(literal_value(v), c.kind) for c, v in zip(columns, values, strict=True)}
        row = []
        for column in table.columns:
            value = given[column.name] if column.name in given else stored_value(column.default, column.kind) if column.has_default else None
            _refuse_null(column, value)
            row.append(value)
        rows.append(tuple(row))
    return append(store, table, store.spark.createDataFrame(rows, table.schema()).coalesce(1), len(rows))


def append(store: TableStore, table: TableDef, frame: DataFrame, rows: int) -> int:
    """Adds the rows of a DataFrame with the table's columns."""
    store.commit(replace(table, files=table.files + store.write(table, frame)))
    return rows


def _touched(store: TableStore, table: TableDef, condition: Column, broken: Column | None) -> tuple[int, list[str]]:
    """(rows that the condition holds for, files that hold them), in one pass that also looks for broken constraints."""
    frame = store.read(table, with_file=True).where(condition)
    measures = [F.count(F.lit(1)).alias("n")] + ([F.max(broken.cast("int")).alias("bad")] if broken is not None else [])
    found = frame.groupBy("__file").agg(*measures).collect()  # a row per file at most
    if broken is not None and any(r["bad"] for r in found):
        raise InvalidOperation("NULL in a NOT NULL column")
    return sum(r["n"] for r in found), [store.plain_path(r["__file"]) for r in found]


def _rewrite(store: TableStore, table: TableDef, files: list[str], change: Callable[[DataFrame], DataFrame]) -> None:
    """A new version in which ``files`` are replaced by their changed rows."""
    touched = set(files)
    if unknown := touched - set(table.files):
        raise StorageError(f"{len(unknown)} files with affected rows are not in the manifest of {table.name}")
    changed, kept = (tuple(f for f in table.files if (f in touched) is taken) for taken in (True, False))
    store.commit(replace(table, files=kept + store.write(table, change(store.read(table, changed)))))


def update(store: TableStore, statement: s.Update) -> int:
    """Assigned values see the row as it was and are cast to their column's type; a failed cast changes nothing."""
    table = store.load(statement.table)
    scope, condition = _row_scope(table), _condition(table, statement.where)
    values: dict[str, Column] = {}
    for name, expression in statement.assignments:
        column = table.column(name)
        if column.name in values:
            raise DuplicateColumn(name)
        value, kind = lowered(resolved(expression, scope))
        values[column.name] = cast_column(value, kind, column.kind)
    strict = [values[c.name].isNull() for c in table.columns if c.name in values and not c.nullable]
    broken = None
    for x in strict:
        broken = x if broken is None else broken | x
    n, files = _touched(store, table, condition, broken)
    if n:
        outputs = [F.when(condition, values[c.name]).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in values else F.col(f"`{c.name}`") for c in table.columns]
        _rewrite(store, table, files, lambda frame: frame.select(*outputs))
    return n


def delete(store: TableStore, statement: s.Delete) -> int:
    """Removes rows whose condition is true; null and false stay."""
    table = store.load(statement.table)
    condition = _condition(table, statement.where)
    n, files = _touched(store, table, condition, None)
    if n and statement.where is None:
        store.commit(replace(table, files=()))
    elif n:
        _rewrite(store, table, files, lambda frame: frame.where(~condition))
    return n


def alter_table(store: TableStore, statement: s.AlterTable) -> TableDef:
    table = store.load(statement.table)
    match statement.action:
        case "add":
            return _add_column(store, table, statement.column)
        case "drop":
            gone = table.column(statement.name)
            if len(table.columns) == 1:
                raise InvalidOperation("the last column cannot be dropped")
            return store.commit(replace(table, columns=tuple(c for c in table.columns if c is not gone)))
        case "rename":
            old = table.column(statement.name)
            if table.has(statement.new_name) and statement.new_name.lower() != old.name.lower():
                raise DuplicateColumn(statement.new_name)
            return store.commit(replace(table, columns=tuple(replace(c, name=statement.new_name) if c is old else c for c in table.columns)))
        case "type":
            return _change_type(store, table, statement)
    raise InvalidOperation(statement.action)


def _has_rows(store: TableStore, table: TableDef) -> bool:
    return bool(table.files) and not store.read(table).isEmpty()


def _add_column(store: TableStore, table: TableDef, spec: s.ColumnSpec) -> TableDef:
    if table.has(spec.name):
        raise DuplicateColumn(spec.name)
    column = _spec_column(spec)
    after = replace(table, columns=(*table.columns, column))
    if not _has_rows(store, table):
        return store.commit(after)
    value = stored_value(column.default, column.kind) if column.has_default else None
    if value is None:
        if not column.nullable:
            raise InvalidOperation(f"NOT NULL column {column.name} needs a DEFAULT, as the table has rows")
        return store.commit(after)  # files without the column read as NULL
    filled = store.read(table).withColumn(column.name, F.lit(value).cast(SPARK_TYPES[column.kind]))
    return store.commit(replace(after, files=store.write(after, filled)))


def _change_type(store: TableStore, table: TableDef, statement: s.AlterTable) -> TableDef:
    old = table.column(statement.name)
    if old.kind is statement.kind:
        return table
    default = old.default
    if old.has_default:
        stored_value(default, statement.kind)
    column = new_column(old.name, statement.kind, old.nullable, old.primary_key, old.has_default, default)
    after = replace(table, columns=tuple(column if c is old else c for c in table.columns))
    if not _has_rows(store, table):
        return store.commit(replace(after, files=()))
    cast = store.read(table).withColumn(old.name, cast_column(F.col(f"`{old.name}`"), old.kind, statement.kind))
    return store.commit(replace(after, files=store.write(after, cast)))


"""Statements in, DataFrames out."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import CatalogError, QueryError, SchemaNotFound, TableAlreadyExists, TableNotFound, TransactionError, translated
from .plans import statements as st
from .plans import syntax as s
from .plans.lowering import lower_select
from .plans.parser import parse
from .session import require_ansi
from .sources.tables import TableDef, TableStore, Transaction


class Engine:
    """Runs statements of the dialect over its own tables and over registered DataFrames.

    ``root`` is the folder of the engine's tables, on storage that the cluster shares; without one there are only
    registered, read-only tables. A SELECT is lazy; its errors at run time are Spark's, which ``collect`` translates.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        require_ansi(spark)
        self.spark = spark
        self.root = root.rstrip("/") if root else None
        self.store = TableStore(spark, root) if root else None
        self.schema = ""
        self._views: dict[str, DataFrame | Callable[[], DataFrame]] = {}

    # catalog

    def register(self, name: str, frame: DataFrame | Callable[[], DataFrame]) -> None:
        """Makes a DataFrame readable as a table; what gives one is called when a statement first needs it."""
        if self.store and self.store.exists(name):
            raise TableAlreadyExists(name)
        self._views[name.lower()] = frame

    def register_folder(self, folder: str, names: Iterable[str]) -> None:
        """Registers ``folder/name.parquet`` for each name; files are read when a statement needs them."""
        for name in names:
            self.register(name, functools.partial(self.spark.read.parquet, f"{folder}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        view = self._views.get(name.lower())
        if view is not None:
            if not isinstance(view, DataFrame):
                view = self._views[name.lower()] = view()
            return view
        if self.store is None:
            raise TableNotFound(name)
        return self.store.read(self.store.load(name))

    def definition(self, name: str) -> TableDef:
        return self._own().load(name)

    def tables(self) -> list[str]:
        return sorted([*self._views, *(self.store.names() if self.store else [])], key=str.lower)

    def drop_table(self, name: str) -> None:
        if self._views.pop(name.lower(), None) is None:
            self._own().drop(name)

    # schemas: the root folder's own tables, and folders of further tables

    def _schemas(self) -> TableStore:
        self._own()
        return TableStore(self.spark, f"{self.root}/_schemas")

    def create_schema(self, name: str) -> None:
        """Makes a schema: a set of tables of its own, whose names are free to equal those of others."""
        if not re.fullmatch(r"[^\W\d]\w*", name):
            raise CatalogError(f"{name!r} is no name of a schema")
        if name.lower() in self.schemas():
            raise CatalogError(f"schema {name} exists")
        TableStore(self.spark, f"{self._schemas().root}/{name.lower()}").prepare()

    def schemas(self) -> list[str]:
        return self._schemas().folders()

    def use_schema(self, name: str = "") -> None:
        """Statements from now on read and write the tables of this schema; without a name those of the root folder."""
        if name and name.lower() not in self.schemas():
            raise SchemaNotFound(name)
        if isinstance(self.store, Transaction):
            raise TransactionError("a transaction stays within one schema")
        self.schema = name.lower()
        self.store = TableStore(self.spark, f"{self.root}/_schemas/{self.schema}" if name else self.root)

    @contextmanager
    def transaction(self) -> Iterator[Engine]:
        """An engine whose statements happen together: all of them when the block ends, none if it raises."""
        inner = Engine(self.spark)
        inner.root, inner.schema, inner._views = self.root, self.schema, self._views
        inner.store = Transaction(self._own())
        yield inner
        inner.store.finish()

    def _own(self) -> TableStore:
        if self.store is None:
            raise CatalogError("the engine has no folder for tables")
        return self.store

    def _writable(self, name: str) -> TableStore:
        if name.lower() in self._views:
            raise CatalogError(f"{name} is read-only")
        return self._own()

    # statements

    def sql(self, text: str) -> DataFrame:
        """The result of one statement: rows of a SELECT, else one row with the status."""
        return self.execute(parse(text))

    def execute(self, statement: s.Statement) -> DataFrame:
        try:
            match statement:
                case s.Select():
                    return lower_select(self.spark, statement, self.table)
                case s.Insert():
                    st.insert(self._writable(statement.table), statement)
                    return self._status("Insert successful")
                case s.Update():
                    return self._status("Update successful", st.update(self._writable(statement.table), statement))
                case s.Delete():
                    return self._status("Delete successful", st.delete(self._writable(statement.table), statement))
                case s.CreateTable():
                    if statement.table.lower() in self._views:
                        raise TableAlreadyExists(statement.table)
                    st.create_table(self._own(), statement)
                    return self._status(f"Table {statement.table} created")
                case s.AlterTable():
                    st.alter_table(self._writable(statement.table), statement)
                    return self._status(f"Table {statement.table} altered")
        except QueryError:
            raise
        except Exception as error:
            raise translated(error) from error
        raise CatalogError(f"unknown statement {statement}")

    def collect(self, text: str) -> list:
        """Rows of a statement, with Spark's run-time errors as the engine's."""
        frame = self.sql(text)
        try:
            return frame.collect()
        except Exception as error:
            raise translated(error) from error

    def _status(self, text: str, rows: int | None = None) -> DataFrame:
        if rows is None:
            return self.spark.createDataFrame([(text,)], "status string")
        return self.spark.createDataFrame([(text, rows)], "status string, rows_affected bigint")

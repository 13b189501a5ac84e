"""Command line: a shell, single statements, creating a database folder and listing what is in one."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from .engine import Engine
from .errors import QueryError
from .session import build_session

PROMPT = "tessera> "
HELP = """Statements:
  SELECT ... FROM ... [WHERE] [GROUP BY] [HAVING] [ORDER BY] [LIMIT]
  INSERT INTO table [(columns)] VALUES (...)
  UPDATE table SET column = value [WHERE]
  DELETE FROM table [WHERE]
  CREATE TABLE table (column TYPE [NOT NULL] [PRIMARY KEY] [DEFAULT value], ...)
  ALTER TABLE table ADD | DROP | RENAME ... TO | ALTER ... TYPE
Aggregates: COUNT, SUM, AVG, MIN, MAX.  Functions: UPPER, LOWER, ABS.
Commands: help, exit, quit"""
SHOWN_ROWS = 1000


def shown(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def table_text(columns: list[str], rows: list, more: bool = False) -> str:
    """Rows as a bordered table with a row count."""
    cells = [[shown(v) for v in row] for row in rows]
    widths = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda values: "|" + "|".join(f" {v:<{w}} " for v, w in zip(values, widths, strict=True)) + "|"
    count = f"({len(rows)}{'+' if more else ''} row{'' if len(rows) == 1 else 's'})"
    return "\n".join([rule, line(columns), rule, *map(line, cells), *([rule] if cells else []), count])


def run_statement(engine: Engine, text: str, out: Callable[[str], None] = print) -> bool:
    """Runs a statement and prints its result, or its error; at most SHOWN_ROWS rows come to the driver."""
    try:
        frame = engine.sql(text)
        rows = frame.take(SHOWN_ROWS + 1)
        out(table_text(frame.columns, rows[:SHOWN_ROWS], len(rows) > SHOWN_ROWS))
    except QueryError as error:
        out(f"Error: {error}")
        return False
    except Exception as error:
        from .errors import translated

        out(f"Error: {translated(error)}")
        return False
    return True


def shell(engine: Engine, read: Callable[[str], str] = input, out: Callable[[str], None] = print) -> None:
    out("Type 'help' for help, 'exit' to leave.")
    while True:
        try:
            line = read(PROMPT).strip()
        except (EOFError, KeyboardInterrupt):
            break
        match line.lower():
            case "":
                continue
            case "exit" | "quit":
                break
            case "help":
                out(HELP)
            case _:
                run_statement(engine, line, out)
    out("Goodbye!")


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--db", default="tessera-db", help="folder of the tables")
    parser.add_argument("--master", default=None, help="Spark master")
    commands = parser.add_subparsers(dest="command")
    commands.add_parser("shell", help="interactive shell (the default)")
    commands.add_parser("query", help="run one statement").add_argument("statement")
    commands.add_parser("create", help="create the folder")
    commands.add_parser("info", help="list tables")
    chosen = parser.parse_args(arguments)
    root = chosen.db if "://" in chosen.db else os.path.abspath(chosen.db)
    engine = Engine(build_session(master=chosen.master), root)
    match chosen.command:
        case "query":
            return 0 if run_statement(engine, chosen.statement) else 1
        case "create":
            engine.store.prepare()
            print(f"Database created at {root}")
        case "info":
            print(f"Database: {root}")
            for name in engine.tables():
                table = engine.definition(name)
                print(f"  {table.name} (version {table.version}): " + ", ".join(f"{c.name} {c.kind.value}" for c in table.columns))
            print(f"{len(engine.tables())} table(s)")
        case _:
            shell(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main())

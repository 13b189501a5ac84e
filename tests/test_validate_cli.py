import pytest

from tessera import cli
from tessera import validate as v
from tessera.plans.parser import parse
from tessera.sources.tables import TableDef, new_column
from tessera.types import Kind

TABLE = TableDef(
    "p",
    (
        new_column("id", Kind.INTEGER, primary_key=True),
        new_column("name", Kind.TEXT, nullable=False),
        new_column("salary", Kind.FLOAT),
        new_column("active", Kind.BOOLEAN, nullable=False, has_default=True, default=True),
    ),
)


def kind(text):
    return v.expression_kind(parse(f"SELECT {text} FROM p").outputs[0].expression, TABLE)


def test_rows():
    v.validate_row({"id": 1, "name": "x", "salary": 5}, TABLE)
    for row, error in (({"id": 1}, v.MissingValue), ({"id": None, "name": "x"}, v.NullNotAllowed), ({"id": 1, "name": "x", "no": 1}, v.UnknownColumn), ({"id": "1", "name": "x"}, v.KindMismatch)):
        with pytest.raises(error):
            v.validate_row(row, TABLE)


def test_frames(spark):
    good = spark.createDataFrame([(1, "x", 2.0)], "id bigint, name string, salary double")
    v.validate_frame(good, TABLE)
    with pytest.raises(v.NullNotAllowed):
        v.validate_frame(spark.createDataFrame([(1, None)], "id bigint, name string"), TABLE)
    with pytest.raises(v.MissingValue):
        v.validate_frame(spark.createDataFrame([(1,)], "id bigint"), TABLE)


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("id + 1", Kind.INTEGER), ("id * salary", Kind.FLOAT), ("name + 'x'", Kind.TEXT), ("id = salary", Kind.BOOLEAN), ("UPPER(name)", Kind.TEXT), ("ABS(salary)", Kind.FLOAT), ("COUNT(*)", Kind.INTEGER), ("AVG(id)", Kind.FLOAT), ("CASE WHEN active THEN 1 ELSE 2.0 END", Kind.FLOAT), ("NOT active", Kind.BOOLEAN), ("name IS NULL", Kind.BOOLEAN)],
)
def test_expression_kinds(text, wanted):
    assert kind(text) is wanted


@pytest.mark.parametrize("text", ["id + name", "name = 1", "active AND id", "NOT id", "UPPER(id)", "ABS(name)", "FOO(id)", "SUM(name)", "missing"])
def test_expression_errors(text):
    with pytest.raises(v.ValidationError):
        kind(text)


def test_conversions():
    assert v.convert_to(5, Kind.FLOAT) == 5.0 and v.convert_to(2.0, Kind.INTEGER) == 2 and v.convert_to("Yes", Kind.BOOLEAN) is True and v.convert_to(1.0, Kind.TEXT) == "1" and v.convert_to("2024-02-29", Kind.DATE).day == 29
    for value, target, error in ((2.5, Kind.INTEGER, v.ValueOutOfRange), ("abc", Kind.INTEGER, v.KindMismatch), (" 12 ", Kind.INTEGER, v.KindMismatch), ("2024", Kind.DATE, v.InvalidDate), ("2024-02-30", Kind.DATE, v.InvalidDate), ("a-b-c", Kind.DATE, v.InvalidDate), ("x", Kind.TIMESTAMP, v.InvalidTimestamp)):
        with pytest.raises(error):
            v.convert_to(value, target)


def test_shell(engine):
    lines = iter(["help", "", "CREATE TABLE t (id INT, b BOOLEAN)", "INSERT INTO t VALUES (1, TRUE), (2, NULL)", "SELECT * FROM t ORDER BY id", "SELECT nope FROM t", "SELECT id / 0 AS x FROM t", "exit"])
    out = []
    cli.shell(engine, lambda prompt: next(lines), out.append)
    text = "\n".join(out)
    assert "| 1  | true |" in text and "| 2  | NULL |" in text and "(2 rows)" in text and "Column not found: nope" in text and "Division by zero" in text and out[-1] == "Goodbye!"


def test_query_command(spark, tmp_path, capsys):
    root = str(tmp_path / "db")
    assert cli.main(["--db", root, "create"]) == 0
    assert cli.main(["--db", root, "query", "CREATE TABLE c (id INT)"]) == 0
    assert cli.main(["--db", root, "query", "SELECT broken"]) == 1
    assert cli.main(["--db", root, "info"]) == 0
    assert "c (version 1): id INTEGER" in capsys.readouterr().out

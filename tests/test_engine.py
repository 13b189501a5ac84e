import math

import pytest

from tessera import errors as e

GOODS = [
    (1, "Kayak", "Water", 640.0), (2, "Paddle", "Water", 48.0), (3, "Tent", "Camp", 210.0), (4, "Stove", "Camp", 72.5), (5, "Rope", "Climb", 99.0),
    (6, "Harness", "Climb", 61.0), (7, "Drysuit", "Water", 512.0), (8, "Lantern", "Camp", 8.5), (9, "Chalk", "Climb", None),
]


@pytest.fixture
def shop(spark):
    from tessera.engine import Engine

    engine = Engine(spark)
    engine.register("goods", spark.createDataFrame(GOODS, "id bigint, name string, category string, price double"))
    engine.register("nums", spark.createDataFrame([(-7, 2.5, "x"), (7, 0.0, None), (None, None, "Y")], "a bigint, b double, c string"))
    return engine


def rows(engine, text):
    return [tuple(r) for r in engine.collect(text)]


def test_aggregates(shop):
    assert rows(shop, "SELECT COUNT(*) FROM goods") == [(9,)]
    found = rows(shop, "SELECT category, COUNT(*), SUM(price), AVG(price), MIN(price), MAX(price) FROM goods GROUP BY category ORDER BY category")
    assert found == [("Camp", 3, 291.0, 97.0, 8.5, 210.0), ("Climb", 3, 160.0, 80.0, 61.0, 99.0), ("Water", 3, 1200.0, 400.0, 48.0, 640.0)]
    assert rows(shop, "SELECT category, SUM(price) FROM goods GROUP BY category HAVING SUM(price) > 300.0") == [("Water", 1200.0)]
    found = rows(shop, "SELECT category, AVG(price) AS mean FROM goods WHERE price > 50.00 GROUP BY category HAVING COUNT(*) >= 2 ORDER BY mean DESC")
    assert [x for x, _ in found] == ["Water", "Camp", "Climb"] and math.isclose(found[1][1], 141.25)
    assert rows(shop, "SELECT COUNT(*), SUM(price) FROM goods WHERE id > 100") == [(0, None)]
    assert rows(shop, "SELECT COUNT(price), COUNT(DISTINCT category) FROM goods") == [(8, 3)]


def test_names(shop):
    frame = shop.sql("SELECT name, COUNT(*), SUM(price), id % 5, id AS k FROM goods GROUP BY name, id % 5, id")
    assert frame.columns == ["name", "COUNT(*)", "SUM(price)", "(id % 5)", "k"]


def test_integer_arithmetic(shop):
    assert rows(shop, "SELECT a / 2 AS q, a % 3 AS r, a * 2 AS m FROM nums WHERE a < 0") == [(-3, -1, -14)]
    assert rows(shop, "SELECT 7 / 2 AS i, 7 / 2.0 AS f, 'a' + 'b' AS t FROM nums WHERE a IS NULL") == [(3, 3.5, "ab")]
    with pytest.raises(e.DivisionByZero):
        rows(shop, "SELECT a / 0 AS x FROM nums")
    with pytest.raises(e.DivisionByZero):
        rows(shop, "SELECT a % 0 AS x FROM nums")
    with pytest.raises(e.DivisionByZero):
        rows(shop, "SELECT 1.5 / b AS x FROM nums")
    with pytest.raises(e.NumericOverflow):
        rows(shop, "SELECT a + 9223372036854775807 AS x FROM nums")
    with pytest.raises(e.NumericOverflow):
        rows(shop, "SELECT SUM(x.a * 1000000000000000000) AS s FROM nums x, nums y WHERE x.a > 0")


@pytest.mark.parametrize("text", ["a + c", "c * 2", "a % 2.0", "-c", "a = c", "NOT a", "a AND TRUE", "UPPER(a)", "ABS(c)"])
def test_type_errors(shop, text):
    with pytest.raises(e.TypeMismatch):
        shop.sql(f"SELECT {text} AS x FROM nums")


def test_three_valued_logic(shop):
    assert rows(shop, "SELECT a FROM nums WHERE a > 0 OR NULL") == [(7,)]
    assert rows(shop, "SELECT (FALSE AND NULL) AS f, (TRUE OR NULL) AS t FROM nums WHERE a > 0") == [(False, True)]
    assert rows(shop, "SELECT CASE b WHEN NULL THEN 1 ELSE 2 END AS x FROM nums WHERE b IS NULL") == [(2,)]


def test_order(shop):
    assert [r[0] for r in rows(shop, "SELECT a FROM nums ORDER BY a")] == [None, -7, 7]
    assert [r[0] for r in rows(shop, "SELECT a FROM nums ORDER BY a DESC")] == [7, -7, None]
    assert [r[0] for r in rows(shop, "SELECT c FROM nums ORDER BY CASE WHEN c IS NULL THEN 0 ELSE 1 END, a DESC")] == [None, "x", "Y"]
    assert [r[0] for r in rows(shop, "SELECT name FROM goods ORDER BY price DESC, id LIMIT 2")] == ["Kayak", "Drysuit"]
    assert len(rows(shop, "SELECT id FROM goods ORDER BY 1")) == 9  # a constant, not an ordinal


def test_resolution_errors(shop):
    for text in ("SELECT nope FROM nums", "SELECT x.a FROM nums", "SELECT nope(a) FROM nums"):
        with pytest.raises(e.ColumnNotFound):
            shop.sql(text)
    with pytest.raises(e.TableNotFound):
        shop.sql("SELECT a FROM nowhere")
    with pytest.raises(e.PlanningError):
        shop.sql("SELECT a FROM nums x JOIN nums y ON x.a = y.a")
    with pytest.raises(e.DuplicateColumn):
        shop.sql("SELECT * FROM nums x JOIN nums y ON x.a = y.a")
    with pytest.raises(e.PlanningError):
        shop.sql("SELECT name, COUNT(*) FROM goods GROUP BY category")
    with pytest.raises(e.CatalogError):
        shop.sql("DELETE FROM nums")


def test_joins(engine):
    for text in (
        "CREATE TABLE l (id INT PRIMARY KEY, value TEXT)", "INSERT INTO l VALUES (100, 'TestA'), (101, 'TestB'), (102, 'TestC')",
        "CREATE TABLE r (id INT PRIMARY KEY, fk_id INT, data TEXT)", "INSERT INTO r VALUES (200, 100, 'DataOne'), (201, 101, 'DataTwo'), (202, 100, 'DataThree'), (203, NULL, 'DataFour')",
    ):
        engine.sql(text)
    inner = {("TestA", "DataOne"), ("TestA", "DataThree"), ("TestB", "DataTwo")}
    select = "SELECT l.value, r.data FROM l {} JOIN r ON l.id = r.fk_id"
    assert set(rows(engine, select.format(""))) == inner
    assert set(rows(engine, select.format("LEFT"))) == inner | {("TestC", None)}
    assert set(rows(engine, select.format("RIGHT"))) == inner | {(None, "DataFour")}
    assert set(rows(engine, select.format("FULL"))) == inner | {("TestC", None), (None, "DataFour")}
    assert len(rows(engine, "SELECT l.id, r.data FROM l CROSS JOIN r")) == 12
    assert len(rows(engine, "SELECT l.id, r.data FROM l, r WHERE l.id < r.fk_id")) == 1


def test_update_delete(engine):
    engine.sql("CREATE TABLE p (id INT PRIMARY KEY, name TEXT, age INT, city TEXT)")
    engine.sql("INSERT INTO p VALUES (1, 'Alice', 30, 'New York'), (2, 'Bob', 24, 'London'), (3, 'Charlie', 35, 'Paris'), (4, 'David', 28, 'New York')")
    assert rows(engine, "UPDATE p SET age = age + 1, city = 'Brooklyn' WHERE city = 'New York'")[0][1] == 2
    assert rows(engine, "SELECT id, age, city FROM p ORDER BY id") == [(1, 31, "Brooklyn"), (2, 24, "London"), (3, 35, "Paris"), (4, 29, "Brooklyn")]
    assert rows(engine, "UPDATE p SET city = NULL WHERE id = 2")[0][1] == 1
    assert rows(engine, "DELETE FROM p WHERE city = 'Paris'")[0][1] == 1
    assert rows(engine, "SELECT COUNT(*) FROM p") == [(3,)]
    assert rows(engine, "DELETE FROM p")[0][1] == 3
    assert rows(engine, "SELECT * FROM p") == []


def test_update_rewrites_only_touched_files(engine):
    engine.sql("CREATE TABLE p (id INT, x INT)")
    engine.sql("INSERT INTO p VALUES (1, 1)")
    engine.sql("INSERT INTO p VALUES (2, 2)")
    before = set(engine.definition("p").files)
    engine.sql("UPDATE p SET x = 5 WHERE id = 2")
    after = set(engine.definition("p").files)
    assert len(before & after) == 1 and len(after) == 2


def test_constraints(engine):
    engine.sql("CREATE TABLE n (id INT NOT NULL, x INT DEFAULT 3)")
    for text in ("INSERT INTO n VALUES (NULL, 1)", "INSERT INTO n (x) VALUES (1)", "INSERT INTO n (id) VALUES (1, 2)"):
        with pytest.raises(e.InvalidOperation):
            engine.sql(text)
    engine.sql("INSERT INTO n (id) VALUES (1)")
    with pytest.raises(e.InvalidOperation):
        engine.sql("UPDATE n SET id = NULL")
    with pytest.raises(e.TypeMismatch):
        engine.sql("INSERT INTO n VALUES ('abc', 1)")
    with pytest.raises(e.TypeMismatch):
        engine.sql("INSERT INTO n VALUES (TRUE, 1)")
    with pytest.raises(e.DuplicateColumn):
        engine.sql("CREATE TABLE m (a INT, A TEXT)")
    with pytest.raises(e.TableAlreadyExists):
        engine.sql("CREATE TABLE N (a INT)")
    assert rows(engine, "SELECT * FROM n") == [(1, 3)]


def test_failed_statements_change_nothing(engine):
    engine.sql("CREATE TABLE a (id INT, v TEXT)")
    engine.sql("INSERT INTO a VALUES (1, '12'), (2, 'abc')")
    version = engine.definition("a").version
    with pytest.raises(e.TypeMismatch):
        engine.sql("ALTER TABLE a ALTER COLUMN v TYPE INT")
    with pytest.raises(e.DivisionByZero):
        engine.sql("UPDATE a SET id = id / 0")
    assert engine.definition("a").version == version
    assert rows(engine, "SELECT v FROM a ORDER BY id") == [("12",), ("abc",)]


def test_overtaken_statement_fails(engine):
    engine.sql("CREATE TABLE a (id INT)")
    stale = engine.definition("a")
    engine.sql("INSERT INTO a VALUES (1)")
    with pytest.raises(e.TransactionError):
        engine.store.commit(stale)


def test_alter(engine):
    engine.sql("CREATE TABLE t (id INT, value INT)")
    engine.sql("INSERT INTO t VALUES (1, 10)")
    engine.sql("ALTER TABLE t ADD COLUMN category TEXT DEFAULT 'General'")
    engine.sql("ALTER TABLE t ADD COLUMN name TEXT NOT NULL DEFAULT 'DefaultName'")
    engine.sql("INSERT INTO t (id, value, category) VALUES (2, 20, NULL)")
    assert rows(engine, "SELECT * FROM t ORDER BY id") == [(1, 10, "General", "DefaultName"), (2, 20, None, "DefaultName")]
    with pytest.raises(e.InvalidOperation):
        engine.sql("ALTER TABLE t ADD COLUMN must INT NOT NULL")
    with pytest.raises(e.DuplicateColumn):
        engine.sql("ALTER TABLE t ADD COLUMN value INT")
    engine.sql("ALTER TABLE t RENAME COLUMN value TO amount")
    assert rows(engine, "SELECT amount FROM t WHERE id = 2") == [(20,)]
    with pytest.raises(e.DuplicateColumn):
        engine.sql("ALTER TABLE t RENAME COLUMN amount TO id")
    with pytest.raises(e.ColumnNotFound):
        engine.sql("ALTER TABLE t RENAME COLUMN nope TO x")
    for column in ("category", "name", "amount"):
        engine.sql(f"ALTER TABLE t DROP COLUMN {column}")
    with pytest.raises(e.InvalidOperation):
        engine.sql("ALTER TABLE t DROP COLUMN id")
    with pytest.raises(e.TableNotFound):
        engine.sql("ALTER TABLE nowhere ADD COLUMN x INT")


@pytest.mark.parametrize(
    ("old", "new", "given", "wanted"),
    [
        ("INT", "FLOAT", ["10", "-5", "0"], [10.0, -5.0, 0.0]),
        ("TEXT", "INT", ["'123'", "'-456'", "NULL", "'0'"], [123, -456, None, 0]),
        ("INT", "TEXT", ["123", "-456", "0"], ["123", "-456", "0"]),
        ("FLOAT", "INT", ["123.789", "-456.123", "0.0", "NULL"], [123, -456, 0, None]),
        ("BOOLEAN", "TEXT", ["TRUE", "FALSE", "NULL"], ["true", "false", None]),
        ("TEXT", "BOOLEAN", ["'true'", "'FALSE'", "'t'", "'F'", "'1'", "'0'", "NULL"], [True, False, True, False, True, False, None]),
    ],
)
def test_alter_type(engine, old, new, given, wanted):
    engine.sql(f"CREATE TABLE t (k INT, v {old})")
    engine.sql("INSERT INTO t VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(given)))
    engine.sql(f"ALTER TABLE t ALTER COLUMN v TYPE {new}")
    assert [r[0] for r in rows(engine, "SELECT v FROM t ORDER BY k")] == wanted


@pytest.mark.parametrize("value", ["'notabool'", "'yes'"])
def test_alter_type_refuses(engine, value):
    engine.sql("CREATE TABLE t (v TEXT)")
    engine.sql(f"INSERT INTO t VALUES ({value})")
    with pytest.raises(e.TypeMismatch):
        engine.sql("ALTER TABLE t ALTER COLUMN v TYPE BOOLEAN")


def test_tables_outlive_the_engine(spark, engine):
    from tessera.engine import Engine

    engine.sql("CREATE TABLE kept (id INT, day DATE, at TIMESTAMP)")
    engine.sql("INSERT INTO kept VALUES (1, '2024-05-06', '2024-05-06 07:08:09')")
    again = Engine(spark, engine.store.root)
    assert again.tables() == ["kept"]
    assert rows(again, "SELECT id FROM kept WHERE day = '2024-05-06' AND at > '2024-05-06 00:00:00'") == [(1,)]


def test_plan_prunes_and_pushes(spark, tmp_path):
    from tessera.engine import Engine

    spark.range(100).selectExpr("id", "id * 2 AS x", "'wide' AS w").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark)
    engine.register("t", spark.read.parquet(str(tmp_path / "t")))
    plan = engine.sql("SELECT x FROM t WHERE id > 90")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "w:string" not in plan


@pytest.mark.parametrize("name", ["with space", "per%41cent", "a+b", "plain"])
def test_changes_reach_files_on_odd_paths(spark, tmp_path, name):
    from tessera.engine import Engine

    engine = Engine(spark, str(tmp_path / name))
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    engine.sql("INSERT INTO t VALUES (3, 'c')")
    assert rows(engine, "UPDATE t SET v = 'x' WHERE id = 1")[0][1] == 1
    assert rows(engine, "DELETE FROM t WHERE id = 3")[0][1] == 1
    assert rows(engine, "SELECT id, v FROM t ORDER BY id") == [(1, "x"), (2, "b")]


def test_lost_statements_leave_no_lock(engine):
    """A driver that is lost after its files, or after its draft, leaves the table as it was and open to the next statement."""
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY)")
    engine.sql("INSERT INTO t VALUES (1)")
    table, folder = engine.definition("t"), f"{engine.store.root}/t"
    engine.store.write(table, engine.store.read(table))
    with open(f"{folder}/_draft-lost.json", "w") as out:
        out.write('{"name": ')
    assert rows(engine, "SELECT id FROM t") == [(1,)]
    engine.sql("INSERT INTO t VALUES (2)")
    engine.sql("UPDATE t SET id = id + 10 WHERE id = 2")
    assert rows(engine, "SELECT id FROM t ORDER BY id") == [(1,), (12,)]
    assert engine.store.vacuum("t") >= 4 and engine.store.vacuum("t") == 0
    assert rows(engine, "SELECT id FROM t ORDER BY id") == [(1,), (12,)]


def test_compact_sorts_by_the_key(engine):
    engine.sql("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    for i in (3, 1, 2):
        engine.sql(f"INSERT INTO t VALUES ({i}, 'v{i}')")
    version = engine.definition("t").version
    engine.store.compact("t")
    after = engine.definition("t")
    assert after.version == version + 1 and len(after.files) == 1
    assert rows(engine, "SELECT id, v FROM t") == [(1, "v1"), (2, "v2"), (3, "v3")]


def test_statements_of_a_transaction_happen_together(engine, spark):
    engine.sql("CREATE TABLE a (id INT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO a VALUES (1, 10), (2, 20)")
    count = lambda on, t: on.collect(f"SELECT COUNT(*) AS n FROM {t}")[0]["n"]
    with engine.transaction() as t:
        t.sql("INSERT INTO a VALUES (3, 30)")
        t.sql("CREATE TABLE b (id INT)")
        t.sql("INSERT INTO b VALUES (7)")
        t.sql("UPDATE a SET v = v + 1 WHERE id < 3")
        t.sql("ALTER TABLE b ADD COLUMN w TEXT DEFAULT 'x'")
        assert count(t, "a") == 3 and count(t, "b") == 1 and count(engine, "a") == 2 and engine.tables() == ["a"] and t.tables() == ["a", "b"]
    assert sorted(map(tuple, engine.collect("SELECT id, v FROM a"))) == [(1, 11), (2, 21), (3, 30)] and engine.collect("SELECT w FROM b")[0]["w"] == "x"
    with pytest.raises(e.QueryError), engine.transaction() as t:
        t.sql("DELETE FROM a")
        t.sql("INSERT INTO nowhere VALUES (1)")
    assert count(engine, "a") == 3
    with pytest.raises(e.TransactionError), engine.transaction() as t:
        t.sql("DELETE FROM b")
        t.sql("INSERT INTO a VALUES (4, 40)")
        engine.sql("INSERT INTO a VALUES (5, 50)")  # overtakes
    assert count(engine, "a") == 4 and count(engine, "b") == 1
    assert engine.store.vacuum("a") > 0 and count(engine, "a") == 4
    with engine.transaction() as t, pytest.raises(e.TransactionError):
        t.drop_table("a")


def test_a_lost_transaction_is_no_lock(engine):
    from tessera.sources.tables import Transaction

    for name in ("a", "b"):
        engine.sql(f"CREATE TABLE {name} (id INT)")
    count = lambda t: engine.collect(f"SELECT COUNT(*) AS n FROM {t}")[0]["n"]

    class Lost(Transaction):
        def _decide(self, transaction, outcome):
            """The driver goes away before the outcome is written."""
            self.lost = transaction
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt), engine.transaction() as t:
        t.store = Lost(engine.store)
        t.sql("INSERT INTO a VALUES (1)")
        t.sql("INSERT INTO b VALUES (1)")
    assert count("a") == 0 and count("b") == 0
    engine.sql("INSERT INTO a VALUES (2)")  # calls the lost one off
    assert not engine.store._decide(t.store.lost, "done") and count("a") == 1 and count("b") == 0
    with engine.transaction() as again:
        again.sql("INSERT INTO b VALUES (3), (4)")
        again.sql("INSERT INTO a VALUES (5)")
    assert count("a") == 2 and count("b") == 2
    engine.store.vacuum("b")
    assert count("b") == 2


def test_schemas(engine):
    engine.sql("CREATE TABLE t (id INT)")
    engine.create_schema("Sales")
    with pytest.raises(e.CatalogError):
        engine.create_schema("sales")
    with pytest.raises(e.CatalogError):
        engine.create_schema("../x")
    with pytest.raises(e.SchemaNotFound):
        engine.use_schema("other")
    engine.use_schema("SALES")
    assert engine.schemas() == ["sales"] and engine.tables() == []
    engine.sql("CREATE TABLE t (name TEXT)")
    engine.sql("INSERT INTO t VALUES ('x')")
    with engine.transaction() as t:
        t.sql("INSERT INTO t VALUES ('y')")
    assert len(engine.collect("SELECT name FROM t")) == 2
    engine.use_schema()
    assert engine.collect("SELECT id FROM t") == [] and engine.tables() == ["t"]

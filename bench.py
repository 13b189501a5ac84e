"""Times the headline queries and prints one JSON line: median seconds of five runs after one warm-up, to a sink that writes nothing."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera import catalogue  # noqa: E402
from tessera.engine import Engine  # noqa: E402
from tessera.plans.parser import parse  # noqa: E402
from tessera.plans.statements import append  # noqa: E402
from tessera.session import build_session  # noqa: E402

SELECTS = [
    "flagship", "pricing_summary", "revenue_by_nation", "join_multi", "join_left", "join_full", "join_self", "join_compound_on",
    "group_multi", "group_expr", "agg_expr_arg", "agg_count_distinct", "having_hidden", "order_multi", "order_limit", "filter_and_or_not", "case_searched",
]
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def seconds(run) -> float:
    run()
    found = []
    for _ in range(RUNS):
        began = time.perf_counter()
        run()
        found.append(time.perf_counter() - began)
    return round(statistics.median(found), 4)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as scratch:
        spark = build_session(
            "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{scratch}/warehouse"}
        )
        spark.sparkContext.setLogLevel("ERROR")
        queries = catalogue.queries()
        times = {name: seconds(lambda n=name: queries[n](spark, folder).write.format("noop").mode("overwrite").save()) for name in SELECTS}

        orders = spark.read.parquet(f"{folder}/orders.parquet").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS total")
        engine = Engine(spark, f"{scratch}/db")
        engine.sql("CREATE TABLE o (id INT NOT NULL, status TEXT, total FLOAT)")
        append(engine.store, engine.definition("o"), orders, 0)
        times["update_rewrite"] = seconds(lambda: engine.sql("UPDATE o SET total = total * 1.01 WHERE status = 'F'"))
        times["delete_rewrite"] = seconds(lambda: engine.sql("DELETE FROM o WHERE total < 100.0"))
        times["insert_row"] = seconds(lambda: engine.sql("INSERT INTO o VALUES (1, 'N', 50.0)"))
        text = "SELECT o.id, c.name FROM o JOIN c ON o.cust = c.id JOIN n ON c.nat = n.id WHERE o.total > 100 AND c.name <> 'x' GROUP BY o.id, c.name ORDER BY o.id"
        times["parse_join_1000"] = seconds(lambda: [parse(text) for _ in range(1000)])
        spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()

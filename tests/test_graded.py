"""Graded queries: tests are judged where their page is, and gathered only after they went to their page."""

import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagemint.operators.grade import TESTS, grade


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cells_are_judged_in_place(spark, tmp_path):
    """No operator that holds a task's rows, and one row for each customer, a repeated one too."""
    spark.sql("SELECT id % 50 AS c_custkey FROM range(60)").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = entry.queries()["cell_verdicts"](spark, str(tmp_path))
    assert not re.search(r"Aggregate|Join|Sort|Window", plan(found))
    with duckdb.connect() as sql:
        sql.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = sql.execute(entry.oracle_sql()["cell_verdicts"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 60


def test_tests_are_gathered_after_the_shuffle(spark):
    """A task that reads tests sends them to their pages as they come; gathering first would hold all it has read."""
    rows = [(f"t{k}", f"p{k % 3}", "present", "html", "authored", ["eng"], '{"content": {"text": "a"}}', "{}") for k in range(9)]
    pages = spark.createDataFrame([(f"p{k}", "d", "s") for k in range(3)], "page_id string, document string, suite string")
    predictions = spark.sql("SELECT page_id, html, cast(null as array<struct<label:string,bbox:array<double>,text:string>>) AS blocks FROM VALUES ('p0', '<p>a</p>'), ('p1', 'b') AS t(page_id, html)")
    lines = grade(spark.createDataFrame(rows, TESTS), predictions, F.broadcast(pages))
    lines_plan = plan(lines)
    gathers = [line for line in lines_plan.split("\n") if "collect_list" in line]
    assert gathers
    depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
    for lower, upper in zip(gathers[1:], gathers):
        between = lines_plan.split("\n")
        between = between[between.index(upper) + 1 : between.index(lower)]
        assert not any("Exchange" in x and depth(upper) < depth(x) < depth(lower) for x in between), lines_plan
    assert {r.test_id: r.passed for r in lines.collect()} == {f"t{k}": k % 3 == 0 for k in range(9)}

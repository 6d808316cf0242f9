"""The JSON report has the issues of every category."""

import json

from lintlake.functions.dialect import SPARK
from lintlake.plans import catalog, report
from lintlake.sources import sinks

ROWS = [(c, "r", "a.js", 1, "low", "t") for c in ("security", "imports", "language", "types", "split")]


def test_no_category_is_left_out(spark, sf):
    issues = spark.createDataFrame(ROWS, "category string, rule string, file string, line long, severity string, title string")
    issues.createOrReplaceTempView("export_issues")
    got = spark.sql(f"WITH issues AS (SELECT * FROM export_issues) {report.json_summary(SPARK)}").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], "low", 1) for r in ROWS)
    said = [json.loads(r[0]) for r in sinks.to_json(issues, spark.createDataFrame([("a.js", 90)], "path string, score long")).collect()]
    assert {x["category"] for x in said if x["kind"] == "issue"} == {x["category"] for x in said if x["kind"] == "count"} == {r[0] for r in ROWS}
    q = catalog.queries()
    assert sum(r.n for r in q["export_json"](spark, sf).collect()) == q["issues_line_rules"](spark, sf).count()

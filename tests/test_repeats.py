"""Lines told once: nothing is lost, and what depends on a line is worked out once for all its places."""

from lintlake.functions.dialect import SPARK
from lintlake.operators import line_rules
from lintlake.plans import catalog, report
from lintlake.sources import corpora, repeats

FILES = [
    ("src/a.js", "a.js", "js", "let q = 1;\n\neval(x);\nlet q = 1;\n"),
    ("src/b.js", "b.js", "js", "eval(x);\n\nä x = 1;\r\neval(x);"),
    ("src/c.py", "c.py", "py", "eval(x);\nf = open('a')\nfrom x import *"),
    ("tests/d.py", "d.py", "py", "f = open('a')\n\nf = open('a')"),
    ("src/w.js", "w.js", "js", "eval(x); " * 60 + "\nlet q = 1;"),
]


def views(spark):
    spark.createDataFrame(FILES, "path string, name string, lang string, content string").createOrReplaceTempView("odd_files")
    return corpora.views(SPARK, "SELECT * FROM odd_files")


def test_every_line_keeps_its_places(spark, monkeypatch):
    v = views(spark)
    want = sorted(map(tuple, spark.sql(f"{v} SELECT path, line, lang, wide, text FROM lines").collect()))
    for most in (1 << 24, 30):  # together, and a file at a time
        monkeypatch.setattr(repeats, "PIECE_BYTES", most)
        once = repeats.distinct_lines(f"{v} SELECT * FROM files", line_rules.path_kind(SPARK))
        got = sorted(map(tuple, spark.sql(f"SELECT place.path, place.line, lang, wide, text FROM (SELECT *, explode(places) AS place FROM {once})").collect()))
        assert got == want
    one_task = repeats.distinct_lines(f"SELECT /*+ COALESCE(1) */ * FROM ({v} SELECT * FROM files)", "''")
    monkeypatch.undo()
    rows = spark.sql(f"SELECT lang, wide, text, size(places) AS n FROM {one_task}").collect()
    assert len({(r.lang, r.wide, r.text) for r in rows}) <= len(rows) < len(want)


def test_issues_of_lines_told_once(spark):
    v = views(spark)
    want = spark.sql(f"{v}, issues AS (SELECT * FROM ({report.deduplicated_lines()})) SELECT category, rule, file, line, severity, title, snippet FROM issues")
    once = repeats.distinct_lines(f"{v} SELECT * FROM files", line_rules.path_kind(SPARK))
    got = spark.sql(report.deduplicated_lines(once)).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.file for r in got.where("rule = 'mem_py_open'").collect()} == {"src/c.py"}  # the same line in a test is none


def test_reports_work_out_no_line_twice(spark, sf):
    plan = lambda k: catalog.queries()[k](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for key in ("highlight_line", "issues_line_rules", "score_file", "agg_count_by_category", "code_context"):
        assert "MapInArrow" in plan(key) and "posexplode" not in plan(key)
    assert plan("agg_totals").count("MapInArrow") == 1  # the issues were found twice

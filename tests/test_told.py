"""Rules over all lines: asked of each line once or in the row of a file, they find what windows over all lines find."""

import pytest

from lintlake.functions.dialect import SPARK, TOLD, Spark
from lintlake.model import Settings
from lintlake.operators import context_rules, cross_rules, function_rules
from lintlake.plans import report
from lintlake.plans.analyze import Analysis
from lintlake.sources import corpora


class Windows(Spark):
    name = "windows"  # Spark's expressions in the form of the checking SQL


KEYS = ["smell_long_file", "smell_deep_nesting", "pat_todo_density", "sec_py_yaml_load", "sec_py_tls_off"]
ODD = [
    ("a.py", "a.py", "py", "for x in rows:\n    db.get(x)\nfor y in call(\n  a.get(y),\n  q):\n  b.get(y)"),
    ("b.js", "b.js", "js", "for (const x of xs) {\n  if (x) { y.find(x); }\n  z.query(x);\n}\nz.find(1);\nwhile (a) {\n  q.map(b => c.get(b));\n  d.get(1);\n"),
    ("c.js", "c.js", "js", "try {\n} catch (e) {\n  console.log(e);\n}\ntry {} catch (e) {\n}\n\nconsole.warn(1);\n} catch (f) { console.log(f);\n throw f; }\n} catch (g) {\n console.log(g);"),
    ("d.js", "d.js", "js", "}}}{{{{{\n{}{{}}\n{{{{{{{{{\n// {{{{{{{{{{{{{{{{{\n}}}}}}\n{{{{{{"),
    ("e.py", "e.py", "py", "\n  # x\n" + " " * 24 + "deep()\n" + " " * 28 + "# deeper\n" + " " * 24 + "deep()"),
    ("f.py", "f.py", "py", "\n".join(["# TODO"] * 5)),
    ("g.py", "g.py", "py", "k = \"aB3/xY9+Qz7=Lm2-Wp5_Rt8Kd4\"\nl = 'aaaaaaaaaaaaaaaaaaaaaaaa+'"),
    ("h.txt", "h.txt", "txt", "x\n" * 301),
    ("requirements.txt", "requirements.txt", "txt", "# pinned\nrequests==2.19.0\n\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    made = [(f"s.{x}", f"s.{x}", x, "\n".join(texts).replace("@N", "1").replace("@K", "2")) for x, texts in corpora.SNIPPETS.items()] + ODD
    spark.createDataFrame(made, "path string, name string, lang string, content string").createOrReplaceTempView("told_files")
    return spark.table("told_files")


def selects(d):
    out = {k: context_rules.RULES[k][1](d) for k in KEYS} | {k: cross_rules.RULES[k][1](d) for k in ("dead_export", "dead_unused_function", "dup_magic_value", "test_uncovered_fn")}
    out |= {k: function_rules.RULES[k][2](d, Settings()) for k in ("pat_n_plus_one", "err_js_catch_logs")}
    return {k: f"SELECT file, line, severity, title FROM ({v})" for k, v in out.items()} | {"fn_names": cross_rules.fn_names(d), "pypi": cross_rules.pypi(d), "entropy": report.high_entropy(d)}


def test_same_as_windows(spark, files):
    views = corpora.views(SPARK, "SELECT * FROM told_files")
    with Analysis(files, categories=["comments"]) as a:
        lines = sorted(map(tuple, a.sql("SELECT path, name, lang, wide, line, text FROM lines").collect()))
        assert lines == sorted(map(tuple, spark.sql(f"{views} SELECT path, name, lang, wide, line, text FROM lines").collect()))
        for key, want in selects(Windows()).items():
            want = sorted(map(tuple, spark.sql(f"{views} {want}").collect()))
            assert sorted(map(tuple, spark.sql(f"{views} {selects(SPARK)[key]}").collect())) == want, key
            assert sorted(map(tuple, a.sql(selects(TOLD)[key]).collect())) == want, key
            assert want or key not in ("pat_n_plus_one", "err_js_catch_logs", "smell_deep_nesting", "smell_long_file", "pat_todo_density", "entropy", "pypi", "fn_names"), key


def test_no_line_is_asked_at_each_of_its_places(files):
    """Each rule once sorted all lines, or tried its patterns at every place of a line."""
    with Analysis(files, categories=["comments"]) as a:
        plan = lambda k: a.sql(selects(TOLD)[k])._jdf.queryExecution().executedPlan().toString()
        for key in ("pat_n_plus_one", "err_js_catch_logs", "smell_deep_nesting", "entropy"):
            assert "Window" not in plan(key)
        for key in ("fn_names", "dup_magic_value", "entropy"):
            told = plan(key)
            assert "RLIKE" not in told[: told.index("Generate explode(places")] and "regexp_extract" not in told[: told.index("Generate explode(places")]

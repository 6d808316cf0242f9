"""Rules on a line and those around it: in the row of a file they find what windows over all lines find."""

import pytest

from lintlake.functions.dialect import SPARK, Spark
from lintlake.operators import context_rules
from lintlake.plans.analyze import Analysis
from lintlake.sources import corpora


class Windows(Spark):
    name = "windows"  # Spark's expressions in the form of the checking SQL


KEYS = ["err_js_async_no_try", "err_js_empty_catch", "err_js_then_no_catch", "mem_js_use_effect", "mem_py_db_conn", "mem_py_growing_attr", "perf_py_list_comp", "pat_regex_long", "com_restated_doc", "a11y_button_empty", "err_py_swallowed", "type_py_untyped", "perf_js_json_in_loop", "lang_go_naked_return", "lang_py_module_global", "imp_js_buried", "sec_insecure_random", "mem_js_listener"]
ODD = [("e.js", "e.js", "js", "} catch (e) {"), ("f.py", "f.py", "py", "except:\n"), ("g.py", "g.py", "py", "def a_b():"), ("h.js", "h.js", "js", "\n/" + "ab" * 50 + "/g\n// x\n/" + "ab" * 50 + "/g")]


@pytest.fixture(scope="module")
def views(spark):
    files = [(f"s.{x}", f"s.{x}", x, "\n".join(texts).replace("@N", "1").replace("@K", "2")) for x, texts in corpora.SNIPPETS.items()] + ODD
    spark.createDataFrame(files, "path string, name string, lang string, content string").createOrReplaceTempView("beside_files")
    return corpora.views(SPARK, "SELECT * FROM beside_files")


def test_same_as_windows(spark, views):
    for d in (SPARK, Windows()):
        union = " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({context_rules.RULES[k][1](d)})" for k in KEYS)
        found = sorted(map(tuple, spark.sql(f"{views} {union}").collect()))
        assert d is SPARK and len(found) > len(KEYS) or found == first
        first = found


def test_no_window_over_all_lines(spark, views):
    for key in KEYS[:11]:
        plan = spark.sql(f"{views} {context_rules.RULES[key][1](SPARK)}")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan


def test_statements_of_an_analysis_run_nothing(spark, views):
    """Each once read the schema of every table by a job of its own, about 600 in all."""
    with Analysis(spark.table("beside_files"), categories=["comments", "types"]) as a:
        spark.sparkContext.setJobGroup("statements", "")
        a.parts()
        ran = spark.sparkContext.statusTracker().getJobIdsForGroup("statements")
        spark.sparkContext._jsc.clearJobGroup()
        assert len(ran) == 0

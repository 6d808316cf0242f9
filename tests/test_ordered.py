"""What rules ask of lines in their order: one pass finds what each rule finds by itself."""

import random

import pytest

from lintlake.functions.dialect import SPARK
from lintlake.model import Settings
from lintlake.operators import context_rules, cross_rules, function_rules
from lintlake.plans import report
from lintlake.plans.analyze import Analysis
from lintlake.sources import corpora, repeats
from tests.test_told import ODD, Windows

KEYS = context_rules.RULES | cross_rules.RULES
CATEGORIES = ["smells", "cyclomatic", "cognitive", "duplicates", "split", "patterns", "errors", "dead"]
#: Finds nothing where there are tests.
NONE = {"test_no_tests"}


def _files():
    rnd = random.Random(4)
    out = list(ODD)
    for k in range(3):
        for lang, texts in corpora.SNIPPETS.items():
            some = [rnd.choice(texts).replace("@N", str(rnd.randrange(3))).replace("@K", str(rnd.randrange(3))) for _ in range(60)]
            out.append((f"src/{k}/s.{lang}", f"s.{lang}", lang, rnd.choice(["", "\n\n"]).join(["\n".join(some), "\n" * rnd.randrange(4)])))
    for k in range(30):  # no sense, but every order of braces, indents and heads
        lang = rnd.choice(["js", "py", "java", "rb", "c", "txt"])
        parts = ["{", "}", "}}", "function f@(a, b) {", "const g@ = (x) => {", "def h@(a, b):", "    def i@(c):", "\tif x && y {", "        return x ? 1 : 2", "", "  ", "} catch (e) {", "console.log(e);", "for x in y:", "x.get(1)", "from a import b@, c@", "import { b@ } from 'a'", "import d@ from 'a'", "import a as e@", "v@ = b@", "let w@ = c@", "public int f@(int a) {", "} else if (x) {", "h@(1); f@(2)", "\r", "é{", "# TODO é", "// x", "\x01 def j@(a):"]
        out.append((f"odd/{k}.{lang}", f"{k}.{lang}", lang, "\n".join(rnd.choice(parts).replace("@", str(rnd.randrange(2))) for _ in range(rnd.choice([1, 2, 7, 40, 700])))))
    out += [("b/long.js", "long.js", "js", out[12][3] + "\n"), ("b/one.js", "one.js", "js", "{"), ("b/blank.py", "blank.py", "py", "\n\n"), ("b/open.js", "open.js", "js", "function never() {\n" + "  go();\n" * 900), ("b/none.js", "none.js", "js", ""), ("tests/test_x.py", "test_x.py", "py", "def test_load_user():\n    password = 1\n    for x in y:\n        text += x\n")]
    return out


@pytest.fixture(scope="module")
def files(spark):
    spark.createDataFrame(_files(), "path string, name string, lang string, content string").createOrReplaceTempView("ordered_files")
    return spark.table("ordered_files")


def _wanted(spark):
    """The rules by themselves: windows over lines where there are some, else in the row of a file."""
    s, views = Settings(), corpora.views(SPARK, "SELECT * FROM ordered_files")
    made = {k: f"{views} {f(Windows() if k in ('smell_deep_nesting', 'pat_todo_density') else SPARK)}" for k, (_, f) in KEYS.items()}
    made["sec_high_entropy"] = f"{views} {report.high_entropy(SPARK)}"
    for key, (_, tables, select) in function_rules.RULES.items():
        made[key] = f"{views}{function_rules.with_spans(SPARK, tables)} {select(SPARK if tables else Windows(), s)}"
    return {k: sorted((r["file"], r["line"] or 0, r["severity"], r["title"]) for r in spark.sql(v).collect()) for k, v in made.items()}


def test_one_pass_finds_what_rules_find(spark, files, monkeypatch):
    want = _wanted(spark)
    assert {k for k, v in want.items() if not v} <= NONE
    for most, rows in ((1 << 24, "10000"), (2000, "7")):  # together, and some files at a time in small batches
        monkeypatch.setattr(repeats, "PIECE_BYTES", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            with Analysis(files) as a:
                got: dict[str, list] = {k: [] for k in want}
                for r in a.found().collect():
                    if r["rule"] in got:
                        got[r["rule"]].append((r["file"], r["line"] or 0, r["severity"], r["title"]))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        unlike = {k: (sorted(set(got[k]) - set(v))[:3], sorted(set(v) - set(got[k]))[:3], len(got[k]), len(v)) for k, v in want.items() if sorted(got[k]) != v}
        assert not unlike, unlike


def test_no_rule_on_order_reads_files_again(files):
    """Five tables of functions, and each rule on unused names, blocks and nesting, once took a pass over the lines of all files."""
    with Analysis(files, categories=["cognitive", "cyclomatic", "split"]) as a:
        for name, part in a.parts().items():
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "split(content" not in plan and "/files" not in plan, name


def test_nothing_found_in_order(spark):
    none = spark.createDataFrame([("a.txt", "a.txt", "txt", "x")], "path string, name string, lang string, content string")
    with Analysis(none, categories=CATEGORIES) as a:
        assert a.issues().count() == 0

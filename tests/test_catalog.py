"""Every SQL query gives the same rows in Spark and in DuckDB."""

import glob
import os

import duckdb
import pytest

from lintlake.functions.dialect import DUCK, SPARK
from lintlake.model import CYCLE_PENALTY, DEDUP, NOT_SCORED, OTHER_PENALTY, SEVERITY, Settings
from lintlake.operators import context_rules, cross_rules, function_rules, line_rules
from lintlake.plans import catalog, report
from lintlake.sources import corpora

SELECTS = {r.key: r.select for r in line_rules.RULES} | {k: v[1] for k, v in (context_rules.RULES | cross_rules.RULES).items()} | cross_rules.EXTRACTORS | cross_rules.UNCAPPED | report.FILE_QUERIES
SELECTS |= {k: (lambda d, f=v[-1]: f(d, Settings())) for k, v in (function_rules.RULES | function_rules.QUERIES).items()}


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def both(spark, sf):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("files", "lines"):
        spark.sql(f"{corpora.views(SPARK, corpora.code(SPARK, sf))} SELECT * FROM {name}").cache().createOrReplaceTempView(name)
        duck.sql(f"CREATE TABLE {name} AS {corpora.views(DUCK, corpora.code(DUCK, ''))} SELECT * FROM {name}")
    for name, x in function_rules.EXTRACTORS.items():
        spark.sql(function_rules.spans(SPARK, x)).cache().createOrReplaceTempView(name)
        duck.sql(f"CREATE TABLE {name} AS {function_rules.spans(DUCK, x)}")
    return spark, duck


def test_corpora_are_equal(both):
    spark, duck = both
    a, b = spark.table("lines"), duck.sql("SELECT * FROM lines")
    assert rows(a.columns, a.collect()) == rows(b.columns, b.fetchall())


@pytest.mark.parametrize("key", sorted(SELECTS))
def test_select(both, key):
    spark, duck = both
    a, b = spark.sql(SELECTS[key](SPARK)), duck.sql(SELECTS[key](DUCK))
    assert rows(a.columns, a.collect()) == rows(b.columns, b.fetchall())


@pytest.mark.parametrize("key", ["score_file", "agg_totals", "export_sarif", "quick_wins", "snapshot_diff", "win_trend_15", "circular_scc", "circular_break", "dup_exact_block_documents", "specific_fixes", "arch_suggestions", "code_context", "issues_all_rules", "score_file_all_rules"])
def test_query(both, sf, key):
    spark, duck = both
    a, b = catalog.queries()[key](spark, sf), duck.sql(catalog.oracle_sql()[key])
    assert rows(a.columns, a.collect()) == rows(b.columns, b.fetchall())


def test_every_rule_has_a_query():
    assert {r.key for r in line_rules.RULES} <= set(catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 170


def test_every_line_item_is_in_the_corpus(spark, tmp_path):
    items = [(s, o, 1, p) for s in range(1, 14) for o, p in enumerate([3, 10, 7, 21, s], 1)]
    spark.createDataFrame(items, "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 14).write.parquet(f"{tmp_path}/supplier.parquet")
    want = {}
    for s, o, _, p in items:
        texts = corpora.SNIPPETS[corpora.LANGS[s % 13]]
        want.setdefault(s, []).append(texts[(p * 31 + o) % len(texts)].replace("@K", str(1 + p % 13)).replace("@N", str(o % 7)))
    got = {r["name"]: r["content"] for r in catalog.code_files(spark, str(tmp_path)).where("name rlike 's[0-9]+[.]'").collect()}
    assert got == {f"{'test_' if s % 9 == 4 else ''}s{s}.{corpora.LANGS[s % 13]}": "\n".join(x) for s, x in want.items()}


def test_scores_over_all_rules(spark, tmp_path):
    """Issues of every kind of rule reach the registered issues and scores; both are worked out anew in Python."""
    items = [(s, o, 1, p) for s in range(1, 14) for o, p in enumerate(range(s, s + 60), 1)]
    n_js, n_ts = len(corpora.SNIPPETS["js"]), len(corpora.SNIPPETS["ts"])
    items += [(1, -25 * 31 % n_ts, 2, 25), (26, -30 * 31 % n_js, 2, 30)]  # src/m1/s1.ts and src/m1/s26.js import each other
    spark.createDataFrame(items, "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 31).write.parquet(f"{tmp_path}/supplier.parquet")
    queries = catalog.queries()
    issues = [r.asDict() for r in queries["issues_all_rules"](spark, str(tmp_path)).collect()]
    for key in ("smell_long_function", "dup_structural_fn", "dead_unused_import_py_alias", "err_py_swallowed"):  # walk, structure, cross-file, context
        found = [r.asDict() for r in queries[key](spark, str(tmp_path)).collect()]
        assert found
        for f in found:  # one that is left out shares file, line and start of title with one that stays
            same = [x for x in issues if (x["file"], x["line"]) == (f["file"], f["line"])]
            width = max((DEDUP.get(x["category"], 0) or 0 for x in same if x["rule"] == key), default=0)
            assert any(x["rule"] == key and x["title"][: width or None] == f["title"][: width or None] for x in same), f
    members = {x["file"] for x in issues if x["rule"] == "circular_scc"}
    assert members
    want = {}
    for x in issues:
        if x["category"] not in NOT_SCORED:
            n, lost = want.get(x["file"], (0, CYCLE_PENALTY if x["file"] in members else 0))
            want[x["file"]] = (n + 1, lost + (SEVERITY[x["severity"]][1] if x["severity"] in SEVERITY else OTHER_PENALTY))
    scores = queries["score_file_all_rules"](spark, str(tmp_path)).collect()
    assert len(scores) == 14 + 4
    assert {r["path"]: (r["issues"], r["score"]) for r in scores} == {r["path"]: (n, max(0, 100 - lost)) for r in scores for n, lost in [want.get(r["path"], (0, 0))]}

"""All queries of the analyzer, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.dialect import DUCK, SPARK, Dialect
from lintlake.model import Settings
from lintlake.operators import context_rules, cross_rules, function_rules, graph, line_rules
from lintlake.plans import report
from lintlake.plans.analyze import Analysis
from lintlake.sources import corpora, repeats

Query = Callable[[SparkSession, str], DataFrame]


def _selects() -> dict[str, Callable[[Dialect, str], str]]:
    """key -> SQL of a whole query in a dialect."""

    def on(corpus: Callable[[Dialect, str], str], select: Callable[[Dialect], str], issues: bool = False):
        def make(d: Dialect, sf_dir: str) -> str:
            views = corpora.views(d, corpus(d, sf_dir))
            if d.name == "spark" and select is report.highlighted_lines:
                return select(d, repeats.distinct_lines(f"{views} SELECT * FROM files", "''"))
            one_path = corpus is corpora.code
            made = report.AT_ONCE.get(select, select) if d.name == "spark" and one_path else select
            return f"{report.with_issues(d, views, one_path=one_path) if issues else views} {made(d)}"

        return make

    def on_functions(tables: tuple[str, ...], select: function_rules.Select, columns: tuple[str, ...] = ("*",)):
        def make(d: Dialect, sf_dir: str) -> str:
            return f"{corpora.views(d, corpora.code(d, sf_dir))}{function_rules.with_spans(d, tables)} SELECT {', '.join(columns)} FROM ({select(d, Settings())})"

        return make

    out = {r.key: on(corpora.code, r.select) for r in line_rules.RULES}
    out |= {k: on(corpora.code, f) for k, (_, f) in (context_rules.RULES | cross_rules.RULES).items()}
    out |= {k: on(corpora.code, f) for k, f in (cross_rules.EXTRACTORS | cross_rules.UNCAPPED | report.FILE_QUERIES).items()}
    out |= {k: on_functions(tables, f, ("file", "line", "severity", "title")) for k, (_, tables, f) in function_rules.RULES.items()}
    out |= {k: on_functions(tables, f) for k, (tables, f) in function_rules.QUERIES.items()}
    out |= {k: on(corpora.code, f, True) for k, f in report.ISSUE_QUERIES.items()}
    out |= report.TABLE_QUERIES
    out |= {k: (lambda d, sf_dir, f=f: f"{corpora.views(d, corpora.manifests(d, sf_dir))} {f(d, corpora.advisories(d, sf_dir), corpora.PROJECT)}") for k, f in cross_rules.DEPENDENCIES.items()}
    secret = next(r for r in line_rules.RULES if r.key == "sec_hardcoded_secret")
    out["sec_hardcoded_secret_documents"] = on(corpora.prose, secret.select)
    out["dup_exact_block_documents"] = on(corpora.prose, cross_rules.exact_block)
    out["test_no_tests"] = on(corpora.prose, cross_rules.no_tests)
    out["score_file_pages"] = on(corpora.pages, report.file_scores, True)
    return out


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{corpora.views(SPARK, corpora.code(SPARK, sf_dir))} SELECT path, name, lang, content FROM files")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cut(spark.sql(f"{corpora.views(SPARK, corpora.code(SPARK, sf_dir))} {cross_rules.import_edges(SPARK)}"))


def circular_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cycle_issues(graph.strong_components(_edges(spark, sf_dir)))


def circular_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.cycle_breaks(edges, graph.strong_components(edges))


def circular_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    return graph.cycle_chains(edges, graph.strong_components(edges))


def _cycle_tables() -> str:
    """Edges ``e`` and members ``m`` (node, scc) of cycles, to go behind ``files`` and ``lines``."""
    reach = "r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"
    member = "m AS (SELECT x.a AS node, least(x.a, min(x.b)) AS scc FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"
    return f", e AS ({cross_rules.import_edges(DUCK)}), {reach}, {member}"


_CYCLE = "CASE WHEN count(*) {over} > 3 THEN 'high' ELSE 'medium' END AS severity, concat('Circular dependency — ', CAST(count(*) {over} AS STRING), ' files') AS title"


#: The walk of each component: paths as long as they get, each with the first file not yet on it.
_WALK = """, begin AS (SELECT scc, dst AS node FROM (SELECT scc, dst, row_number() OVER (PARTITION BY scc ORDER BY count(*) DESC, dst) AS nth FROM inside GROUP BY scc, dst) WHERE nth = 1),
walk(scc, node, path) AS (SELECT scc, node, [node] FROM begin UNION ALL SELECT w.scc, min(i.dst), list_append(w.path, min(i.dst)) FROM walk AS w JOIN inside AS i ON i.scc = w.scc AND i.src = w.node WHERE NOT list_contains(w.path, i.dst) GROUP BY w.scc, w.path),
longest AS (SELECT scc, list_transform(arg_max(path, len(path)), lambda x: regexp_replace(x, '^.*/', '')) AS names FROM walk GROUP BY scc)
SELECT scc, array_to_string(list_append(names, names[1]), ' → ') AS chain FROM longest"""


def _cycles_sql(select: str) -> str:
    views = corpora.views(DUCK, corpora.code(DUCK, "")).replace("WITH raw", "WITH RECURSIVE raw", 1)
    inner = "inside AS (SELECT p.scc, e.src, e.dst FROM e JOIN m AS p ON e.src = p.node JOIN m AS q ON e.dst = q.node AND p.scc = q.scc)"
    return f"{views}{_cycle_tables()}, {inner}{select if select[0] == "," else " " + select}"


def _all_rules_sql(select: Callable[[Dialect], str], corpus: Callable[[Dialect, str], str] = corpora.code) -> str:
    """A report over the issues of all rules, in one statement."""
    d = DUCK
    views = corpora.views(d, corpus(d, "")).replace("WITH raw", "WITH RECURSIVE raw", 1) + function_rules.with_spans(d, tuple(function_rules.EXTRACTORS)) + _cycle_tables()
    parts = [(c, k, f(d)) for k, (c, f) in (context_rules.RULES | cross_rules.RULES).items()] + [(c, k, f(d, Settings())) for k, (c, _, f) in function_rules.RULES.items()]
    parts += [("security", "sec_high_entropy", report.high_entropy(d)), ("circular", "circular_scc", f"SELECT node AS file, CAST(NULL AS BIGINT) AS line, {_CYCLE.format(over='OVER (PARTITION BY scc)')} FROM m")]
    found = " UNION ALL ".join([report.line_issues(d), *[f"SELECT {d.lit(c)} AS category, {d.lit(k)} AS rule, file, line, severity, title FROM ({sql})" for c, k, sql in parts]])
    return f"{report.with_issues(d, views, found)} {select(d)}"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"{corpora.views(SPARK, corpora.pages(SPARK, sf_dir))} SELECT path, name, lang, content FROM files")


#: Analyses whose issues are written, by application, corpus, folder and state of its tables.
_FOUND: dict[tuple, Analysis] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the files of the tables that corpora are made of: issues that are found once count until one changes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in ("lineitem", "supplier", "pages"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        out.append(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))) if fs.exists(path) else None)
    return tuple(out)


def _analysis(files: Query, spark: SparkSession, sf_dir: str) -> Analysis:
    key = (spark.sparkContext.applicationId, files.__name__, sf_dir, _state(spark, sf_dir))
    if key not in _FOUND:
        a = Analysis(files(spark, sf_dir))
        a.issues().write.parquet(f"{a.folder}/issues")
        _FOUND[key] = a
    return _FOUND[key]


def _all_rules_query(files: Query, select: Callable[[Dialect], str]) -> Query:
    """A report over the issues of all rules. They are found once and written, for all reports of the application to read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _analysis(files, spark, sf_dir)
        return a.report(spark.read.parquet(f"{a.folder}/issues"), select)

    return run


def _all_rules_name(key: str) -> str:
    return "issues_all_rules" if key == "issues_line_rules" else f"{key}_all_rules"


def all_rules_queries() -> dict[str, Query]:
    """The issue queries over all rules."""
    out = {_all_rules_name(k): _all_rules_query(code_files, f) for k, f in report.ISSUE_QUERIES.items()}
    return out | {"score_file_pages_all_rules": _all_rules_query(page_files, report.file_scores)}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: (lambda spark, sf_dir, f=f: spark.sql(f(SPARK, sf_dir))) for k, f in _selects().items()}
    out |= all_rules_queries()
    return out | {"circular_scc": circular_scc, "circular_break": circular_break, "circular_chain": circular_chain}


def oracle_sql() -> dict[str, str]:
    out = {k: f(DUCK, "") for k, f in _selects().items()}
    out["circular_scc"] = _cycles_sql(f"SELECT scc AS file, CAST(NULL AS BIGINT) AS line, {_CYCLE.format(over='')} FROM m GROUP BY scc")
    out["circular_break"] = _cycles_sql("SELECT scc, node AS break_at FROM (SELECT scc, dst AS node, row_number() OVER (PARTITION BY scc ORDER BY count(*), dst) AS nth FROM inside GROUP BY scc, dst) WHERE nth = 1")
    out["circular_chain"] = _cycles_sql(_WALK)
    out |= {_all_rules_name(k): _all_rules_sql(f) for k, f in report.ISSUE_QUERIES.items()}
    out["score_file_pages_all_rules"] = _all_rules_sql(report.file_scores, corpora.pages)
    return out

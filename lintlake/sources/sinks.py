"""Reports as files: JSON, SARIF 2.1.0 and HTML, each a DataFrame of one text row that ``write`` stores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.dialect import SPARK
from lintlake.model import SEVERITY
from lintlake.plans import report
from lintlake.plans.report import SARIF_CATEGORIES

_PRINT = "<style>@page{size:A4;margin:15mm}table{width:100%;border-collapse:collapse}thead{display:table-header-group}tr{break-inside:avoid}.page{break-after:page}footer{text-align:right}</style>"


def _level(k: int, other):
    col = F.lit(other)
    for name, values in SEVERITY.items():
        col = F.when(F.col("severity") == name, F.lit(values[k])).otherwise(col)
    return col


def to_json(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts, issues and file scores as JSON lines: a summary, then one line for each issue and file."""
    summary = issues.groupBy("category").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.to_json(F.struct(F.lit("count").alias("kind"), "category", "n")).alias("value"))
    each = issues.select(F.lit(1).alias("part"), F.to_json(F.struct(F.lit("issue").alias("kind"), *issues.columns)).alias("value"))
    files = scores.select(F.lit(2).alias("part"), F.to_json(F.struct(F.lit("file").alias("kind"), *scores.columns)).alias("value"))
    return summary.union(each).union(files).orderBy("part", "value").select("value")


def to_sarif(issues: DataFrame) -> DataFrame:
    """One SARIF log of all issues of its categories; a log is one document, so it is built in one task."""
    some = issues.where(F.col("category").isin(*SARIF_CATEGORIES)).withColumn("ruleId", F.concat("category", F.lit(":"), F.substring("title", 1, 40))).withColumn("level", _level(3, "warning"))
    result = F.struct("ruleId", "level", F.struct(F.col("title").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    rules = some.groupBy("ruleId").agg(F.min("title").alias("title")).agg(F.array_sort(F.collect_list(F.struct(F.col("ruleId").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription")))).alias("rules"))
    results = some.select(result.alias("r")).agg(F.array_sort(F.collect_list("r")).alias("results"))
    driver = F.struct(F.lit("lintlake").alias("name"), "rules")
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), "results")).alias("runs"))
    return rules.crossJoin(results).select(F.to_json(log).alias("value"))


def sarif_logs(issues: DataFrame) -> DataFrame:
    """SARIF logs for issues of any number: the lines of each partition are a whole log, made while they are read. ``write_logs`` stores them."""
    some = issues.where(F.col("category").isin(*SARIF_CATEGORIES)).withColumn("level", _level(3, "warning"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.to_json(F.struct(F.concat("category", F.lit(":"), F.substring("title", 1, 40)).alias("ruleId"), "level", F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "lintlake"}}, "results": [\n'
        for batch in batches:
            lines = []
            for text in batch["value"].to_pylist():
                lines.append(before + text)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([("" if before == "," else before) + "]}]}"], pa.string())], ["value"])

    return some.select(result.alias("value")).mapInArrow(run, "value string")


def write_logs(logs: DataFrame, folder: str) -> None:
    logs.write.mode("overwrite").text(folder)


def to_print(issues: DataFrame) -> DataFrame:
    """The issues on pages by section, with repeated heads and numbers at the foot."""
    pages = _over(report.printed_pages(SPARK), issues=issues)
    listed = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "html"))), lambda x: x["html"]), "").alias("body"))  # a bounded number of pages
    return listed.select(F.concat(F.lit(f"<!doctype html><meta charset=utf-8><title>Report</title>{_PRINT}"), "body").alias("value"))


def to_html(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """A page with the most severe issues and the worst files."""
    rows = _over(report.html_rows(SPARK, "scores"), issues=issues, scores=scores)
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == k, F.struct("nth", "html")))), lambda x: x["html"]), "")
    found = rows.agg(part(0).alias("issues"), part(1).alias("files"))  # a bounded number of rows
    heads = ["<!doctype html><meta charset=utf-8><title>Report</title><table><thead><tr><th>Severity<th>Issue<th>File<th>Line</thead>", "</table><table><thead><tr><th>Score<th>File</thead>", "</table>"]
    return found.select(F.concat(F.lit(heads[0]), "issues", F.lit(heads[1]), "files", F.lit(heads[2])).alias("value"))


def _over(select: str, **tables: DataFrame) -> DataFrame:
    """SQL over data frames under names of its own."""
    spark = next(iter(tables.values())).sparkSession
    views = {n: f"{n}_{uuid.uuid4().hex[:12]}" for n in tables}
    for n, view in views.items():
        tables[n].createOrReplaceTempView(view)
    return spark.sql(f"WITH {', '.join(f'{n} AS (SELECT * FROM {v})' for n, v in views.items())} {select}")


def write(made: DataFrame, folder: str) -> None:
    made.coalesce(1).write.mode("overwrite").text(folder)

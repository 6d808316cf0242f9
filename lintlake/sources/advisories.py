"""Advisory tables in the Open Source Vulnerability format: one JSON record for each advisory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of a record that are read.
SCHEMA = (
    "id string, aliases array<string>, summary string, database_specific struct<severity: string>, severity array<struct<type: string, score: string>>,"
    " affected array<struct<package: struct<ecosystem: string, name: string>, versions: array<string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>>>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``id, eco, package, introduced, until, last, alias, summary, level, cvss, fixed``: a row for each range of versions and each listed version.

    The events of a range are taken in order: each version that introduces goes with the first one behind it that fixes or is
    the last affected; one with neither has no end. Ranges of commits are left out. Records without an affected package
    give no row; missing texts are empty.
    """
    each = spark.read.schema(SCHEMA).json(path, multiLine=False).withColumn("a", F.explode("affected"))
    fixed = F.filter(F.flatten(F.transform("a.ranges", lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda x: x.isNotNull())
    text = lambda c: F.coalesce(c, F.lit(""))

    def spans(r):
        events = r["events"]
        closes = lambda e: e["fixed"].isNotNull() | e["last_affected"].isNotNull()
        opened = F.filter(F.transform(events, lambda e, i: F.struct(e["introduced"].alias("introduced"), F.element_at(F.concat(F.filter(F.slice(events, i + 2, F.size(events)), closes), F.array(F.lit(None).cast("struct<introduced: string, fixed: string, last_affected: string>"))), 1).alias("end"))), lambda x: x["introduced"].isNotNull())
        return F.transform(opened, lambda x: F.struct(x["introduced"].alias("introduced"), text(x["end"]["fixed"]).alias("until"), text(x["end"]["last_affected"]).alias("last")))

    ranged = F.flatten(F.transform(F.filter(F.coalesce("a.ranges", F.array()), lambda r: ~r["type"].eqNullSafe("GIT")), spans))
    listed = F.transform(F.coalesce("a.versions", F.array()), lambda v: F.struct(v.alias("introduced"), F.lit("").alias("until"), v.alias("last")))
    return each.withColumn("v", F.explode(F.concat(ranged, listed))).select(
        "id", F.col("a.package.ecosystem").alias("eco"), F.col("a.package.name").alias("package"), "v.introduced", "v.until", "v.last", text(F.coalesce(F.get("aliases", 0), "id")).alias("alias"),
        text(F.col("summary")).alias("summary"), text(F.col("database_specific.severity")).alias("level"), text(F.get("severity", 0)["score"]).alias("cvss"), text(F.get(fixed, 0)).alias("fixed"),
    )

"""Scans of a stream of changed files: line rules as files arrive, and a table of scans kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.functions.dialect import SPARK
from lintlake.operators import line_rules
from lintlake.sources.corpora import views
from lintlake.sources.files import with_names


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of ``path, name, lang, content`` of the text files that appear in a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return with_names(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def issues_of(files: DataFrame) -> DataFrame:
    """Issues of the line rules; works on streams as on tables, as no rule looks beyond its line."""
    name = "changed_files"
    files.createOrReplaceTempView(name)
    return files.sparkSession.sql(f"{views(SPARK, f'SELECT * FROM {name}')} {line_rules.fused('lines')}")


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the issues of each batch of changed files to ``out``, with the number of the batch."""

    def store(batch: DataFrame, number: int) -> None:
        issues_of(batch).withColumn("scan", F.lit(number)).write.mode("append").parquet(out)

    return changed_files(spark, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

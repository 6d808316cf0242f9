"""A training-data pipeline of the operators in ``lintlake.llm``: filter, deduplicate, pack.

Each stage takes all that the one before kept, written as Parquet and read again. A document is rejected by the
quality classifier below its cut, and by language identification if it has no letter or no language is at
least as likely as not; of documents that five-word shingles link at a similarity of 0.8 the one with the least
id stays; strings of 50 bytes or more that an earlier document has are cut out of later ones, at code points;
what is left is packed into sequences of 2048 tokens.

Cases: a null or empty text is scored like any other by the classifier, has no language and goes there; rows that
repeat an id and a text count once from the third stage on, rows without an id stay unless they repeat; of texts
that are equal the one with the least id stays; extra columns are dropped; an empty table stays empty at every stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import jaccard, language, packing, quality, queries, repeats
from lintlake.llm.storage import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least likelihood of the best language of a document that stays.
LEAST_LANGUAGE = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; labels are learned from outside its held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out(5, 0))
    scored = quality.score(docs, quality.fit(docs, labels), keep=COLUMNS)
    return scored.where(F.col("score") >= quality.CUT).select(COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; a missing language is filled in."""
    model = language.fit(docs.where(~queries.held_out(4, 2)))
    told = language.predict(docs, model, keep=COLUMNS)
    told = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; of rows that repeat an id and a text, one."""
    found = jaccard.similar_components(docs, words=5, share=(80, 100))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    stay = docs.join(first, "doc_id", "left_semi").withColumn("_text", F.xxhash64("text"))
    nameless = docs.where("doc_id is null").withColumn("_text", F.xxhash64("text"))
    return stay.union(nameless.select(stay.columns)).dropDuplicates(["doc_id", "_text"]).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that earlier ones have."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", "ignore") for k in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), batch["lang"], batch["source"], pa.array([len(t) for t in texts], pa.int64())], COLUMNS)

    cut = repeats.remove_repeats(docs, length=50, carry=["lang", "source"]).select("doc_id", "carried.lang", "carried.source", "kept")
    return cut.mapInArrow(decode, "doc_id long, text string, lang string, source string, n_chars long")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(queries.TOKENIZER), size=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_filter),
    ("language identification", language_filter),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", pack),
]

#: Not expressible in SQL: two trained classifiers and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The contract queries over the operators: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import alignment, bpe, fingerprint, html, jaccard, language, lm, media, packing, periodic, quality, repeats, windows

TOKENIZER, WORDS, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(n: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder`` modulo ``n``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == remainder, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(4, 2).alias("held_out")
    model = language.fit(docs.where(~held_out(4, 2)))
    return language.predict(docs, model, keep=["doc_id", out])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), size=2048, end_id=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    scored = quality.score(docs, quality.fit(docs, labels), keep=["doc_id", held_out(5, 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= quality.CUT).cast("int"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    kept = F.octet_length("kept").cast("long")
    return found.select("doc_id", (kept + removed).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(documents(spark, sf_dir), ~held_out(5, 1))
    return scored.withColumn("train", ~F.col("train")).withColumnRenamed("train", "held_out")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir), words=3, share=(90, 100))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by crc32 gets a planted run; digests of all runs, and the one with the greatest exponent."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    found = periodic.collapse_runs(documents(spark, sf_dir), seed=F.when(crc % 10 == 0, F.floor(crc / 10)))
    more = lambda a, x: (a["length"] * x["period"] < x["length"] * a["period"]) | a["length"].isNull()
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, x: F.when(more(a, x), x).otherwise(a))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    picked = found.withColumn("best", best)
    return picked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_online(documents(spark, sf_dir), public_tokenizers.path(WORDS), size=4096, end_id=2)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op")}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Bytes as pairs of hexadecimal digits; all 50-byte strings, each with its least document; runs of strings at most 50 apart.
OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, c, substr(h, 512 * c + 1, 610) AS h FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 512)) AS c FROM d)),
strings AS (SELECT doc_id, 256 * c + k AS k, hash(substr(h, 2 * k - 1, 100)) AS s FROM (SELECT doc_id, c, h, unnest(generate_series(1, length(h) // 2 - 49)) AS k FROM chunks)),
least AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
hits AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS fresh FROM strings JOIN least USING (s) WHERE m < doc_id),
runs AS (SELECT doc_id, run, min(k) AS a, max(k) + 49 AS b FROM (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM hits) GROUP BY doc_id, run),
parts AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM runs),
kept AS (SELECT doc_id, count(*) AS n, sum(b - a + 1) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY run) AS head FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
#: Shingle sets, links between those that meet, and what links reach.
OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda k: array_to_string(w[k:k + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM met JOIN n AS p ON x = p.doc_id JOIN n AS q ON y = q.doc_id WHERE 100 * o >= 90 * (p.n + q.n - o)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach AS r JOIN link AS l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(least.y, w.doc_id)) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.x
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force, round trips and held-out rows."""
    return {"op4_repeats": OP4_SQL, "op6_jaccard": OP6_SQL}

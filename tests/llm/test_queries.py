"""The registered queries as they are called: columns, types, folds, and odd, repeated and empty tables."""

import zlib

import corpus_pipeline
import pytest

from lintlake.llm import queries

#: Columns and types that each query returns at least.
COLUMNS = {
    "op1_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op7_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op8_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_fingerprint": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op11_periodic": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op12_windows": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op13_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}
#: Remainders of the folds of the queries that learn.
FOLDS = {"op1_language": (4, 2), "op3_quality": (5, 0), "op5_lm": (5, 1)}
#: Columns that must not be null where the id is not.
FREE = {"url"}
#: Those that are null together.
BEST_RUN = ("start", "length", "period", "exponent_milli")


@pytest.fixture(scope="module")
def tables(spark, sf, odd, tmp_path_factory):
    """Folders of real documents with odd ones behind them, and of tables without rows."""
    out = {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd_docs = odd.where("doc_id is not null").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.union(odd_docs).withColumn("block", docs.n_chars * 0).withColumn("range", docs.n_chars * 0)  # names that clash with the operators' own
    pages = spark.createDataFrame([(1, "http://h/a", "<article><p>one"), (1, "http://h/a", "<article><p>one"), (2, None, None), (3, "", ""), (None, "x", "<p>y")], "page_id long, url string, html string")
    for kind in ("full", "empty"):
        folder = str(tmp_path_factory.mktemp(kind))
        for name, df in (("documents", docs), ("labels", spark.read.parquet(f"{sf}/labels.parquet")), ("pages", pages)):
            (df if kind == "full" else df.where("false")).write.parquet(f"{folder}/{name}.parquet")
        out[kind] = folder
    return out


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, tables, name):
    query = queries.queries()[name]
    got = query(spark, tables["full"])
    types = dict(got.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    key = "page_id" if name == "op8_html" else "doc_id"
    source = spark.read.parquet(f"{tables['full']}/{'pages' if name == 'op8_html' else 'documents'}.parquet")
    want = sorted(str(r[0]) for r in source.select(key).collect())
    have = sorted(str(r[key]) for r in rows if (name != "op2_packing" or r["piece"] == 0) and (name != "op12_windows" or r["start"] == 0))
    assert have == want  # every row, repeated ones too, once
    assert all(r[c] is not None for r in rows if r[key] is not None for c in COLUMNS[name] if c not in FREE and (name != "op11_periodic" or c not in BEST_RUN or r["n_runs"]))
    if name in FOLDS:
        n, rest = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in rows)
    if name in ("op1_language", "op3_quality", "op9_fingerprint"):
        shares = [r[c] for r in rows for c in COLUMNS[name] if c == "score" or c.startswith("near_")]
        assert all(0 <= x <= 1 for x in shares)
    if name == "op3_quality":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if name == "op1_language":
        texts = {r["doc_id"]: r["text"] for r in source.collect()}
        assert all((r["lang_pred"] == "und") == (not any(x.isalpha() for x in texts[r["doc_id"]] or "")) for r in rows if r["doc_id"] != 1000008)
    if name == "op2_packing":
        places = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in places.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 2048
        assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_without_rows(spark, tables, name):
    got = queries.queries()[name](spark, tables["empty"])
    assert got.collect() == [] and set(COLUMNS[name]) <= set(got.columns)


def test_stages(spark, tables):
    """Each stage on odd and repeated rows, and on none, gives the columns of documents; a clean copy stays once."""
    for kind in ("full", "empty"):
        docs = spark.read.parquet(f"{tables[kind]}/documents.parquet").select(corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, tables[kind])
            rows = got.collect()
            if stage is not corpus_pipeline.pack:
                assert got.columns == corpus_pipeline.COLUMNS, name
                assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
            if kind == "empty":
                assert rows == [], name
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet").select(corpus_pipeline.COLUMNS)
    left = corpus_pipeline.near_duplicates(spark, docs, tables["full"]).collect()
    seen = [r["text"] for r in left if r["text"] and len(r["text"].split()) >= 5]
    assert len(seen) == len(set(seen))
    cut = corpus_pipeline.repeated_passages(spark, docs, tables["full"]).collect()
    assert sorted(str(r["doc_id"]) for r in cut) == sorted(str(r[0]) for r in docs.select("doc_id").collect())
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

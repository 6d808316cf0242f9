"""I-Match fingerprints over several randomised lexicons.

Document frequencies of all lower-cased words are counted over the whole corpus. The lexicon holds the words
whose share of documents lies in [``LOW``, ``HIGH``], a band of inverse document frequency. As the shares of
all words sum to the mean number of distinct words of a document, at most that mean / ``LOW`` words can be in it;
where that is more than ``MOST``, the lower end is raised to mean / ``MOST``, so the lexicon that goes to the tasks has
at most ``MOST`` words, however large the corpus and however long its documents. ``SUBSETS`` randomised sub-lexicons
keep each word with probability 1/4 to 1/2048. A document's fingerprint is, for each sub-lexicon, a 64-bit hash of the
sequence of the sorted distinct words it has in it; likeness is the share of equal hashes among those that either
document has.

Cases: a null text is an empty one, whose fingerprint is all zeros; a text without a word in the band uses all
its words as if they were in it; equal texts have equal fingerprints; ids must be numbers; ids that occur more than
once, or null ids (first), are ordered by text; the document after the last is the first, and a lone document is its
own next one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm import exchange
from lintlake.llm.bytesets import column, mix, slices, strings, word_hashes
from lintlake.llm.storage import bounded, kept

LOW, HIGH = 0.0005, 0.2
RATES = 10
EACH = 6
SUBSETS = RATES * EACH
#: Words of a lexicon, at most: 64 MB.
MOST = 8_000_000
#: Ranges of ids that quantiles tell apart; each is cut further into equal steps.
COARSE = 64


def band(df: DataFrame, least: float, most: float, text_col: str = "text", n_ranges: int = 16) -> DataFrame:
    """``word`` (64-bit hash) and ``n`` of the words that between ``least`` and ``most`` documents have; in rows without a word, the sum of n over all words.

    A task sends each range of hashes its distinct words, sorted, with their counts, in one value; a range adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            buf, starts = column(batch["text"])
            for a, b in slices(starts):
                h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                if not len(h):
                    continue
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                h = h[np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]]  # one for each text
                held.append(_summed(h, np.ones(len(h), np.int64)))
                size += len(held[-1][0])
            if size > 1 << 21:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield sent(held.pop())
                    size = 0
        if held:
            yield sent(_summed(*map(np.concatenate, zip(*held, strict=True))))

    def sent(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        h, n = found
        at = exchange.cut(h, n_ranges)
        full = [r for r in range(n_ranges) if at[r] < at[r + 1]]
        data = []
        for r in full:
            c = n[at[r] : at[r + 1]]
            more = np.flatnonzero(c != 1)
            data.append(exchange.pack(0, **exchange.pack_sorted(h[at[r] : at[r + 1]]), i=more.astype(np.int32), c=c[more].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], ["range", "data"])

    def add(table: pa.Table) -> pa.Table:
        words, counts = [], []
        for d in table["data"]:
            v = exchange.unpack(d.as_py())
            words.append(exchange.unpack_sorted(v))
            counts.append(np.ones(len(words[-1]), np.int64))
            counts[-1][v["i"]] = v["c"]
        h, n = _summed(np.concatenate(words), np.concatenate(counts))
        keep = (n >= least) & (n <= most)
        return pa.table({"word": pa.array([*h[keep].view(np.int64).tolist(), None], pa.int64()), "n": pa.array(np.append(n[keep], n.sum()))})

    texts = bounded(df).select(F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "range int, data binary").groupBy("range").applyInArrow(add, "word long, n long")


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted, with the sums of their counts."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n, first)


#: Base of the polynomial that hashes a sequence, modulo 2**64; odd.
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Lexicon:
    """Sorted word hashes and, for each, the bits of the sub-lexicons that keep it."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.sort(words.view(np.uint64))
        self.bits = membership(self.words)


def membership(words: np.ndarray) -> np.ndarray:
    """Bit s is set if sub-lexicon s, of rate 2**-(s // EACH + 2), keeps the word."""
    bits = np.zeros(len(words), np.uint64)
    for s in range(SUBSETS):
        draw = mix(words + np.uint64((s + 1) * 0xA24BAED4963EE407 % (1 << 64))) >> np.uint64(32)
        bits |= (draw < np.uint64(1 << (32 - s // EACH - 2))).astype(np.uint64) << np.uint64(s)
    return bits


def fingerprints(buf: np.ndarray, starts: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``SUBSETS`` 64-bit hashes for each text; 0: no word in that sub-lexicon."""
    n = len(starts) - 1
    out = np.zeros((n, SUBSETS), np.uint64)
    for a, b in slices(starts):
        h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        if not len(h):
            continue
        if len(lexicon.words):
            at = np.minimum(np.searchsorted(lexicon.words, h), len(lexicon.words) - 1)
            inside = lexicon.words[at] == h
        else:
            at, inside = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        bare = np.bincount(row[inside], minlength=b - a)[row] == 0  # words of texts without a word in the band
        bits = np.where(inside, lexicon.bits[at] if len(lexicon.words) else np.uint64(0), np.uint64(0))
        if bare.any():
            bits[bare] = membership(h[bare])
        keep = inside | bare
        h, row, bits = h[keep], row[keep], bits[keep]
        order = np.lexsort((h, row))
        h, row, bits = h[order], row[order], bits[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row, bits = h[new], row[new], bits[new]
        powers = np.cumprod(np.full(int(np.bincount(row).max()), _BASE, np.uint64))
        for s in range(SUBSETS):
            has = np.flatnonzero((bits >> np.uint64(s)) & np.uint64(1))
            if not len(has):
                continue
            r = row[has]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            # of the sequence of sorted distinct words: a polynomial in their places
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            total = np.add.reduceat(mix(h[has] + np.uint64(s)) * powers[place], first)
            out[a + r[first], s] = mix(total) | np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal hashes among those that either has; 1 for two texts without words.

    Of the rates, those count at which some sub-lexicons are empty for both, if any: at higher rates a
    single changed word changes every hash, so they tell only equal texts from others.
    """
    either = (a != 0) | (b != 0)
    sparse = either & np.repeat(either.reshape(-1, RATES, EACH).mean(2) <= 0.75, EACH, axis=1)
    either = np.where(sparse.any(1)[:, None], sparse, either)
    total = either.sum(1)
    return np.where(total == 0, 1.0, ((a == b) & either).sum(1) / np.maximum(total, 1))


def as_text(prints: np.ndarray) -> list[str]:
    whole = prints.astype(">u8").tobytes().hex()
    return [whole[i : i + 16 * SUBSETS] for i in range(0, len(whole), 16 * SUBSETS)]


def lexicon(df: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> Lexicon:
    """The words of ``df`` in the band, counted over all its rows."""
    total = df.count()
    words = kept(band(df, max(2.0, low * total), high * total, text_col, max(16, total // 16384)), "band")
    every = words.where("word is null").agg(F.sum("n")).first()[0] or 0
    least = max(low, every / max(total, 1) / MOST) * total  # at most MOST words can reach it
    found = words.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("word").toArrow()
    return Lexicon(found["word"].to_numpy())


def _range_of(col: Column, edges: list[float], steps: int) -> Column:
    """The number of a value's range, ascending: between two edges, ranges are equal steps. 0 for null."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col >= edges[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    if len(edges) < 2:
        return F.lit(0)
    outer = tree(1, len(edges) - 1) - 1  # the last stretch includes its end
    low = F.element_at(F.array(*map(F.lit, edges)), outer + 1)
    wide = F.element_at(F.array(*[F.lit(max(b - a, 1e-9)) for a, b in zip(edges, edges[1:], strict=False)]), outer + 1)
    inner = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor((col - low) / wide * steps)))
    return F.coalesce((outer * steps + inner).cast("long"), F.lit(0))


def with_next(df: DataFrame, id_col: str, text_col: str, rows_per_range: int = 8192) -> DataFrame:
    """``_bucket, _extra, id, text`` such that, sorted so, each row that is not extra is followed by the next document.

    The ids are cut into ranges; the first document of a range is copied to the end of the range before it.
    Texts are shuffled once, a range to a task, and a task reads its range as a sorted stream.
    """
    rows = bounded(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    parts = max(1, -(-ids.count() // rows_per_range))
    coarse = min(COARSE, parts)
    edges = sorted(set(ids.approxQuantile("id", [i / coarse for i in range(coarse + 1)], 1 / (8 * coarse)))) if parts > 1 else []
    rows = rows.withColumn("_bucket", _range_of(F.col("id"), edges, -(-parts // coarse)))
    least = rows.groupBy("_bucket").agg(F.min(F.struct("id")).alias("_first"))  # a struct: null ids come first
    order = Window.orderBy("_bucket")  # one row for each range
    firsts = kept(least.select("_bucket", "_first", F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to")), "firsts")
    used = firsts.count()
    first = firsts.select(F.col("_bucket").alias("_b"), F.col("_first.id").alias("_id"), "_to")
    copies = rows.join(F.broadcast(first) if used <= 1 << 16 else first, (F.col("_bucket") == F.col("_b")) & F.col("id").eqNullSafe(F.col("_id")))
    both = rows.select("_bucket", F.lit(0).alias("_extra"), "id", "text").union(copies.select(F.col("_to").alias("_bucket"), F.lit(1).alias("_extra"), "id", "text"))
    return both.repartitionByRange(max(1, used), "_bucket").sortWithinPartitions("_bucket", "_extra", "id", "text")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how like they are to those and to the next document's."""
    held = df.sparkSession.sparkContext.broadcast(lexicon(df, text_col))  # at most MOST words
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        last: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = fingerprints(*column(part["text"]), words)
                rows = list(zip(part["_bucket"].to_pylist(), part["_extra"].to_pylist(), part["id"].to_pylist(), part["text"].to_pylist(), prints, strict=True))
                if last is not None:
                    rows.insert(0, last)
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
                last = rows[-1]
                if pairs:
                    yield made(pairs, words)

    def made(pairs: list, words: Lexicon) -> pa.RecordBatch:
        edited = []
        for x, y in pairs:
            half = len(x[3]) // 2
            edited.append(x[3][: len(x[3]) - half] + y[3][:half])
        own = np.array([x[4] for x, _ in pairs])
        other = np.array([y[4] for _, y in pairs])
        new = fingerprints(*strings(edited), words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[2] for x, _ in pairs], out_schema.field(0).type),
                pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(as_text(own), pa.string()),
                pa.array(as_text(new), pa.string()),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, other)),
            ],
            schema=out_schema,
        )

    from pyspark.sql.pandas.types import to_arrow_type

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [to_arrow_type(df.schema[id_col].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out_schema = pa.schema(list(zip(names, types, strict=True)))
    return with_next(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

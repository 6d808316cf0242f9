"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of a text, lower-cased, with every run of other characters as one blank, give character n-grams of
orders 1 to ``ORDERS``, hashed into ``BUCKETS`` features with weight (1 + log tf) * idf, normalised. Document
frequencies cover all training rows. The weights are learned by follow-the-regularised-leader (FTRL-proximal)
with L1 and L2 penalties on at most ``SAMPLE`` training rows spread over the languages, and one temperature is
then fitted on rows that the learner did not see.

Cases: a null text, or one without a letter, is ``und`` with score 0; a null language is not learned from;
repeated rows count as often as they occur; without any training row every text is ``und``; long texts are
read whole; columns besides the id, text and language are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.storage import bounded, kept

BUCKETS = 1 << 15
ORDERS = 3
#: At most so many labelled rows are fitted on, shared evenly by the languages.
SAMPLE = 3000
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


@functools.cache
def _folded() -> np.ndarray:
    """Each code point's lower-case letter, or a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of a text and their counts; empty without a letter."""
    codes = _folded()[np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)]
    solid = codes != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # one blank after each run of letters
    keep[0] = True
    codes = codes[keep]
    if len(codes) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(len(codes), np.uint32)
    parts = []
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            break
        value = value[: len(codes) - n + 1] * _MUL[0] + codes[n - 1 :] * _MUL[1]
        parts.append((value ^ (value >> np.uint32(15))) * _MUL[2] + np.uint32(n) >> np.uint32(17))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return vector(at, counts, self.idf) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 4, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (class, buckets, values); the last coordinate of the state is the bias."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = g * g
            z[at] = zs + g - (np.sqrt(ns + more) - np.sqrt(ns)) / alpha * w
            n[at] = ns + more
    w = weights(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-out rows."""

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(math.log(0.05), math.log(20), 121))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def fit(df: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of ``df`` that have a language."""
    rows = bounded(df).where(F.col(lang_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.lit(11)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each = max(1, sample // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / v))) for k, v in sizes.items()])
    rows = rows.select("text", "lang", (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).alias("chosen"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        total = 0
        for batch in batches:
            out: list[tuple] = []
            for text, lang, chosen in zip(batch["text"], batch["lang"], batch["chosen"], strict=True):
                at, counts = grams(text.as_py() or "")
                seen[at] += 1
                total += 1
                if chosen.as_py() and len(at):
                    out.append((-2, 0, lang.as_py(), at.astype("<u2").tobytes(), counts.astype("<u4").tobytes()))
            yield table(out)
        at = np.flatnonzero(seen)
        yield table([(-1, total, None, None, None)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())], ["bucket", "n", "lang", "at", "counts"])

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["bucket", "n", "lang", "at", "counts"])

    made = kept(rows.mapInArrow(count, "bucket int, n long, lang string, at binary, counts binary"), "language")
    frequency = np.zeros(BUCKETS)
    total = 1
    for b, n in made.where("bucket >= -1").groupBy("bucket").agg(F.sum("n")).collect():
        if b < 0:
            total = n
        else:
            frequency[b] = n
    idf = np.log((1 + total) / (1 + frequency)) + 1
    chosen = made.where("bucket = -2").orderBy("lang", F.xxhash64("at", "counts"), "at", "counts").select("lang", "at", "counts").collect()
    names = sorted({r["lang"] for r in chosen})
    place = {x: i for i, x in enumerate(names)}
    used: dict[str, int] = {}
    learn, hold = [], []
    for r in chosen:
        k = used[r["lang"]] = used.get(r["lang"], 0) + 1
        if k > each:  # the bound holds whatever the hash gives
            continue
        at, counts = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)
        (hold if k % 5 == 0 else learn).append((place[r["lang"]], at, vector(at, counts, idf)))
    if not learn:
        return Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    weights, bias = ftrl(learn, len(names))
    t = temperature(np.array([x @ weights[at] + bias for _, at, x in hold]), np.array([y for y, _, _ in hold]))
    return Model(names, idf, weights, bias, t)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``keep`` (by default the id), ``lang_pred`` and ``score`` of every row, from its text alone."""
    source = bounded(df).select(*(keep or [id_col]))
    own = text_col in source.columns
    source = source if own else bounded(df).select(*(keep or [id_col]), text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the corpus
    names = source.columns if own else source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        for batch in batches:
            said = [found.predict(t.as_py()) for t in batch[text_col]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], [*names, "lang_pred", "score"])

    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names]
    return source.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))

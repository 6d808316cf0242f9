"""Quality classifier: Bradley-Terry strengths learned from preference pairs.

Every text has a vector of surface features (``features``). Each labelled good text is preferred to labelled
bad ones; the strengths are linear in the features and minimise the logistic loss of feature differences over
such pairs. The cut is the quantile of the training strengths that leaves the labelled share of bad texts
below it, and a score is the logistic of the distance to the cut, shifted so that the cut has score ``CUT``.

Cases: a null text is an empty one, and gets the score of an empty text; rows without a label, or with a null
one, are not learned from; with one class only, every score is 1 (only good) or 0 (only bad), and without
labels 1; a document that is labelled twice is learned from twice; columns besides the id, text and label are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.bytesets import LOWER, column, prefix, slices, spans, words
from lintlake.llm.storage import bounded

#: Score of the quantile cut.
CUT = 0.3
#: At most so many labelled rows of each class are fitted on.
SAMPLE = 4000
#: Preference pairs that each fitted row takes part in, about.
PAIRS = 12
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_CLASS = np.zeros(256, np.int64)  # 0: other, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 above ASCII, 7...: punctuation
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
for _i, _b in enumerate(_PUNCTUATION):
    _CLASS[_b] = 7 + _i
_KINDS = 7 + len(_PUNCTUATION)


def features(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of surface features for each text."""
    n = len(starts) - 1
    size = np.diff(starts)
    kind = _CLASS[buf]
    if len(buf):
        capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
        kind[1:][capital] = 1
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    begin, end, owner = words(buf, starts)
    total = np.bincount(owner, minlength=n).astype(float)
    per = 1 / np.maximum(total, 1)

    def rate(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) * per

    upper, lower, marks = (np.concatenate([[0], np.cumsum(m)]) for m in (kind == 1, kind == 2, kind >= 7))
    length = end - begin
    ups, lows, punct = (c[end] - c[begin] for c in (upper, lower, marks))
    last = kind[end - 1] >= 7 if len(end) else np.zeros(0, bool)
    last2 = last & (length > 1) & (buf[end - 1] == buf[np.maximum(end - 2, 0)]) if len(end) else last
    low = LOWER[buf]
    hashed = spans(prefix(low), begin, end) if len(begin) else np.zeros(0, np.uint64)
    same = [np.zeros(len(owner), bool) for _ in range(3)]
    for k in range(1, 4):
        if len(owner) > k:
            same[k - 1][k:] = (hashed[k:] == hashed[:-k]) & (owner[k:] == owner[:-k])
    distinct = _distinct(owner, hashed, n)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    mean = np.bincount(owner, weights=length, minlength=n) * per
    wide = np.sqrt(np.maximum(np.bincount(owner, weights=length.astype(float) ** 2, minlength=n) * per - mean**2, 0))
    parts = [
        np.log1p(size),
        np.log1p(total),
        mean,
        wide,
        counts[:, 1] / letters,
        counts[:, 3] / np.maximum(size, 1),
        counts[:, 5] * per,
        counts[:, 7:].sum(1) * per,
        rate((ups > 0) & (lows == 0) & (length > 1)),
        rate(last),
        rate(last2),
        rate(punct == length),
        rate(punct > 1),
        rate(same[0]),
        rate(same[1]),
        rate(same[2]),
        np.log1p(distinct) / np.log1p(np.maximum(total, 1)),
        *np.log1p(counts[:, 7:] * per[:, None] * 10).T,
    ]
    return np.stack(parts, 1)


def _distinct(owner: np.ndarray, hashed: np.ndarray, n: int) -> np.ndarray:
    if not len(owner):
        return np.zeros(n)
    order = np.lexsort((hashed, owner))
    h, o = hashed[order], owner[order]
    return np.bincount(o[np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]], minlength=n)


@dataclass
class Model:
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((np.clip(x, self.low, self.high) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        at = self.slope * (self.strength(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def bradley_terry(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, seed: int = 5) -> Model:
    """Strengths from preferences of every kind y = 1 over y = 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    zero = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Model(zero, zero, zero, zero + 1, zero, 0.0, 1.0, 0.0 if len(bad) else 1.0)
    low, high = np.quantile(x, 0.002, 0), np.quantile(x, 0.998, 0)
    mean = np.clip(x, low, high).mean(0)
    scale = np.maximum(np.clip(x, low, high).std(0), 1e-6)
    z = (np.clip(x, low, high) - mean) / scale
    rng = np.random.default_rng(seed)
    m = PAIRS * max(len(good), len(bad))
    winners = np.concatenate([rng.permutation(good) for _ in range(-(-m // len(good)))])[:m]
    losers = np.concatenate([rng.permutation(bad) for _ in range(-(-m // len(bad)))])[:m]
    d = z[winners] - z[losers]
    w = np.zeros(z.shape[1])
    for _ in range(40):  # Newton steps on the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / m + penalty * np.eye(len(w)), d.T @ p / m - penalty * w)
        w = w + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    made = Model(low, high, mean, scale, w, 0.0, 1.0)
    s = made.strength(x)
    made.cut = float(np.quantile(s, (y == 0).mean(), method="midpoint"))
    spread = abs(float(np.median(s[good]) - np.median(s[bad])))
    made.slope = 8 / max(spread, 1e-6)
    return made


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from the labelled rows of ``df``. Classes are sampled at one common rate, so that their shares stay."""
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    sizes = [r[0] for r in wanted.groupBy("_y").count().select("count").collect()]
    if not sizes:
        return bradley_terry(np.zeros((0, 1)), np.zeros(0))
    rate = min(1.0, 2 * sample / sum(sizes))
    chosen = wanted.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) < rate * (1 << 30))
    rows = bounded(df).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # about 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts = column(batch["_text"])
            x = np.concatenate([features(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in slices(starts)] or [np.zeros((0, 0))])
            yield pa.RecordBatch.from_arrays([batch["_id"].cast(pa.string()), batch["_y"], pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id string, y int, x binary").orderBy("id", "y", "x").collect()
    if not got:
        return bradley_terry(np.zeros((0, 1)), np.zeros(0))
    return bradley_terry(np.array([np.frombuffer(r["x"]) for r in got]), np.array([r["y"] for r in got]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str | Column] | None = None) -> DataFrame:
    """``keep`` (by default the id) and ``score`` of every row, from its text alone."""
    source = bounded(df).select(*(keep or [id_col]))
    own = text_col in source.columns
    source = source if own else bounded(df).select(*(keep or [id_col]), text_col)
    names = source.columns if own else source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts = column(batch[text_col])
            got = [model.score(features(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])) for a, b in slices(starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.concatenate(got) if got else [], pa.float64())], [*names, "score"])

    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names]
    return source.mapInArrow(run, ", ".join([*fields, "score double"]))

"""Language-model scores by deleted interpolation of n-gram estimates.

The model mixes maximum-likelihood estimates of a token after the two before it, after the one before it, of the token
alone, and a uniform floor. The last three are mixed first; what they give is mixed with the first. At both steps each
frequency class of the context (powers of two of its count) has mixture weights of its own. Counts cover every
training document: blocks of documents ask ranges of hashes for the counts of their distinct words, pairs and
triples (``exchange``), so the counts live spread over the cluster at whatever size. Words are told apart by 64 bits,
pairs and triples by 48. The weights are learned by expectation-maximisation on held-out counts: for the tokens of
the training documents in one of ``HELD_BLOCKS`` blocks the estimates are taken with that occurrence deleted, and the
tokens are summed up by frequency class and the logarithms of their estimates, in quarters of a power of two.

Tokens: words of the text with A-Z lower-cased, then one end; ends are also the context of the first word, where each
training document counts once. After any context the probabilities of the training tokens and of one unknown token sum
to 1: where a context was never seen, its share of the mixture goes to the other estimates.

Cases: a null or blank text has its end alone; a document outside training whose tokens are all unknown gets
the floor; without training documents there is only the unknown token, whose floor is 1, and the base formula has 0
counts; repeated rows count as often as they occur; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm import exchange
from lintlake.llm.bytesets import column, mix, slices, word_hashes
from lintlake.llm.storage import kept

#: The hash of the end token; no word's hash is fixed to it.
END = np.uint64(0x5851F42D4C957F2D)
#: One of so many blocks is held out for the mixture weights.
HELD_BLOCKS = 8
CLASSES = 24
_STEPS = 160  # of a quarter of a power of two, for the logarithm of an estimate over the floor
#: What pairs and triples keep of their hashes, and the kinds of keys: words, pairs, triples.
_HIGH, _LOW_BITS = ~np.uint64(0xFFFF), np.uint64(16)
_KINDS = "wpt"


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block and the place of each row's first token; every row ends with END."""
    buf, starts = column(table["text"])
    parts, sizes = [], []
    for a, b in slices(starts):
        h, row = word_hashes(buf[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        n = np.bincount(row, minlength=b - a)
        ends = np.cumsum(n + 1) - 1
        out = np.full(len(h) + b - a, END)
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word] = h
        parts.append(out)
        sizes.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))]


def keys(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The key of each token, of it after the one before it, and of it after the two before it."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[first[:-1]] = END
    earlier = np.empty_like(t)
    earlier[1:] = before[:-1]
    earlier[first[:-1]] = END
    after = mix(before * np.uint64(0x9E3779B97F4A7C15))
    return mix(t ^ np.uint64(0x2545F4914F6CDD1D)), mix(after + t) & _HIGH, mix(mix(after + earlier * np.uint64(0xC2B2AE3D27D4EB4F)) + t) & _HIGH


def _distinct(t: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind the sorted distinct keys of a block, and the place in them of each token's key."""
    return [np.unique(k, return_inverse=True) for k in keys(t, first)]


def _packed(kind: str, found: np.ndarray) -> dict[str, np.ndarray]:
    return {kind + x: v for x, v in exchange.pack_sorted(found if kind == "w" else found >> _LOW_BITS).items()}


def _part(kind: str, value: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {x[1:]: v for x, v in value.items() if x[0] == kind}


def ask_counts(n: int):
    def make(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        t, first = tokens(table)
        train = np.repeat(table["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        sent: list[dict[str, np.ndarray]] = [{} for _ in range(n)]
        for kind, (found, place) in zip(_KINDS, _distinct(t, first), strict=True):
            count = np.bincount(place[train], minlength=len(found))
            at = exchange.cut(found, n)
            for r in range(n):
                a, b = at[r], at[r + 1]
                sent[r] |= _packed(kind, found[a:b]) | {kind + x: v for x, v in exchange.pack_counts(count[a:b]).items()}
        for r in range(n):
            if any(len(sent[r][k + "base"]) for k in _KINDS):
                yield r, exchange.pack(0, **sent[r])

    return make


COUNTED = "range int, block int, data binary, tokens long, types long"


def count(table: pa.Table) -> pa.Table:
    """The counts of all training documents for each key of each block; the range's totals stand in its first row."""
    values = [exchange.unpack(d.as_py()) for d in table["data"]]
    told: list[dict[str, np.ndarray]] = [{} for _ in values]
    n_tokens = n_types = 0
    for kind in _KINDS:
        parts = [_part(kind, v) for v in values]
        every = [exchange.unpack_sorted(v) for v in parts]
        key = np.concatenate(every)
        if not len(key):
            for out in told:
                out[kind] = np.zeros(0, np.uint8)
            continue
        by = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
        total = np.add.reduceat(np.concatenate([exchange.unpack_counts(v) for v in parts])[by], edge)
        whole = np.empty(len(key), np.int64)
        whole[by] = np.repeat(total, np.diff(np.r_[edge, len(key)]))
        if kind == "w":
            n_tokens, n_types = int(total.sum()), int((total > 0).sum())
        at = 0
        for k, out in zip(every, told, strict=True):
            c = whole[at : at + len(k)]
            at += len(k)
            out[kind] = c.astype(np.min_scalar_type(int(c.max(initial=0))))
    data = [exchange.pack(1, **out) for out in told]
    rest = [0] * (len(data) - 1)
    return pa.table({"range": table["range"], "block": table["block"], "data": pa.array(data, pa.binary()), "tokens": pa.array([n_tokens, *rest], pa.int64()), "types": pa.array([n_types, *rest], pa.int64())})


def frequency_class(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two not above its count."""
    return np.where(context > 0, np.minimum(CLASSES - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)), 0)


@dataclass
class Model:
    n: int  # training tokens
    types: int  # distinct ones
    weights: np.ndarray  # CLASSES x (pair, single, floor), by the class of the token before
    upper: np.ndarray  # CLASSES x (triple, what the others give), by the class of the two tokens before

    @property
    def floor(self) -> float:
        return 1 / (self.types + 1)

    def lower(self, pair: np.ndarray, context: np.ndarray, single: np.ndarray, n: int | None = None) -> np.ndarray:
        w = self.weights[frequency_class(context)]
        return w[:, 0] * (pair / np.maximum(context, 1)) + w[:, 1] * (single / max(self.n if n is None else n, 1)) + w[:, 2] * self.floor

    def probability(self, triple: np.ndarray, two: np.ndarray, pair: np.ndarray, context: np.ndarray, single: np.ndarray) -> np.ndarray:
        w = self.upper[frequency_class(two)]
        return w[:, 0] * (triple / np.maximum(two, 1)) + w[:, 1] * self.lower(pair, context, single)

    def base(self, single: np.ndarray) -> np.ndarray:
        return np.log10((single + 0.5) / (self.n + 0.5 * (self.types + 1)))


def _counts(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Row starts of a block's tokens, and each token's triple, two-token context, pair, context and single counts."""
    t, first = tokens(table)
    single, pair, triple = (np.concatenate([found[r][kind] for r in sorted(found)]).astype(np.int64)[place] for kind, (_, place) in zip(_KINDS, _distinct(t, first), strict=True))
    context, two = np.empty_like(single), np.empty_like(single)
    context[1:] = single[:-1]
    context[first[:-1]] = single[first[1:] - 1]  # the end's count
    two[1:] = pair[:-1]
    two[first[:-1]] = single[first[1:] - 1]  # every training document begins once behind two ends
    return first, triple, two, pair, context, single


def _steps(p: np.ndarray, floor: float) -> np.ndarray:
    return np.where(p > 0, np.clip(np.round(4 * np.log2(np.maximum(p, 1e-300) / floor)) + 40, 1, _STEPS - 1), 0).astype(np.int64)


def held_cells(n: int, types: int, lower: Model | None = None):
    """Tokens by frequency class and steps of two estimates: pair and single, or triple and what ``lower`` gives."""

    def finish(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        cells, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if table.num_rows and found:
            first, *counts = _counts(table, found)
            train = np.repeat(table["train"].to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            triple, two, pair, context, single = (np.maximum(x[train] - 1, 0) for x in counts)  # this occurrence deleted
            if lower is None:
                cell, estimates = frequency_class(context), (pair / np.maximum(context, 1), single / max(n - 1, 1))
            else:
                cell, estimates = frequency_class(two), (triple / np.maximum(two, 1), lower.lower(pair, context, single, n - 1))
            for p in estimates:
                cell = cell * _STEPS + _steps(p, 1 / (types + 1))
            cells, total = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(total, pa.int64())})

    return finish


def _after_unseen(weights: np.ndarray) -> np.ndarray:
    """An unseen context gives no estimate: its share goes to the others, so that a mixture sums to 1 there too."""
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def mixture(cells: np.ndarray, total: np.ndarray, guess: tuple[float, ...], rounds: int = 60) -> np.ndarray:
    """Weights of each frequency class by expectation-maximisation; a third weight is the floor's."""
    start = np.array(guess)
    out = np.tile(start, (CLASSES, 1))
    if not len(cells):
        return _after_unseen(out)
    kind = cells // (_STEPS * _STEPS)
    step = np.stack([cells // _STEPS % _STEPS, cells % _STEPS], 1)
    p = np.where(step > 0, 2.0 ** ((step - 40) / 4), 0.0)
    if len(guess) == 3:
        p = np.concatenate([p, np.ones((len(p), 1))], 1)  # all over the floor
    for _ in range(rounds):
        part = p * out[kind]
        part *= (total / np.maximum(part.sum(1), 1e-300))[:, None]
        for c in range(len(guess)):
            out[:, c] = np.bincount(kind, weights=part[:, c], minlength=CLASSES)
        out += start * 1e-3  # a class without tokens keeps the first guess; no weight is 0
        out /= out.sum(1, keepdims=True)
    return _after_unseen(out)


def score_rows(model: Model):
    def finish(table: pa.Table, found: dict[int, dict[str, np.ndarray]]) -> pa.Table:
        names = [c for c in table.column_names if c not in ("block", "text", "train")]
        if not table.num_rows:
            columns: list = [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        else:
            first, *counts = _counts(table, found)
            single = counts[-1]
            at = first[:-1]
            columns = [
                pa.array(np.diff(first)),
                pa.array(np.add.reduceat((single > 0).astype(np.int64), at)),
                pa.array(np.full(len(at), model.n)),
                pa.array(np.add.reduceat(model.base(single), at)),
                pa.array(np.add.reduceat(np.log10(model.probability(*counts)), at)),
            ]
        return pa.table([*(table[c] for c in names), *columns], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return finish


def score_documents(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = exchange.BLOCK_BYTES) -> DataFrame:
    """``id_col, train, n_tokens, n_known, train_tokens, base_score, score`` of every row; learns from rows where ``train``."""
    spark = df.sparkSession
    flagged = df.select(F.struct(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train")).alias("_row"), F.col(text_col).alias("text"))
    docs, n_blocks = exchange.blocks(flagged, "_row", "text", block_bytes)
    docs = docs.select("block", F.col("id.id").alias("id"), F.col("id.train").alias("train"), F.col("id.train").alias("learned"), "text")
    n = exchange.ranges(n_blocks)
    counted = kept(exchange.ask(docs, ask_counts(n)).groupBy("range").applyInArrow(count, COUNTED), "counts")
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    answers = counted.select("range", "block", "data")
    held = F.col("block") % min(HELD_BLOCKS, n_blocks) == 0

    def learned(lower: Model | None, guess: tuple[float, ...]) -> np.ndarray:
        made = exchange.told(docs.where(held), answers.where(held), held_cells(total[0], total[1], lower), "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()  # a bounded grid
        return mixture(np.array([r[0] for r in made], np.int64), np.array([r[1] for r in made], np.float64), guess)

    model = Model(total[0], total[1], np.tile([0.0, 0.0, 1.0], (CLASSES, 1)), np.tile([0.0, 1.0], (CLASSES, 1)))
    if model.n:  # else the floor, which is then 1
        model.weights = learned(None, (0.4, 0.5, 0.1))
        model.upper = learned(model, (0.3, 0.7))
    kind = docs.schema["id"].dataType.simpleString()
    out = exchange.told(docs, answers, score_rows(model), f"id {kind}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), F.col("learned").alias("train"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

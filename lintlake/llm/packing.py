"""Best-fit packing of token pieces into fixed-size sequences by exact-complement hashing.

Only the histogram of lengths (at most ``size`` numbers, whatever the corpus) reaches the driver. There the
plan is made: for the longest length left, the sums of single lengths, pairs and triples of lengths are
looked up for the exact gap, under the counts still available; a combination that fills the gap is consumed
as often as its scarcest length allows. What no combination fills goes by best fit, again in whole batches
of equal lengths. A piece then finds its place from its length and its rank among the pieces of that length;
ranks come from counts for each task and length, so no task sees all pieces of a length.

Cases: a null or empty text is one piece (its end mark); a length over ``size`` is an error of the caller;
ties between equal lengths go by file order; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintlake.llm.bpe import codec
from lintlake.llm.storage import bounded, kept

#: (lengths in their order in a sequence, how many such sequences)
Plan = list[tuple[tuple[int, ...], int]]


class Sums:
    """The index of exact complements: sum -> the single, the pairs and the triples of lengths that make it.

    Counts only fall, so an entry that they no longer allow is passed over for good: each list has a place up to which
    its entries are spent. A triple's entry is its first length and the sum of the other two, whose pairs are indexed.
    """

    def __init__(self, counts: np.ndarray) -> None:
        have = np.flatnonzero(counts).astype(np.int16 if 2 * len(counts) < 1 << 15 else np.int32)
        self.single_sums = set(have.tolist())
        a, b = np.meshgrid(have, have, indexing="ij")
        keep = (a >= b) & (a + b < len(counts))
        self.pair_sums = _by_sum(a[keep], b[keep], a[keep] + b[keep])
        sums = np.array(sorted(self.pair_sums), have.dtype)
        # a triple's first length is no less than the mean: 3 * c >= c + r
        rests = [sums[: np.searchsorted(sums, min(2 * c, len(counts) - 1 - c), "right")] for c in have.tolist()]
        c = np.repeat(have, [len(r) for r in rests])
        r = np.concatenate([have[:0], *rests])
        self.triple_sums = _by_sum(c, r, c + r)
        self.spent_pairs = dict.fromkeys(self.pair_sums, 0)
        self.spent_triples = dict.fromkeys(self.triple_sums, 0)

    def single(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        return (gap,) if gap in self.single_sums and left[gap] else ()

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        first, second = self.pair_sums.get(gap, ((), ()))
        for k in range(self.spent_pairs.get(gap, 0), len(first)):
            a, b = first[k], second[k]
            if left[a] and left[b] and (a != b or left[a] > 1):
                self.spent_pairs[gap] = k
                return a, b
        if first:
            self.spent_pairs[gap] = len(first)
        return ()

    def triple(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        first, rest = self.triple_sums.get(gap, ((), ()))
        for k in range(self.spent_triples.get(gap, 0), len(first)):
            c, r = first[k], rest[k]
            if left[c]:
                second, third = self.pair_sums[r]
                for j in range(self.spent_pairs[r], len(second)):
                    a, b = second[j], third[j]
                    if left[a] > (a == c) and left[b] > (b == c) + (a == b):
                        self.spent_triples[gap] = k
                        return c, a, b
        if first:
            self.spent_triples[gap] = len(first)
        return ()


def _by_sum(first: np.ndarray, rest: np.ndarray, sums: np.ndarray) -> dict[int, tuple[array, array]]:
    """sum -> its entries, the longest first length first, as compact arrays: lists of numbers would take the driver some 300 MB."""
    by = np.lexsort((-rest, -first, sums))
    first, rest, sums = first[by], rest[by], sums[by]
    code = "h" if first.dtype == np.int16 else "i"
    kinds, begin = np.unique(sums, return_index=True)
    ends = np.append(begin, len(sums))[1:]
    return {int(s): (array(code, first[i:j].tobytes()), array(code, rest[i:j].tobytes())) for s, i, j in zip(kinds, begin, ends, strict=True)}


def plan(counts: np.ndarray, size: int) -> Plan:
    """How to pack ``counts[length]`` pieces of each length into sequences of ``size``."""
    left = np.zeros(size + 1, np.int64)
    left[: len(counts)] = counts
    out: Plan = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    sums = Sums(left)
    rest = np.zeros(size + 1, np.int64)
    for length in range(size - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            gap = size - length
            others = sums.single(gap, left) or sums.pair(gap, left) or sums.triple(gap, left)
            left[length] += 1
            if not others:
                rest[length] += left[length]
                left[length] = 0
                break
            whole = (length, *others)
            kinds, need = np.unique(whole, return_counts=True)
            times = int((left[kinds] // need).min())
            left[kinds] -= need * times
            out.append((whole, times))
    return out + best_fit(rest, size)


def best_fit(counts: np.ndarray, size: int) -> Plan:
    """Best fit, longest first, over batches of equal lengths and equal sequences."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(size + 1, bool)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = size - sum(lengths)
        open_.setdefault(gap, []).append((lengths, times))
        gaps[gap] = True

    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                lengths, times = open_[gap].pop()
                if not open_[gap]:
                    gaps[gap] = False
                used = min(times, n)
                if used < times:
                    put(lengths, times - used)
                put((*lengths, length), used)
                n -= used
            else:
                each = size // length
                if full := n // each:
                    put((length,) * each, full)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
    return [x for group in open_.values() for x in group]


def _segments(made: Plan, size: int) -> tuple[np.ndarray, ...]:
    """Rank ranges of each length with the sequence and offset that the first rank gets.

    Slots of one length that follow each other in a sequence share a range: rank r takes
    sequence first + r // slots, at offset + (r % slots) * length.
    """
    used = np.zeros(size + 1, np.int64)
    rows, first = [], 0
    for lengths, times in made:
        at, i = 0, 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            slots, length = j - i, lengths[i]
            rows.append((length, used[length], first, at, slots))
            used[length] += slots * times
            at += slots * length
            i = j
        first += times
    table = np.array(rows or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return tuple(np.ascontiguousarray(c) for c in table.T)


def pack(pieces: DataFrame, size: int, length_col: str = "length", group_col: str = "task", rank_col: str = "task_rank") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    group_col and rank_col number the pieces of a length within any grouping of the rows
    (``token_pieces`` gives the task and the rank in it); both are dropped from the result.
    """
    by_task = pieces.groupBy(length_col, group_col).agg(F.count("*").alias("_n"))
    counts = np.zeros(size + 1, np.int64)
    for r in by_task.groupBy(length_col).agg(F.sum("_n").alias("_n")).collect():
        counts[r[0]] = r[1]
    length, low, first, at, slots = _segments(plan(counts, size), size)
    width = np.int64(counts.max(initial=0) + 1)
    keys = length * width + low
    before = Window.partitionBy(length_col).orderBy(group_col).rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(length_col, group_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, [length_col, group_col])
    names = [c for c in pieces.columns if c not in (group_col, rank_col)]
    fields = [f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch[length_col].to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch["_base"].to_numpy(zero_copy_only=False).astype(np.int64) + batch[rank_col].to_numpy(zero_copy_only=False)
            seg = np.searchsorted(keys, n * width + rank, "right") - 1
            inner = rank - low[seg]
            where = first[seg] + inner // slots[seg], at[seg] + inner % slots[seg] * n
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, where)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def token_pieces(df: DataFrame, tokenizer: str, size: int, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text and ``end_id``, cut into pieces of ``size`` (the first takes what is over)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(7)]
                for row, text in enumerate(part["text"]):
                    ids = np.append(coder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for x, v in zip(out, (row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a], ids[a:b].astype(np.int32)), strict=True):
                            x.append(v)
                        seen[b - a] += 1
                m = len(out[0])
                arrays = [part[id_col].take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:6]), pa.array(np.full(m, task, np.int64))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(out[6], pa.list_(pa.int32()))] if with_ids else [])], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "task_rank", "task", *(["ids"] if with_ids else [])]
    source = bounded(df).select(F.col(id_col), F.col(text_col).alias("text"))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task_rank long, task long" + ", ids array<int>" * with_ids)


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with their sequence and place in it. The pieces are kept once: their ranks must not change."""
    return pack(kept(token_pieces(df, tokenizer, size, end_id, with_ids, id_col, text_col), "pieces"), size)

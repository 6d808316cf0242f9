"""Alignment of two tokenizers on the same texts: minimal groups of tokens, their links, and counts of linked pairs.

Token A and token B of a text are linked where their byte ranges overlap. Links make a bipartite graph; its connected
components, found by union-find, are exactly the minimal groups, which begin and end where both tokenizers cut.

Tasks encode whole texts and find groups and links; nothing of a text is shuffled. The texts of a task are taken in
blocks of about ``BLOCK_BYTES``. A block gives one row with its distinct pairs and their counts, and with the pairs of
each of its texts as places in that list. Counts of pairs are summed up over the blocks by a distributed aggregation,
the highest count of each B token is looked up in a table of at most as many rows as B has tokens (the one table that
is broadcast), and each block is told the counts of its own pairs. A pair that is in every block is one row for each.

Cases: a null or empty text, and one that either tokenizer does not give back byte by byte, has no tokens, and zeros;
strings of special tokens in texts are plain text; repeated rows count as often as they occur; texts of any length are
handled whole; an empty table gives an empty table; columns besides the id and the text are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.bpe import Codec
from lintlake.llm.exchange import pack, unpack
from lintlake.llm.storage import bounded, kept

#: Bytes of text in a block, about, and in one step of numpy.
BLOCK_BYTES, STEP_BYTES = 4 << 20, 1 << 19


class Pieces:
    """A SentencePiece model with the bytes of its tokens."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes_of = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.vocab_size())]
        self.lengths = np.array([len(b) for b in self.bytes_of])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Pair:
    """Both tokenizers, and the decimal ids with what may follow them in the text of a group."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = Codec(a, specials=False), Pieces(b)
        if len(self.a.bytes_of) * len(self.b.bytes_of) > 1 << 32:
            raise ValueError("pairs of these vocabularies have no numbers of 32 bits")
        size = max(len(self.a.bytes_of), len(self.b.bytes_of))
        self.size = size
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(size)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B for each text that has a byte and is given back by both; else two empty arrays."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for text, b in zip(texts, self.b.encode(texts), strict=True):
            if not text:
                out.append(none)
                continue
            whole = " " + text
            a = self.a.encode(whole)
            data = whole.encode()
            given_back = b"".join([self.a.bytes_of[i] for i in a.tolist()]) == data == b"".join([self.b.bytes_of[i] for i in b])
            out.append((a.astype(np.int64), np.array(b, np.int64)) if given_back else none)
        return out


@functools.lru_cache(2)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over all links at once: the least node of each node's component.

    The larger root of every open link is hooked below the smaller, and all paths are halved until they are flat.
    """
    parent = np.arange(n)
    while True:
        x, y = parent[u], parent[v]
        open_ = x != y
        if not open_.any():
            return parent
        u, v, x, y = u[open_], v[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of A and B whose byte ranges overlap, from the ends (ascending, both to the same last byte): one
    link for each stretch between two neighbouring ends of either."""
    n = int(ends_a[-1]) if len(ends_a) else 0
    cut_a, cut_b = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    cut_a[ends_a], cut_b[ends_b] = 1, 1
    ends = np.flatnonzero(cut_a | cut_b)
    # tokens that end before a stretch does
    return (np.cumsum(cut_a)[ends] - cut_a[ends]).astype(np.int64), (np.cumsum(cut_b)[ends] - cut_b[ends]).astype(np.int64)


def align(pairs: Pair, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """Numbers of each text (n_a, n_b, n_groups, n_links), its groups as text, and the text and pair of each link."""
    n_a, n_b = (np.array([len(x[k]) for x in found], np.int64) for k in (0, 1))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))
    la, lb = links(np.cumsum(pairs.a.lengths[a]), np.cumsum(pairs.b.lengths[b]))
    root = components(len(a) + len(b), la, len(a) + lb)
    text = np.repeat(np.arange(len(found)), n_a)
    heads = root[: len(a)] == np.arange(len(a))  # the least node of a component is its first token of A
    numbers = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text[heads], minlength=len(found)), "n_links": np.bincount(text[la], minlength=len(found))}
    # members of groups: by group, A before B, in order; each id is followed by the mark that the next one asks for
    side = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
    order = np.argsort(2 * root + side, kind="stable")
    group, part = root[order], side[order]
    mark = np.full(len(order), 2)
    same = group[1:] == group[:-1]
    mark[:-1][same] = part[1:][same] - part[:-1][same]
    said = mark * pairs.size + np.r_[a, b][order]
    at = np.r_[0, np.cumsum(n_a + n_b)].tolist()
    names = pairs.said
    groups = ["".join([names[k] for k in said[i:j].tolist()])[:-1] for i, j in zip(at, at[1:], strict=False)]
    return numbers, groups, text[la], a[la] * len(pairs.b.bytes_of) + b[lb]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], int]]:
    """Ids and texts in steps of about ``STEP_BYTES``."""
    for batch in batches:
        texts = [t or "" for t in batch["text"].to_pylist()]
        at = size = 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= STEP_BYTES or k == len(texts) - 1:
                yield batch["id"].slice(at, k + 1 - at), texts[at : k + 1], size
                at, size = k + 1, 0


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = "block long, rows int, data binary, pairs array<long>, counts array<long>"


def _counted(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and count of the distinct pairs of each text, by text and pair."""
    both, times = np.unique(text << 32 | key, return_counts=True)
    return both >> 32, (both & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)


def _close(block: int, tables: list[pa.RecordBatch], linked: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The row of a block: its texts, its distinct pairs, and those of each text as places in them."""
    table = pa.Table.from_batches(tables)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    row, key, times = (np.concatenate(x) for x in zip(*linked, strict=True))
    distinct = np.unique(key)
    spot = np.searchsorted(distinct, key)
    counts = np.bincount(spot, times, len(distinct)).astype(np.int64)
    data = pack(3, table=np.frombuffer(sink.getvalue(), np.uint8), n=np.bincount(row, minlength=table.num_rows).astype(np.uint32), spot=np.diff(spot, prepend=0).astype(np.int32), times=times)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([table.num_rows], pa.int32()), pa.array([data], pa.binary()), pa.array([distinct.astype(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], ["block", "rows", "data", "pairs", "counts"])


def _blocks(a: str, b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)
        block = TaskContext.get().partitionId() << 32
        tables: list[pa.RecordBatch] = []
        linked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = held = 0
        for ids, texts, size in _texts(batches):
            numbers, groups, text, key = align(both, both.tokens(texts))
            said = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups] if digest else groups
            tables.append(pa.RecordBatch.from_arrays([ids, *(pa.array(numbers[c], pa.int64()) for c in NUMBERS), pa.array(said, pa.string())], ["id", *NUMBERS, "groups"]))
            linked.append(_counted(text + rows, key))
            rows, held = rows + len(texts), held + size
            if held >= BLOCK_BYTES:
                yield _close(block, tables, linked)
                tables, linked, rows, held, block = [], [], 0, 0, block + 1
        if tables:
            yield _close(block, tables, linked)

    return run


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of one block, with the sums of what its pairs count over all blocks."""
    value = unpack(left["data"][0].as_py())
    rows = pa.ipc.open_stream(pa.py_buffer(value["table"].tobytes())).read_all()
    order = np.argsort(right["pair"].to_numpy())
    total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
    spot = np.cumsum(value["spot"].astype(np.int64))
    times = value["times"].astype(np.int64)
    edge = np.r_[0, np.cumsum(value["n"].astype(np.int64))]

    def by_row(x: np.ndarray) -> pa.Array:
        sums = np.r_[0, np.cumsum(x)]
        return pa.array(sums[edge[1:]] - sums[edge[:-1]], pa.int64())

    n_best, count_sum = (by_row(times * x[spot]) if len(spot) else pa.array(np.zeros(len(edge) - 1, np.int64)) for x in (best, total))
    return pa.table([*(rows[c] for c in ("id", *NUMBERS)), n_best, count_sum, rows["groups"]], names=["id", *NUMBERS, "n_best", "count_sum", "groups"])


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """``pair, total, best``: how many links hold each pair, and whether no pair of its B token has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = kept(each.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    highest = total.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("total").alias("most"))  # a row for each token of B at most
    joined = total.withColumn("b", F.col("pair") % n_b).join(F.broadcast(highest), "b")
    return joined.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align_documents(df: DataFrame, a: str, b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, or with ``digest`` its SHA-256 in hexadecimal (nothing for a text without tokens).
    ``a`` is a byte-level BPE file of the tokenizers library, ``b`` a SentencePiece model with byte fallback.
    """
    source = bounded(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    blocks = kept(source.mapInArrow(_blocks(a, b, digest), BLOCK), "blocks")
    counts = pair_counts(blocks, sentencepiece.SentencePieceProcessor(model_file=b).vocab_size())
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").select("of", "pair", "total", "best")
    schema = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    out = blocks.select("block", "data").groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_sums, schema)
    return out.withColumnRenamed("id", id_col)

"""Asking a distributed table: blocks of documents send hashes, ranges of hashes answer each block.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash of their id. A block sends each distinct
64-bit hash once, with what belongs to it, packed in one binary value for each range of hashes; a range, which
holds the hashes that all blocks sent it, answers each block in kind, and the block joins the answers with its
own documents again. A hash that occurs everywhere is thus one entry for each block, however many documents
hold it, and no key is gathered row by row.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Blocks for each range.
FAN = 4


def blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """``block, id, text, carried`` (a struct of the columns ``carry``) and the number of blocks. A null text is an empty one."""
    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    # id and length, not the id alone: ids that repeat still spread; rows without an id go by their text
    key = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id", F.octet_length("text")))
    return rows.select(F.pmod(key, F.lit(n)).cast("int").alias("block"), *rows.columns), n


def ranges(n_blocks: int, fan: int = FAN) -> int:
    return max(1, n_blocks // fan)


def cut(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges begins in sorted hashes; n + 1 places."""
    edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, edges), len(sorted_hashes)].astype(np.int64)


def pack(level: int = 1, **arrays: np.ndarray) -> bytes:
    """Named arrays as one value; level 0: not compressed."""
    out = io.BytesIO()
    for name, a in arrays.items():
        data = np.ascontiguousarray(a)
        body = data.tobytes()
        head = f"{name} {data.dtype.str} {len(body)}\n".encode()
        out.write(head)
        out.write(body)
    return (b"z" + zstandard.compress(out.getvalue(), level)) if level else (b"r" + out.getvalue())


def unpack(value: bytes) -> dict[str, np.ndarray]:
    data = zstandard.decompress(value[1:]) if value[:1] == b"z" else value[1:]
    out, at = {}, 0
    while at < len(data):
        end = data.index(b"\n", at)
        name, kind, n = data[at:end].decode().split(" ")
        at = end + 1
        out[name] = np.frombuffer(data, np.dtype(kind), int(n) // np.dtype(kind).itemsize, at)
        at += int(n)
    return out


def pack_sorted(values: np.ndarray) -> dict[str, np.ndarray]:
    """Ascending 64-bit numbers as gaps of as few bytes as the largest needs, byte by byte; the two upper bytes, mostly alike, compressed."""
    gaps = np.diff(values, prepend=values[:1])
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    low = max(0, width - 2)
    return {"base": values[:1], "gaps": planes[:low].ravel(), "top": np.frombuffer(zstandard.compress(planes[low:].tobytes(), 1), np.uint8), "width": np.array([width], np.int8)}


def unpack_sorted(value: dict[str, np.ndarray]) -> np.ndarray:
    width = int(value["width"][0])
    low = max(0, width - 2)
    top = np.frombuffer(zstandard.decompress(value["top"].tobytes()), np.uint8).reshape(width - low, -1)
    wide = np.zeros((top.shape[1], 8), np.uint8)
    wide[:, :low] = value["gaps"].reshape(low, top.shape[1]).T
    wide[:, low:width] = top.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + (value["base"][0] if len(value["base"]) else np.uint64(0))


def pack_counts(values: np.ndarray) -> dict[str, np.ndarray]:
    """Counts that are mostly small: a compressed byte for each, and those of 255 and more apart."""
    big = np.flatnonzero(values >= 255)
    small = zstandard.compress(np.minimum(values, 255).astype(np.uint8).tobytes(), 1)
    return {"small": np.frombuffer(small, np.uint8), "at": big.astype(np.int32), "big": values[big].astype(np.int64)}


def unpack_counts(value: dict[str, np.ndarray]) -> np.ndarray:
    out = np.frombuffer(zstandard.decompress(value["small"].tobytes()), np.uint8).astype(np.int64)
    out[value["at"]] = value["big"]
    return out


SENT = "range int, block int, data binary"


def ask(docs: DataFrame, make: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """What each block sends: ``make(block's rows)`` gives (range, value)."""

    def run(table: pa.Table) -> pa.Table:
        return sent(table["block"][0].as_py(), make(table))

    return docs.groupBy("block").applyInArrow(run, SENT)


def sent(block: int, made: Iterator[tuple[int, bytes]]) -> pa.Table:
    rows = list(made)
    return pa.table({"range": pa.array([r for r, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})


def answer(sent: DataFrame, reply: Callable[[list[dict[str, np.ndarray]]], list[bytes]]) -> DataFrame:
    """What each range answers: ``reply(the blocks' values)`` gives one value for each of them."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["block"].to_numpy(), kind="stable")
        values = [unpack(table["data"][int(k)].as_py()) for k in order]
        blocks_ = table["block"].take(pa.array(order))
        return pa.table({"range": table["range"].take(pa.array(order)), "block": blocks_, "data": pa.array(reply(values), pa.binary())})

    return sent.groupBy("range").applyInArrow(run, SENT)


def told(docs: DataFrame, answers: DataFrame, finish: Callable[[pa.Table, dict[int, dict[str, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """Each block's rows with its answers by range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r: unpack(d) for r, d in zip(right["range"].to_pylist(), right["data"].to_pylist(), strict=True)}
        return finish(left, found)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

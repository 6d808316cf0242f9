"""Lines that files say again: each line of some files once, with all its places.

A file's lines repeat, and files of a language share lines. What depends on a line alone is then worked out once for the files of
a batch, and told for each place. No row is shuffled; a batch is what Arrow hands a task at a time, cut at ``PIECE_BYTES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Characters of the files whose lines are told together.
PIECE_BYTES = 16 << 20


def fresh() -> str:
    return uuid.uuid4().hex[:12]


def pieces(batch: pa.RecordBatch, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch of files (content) cut where the characters get too many."""
    most = most or PIECE_BYTES
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["content"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(sizes, most + (sizes[begin - 1] if begin else 0), "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Lines:
    """The lines of some files (content) in order: ``text``, ``file`` and ``line``; in groups of equal text and kind of file, their places by group
    (``order``), how many a group has (``counts``) and its ``first``."""

    def __init__(self, files: pa.RecordBatch, kind: pa.Array) -> None:
        split = pc.split_pattern(files["content"], "\n")
        self.text, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        self.file = np.repeat(np.arange(len(lengths)), lengths)
        self.line = np.arange(len(self.file)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        texts, kinds = self.text.dictionary_encode(), kind.dictionary_encode()
        key = kinds.indices.to_numpy()[self.file].astype(np.int64) * len(texts.dictionary) + texts.indices.to_numpy()
        group = pa.array(key).dictionary_encode().indices.to_numpy()
        self.counts = np.bincount(group)
        self.order = np.argsort(group.astype(np.uint16) if len(self.counts) < 1 << 16 else group, kind="stable")
        self.first = self.order[np.cumsum(self.counts) - self.counts]


def distinct_lines(files: str, kind: str, spark: SparkSession | None = None, whole: bool = False) -> str:
    """The name of a view (path, lang, wide, text, places) of the SQL of ``files`` (path, lang, wide, content): a row for each line of
    some files that share lang, wide and ``kind`` (SQL); ``places``: path and line of each of its places; ``path``: one of theirs. ``whole``: the files have
    ``name`` and ``lines``, a place its file's name, and a line whether its files are ``long`` (more than 10 lines)."""

    most = PIECE_BYTES
    of_place, of_line = (["path", "name"], ["path", "lang", "wide", "long"]) if whole else (["path"], ["path", "lang", "wide"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, most):
                x = Lines(piece, piece["kind"])
                place = pa.StructArray.from_arrays([*(piece[c].take(pa.array(x.file[x.order])) for c in of_place), pa.array(x.line[x.order])], [*of_place, "line"])
                places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(x.counts)].astype(np.int32)), place)
                told = [piece[c].take(pa.array(x.file[x.first])) for c in of_line]
                yield pa.RecordBatch.from_arrays([*told, x.text.take(pa.array(x.first)), places], [*of_line, "text", "places"])

    spark = spark or SparkSession.active()
    more, long = (", name, lines > 10 AS long", ", CAST(lines > 10 AS STRING)") if whole else ("", "")
    rows = spark.sql(f"SELECT path, lang, wide{more}, concat_ws(',', lang, CAST(wide AS STRING){long}, {kind}) AS kind, content FROM ({files})")
    name = f"distinct_lines_{fresh()}"
    rows.mapInArrow(once, f"path string, lang string, wide boolean{', long boolean' * whole}, text string, places array<struct<path: string{', name: string' * whole}, line: bigint>>").createOrReplaceTempView(name)
    return name

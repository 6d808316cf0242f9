"""Media columns: payloads as 8-bit images in archives, read back by a Spark data source.

``write_archives`` stores each payload losslessly as an 8-bit greyscale PNG in ZIP archives (members
uncompressed, so that a member's bytes lie in one range of its archive), one archive for each task and
``archive_bytes``, in a folder that all executors share, with a table of the finished archives and their sizes.
``ArchiveSource`` ("media_archive") plans partitions as byte ranges from names and sizes alone; it opens no archive.
A task reads the central directory of its archives, takes the members that begin in its ranges, and streams their
bytes as Arrow batches; a member whose read fails or whose checksum is wrong is read again on its own, from its
offset, before the task gives up.

Cases: a null text is an empty one; payloads are padded with blanks to a positive multiple of 192 bytes
(one image line); equal texts give equal media; null and empty ids stay apart; repeated rows are stored as often as
they occur; an empty table writes no archive and reads as empty; other columns are ignored.
"""

from __future__ import annotations

import binascii
import hashlib
import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lintlake.llm.storage import bounded, new_folder

#: Bytes of one image line, and what payloads are padded to.
WIDTH = 192
#: Fixed value: the signature of a PNG file.
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale image of ``WIDTH`` columns whose samples are the payload."""
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that ``to_png`` made; raises ValueError on damage."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, width = 8, b"", 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if binascii.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", body)[0]
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].reshape(-1)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload of a text, and its bytes before padding."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def feature(samples: np.ndarray) -> str:
    """Sixteen 4-bit band shares of the sample histogram, with mean and deviation, as text."""
    share = np.bincount(samples >> 4, minlength=16) * 15 // max(1, len(samples))
    return "".join(f"{int(x):x}" for x in share) + f"-{samples.mean():.3f}-{samples.std():.3f}"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def write_archives(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 256 << 20) -> str:
    """Store every text; the path of the table (name, size) of finished archives. A task that is run again writes
    new archives, and only those of the attempt that finished are in the table."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        out, names, sizes, number = None, [], [], 0

        def close() -> None:
            archive, stream, name, sink = out
            archive.close()
            stream.close()
            names.append(name)
            sizes.append(sink.at)

        for batch in batches:
            for key, text in zip(batch["id"], batch["text"], strict=True):
                if out is None:
                    name = f"{path}/media-{TaskContext.get().partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex[:8]}.zip"
                    stream = fs.open_output_stream(name)
                    sink = _Sink(stream)
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), stream, name, sink
                payload, n = padded(text.as_py())
                info = zipfile.ZipInfo(f"{number:09d}.png")
                info.comment = f"{_key(key.as_py())} {n}".encode()
                out[0].writestr(info, to_png(payload))
                number += 1
                if out[0].fp.tell() > archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    source = bounded(df).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source.mapInArrow(run, "name string, size long").write.parquet(f"{folder}/finished")
    return f"{folder}/finished"


def _key(key: object) -> str:
    return "-" if key is None else f"+{key}"


class _Sink(io.RawIOBase):
    """A write-only stream that counts, as zipfile wants it."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        data = bytes(data)
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def writable(self) -> bool:
        return True

    def flush(self) -> None:
        pass


class Ranges(InputPartition):
    """Byte ranges of archives: (archive, begin, end)."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        super().__init__(spans)
        self.spans = spans


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _uri(options["path"])
        self.finished = options.get("finished", "")
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.retries = int(options.get("retries", 3))

    def archives(self) -> list[tuple[str, int]]:
        """Names and sizes, from the table of finished archives or else from the folder's listing."""
        fs, path = _fs(_uri(self.finished) or self.folder)
        if self.finished:
            parts = [pq.read_table(x.path, filesystem=fs) for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")]
            return sorted(x for t in parts for x in zip(t["name"].to_pylist(), t["size"].to_pylist(), strict=True))
        return sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".zip"))

    def partitions(self) -> list[Ranges]:
        out, spans, held = [], [], 0
        for name, size in self.archives():
            for begin in range(0, size, self.range_bytes):
                end = min(size, begin + self.range_bytes)
                spans.append((name, begin, end))
                held += end - begin
                if held >= self.range_bytes:
                    out.append(Ranges(spans))
                    spans, held = [], 0
        return [*out, Ranges(spans)] if spans or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = _fs(self.folder)
        rows: list[tuple] = []
        held = 0
        for name, begin, end in partition.spans:
            with fs.open_input_file(name) as f:
                for info in self.members(fs, f, name, begin, end):
                    data = self.member(fs, f, name, info.header_offset, info.file_size, info.CRC)
                    rows.append((os.path.basename(name), info.filename, info.header_offset, info.comment.decode(), data))
                    held += info.file_size
                    if held > 4 << 20:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, fs: pafs.FileSystem, f, name: str, begin: int, end: int) -> list[zipfile.ZipInfo]:
        """The members that begin in a range, by the archive's directory; read again on failure."""
        for left in range(self.retries, -1, -1):
            try:
                with zipfile.ZipFile(f) as archive:
                    return [x for x in archive.infolist() if begin <= x.header_offset < end]
            except (OSError, zipfile.BadZipFile):
                if not left:
                    raise
                f = fs.open_input_file(name)
        raise AssertionError

    def member(self, fs: pafs.FileSystem, f, archive: str, offset: int, size: int, crc: int) -> bytes:
        """One member's bytes; on failure again on its own, from its offset, with a new stream."""
        for left in range(self.retries, -1, -1):
            try:
                f.seek(offset)
                head = f.read(30)
                name, extra = struct.unpack_from("<HH", head, 26)
                f.seek(offset + 30 + name + extra)
                data = f.read(size)
                if head[:4] != b"PK\x03\x04" or len(data) != size or binascii.crc32(data) != crc:
                    raise OSError(f"member at {offset} of {archive} is damaged")
                return data
            except OSError:
                if not left:
                    raise
                f = fs.open_input_file(archive)
        raise AssertionError

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        archive, name, offset, comment, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(name, pa.string()), pa.array(offset, pa.int64()), pa.array(comment, pa.string()), pa.array(media, pa.binary())], ["archive", "member", "byte_offset", "comment", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row for each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, byte_offset long, comment string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, finished: str = "", range_bytes: int = 16 << 20) -> DataFrame:
    """One row for each member of the archives in ``folder``; of those in the table ``finished``, if given."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).option("finished", finished).load(folder)


def media_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts as media, read the stored bytes back and describe them."""
    spark = df.sparkSession
    folder = new_folder(spark, "media")
    finished = write_archives(df, folder, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for comment, media in zip(batch["comment"].to_pylist(), batch["media"].to_pylist(), strict=True):
                key, _, n = comment.rpartition(" ")
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((key[1:] if key[:1] == "+" else None, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read = read_archives(spark, folder, finished).select("comment", "media")
    out = read.mapInArrow(run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(F.col("key").cast(kind).alias(id_col), *(c for c in out.columns if c != "key"))

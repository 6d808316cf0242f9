"""Readers that give ``path, name, lang, content`` rows: folders, archives, recorded repository listings.

All are lazy; unreadable bytes become replacement characters, and files that a scan skips are filtered before
their content is decoded.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lintlake.plans.report import SKIP_DIRS, SKIP_EXTS, gitignore_pattern, glob_pattern


def with_names(df: DataFrame) -> DataFrame:
    """``path, name, lang, content`` from ``path, content``; lang is the lower-cased text behind the last dot."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.lower(F.element_at(F.split(name, "[.]"), -1)).alias("lang"), "content")


def kept(path: Column, gitignore: list[str] = (), globs: list[str] = ()) -> Column:
    """Whether a scan keeps a path."""
    keep = ~path.rlike("(?:^|/)(?:" + "|".join(x.replace(".", "[.]") for x in SKIP_DIRS) + ")/")
    keep &= ~F.lower(F.element_at(F.split(path, "[.]"), -1)).isin(*SKIP_EXTS)
    for p in [gitignore_pattern(x) for x in gitignore if x.strip() and not x.startswith(("#", "!"))] + [glob_pattern(x) for x in globs]:
        keep &= ~path.rlike(p)
    return keep


def read_folder(spark: SparkSession, folder: str, gitignore: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """All files below a folder, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.split("://", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^/*" + "".join("[" + c + "]" if c in ".+*?()[]{}|$" else c for c in root.lstrip("/")) + "/", "")
    rows = raw.withColumn("path", path)
    return with_names(rows.where(kept(F.col("path"), gitignore, globs)).select("path", F.decode("content", "UTF-8").alias("content")))


def read_zip(spark: SparkSession, path: str, strip: bool = True, gitignore: list[str] = (), globs: list[str] = ()) -> DataFrame:
    """The files in ZIP archives; ``strip`` drops the first path segment. An archive is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"].to_pylist():
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    rows = [(i.filename.split("/", 1)[-1] if strip and "/" in i.filename else i.filename, archive.read(i).decode("utf-8", "replace")) for i in archive.infolist() if not i.is_dir()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["path", "content"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "path string, content string")
    return with_names(raw.where(kept(F.col("path"), gitignore, globs)))


def read_table(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files that already are rows."""
    return with_names(df.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content")))


def parse_repo_url(url: str) -> tuple[str, str] | None:
    """Owner and name of a repository link, or of ``owner/name``."""
    body = url.strip().split("://", 1)
    parts = [p for p in body[-1].split("#")[0].split("?")[0].split("/") if p][1 if len(body) == 2 else 0 :]
    return (parts[0], parts[1].removesuffix(".git")) if len(parts) >= 2 else None


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(names)
        self.names = names


#: Directories of a recorded contents listing that are followed below each other, at most.
DEPTH = 10


class ListingReader(DataSourceReader):
    """Reads ``tree.json`` ({"tree": [{"path", "type"}]}) and ``blobs/<path>.json`` ({"content": base64}) of a recorded listing.

    Where the tree is missing or says that it is truncated, the directories are followed instead: ``contents.json`` and
    ``contents/<path>.json`` ([{"path", "name", "type"}]), down to ``DEPTH``; one that cannot be read is left out.
    """

    def __init__(self, options: dict) -> None:
        folder = options["path"]
        folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
        self.uri = folder if "://" in folder else f"file://{folder}"
        self.each = int(options.get("files", 64))

    def load(self, name: str):
        fs, root = pafs.FileSystem.from_uri(self.uri)
        with fs.open_input_stream(f"{root}/{name}") as f:
            return json.loads(f.read().decode("utf-8"))

    def names(self) -> list[str]:
        try:
            tree = self.load("tree.json")
            if not tree.get("truncated"):
                return [x["path"] for x in tree["tree"] if x["type"] == "blob"]
        except OSError:
            pass
        return self.followed("contents.json", 0)

    def followed(self, listing: str, depth: int) -> list[str]:
        try:
            items = self.load(listing)
        except OSError:
            if not depth:
                raise
            return []
        out = [x["path"] for x in items if x["type"] == "file"]
        for x in items:
            if x["type"] == "dir" and x["name"] not in SKIP_DIRS and depth < DEPTH:
                out += self.followed(f"contents/{x['path']}.json", depth + 1)
        return out

    def partitions(self) -> list[_Files]:
        names = self.names()
        return [_Files(names[k : k + self.each]) for k in range(0, len(names), self.each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, str]]:
        for name in partition.names:
            try:
                yield name, self.load(f"blobs/{name}.json")["content"]
            except OSError:  # unreadable files are left out of a scan
                continue


class RepositoryListing(DataSource):
    """``spark.read.format("repository_listing").load(folder)``: path and base64 content of a recorded repository."""

    @classmethod
    def name(cls) -> str:
        return "repository_listing"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RepositoryListing)
    raw = spark.read.format("repository_listing").load(folder)
    text = F.decode(F.unbase64(F.regexp_replace("content", r"\s+", "")), "UTF-8")
    return with_names(raw.where(kept(F.col("path"))).select("path", text.alias("content")))

"""Files with names of their own, written by tasks and published together.

``named_files`` is a data source for writing. Each task writes below a staging folder of its own attempt; when all tasks are done the driver moves finished
folders into place, whole folders by one rename where nothing of that name exists yet. A task that fails removes what it wrote; a job that fails
removes its staging folder; attempts that came too late are never published. Writing the same rows twice gives the same folder: files of one name are
replaced. The folder has to be one that driver and executors mount, like the cluster's checkpoint folder; other stores take the same rows as a table (``write_artefacts``).

The files of a folder are one task's, so that a folder is moved by one rename however many there are; in folders of over ``MANY_FILES`` rows each file is dealt by itself.

Nulls: a null path is an error, a null body is an empty file. Rows of one path are one file, in order of ``part`` (ties in any order). An empty table gives an empty folder. A path that leaves the folder is an error.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

import pagestrata
from pagestrata.functions.text import byte_cut
from pagestrata.functions.urls import file_key
from pagestrata.plans.reports import saved_blocks, summary_rows
from pagestrata.session import stored
from pagestrata.sources.store import artefact_rows

cloudpickle.register_pickle_by_value(pagestrata)

#: Bytes that a file's name may have.
NAME_BYTES = 255
_STAGING = "_staging-"
#: Rows of a folder beyond which its files are dealt over many tasks.
MANY_FILES = 10_000
#: Bytes of bodies that are read before they are handed on.
_READ_BYTES = 4_000_000


def local_path(folder: str) -> str:
    """The path of a folder given as a path or a file: address."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file") or parts.netloc not in ("", "localhost"):
        raise ValueError(f"files can be written to a mounted folder only, not to {folder}")
    return os.path.abspath(unquote(parts.path) if parts.scheme else folder)


@dataclass
class Written(WriterCommitMessage):
    """What one task has staged."""

    folder: str
    files: int
    bytes: int


def publish(staged: str, target: str) -> None:
    """Move what lies in a staged folder below the target: folders that are new there by one rename, files over those of the same name."""
    os.makedirs(target, exist_ok=True)
    for entry in os.scandir(staged):
        to = os.path.join(target, entry.name)
        if not entry.is_dir(follow_symlinks=False):
            os.replace(entry.path, to)
            continue
        try:
            os.rename(entry.path, to)
        except OSError:
            if not os.path.isdir(to):
                raise
            publish(entry.path, to)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, f"{_STAGING}{uuid.uuid4().hex}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        own = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        os.makedirs(own)
        try:
            return self._write(batches, own)
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)
            raise

    def _write(self, batches: Iterator[pa.RecordBatch], own: str) -> Written:
        now, file, files, size = None, None, 0, 0
        try:
            for batch in batches:
                for path, body in zip(batch.column("path"), batch.column("body")):
                    path, body = path.as_py(), body.as_py() or b""
                    if path != now or file is None:
                        if file:
                            file.close()
                        file, now, files = self._opened(own, path), path, files + 1
                    file.write(body)
                    size += len(body)
        finally:
            if file:
                file.close()
        return Written(own, files, size)

    @staticmethod
    def _opened(own: str, path: str):
        if not path or os.path.isabs(path) or ".." in path.split("/") or path.startswith(_STAGING):
            raise ValueError(f"not a path below the folder: {path!r}")
        at = os.path.join(own, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        return open(at, "wb")

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for message in messages:
            if message is not None:
                publish(message.folder, self.folder)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class NamedFiles(DataSource):
    """Data source ``named_files``: rows (path, body) in order of path, all of one path in one task."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, body binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are replaced one by one; use mode append")
        return FileWriter(local_path(self.options["path"]))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by folder, or by path in folders of many rows."""
    within = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("__folder")
    many = rows.select(within).groupBy("__folder").count().where(F.col("count") > MANY_FILES).select("__folder", F.lit(True).alias("__many"))
    named = rows.select("path", "part", F.col("body").cast("binary").alias("body"), within).join(F.broadcast(many), "__folder", "left")
    return named.repartition("__folder", F.when(F.col("__many"), F.col("path"))).select("path", "part", "body")


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows ``path, part, body`` as files below a folder; the parts of a file, in order, are its text.

    The rows are gone through twice, first for the number of each folder's rows: what is dear to make should be stored before.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    in_order = dealt(rows).sortWithinPartitions("path", "part").select("path", "body")
    in_order.write.format("named_files").mode("append").save(local_path(folder))


def _hidden(name: str) -> bool:
    """Names that Spark's own file sources pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _entries(top: str) -> Iterator[os.DirEntry]:
    with os.scandir(top) as found:
        yield from (entry for entry in found if not _hidden(entry.name))


def _files_below(top: str) -> Iterator[str]:
    """Files of a folder and its folders; a file is itself."""
    if not os.path.isdir(top):
        yield top
        return
    for entry in _entries(top):
        yield from _files_below(entry.path) if entry.is_dir() else (entry.path,)


def _shares(top: str) -> Iterator[str]:
    """What tasks are dealt of a folder: files and folders of its first two levels, down to which one task lists it."""
    for entry in _entries(top):
        yield from (below.path for below in _entries(entry.path)) if entry.is_dir() else (entry.path,)


def _bodies(paths: Iterator[str], root: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["path", "bytes", "content"])

    for path in paths:
        with open(path, "rb") as file:
            body = file.read()
        if body:
            rows.append((os.path.relpath(path, root), len(body), body))
            size += len(body)
        if size >= _READ_BYTES or len(rows) >= 1000:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, body) of the published files, the path relative to the folder; empty files are no rows.

    Tasks list and read them, so that the driver sees no file's name.
    """
    root = local_path(folder)
    if not os.path.isdir(root):
        raise FileNotFoundError(root)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            shares = _shares(root)
            while some := list(islice(shares, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["share"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = (path for batch in batches for share in batch.column("share") for path in _files_below(share.as_py()))
        yield from _bodies(paths, root)

    shares = spark.range(1).coalesce(1).mapInArrow(listed, "share string")
    tops = shares.repartition(4 * spark.sparkContext.defaultParallelism, "share")
    found = tops.mapInArrow(read, "path string, bytes long, content binary")
    return found.select("path", "bytes", F.decode("content", "UTF-8").alias("body"))


def _file(path: Column, body: Column, part: Column | None = None) -> tuple[Column, Column, Column]:
    return path.alias("path"), (F.lit(0) if part is None else part).alias("part"), body.alias("body")


def page_file_rows(pages: DataFrame) -> DataFrame:
    """One file per page: the key of its URL, cut so that the name is short enough, and the page's id.

    A key that begins with a dot or an underscore, or is empty, has "page" before it, since readers skip such names.
    """
    ending = F.concat(F.lit("."), F.col("page_id").cast("string"), F.lit(".html"))
    key = file_key(F.coalesce("url", F.lit("")))
    key = F.when(key.rlike("^([._]|$)"), F.concat(F.lit("page"), key)).otherwise(key)
    key = byte_cut(key, NAME_BYTES - len(".-9223372036854775808.html"))
    return pages.select(*_file(F.concat(key, ending), F.col("html")))


def block_file_rows(blocks: DataFrame) -> DataFrame:
    """Two files per block: markup and metadata."""
    return artefact_rows(blocks).select(*_file(F.col("path"), F.col("body")))


def bundle_file_rows(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """All files of each operation: those of its blocks and its summary page, one document made of the page's chunks.

    The blocks are gone through several times, so they should be a stored table.
    """
    place = F.struct("section", "platform", "chunk_no")
    path = F.concat(F.lit("blocks/"), F.col("operation_id"), F.lit("/blocks_summary.html"))
    summary = summary_rows(operations, blocks).select(*_file(path, F.col("text"), place))
    first = F.struct(F.lit(0).alias("section"), F.lit("").alias("platform"), F.lit(0).alias("chunk_no"))
    return artefact_rows(blocks).select(*_file(F.col("path"), F.col("body"), first)).unionByName(summary)


def write_page_files(pages: DataFrame, folder: str) -> None:
    """Raw-page sink as files."""
    write_files(page_file_rows(pages), folder)


def save_block_files(blocks: DataFrame, folder: str) -> DataFrame:
    """Write the blocks' files and return the receipt: blocks and folder of each operation. The blocks are made once."""
    blocks = stored(blocks, "blocks")
    write_files(block_file_rows(blocks), folder)
    return saved_blocks(blocks)


def write_bundles(operations: DataFrame, blocks: DataFrame, folder: str) -> None:
    """A folder per operation with every block file and the summary page. The blocks are made once."""
    write_files(bundle_file_rows(operations, stored(blocks, "blocks")), folder)

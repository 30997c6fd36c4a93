"""Documents as files: a Spark sink that writes the text of each change set from the executors, with a commit protocol.

    write_documents(render.junit_lines(items, "High"), "s3://bucket/reports", extension="xml")

Rows (changeset_id, content) of one change set that follow each other become one file, so a document may come line by line and no task
holds a whole one.  A task writes into a folder of its own below ``_staged-<job>``; when all tasks are done the driver renames each
task's folder, one step per task, to ``part-<job>-<task>``.  A task that fails, or runs twice, leaves nothing there.
"""

from __future__ import annotations

import hashlib
import sys
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "changeset_id STRING, content STRING"
MOST_NAME = 180


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a path on a file system that all machines mount."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def file_name(changeset_id: str | None, extension: str) -> str:
    """A name that any file system takes; ids that are long or end alike after quoting keep apart by a hash."""
    name = urllib.parse.quote(changeset_id or "", safe="").replace(".", "%2E")
    if not name or len(name) > MOST_NAME:
        name = name[:MOST_NAME] + "-" + hashlib.sha256((changeset_id or "").encode()).hexdigest()[:16]
    return f"{name}.{extension}"


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task wrote, and the number of its files."""

    folder: str
    files: int
    task: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.extension = options["path"].rstrip("/"), options.get("extension", "txt")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex[:12]

    def _staging(self) -> str:
        return f"{place(self.path)[1]}/_staged-{self.job}"

    def write(self, rows: Iterator) -> Staged:
        files, _ = place(self.path)
        task = TaskContext.get()
        folder = f"{self._staging()}/{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        now, out, n = object(), None, 0
        try:
            for row in rows:
                if row[0] != now or out is None:
                    if out is not None:
                        out.close()
                    if not n:
                        files.create_dir(folder, recursive=True)
                    now, n = row[0], n + 1
                    out = files.open_output_stream(f"{folder}/{file_name(now, self.extension)}")
                out.write((row[1] or "").encode("utf-8", "surrogatepass"))
        except BaseException:
            if out is not None:
                out.close()
            if n:
                files.delete_dir(folder)
            raise
        if out is not None:
            out.close()
        return Staged(folder, n, task.partitionId())

    def commit(self, messages: list[Staged | None]) -> None:
        files, path = place(self.path)
        if self.overwrite and files.get_file_info(path).type == fs.FileType.Directory:
            for old in files.get_file_info(fs.FileSelector(path)):
                if old.base_name.startswith("part-") and old.type == fs.FileType.Directory:
                    files.delete_dir(old.path)
        for m in messages:
            if m is not None and m.files:
                files.move(m.folder, f"{path}/part-{self.job}-{m.task:05d}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _ = place(self.path)
        if files.get_file_info(self._staging()).type == fs.FileType.Directory:
            files.delete_dir(self._staging())


class ReviewDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "review_documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the sink known to a session; its code travels with it."""
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        spark.dataSource.register(ReviewDocuments)
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def write_documents(lines: DataFrame, path: str, *, extension: str = "txt", order: tuple[str | Column, ...] = ("section", "pos"), mode: str = "append") -> None:
    """Write (changeset_id, content) as a file per change set; several rows of one come together in ``order``."""
    register(lines.sparkSession)
    dealt = lines.repartition("changeset_id").sortWithinPartitions("changeset_id", *order)
    dealt.select(F.col("changeset_id").cast("string"), F.col("content").cast("string")).write.format("review_documents").mode(mode).option("path", path).option("extension", extension).save()

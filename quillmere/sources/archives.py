"""Notes in gzipped tar archives, as a data source: an archive is a partition when read, a task's rows are one or several when
written, each within the limits of an import.

Reading streams the members, so no archive is held whole; each is held to the limits of an import. Writing puts the tasks'
archives into a folder beside the target, which the commit renames into place, so readers see all of them or none; a task that
ran twice leaves a file that nobody named, which the commit deletes. Files are opened by pyarrow (file, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import IMPORT_BYTES, IMPORT_ENTRIES, NOTE_BYTES, LoadError

NOTE = "key string, raw string"


def _opened(uri: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass(frozen=True)
class Limits:
    """Members, bytes of all and of one member that an archive may have."""

    entries: int = IMPORT_ENTRIES
    total: int = IMPORT_BYTES
    each: int = NOTE_BYTES


def members(stream, limits: Limits) -> Iterator[tuple[str, str]]:
    """key and raw text of an archive's notes, as its bytes come. One over a limit, or with a member that would leave the
    folder, fails; members that are no .md files are passed over."""
    size = 0
    with tarfile.open(fileobj=stream, mode="r|gz") as tar:
        for n, member in enumerate(tar):
            size += member.size
            if n >= limits.entries or size > limits.total or member.size > limits.each:
                raise LoadError("the archive is over a limit")
            if member.name.startswith("/") or ".." in member.name.split("/"):
                raise LoadError(f"{member.name} leaves the folder")
            if member.isfile() and member.name.endswith(".md"):
                yield re.sub(r"^\./", "", member.name)[:-3], tar.extractfile(member).read().decode("utf-8", "replace")


def parted(rows, limits: Limits) -> Iterator[Iterator[tuple[str, bytes]]]:
    """Key and bytes of notes (key, raw) in runs that an archive may hold, each to be used up before the next. A note over the
    limit of one member fails."""
    notes = ((row["key"], (row["raw"] or "").encode()) for row in rows)
    ahead = next(notes, None)

    def run() -> Iterator[tuple[str, bytes]]:
        nonlocal ahead
        entries = size = 0
        while ahead is not None and entries < limits.entries and size + len(ahead[1]) <= limits.total:
            if len(ahead[1]) > limits.each:
                return
            entries, size = entries + 1, size + len(ahead[1])
            yield ahead
            ahead = next(notes, None)

    while ahead is not None:
        if len(ahead[1]) > min(limits.each, limits.total) or limits.entries < 1:
            raise LoadError(f"{ahead[0]} is over a limit")
        yield run()


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], limits: Limits):
        self.paths, self.limits = paths, limits

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths or [None]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            system, path = _opened(partition.value)
            with system.open_input_stream(path, compression=None) as stream:
                yield from members(stream, self.limits)


@dataclass
class _Part(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, target: str, limits: Limits):
        self.limits = limits
        self.target, self.held = target.rstrip("/"), f"{target.rstrip('/')}.{uuid.uuid4().hex}.writing"

    def write(self, iterator) -> _Part:
        task = TaskContext.get()
        system, folder = _opened(self.held)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        for notes in parted(iterator, self.limits):
            names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):05d}.tar.gz")
            with system.open_output_stream(f"{folder}/{names[-1]}", compression=None) as out, gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z, tarfile.open(fileobj=z, mode="w|") as tar:
                for key, data in notes:
                    info = tarfile.TarInfo(f"{key}.md")
                    info.size, info.mode = len(data), 0o644
                    tar.addfile(info, io.BytesIO(data))
        return _Part(names)

    def commit(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        system, folder = _opened(self.held)
        system.create_dir(folder, recursive=True)
        named = {name for m in messages if m is not None for name in m.names}
        for file in system.get_file_info(fs.FileSelector(folder)):
            if file.base_name not in named:
                system.delete_file(file.path)
        _, target = _opened(self.target)
        if system.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(self.target)
        system.move(folder, target)

    def abort(self, messages: list[_Part | None]) -> None:
        from pyarrow import fs

        system, folder = _opened(self.held)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


def archive_source(paths: list[str], limits: Limits) -> type[DataSource]:
    """A data source `note_archives` that reads the archives at `paths`, and writes to the folder in its option `path`."""

    class Archives(DataSource):
        @classmethod
        def name(cls) -> str:
            return "note_archives"

        def schema(self) -> str:
            return NOTE

        def reader(self, schema) -> DataSourceReader:
            return _Reader(paths, limits)

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(self.options["path"], limits)

    return Archives


def read_archives(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """key and raw text of the notes in an archive, or in all archives (*.tar.gz) of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path).select("path")
    spark.dataSource.register(archive_source(sorted(r["path"] for r in found.collect()), limits))  # a name an archive
    return spark.read.format("note_archives").load()


def write_archives(notes: DataFrame, folder: str, archives: int | None = None, limits: Limits = Limits()) -> None:
    """Write notes (key, raw) as archives in a new folder, one a partition or as many as its limits ask for, each in key order;
    empty ones are not written."""
    spark = notes.sparkSession
    rows = notes.select("key", "raw")
    rows = rows.repartitionByRange(archives, "key") if archives else rows.repartitionByRange("key")
    spark.dataSource.register(archive_source([], limits))
    rows.sortWithinPartitions("key").write.format("note_archives").mode("append").option("path", folder).save()

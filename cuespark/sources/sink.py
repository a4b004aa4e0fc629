"""A data source that writes one named file a row: ``df.write.format("text_files").option("suffix", ".srt").save(path)``.

Rows are ``name, content``.  Every task writes to a folder of its own below ``_staging-...`` in the target; files take
their names when all tasks are done, so a job that fails leaves none, and running it again leaves the same files.  The
driver moves files by listing the tasks' folders, a few at a time; contents never pass through it.  ``overwrite`` also
removes files of the same suffix that the job did not write.

A name may be any text: characters that stores or shells treat specially become ``%XX``, so different names give
different files.  A null name, and a name that comes twice in a task, fail the job (``writers.write_texts`` sends equal
names to one task).

With the option ``digits`` files go to folders named by the first digits of their names' hash, each of which is made by one
task and moved as one: the driver then knows folders, not files, however many files there are.  Such a target belongs
to one job; folders that are there are replaced.  ``spark.read.format("text_files").schema(READ).load(path)`` reads it
back: tasks are dealt folders and list them themselves.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOVES_AT_ONCE = 16
READ = "path string, content binary"
#: Bytes of files that a reading task hands on together.
READ_AT_ONCE = 4 << 20
_SPECIAL = re.compile(r'[<>:"/\\|?*%\x00-\x1f\x7f]|^[._ ]|[. ]$')


def file_name(name: str) -> str:
    return _SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", name) or "%"


def folder_of(name: str, digits: int) -> str:
    return hashlib.md5(name.encode()).hexdigest()[:digits]


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; Hadoop's names of object stores are known too."""
    scheme, colon, rest = uri.partition("://")
    if not colon:
        return fs.FileSystem.from_uri(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves in its folder."""

    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool, digits: int = 0):
        if digits and not overwrite:
            raise ValueError("folders are written in mode overwrite only")
        self.path, self.suffix, self.overwrite, self.digits = path, suffix, overwrite, digits
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, target = store_of(self.path)
        context = TaskContext.get()
        folder = f"{target}/{self.staging}/{context.partitionId():06d}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        seen: set[str] = set()
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("name", "content")), strict=True):
                if name is None or name in seen:
                    raise ValueError("a file needs a name" if name is None else f"two rows are named {name!r}")
                seen.add(name)
                own = folder
                if self.digits:
                    own = f"{folder}/{folder_of(name, self.digits)}"
                    if own not in made:
                        made.add(own)
                        store.create_dir(own)
                with store.open_output_stream(f"{own}/{file_name(name)}{self.suffix}") as f:
                    f.write((content or "").encode())
        return Written(folder, len(seen))

    def commit(self, messages: list[Written | None]) -> None:
        store, target = store_of(self.path)
        store.create_dir(target, recursive=True)
        if self.digits:
            self._take_folders(store, target, messages)
            return
        kept: set[str] = set()

        def take(source: str) -> str:
            name = source.rsplit("/", 1)[1]
            final = f"{target}/{name}"
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(source, final)
            return name

        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            for message in messages:
                if message is not None and message.files:
                    kept.update(pool.map(take, [f.path for f in store.get_file_info(fs.FileSelector(message.folder))]))
            if self.overwrite:
                others = [f.path for f in store.get_file_info(fs.FileSelector(target)) if f.is_file and f.base_name.endswith(self.suffix) and f.base_name not in kept]
                list(pool.map(store.delete_file, others))
        store.delete_dir(f"{target}/{self.staging}")

    def _take_folders(self, store: fs.FileSystem, target: str, messages: list[Written | None]) -> None:
        sources = [f.path for m in messages if m is not None and m.files for f in store.get_file_info(fs.FileSelector(m.folder))]
        names = [s.rsplit("/", 1)[1] for s in sources]
        if len(set(names)) < len(names):
            raise ValueError("two tasks made files of one folder: deal rows by their folders")
        old = [f.path for f in store.get_file_info(fs.FileSelector(target)) if f.type == fs.FileType.Directory and not f.base_name.startswith("_")]
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            list(pool.map(store.delete_dir, old))
            list(pool.map(store.move, sources, [f"{target}/{n}" for n in names]))
        store.delete_dir(f"{target}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        store, target = store_of(self.path)
        if store.get_file_info(f"{target}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{target}/{self.staging}")


@dataclass
class Folders(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    """``READ``: the files of all folders in ``path``, each of ``tasks`` tasks has a share of the folders."""

    def __init__(self, path: str, suffix: str, tasks: int):
        self.path, self.suffix, self.tasks = path, suffix, tasks

    def partitions(self) -> list[Folders]:
        store, target = store_of(self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(target)) if f.type == fs.FileType.Directory and not f.base_name.startswith("_"))
        return [Folders(found[i :: self.tasks]) for i in range(min(self.tasks, len(found)))] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        paths: list[str] = []
        contents: list[bytes] = []
        size = 0
        for folder in partition.paths:
            for file in store.get_file_info(fs.FileSelector(folder)):
                if not file.is_file or not file.base_name.endswith(self.suffix):
                    continue
                with store.open_input_stream(file.path) as f:
                    contents.append(f.read())
                paths.append(file.path)
                size += len(contents[-1])
                if size >= READ_AT_ONCE:
                    yield self._batch(paths, contents)
                    paths, contents, size = [], [], 0
        if paths:
            yield self._batch(paths, contents)

    @staticmethod
    def _batch(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("suffix", ".txt"), overwrite, int(self.options.get("digits", "0")))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("tasks", "200")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFiles)

"""S6 as a data source of its own: binary vector files, read by byte ranges and written by tasks.

A file is ``count, dimension`` (32-bit little endian) and that many signed bytes for each vector. Files are reached through Arrow's file systems, hence local and
shared folders and what Arrow knows by its scheme; :func:`feeds.read_vectors` reads whole files through Spark where it does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_HEADER = 8
#: Bytes of a split and of a batch, unless the option ``split`` says otherwise.
_SPLIT = 64 << 20
_BATCH = 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Range(InputPartition):
    """Vectors ``first`` to ``last`` of a file."""

    path: str
    file: int
    dimension: int
    first: int
    last: int


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[_Range]:
        """Headers are read here; a file of n bytes is ``n / split`` ranges that end between vectors."""
        store, root = _opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        out: list[_Range] = []
        for k, f in enumerate(sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)):
            with store.open_input_file(f.path) as stream:
                header = stream.read(_HEADER)
            if len(header) < _HEADER:
                raise ValueError(f"{f.path} has no header")
            count, dimension = (int(x) for x in np.frombuffer(header, "<i4"))
            if dimension <= 0 or count < 0 or f.size < _HEADER + count * dimension:
                raise ValueError(f"{f.path} is shorter than its header says")
            step = max(1, self.split // dimension)
            out += [_Range(f.path, k, dimension, at, min(count, at + step)) for at in range(0, count, step)]
        return out or [_Range("", 0, 1, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        store, _ = _opened(self.path)
        size, step = partition.dimension, max(1, _BATCH // partition.dimension)
        with store.open_input_file(partition.path) as stream:
            stream.seek(_HEADER + partition.first * size)
            for at in range(partition.first, partition.last, step):
                n = min(step, partition.last - at)
                data = np.frombuffer(stream.read(n * size), np.int8)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, partition.file, np.int32)), pa.array(np.arange(at, at + n)), vectors], names=["file", "id", "vector"])


class _Writer(DataSourceWriter):
    """A file for each task; files of tasks that failed are removed, and none is seen before its task ends well."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        rows = [np.array(r["vector"], np.int8) for r in iterator]
        if not rows:
            return _Written(None)
        if len({len(r) for r in rows}) > 1:
            raise ValueError("vectors of a file must have one dimension")
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"{root.rstrip('/')}/part-{uuid.uuid4().hex}.vec"
        with store.open_output_stream(name + ".tmp") as out:
            out.write(np.array([len(rows), len(rows[0])], "<i4").tobytes())
            for r in rows:
                out.write(r.tobytes())
        store.move(name + ".tmp", name)
        return _Written(name)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        store, _ = _opened(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class VectorFiles(DataSource):
    """``spark.read.format("vectors").option("split", bytes).load(path)``: ``file, id, vector``, ids counting from 0 in each file, files in order of name."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "file int, id long, vector array<tinyint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", _SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("vector files are appended to a folder")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)

"""fvecs and ivecs files: records of a little-endian 32-bit width and that many 32-bit numbers.

``spark.read.format("vecs").option("kind", "f").load(path)`` gives (id, vector). All records have one width, so a file splits at
multiples of the record's size and ids follow from offsets, without a count over the file. ``path`` is a file, or a folder of parts as
:func:`write_parts` leaves it, whose ids go on from part to part. Paths may be URIs of any store that pyarrow's file systems reach from
every executor; :func:`read_vecs` goes through Spark's own reader instead and takes any file system that Spark has.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from arcspan.operators.knn import matrix

#: Bytes of a split, about; records of a batch.
SPLIT_BYTES, BATCH = 32 << 20, 8192


def record_width(head: bytes, size: int, name: str) -> int:
    """Numbers in a record, from the file's first bytes and its size; faults of the file are errors."""
    if size == 0:
        raise ValueError(f"{name} has no vectors")
    if len(head) < 4:
        raise ValueError(f"{name}: the first header is cut off")
    (dim,) = struct.unpack("<i", head[:4])
    if dim <= 0:
        raise ValueError(f"{name}: a width of {dim}")
    if size % (4 + 4 * dim):
        raise ValueError(f"{name}: records differ in width or the last one is cut off")
    return dim


def decode(data: bytes, dim: int, kind: str, name: str) -> np.ndarray:
    raw = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
    if (raw[:, 0] != dim).any():
        raise ValueError(f"{name}: records differ in width")
    body = np.ascontiguousarray(raw[:, 1:])
    return body.view("<f4") if kind == "f" else body


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Split(InputPartition):
    def __init__(self, file: str, dim: int, first: int, begin: int, end: int) -> None:
        self.file, self.dim, self.first, self.begin, self.end = file, dim, first, begin, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "f")
        system, path = store(self.path)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        parts = [found]
        if found.type == fs.FileType.Directory:
            parts = sorted((x for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("part-") and x.size), key=lambda x: x.base_name)
            if not parts:
                raise ValueError(f"{self.path} has no vectors")
        self.files: list[tuple[str, int, int]] = []  # path, width of records, records
        for x in parts:
            with system.open_input_file(x.path) as f:
                dim = record_width(f.read(4), x.size, x.path)
            self.files.append((x.path, dim, x.size // (4 + 4 * dim)))
        if len({dim for _, dim, _ in self.files}) > 1:
            raise ValueError(f"{self.path}: parts differ in width")

    def partitions(self) -> Sequence[InputPartition]:
        out, first = [], 0
        for path, dim, n in self.files:
            step = max(1, SPLIT_BYTES // (4 + 4 * dim))
            out += [_Split(path, dim, first, i, min(i + step, n)) for i in range(0, n, step)]
            first += n
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        dim, width = partition.dim, 4 + 4 * partition.dim
        kind = pa.float32() if self.kind == "f" else pa.int32()
        with store(self.path)[0].open_input_file(partition.file) as f:
            f.seek(partition.begin * width)
            for i in range(partition.begin, partition.end, BATCH):
                n = min(BATCH, partition.end - i)
                rows = decode(f.read(n * width), dim, self.kind, partition.file)
                flat = pa.array(rows.reshape(-1), kind)
                off = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n) + partition.first), pa.ListArray.from_arrays(off, flat)], names=["id", "vector"])


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return f"id long, vector array<{'float' if self.options.get('kind', 'f') == 'f' else 'int'}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecsSource)


def read_vecs(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """(id, vector) of one file by Spark's binary reader, for stores that only Spark reads. The file must fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                rows = decode(data, record_width(data, len(data), name), kind, name)
                for i in range(0, len(rows), BATCH):
                    part = rows[i : i + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(list(part), pa.list_(pa.float32() if kind == "f" else pa.int32()))], names=["id", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"id long, vector array<{'float' if kind == 'f' else 'int'}>")


def encode(rows: np.ndarray, kind: str = "f") -> bytes:
    """The file of a matrix."""
    body = np.asarray(rows, "<f4" if kind == "f" else "<i4")
    out = np.empty((len(body), body.shape[1] + 1), "<i4")
    out[:, 0] = body.shape[1]
    out[:, 1:] = body.view("<i4")
    return out.tobytes()


def write_parts(rows: DataFrame, path: str, kind: str = "f") -> int:
    """(id, vector) in the order of id, a part file from each task; gives the number of vectors. Parts one after the other are the file.

    A task writes under a name of its own and renames when it is done, so a task that is lost or repeated leaves no half part.
    """
    system, root = store(path)
    system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, f = TaskContext.get(), 0, None
        system, root = store(path)
        own = f"{root}/_task-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                f = f or system.open_output_stream(own)
                f.write(encode(matrix(batch.column(0)), kind))
                n += batch.num_rows
        if f is not None:
            f.close()
            system.move(own, f"{root}/part-{context.partitionId():06d}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return rows.orderBy("id").select("vector").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_vecs(rows: DataFrame, path: str, kind: str = "f") -> None:
    """One file of (id, vector) in the order of id, streamed through the driver: the format has no parts."""
    with open(path, "wb") as f:
        for r in rows.orderBy("id").select("vector").toLocalIterator():
            f.write(encode(np.array([r[0]]), kind))

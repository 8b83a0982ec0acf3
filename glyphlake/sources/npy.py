"""A matrix of vectors in NumPy's format, written and read by many tasks.

A matrix is a folder of files in that format and a list of them (`_matrix.json`) in the order of rows. The list is
written last, in one piece, so a reader sees the whole matrix or none, and files of tasks that failed are not in it. A file
alone is a matrix too: its first bytes tell its shape. A task reads only the bytes of its range of rows.

Paths are those of pyarrow's file systems (file, hdfs, s3, gs); executors must share them. Vectors are of 32 bits, all
of one length; a null vector or one of another length fails the writing, as a matrix can't hold it.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

LIST = "_matrix.json"
SCHEMA = "idx bigint, embedding array<float>"
#: Bytes of vectors in a file, and for a task to read; a task holds about three times as many.
FILE_BYTES, TASK_BYTES, BATCH_BYTES = 128 << 20, 128 << 20, 8 << 20
HEADER_BYTES = 65_536


@dataclass
class Rows(InputPartition):
    """Rows of a file, from one on; first is the idx of the first of them in the matrix."""

    path: str
    start: int
    width: int
    dtype: str
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


def described(file: io.RawIOBase) -> dict:
    """start (of the vectors, in bytes), rows, width and dtype by a file's header."""
    head = io.BytesIO(file.read(HEADER_BYTES))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(head)
    if len(shape) != 2 or by_column or dtype.kind != "f":
        raise ValueError(f"not a matrix of floating-point rows: shape {shape}, {dtype}, by column: {by_column}")
    return {"start": head.tell(), "rows": shape[0], "width": shape[1], "dtype": dtype.str}


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int) -> None:
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[Rows]:
        store, path = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_file(path) as f:
                files = [described(f) | {"name": None}]
        else:
            with store.open_input_stream(f"{path}/{LIST}") as f:
                files = json.loads(f.read())
        out, first = [], 0
        for f in files:
            step = max(1, self.task_bytes // max(1, f["width"] * np.dtype(f["dtype"]).itemsize))
            whole = path if f["name"] is None else f"{path}/{f['name']}"
            for at in range(0, f["rows"], step):
                size = f["width"] * np.dtype(f["dtype"]).itemsize
                out.append(Rows(whole, f["start"] + at * size, f["width"], f["dtype"], first + at, min(step, f["rows"] - at)))
            first += f["rows"]
        return out or [Rows(path, 0, 0, "<f4", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        size = part.width * np.dtype(part.dtype).itemsize
        step = max(1, BATCH_BYTES // max(1, size))
        with store.open_input_file(part.path) as f:
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                values = np.frombuffer(f.read_at(n * size, part.start + at * size), part.dtype).astype("<f4", copy=False)
                idx = np.arange(part.first + at, part.first + at + n)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * part.width, pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(idx), lists], ["idx", "embedding"])


class MatrixWriter(DataSourceArrowWriter):
    """Rows in the order of partitions and of rows in them; several files for a large partition."""

    def __init__(self, path: str, file_bytes: int) -> None:
        self.path, self.file_bytes = path, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        done = Written(TaskContext.get().partitionId(), [])
        held: list[np.ndarray] = []
        for batch in batches:
            column = batch.column("embedding")
            widths = set(column.value_lengths().to_pylist())
            if len(widths) > 1 or None in widths or column.flatten().null_count:
                raise ValueError("a matrix holds vectors of one length, without nulls")
            rows = column.flatten().to_numpy().astype("<f4", copy=False).reshape(len(batch), -1) if len(batch) else np.empty((0, 0), "<f4")
            most = max(1, self.file_bytes // max(1, rows.shape[1] * 4))
            while len(rows):
                room = most - sum(map(len, held))
                held.append(rows[:room])
                rows = rows[room:]
                if sum(map(len, held)) == most:
                    done.files.append(self._file(store, path, held))
                    held = []
        if held:
            done.files.append(self._file(store, path, held))
        return done

    @staticmethod
    def _file(store: fs.FileSystem, path: str, held: list[np.ndarray]) -> dict:
        rows, name = np.concatenate(held), f"{uuid.uuid4().hex}.npy"
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(rows))
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(head.getvalue())
            out.write(memoryview(rows).cast("B"))
        return {"name": name, "start": head.tell(), "rows": len(rows), "width": rows.shape[1], "dtype": rows.dtype.str}

    def commit(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        if len({f["width"] for f in files}) > 1:
            raise ValueError("a matrix holds vectors of one length")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{LIST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.delete_file(f"{path}/{f['name']}")


class Matrix(DataSource):
    """Format `matrix`: options path, file_bytes (writing) and task_bytes (reading)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        if overwrite:
            raise ValueError("a matrix is written once: give a new folder")
        return MatrixWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def write_matrix(vectors: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """vectors (idx, embedding) in the order of idx, as a matrix in a new folder; equal idx are in no defined order."""
    vectors.sparkSession.dataSource.register(Matrix)
    own = vectors.selectExpr("CAST(idx AS BIGINT) AS idx", "CAST(embedding AS ARRAY<FLOAT>) AS embedding")
    own = own.repartitionByRange("idx").sortWithinPartitions("idx")
    own.write.format("matrix").option("file_bytes", file_bytes).mode("append").save(path)


def read_matrix(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(idx, embedding) of a matrix's folder, or of one file; idx counts rows from 0 over all files."""
    spark.dataSource.register(Matrix)
    return spark.read.format("matrix").option("task_bytes", task_bytes).load(path)

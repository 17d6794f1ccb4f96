"""NumPy archives (.npz) as a data source: ``spark.read.format("npz")`` and ``df.write.format("npz")``.

Archives are zip files of arrays; their headers are parsed here, and arrays of Python objects are refused, so nothing is ever unpickled.
Each file is a partition; rows of an array are read block by block, so a task's memory doesn't grow with the file. A writer
task makes one archive of its rows: the vectors, their keys, and the configuration and statistics as JSON text.

The folder must be one that the driver and all executors share. Register with ``register(spark)``.
"""

from __future__ import annotations

import ast
import glob
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the array format: the magic string, and the sizes of the header's length by major version.
MAGIC, LENGTH_BYTES = b"\x93NUMPY", {1: 2, 2: 4, 3: 4}
BLOCK_BYTES = 8 << 20
_KINDS = "biufUS"


@dataclass
class Header:
    dtype: np.dtype
    shape: tuple[int, ...]
    fortran: bool


def read_header(stream) -> Header:
    """The header at the start of an array file; the stream then stands at the first value."""
    start = stream.read(8)
    if len(start) < 8 or start[:6] != MAGIC or start[6] not in LENGTH_BYTES:
        raise ValueError("not an array file")
    size = int.from_bytes(stream.read(LENGTH_BYTES[start[6]]), "little")
    known = ast.literal_eval(stream.read(size).decode("utf-8" if start[6] == 3 else "latin-1"))
    if set(known) != {"descr", "fortran_order", "shape"} or not isinstance(known["descr"], str):
        raise ValueError("an array of plain values is needed")
    dtype = np.dtype(known["descr"])
    if dtype.kind not in _KINDS:
        raise ValueError(f"arrays of {dtype} are not read: they would have to be unpickled")
    return Header(dtype, tuple(known["shape"]), known["fortran_order"])


def write_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    text = repr({"descr": dtype.str, "fortran_order": False, "shape": shape})
    pad = -(len(MAGIC) + 4 + len(text) + 1) % 64
    body = (text + " " * pad + "\n").encode("latin-1")
    return MAGIC + b"\x01\x00" + len(body).to_bytes(2, "little") + body


def array_rows(stream, header: Header) -> Iterator[np.ndarray]:
    """Blocks of consecutive rows; an array that is stored by columns is read whole."""
    rows = header.shape[0] if header.shape else 1
    width = int(np.prod(header.shape[1:], dtype=np.int64)) if header.shape else 1
    size = header.dtype.itemsize * width
    if header.fortran and len(header.shape) > 1:
        yield np.frombuffer(stream.read(size * rows), dtype=header.dtype).reshape(header.shape, order="F").reshape(rows, width)
        return
    step = max(1, BLOCK_BYTES // max(1, size))
    for at in range(0, rows, step):
        n = min(step, rows - at)
        data = stream.read(n * size)
        if len(data) != n * size:
            raise ValueError("the array ends early")
        yield np.frombuffer(data, dtype=header.dtype).reshape(n, width)


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file:")
        self.paths = sorted(glob.glob(os.path.join(path, "*.npz"))) if os.path.isdir(path) else [path]
        self.member = options.get("array")

    def partitions(self):
        return [FilePartition(p) for p in self.paths] or [FilePartition("")]

    def read(self, partition):
        if not partition.path:
            return
        with zipfile.ZipFile(partition.path) as archive:
            for name in archive.namelist():
                member = name.removesuffix(".npy")
                if self.member is not None and member != self.member:
                    continue
                with archive.open(name) as stream:
                    header, at = read_header(stream), 0
                    for block in array_rows(stream, header):
                        n, text = len(block), header.dtype.kind in "US"
                        same = lambda v: pa.array([v] * n, pa.string())
                        if text:
                            strings = block.astype("U") if header.dtype.kind == "S" else block
                            columns = [pa.nulls(n, pa.list_(pa.float64())), pa.array([r.tolist() for r in strings], pa.list_(pa.string()))]
                        else:
                            width = block.shape[1]
                            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(block.astype(np.float64).ravel()))
                            columns = [values, pa.nulls(n, pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([same(os.path.basename(partition.path)), same(member), pa.array(np.arange(at, at + n)), *columns], ["file", "array", "row", "numbers", "texts"])
                        at += n


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class NpzWriter(DataSourceWriter):
    """Rows of a key and a vector; ``name`` is the array's, ``config`` and ``stats`` are JSON texts kept beside it as ``<name>_config`` and ``<name>_stats``."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.name = options["path"].removeprefix("file:"), options.get("name", "embeddings")
        self.texts = {k: json.dumps(json.loads(options[k])) for k in ("config", "stats") if k in options}
        self.old = glob.glob(os.path.join(self.folder, "*.npz")) if overwrite else []
        os.makedirs(self.folder, exist_ok=True)

    def write(self, rows):
        keys, vectors = [], []
        for r in rows:
            keys.append(r[0])
            vectors.append(np.asarray(r[1], dtype=np.float64))
        if not keys:
            return Written(None)
        arrays = {self.name: np.stack(vectors), f"{self.name}_keys": np.array(keys), **{f"{self.name}_{k}": np.array(v) for k, v in self.texts.items()}}
        path = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.npz")
        with zipfile.ZipFile(path + ".new", "w", zipfile.ZIP_DEFLATED) as archive:
            for name, a in arrays.items():
                with archive.open(f"{name}.npy", "w", force_zip64=True) as out:
                    out.write(write_header(a.dtype, a.shape))
                    out.write(np.ascontiguousarray(a).tobytes())
        return Written(path)

    def commit(self, messages):
        for p in self.old:
            os.remove(p)
        for m in messages:
            if m is not None and m.path:
                os.replace(m.path + ".new", m.path)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path + ".new"):
                os.remove(m.path + ".new")


class NpzSource(DataSource):
    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return "file string, array string, row long, numbers array<double>, texts array<string>"

    def reader(self, schema: StructType):
        return NpzReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return NpzWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)

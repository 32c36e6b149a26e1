"""Flat vector indexes as files: the public id-map layout, one file per partition.

A file holds a header of the id map, one of the flat index in it, the vectors as 32-bit floats and the
ids as 64-bit integers, all little-endian, so that readers of that layout can load a shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks of the layout, and the number of each metric.
MAP_MARK, FLAT_MARK, METRIC = b"IxMp", {"inner": b"IxFI", "l2": b"IxF2"}, {"inner": 0, "l2": 1}
#: dimension, vectors, two unused fields, trained, metric.
_HEAD = struct.Struct("<iqqqBi")
_COUNT = struct.Struct("<Q")
_UNUSED = 1 << 20
HEADER_BYTES = 2 * (4 + _HEAD.size) + _COUNT.size


def encode_index(ids: np.ndarray, vectors: np.ndarray, metric: str) -> bytes:
    """The bytes of an index of ``vectors`` (one row each) under ``ids``."""
    head = _HEAD.pack(vectors.shape[1], len(ids), _UNUSED, _UNUSED, 1, METRIC[metric])
    flat = vectors.astype("<f4").tobytes()
    return MAP_MARK + head + FLAT_MARK[metric] + head + _COUNT.pack(vectors.size) + flat + _COUNT.pack(len(ids)) + ids.astype("<i8").tobytes()


def decode_header(data: bytes) -> tuple[int, int, str]:
    """(dimension, vectors, metric) of an index; an error if the bytes are none, or contradict themselves."""
    if len(data) < HEADER_BYTES or data[:4] != MAP_MARK:
        raise ValueError("not an id-mapped index")
    outer = _HEAD.unpack_from(data, 4)
    inner = _HEAD.unpack_from(data, 8 + _HEAD.size)
    metric = {v: k for k, v in FLAT_MARK.items()}.get(data[4 + _HEAD.size : 8 + _HEAD.size])
    (cells,) = _COUNT.unpack_from(data, HEADER_BYTES - _COUNT.size)
    if metric is None or outer[:2] != inner[:2] or cells != outer[0] * outer[1] or METRIC[metric] != outer[5]:
        raise ValueError("index headers disagree")
    return outer[0], outer[1], metric


def decode_index(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the bytes of an index; an error if they are cut."""
    dim, n, _ = decode_header(data)
    middle = HEADER_BYTES + 4 * dim * n
    if len(data) != middle + _COUNT.size + 8 * n or _COUNT.unpack_from(data, middle) != (n,):
        raise ValueError("index is cut")
    return np.frombuffer(data, "<i8", n, middle + _COUNT.size), np.frombuffer(data, "<f4", dim * n, HEADER_BYTES).reshape(n, dim)


def write_flat_index(vectors: DataFrame, folder: str, metric: str = "inner") -> DataFrame:
    """Writes ``vectors`` (id, embedding) to ``folder``, a file per partition; a row per file: shard, dim, n.

    A file appears under its name when it is whole, so a task that is run again replaces it.  All
    vectors must have one dimension; rows with a null id or vector are left out.  Partitions bound the
    size of a file; empty ones write none.  ``folder`` is a place that all executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        ids = np.concatenate([b.column(0).to_numpy() for b in parts])
        flat = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in parts])
        if len(flat) % len(ids) or len({len(x) for b in parts for x in b.column(1)}) > 1:
            raise ValueError("vectors of several dimensions")
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.index"
        hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            out.write(encode_index(ids, flat.reshape(len(ids), -1), metric))
        store.move(hidden, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(flat) // len(ids)], pa.int32()), pa.array([len(ids)], pa.int64())], names=["shard", "dim", "n"])

    rows = vectors.where("id is not null and embedding is not null").select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(write, "shard string, dim int, n long")


def read_flat_index(spark: SparkSession, folder: str) -> DataFrame:
    """id, embedding, shard of the indexes in ``folder``; a broken file is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, vectors = decode_index(data)
                for i in range(0, len(ids), 10_000):
                    block = vectors[i : i + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, block.size + 1, vectors.shape[1]), pa.int32()), pa.array(block.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 10_000]), lists, pa.array([path.rsplit("/", 1)[-1]] * len(block))], names=["id", "embedding", "shard"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.index").load(folder)
    return files.select("path", "content").mapInArrow(parse, "id long, embedding array<float>, shard string")


def is_complete(folder: str, dim: int, n: int) -> bool:
    """Whether the indexes of ``folder`` hold ``n`` vectors of ``dim``, by their headers alone."""
    store, path = fs.FileSystem.from_uri(folder)
    total = 0
    for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.endswith(".index") and not f.base_name.startswith("."):
            with store.open_input_file(f.path) as source:
                found, size, _ = decode_header(source.read(HEADER_BYTES))
            if found != dim or f.size != HEADER_BYTES + 4 * found * size + _COUNT.size + 8 * size:
                return False
            total += size
    return total == n

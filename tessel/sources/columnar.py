"""A binary format of columns of doubles.

Little-endian: a magic of 4 bytes, version u32 (1), rows u64, columns u64 (the target is the last), feature names u64,
length of the target's name u16 and the name in UTF-8, a u16 length of each feature name, the feature names, zeros up to
a multiple of 8, then each column's doubles. As every cell's place follows from the header, a task reads only its rows of
the wanted columns. The magic is the caller's to name; Parquet is the format for anything large that stays here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tessel.runtime import ship_package

_FIXED = struct.Struct("<4sIQQQH")


def _open(path: str) -> pa.NativeFile:
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(name)


def _part(f: pa.NativeFile, at: int, size: int) -> pa.Buffer:
    f.seek(at)
    return f.read_buffer(size)


def header(path: str, magic: bytes | None = None) -> tuple[int, list[str], int]:
    """(rows, names of the columns, place of the first double); with magic, a file that opens otherwise raises."""
    with _open(path) as f:
        fixed = f.read(_FIXED.size)
        if len(fixed) < _FIXED.size:
            raise ValueError(f"{path}: no header")
        mark, version, rows, columns, names, target = _FIXED.unpack(fixed)
        if magic is not None and mark != magic or version != 1 or columns != names + 1:
            raise ValueError(f"{path}: not a file of this format")
        last = f.read(target).decode()
        sizes = struct.unpack(f"<{names}H", f.read(2 * names))
        own = [f.read(n).decode() for n in sizes]
        start = -(-f.tell() // 8) * 8
        if f.size() < start + 8 * rows * columns:
            raise ValueError(f"{path}: cut short")
        return rows, [*own, last], start


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, start: int = 0, end: int | None = None, magic: bytes | None = None, block: int = 1 << 16) -> DataFrame:
    """row_id and columns (all by default, the target last) of rows start to end - 1, in blocks of rows. path must be
    readable on every executor."""
    rows, names, first = header(path, magic)
    wanted = names if columns is None else columns
    if missing := set(wanted) - set(names):
        raise ValueError(f"no columns {sorted(missing)}")
    low, high = max(start, 0), rows if end is None else min(end, rows)
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    at, to = low + b * block, min(high, low + (b + 1) * block)
                    data = [pa.Array.from_buffers(pa.float64(), to - at, [None, _part(f, first + 8 * (rows * names.index(c) + at), 8 * (to - at))]) for c in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, to), pa.int64()), *data], names=["row_id", *wanted])

    blocks = -(-max(high - low, 0) // block)
    return spark.range(0, blocks, 1, max(1, min(blocks, 10_000))).mapInArrow(run, ", ".join(["row_id long", *(f"`{c}` double" for c in wanted)]))


def write_columns(df: DataFrame, path: str, features: list[str], target: str, key: str, magic: bytes) -> None:
    """Write one local file, rows by key. A column at a time streams through the driver, so memory is bounded."""
    rows = df.count()
    names = [c.encode() for c in features]
    goal = target.encode()
    head = _FIXED.pack(magic, 1, rows, len(names) + 1, len(names), len(goal)) + goal + struct.pack(f"<{len(names)}H", *map(len, names)) + b"".join(names)
    with open(path, "wb") as f:
        f.write(head + bytes(-len(head) % 8))
        for c in [*features, target]:
            for r in df.orderBy(key).select(df[c].cast("double").alias("v")).toLocalIterator(prefetchPartitions=True):
                f.write(struct.pack("<d", float("nan") if r.v is None else r.v))

"""64-bit values packed into binary rows, dealt out by key: Spark moves one row for thousands of values."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_arrow

#: Rows of values that a task holds before it deals them out.
HELD = 1 << 18
DEALT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("packed", T.BinaryType())])


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit values, one after another."""
    return np.stack([np.asarray(c).view(np.int64) for c in columns]).tobytes()


def unpack(column: pa.Array, width: int) -> list[np.ndarray]:
    """An array (width, n) for each row of a binary column; a null has none."""
    return [np.frombuffer(x.as_buffer(), np.int64).reshape(width, -1) if x.is_valid and x.as_buffer().size else np.zeros((width, 0), np.int64) for x in column]


def steady() -> None:
    """Let a worker keep up to 16 MB that arrays free, until ``trim``: else their pages are mapped, cleared and unmapped each time."""
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD


def trim() -> None:
    """Give back what a task held and freed: workers stay idle behind it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def buckets_of(spark: SparkSession, each: int = 3) -> int:
    """Three buckets, or ``each``, and as many tasks for each shuffle partition: a task holds all of its own in arrays."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(by: np.ndarray, columns: list[np.ndarray], buckets: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of columns, packed, by bucket; ``by`` has hashes that tell the bucket."""
    if not len(by):
        return
    own = ((by.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    values = np.stack([np.asarray(c).view(np.int64)[order] for c in columns])
    ends = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    packed = pa.array([values[:, a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(own[ends[:-1]].astype(np.int32)), pa.array(np.full(len(packed), kind, np.int32)), packed], names=DEALT.fieldNames())


def together(rows: DataFrame, work: Callable[[dict[int, np.ndarray]], Iterator[pa.RecordBatch]], widths: dict[int, int], schema: T.StructType, buckets: int | None = None) -> DataFrame:
    """work over all values of a bucket together, (width, n) by kind; rows: what ``deal`` gives, by ``buckets_of`` buckets unless told otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady()
        held = {kind: [np.zeros((width, 0), np.int64)] for kind, width in widths.items()}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for kind, width in widths.items():
                some = np.flatnonzero(kinds == kind)
                if len(some):
                    held[kind].append(np.concatenate(unpack(batch.column(2).take(pa.array(some)), width), axis=1))
        if any(len(x) > 1 for x in held.values()):
            yield from work({kind: np.concatenate(held.pop(kind), axis=1) for kind in widths})
        trim()

    return map_arrow(rows.repartitionById(buckets or buckets_of(rows.sparkSession), F.col("bucket")), run, schema)

"""Documents packed into blocks: the unit in which whole-corpus operators exchange arrays.

A block is one row: some megabytes of consecutive documents, compressed. The
table of blocks is written once, so a block's number and contents stay the
same however often it is read. Operators send one packed array per (block,
hash partition) through a shuffle instead of one row per n-gram or suffix,
and get one array back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, python_step, row_key, staged

BLOCK_BYTES = 4 << 20
#: Bytes of the arrays that one hash partition gathers, about.
PART_BYTES = 16 << 20
LEAST_PARTS = 16
#: Partition numbers fit 16 bits.
MOST_PARTS = 65_000


def pack(value) -> bytes:
    import pyarrow as pa
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes):
    import pyarrow as pa
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def pack_sorted(values: np.ndarray) -> tuple:
    """Sorted uint64 as differences, byte by byte: the upper bytes compress away."""
    step = np.diff(values, prepend=np.uint64(0))
    return len(values), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(packed: tuple) -> np.ndarray:
    n, raw = packed
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64)


def blocks(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, bytes, packed: (doc_ids, row keys, texts as bytes or None) of consecutive documents."""

    def rows(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        number, held, size = 0, ([], [], []), 0

        def out():
            return pa.record_batch([pa.array([first + number], pa.int64()), pa.array([size], pa.int64()),
                                    pa.array([pack(held)], pa.binary())], names=["block", "bytes", "packed"])

        for b in batches:
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_column(b, "text")):
                if held[0] and size + len(t or b"") > block_bytes:
                    yield out()
                    number, held, size = number + 1, ([], [], []), 0
                for x, v in zip(held, (i, k, t)):
                    x.append(v)
                size += len(t or b"")
        if held[0]:
            yield out()

    d = docs.select("doc_id", row_key().alias("key"), "text")
    return staged(python_step(d, rows, "block long, bytes long, packed binary"), f"{name}-blocks")


def parts_for(table: DataFrame, bytes_per_byte: float, part_bytes: int = PART_BYTES) -> int:
    """The number of hash partitions: as many as the arrays of all blocks need, given their size per byte of text."""
    total = table.agg(F.sum("bytes")).first()[0] or 0
    return min(MOST_PARTS, max(LEAST_PARTS, int(total * bytes_per_byte / part_bytes) + 1))


def with_arrays(table: DataFrame, arrays: DataFrame) -> DataFrame:
    """The blocks with what came back for them: ``arrays`` (block, part, packed), as ``returned`` (one entry a part at most)."""
    per = arrays.groupBy(F.col("block").alias("a_block")).agg(
        F.collect_list(F.struct("part", F.col("packed").alias("array"))).alias("returned"))
    return table.join(per, F.col("block") == F.col("a_block"), "left").select("block", "packed", "returned")


def by_part(arrays: DataFrame, parts: int, fn, schema: str) -> DataFrame:
    """``fn`` over the rows (part, block, packed) of each part: part -> an iterator of record batches."""

    def rows(batches: Iterator):
        part, held = None, []
        for b in batches:
            for p, block, packed in zip(*(c.to_pylist() for c in b.columns)):
                if p != part:
                    if held:
                        yield from fn(part, held)
                    part, held = p, []
                held.append((block, packed))
        if held:
            yield from fn(part, held)

    sent = arrays.select("part", "block", "packed").repartition(parts, "part").sortWithinPartitions("part", "block")
    return python_step(sent, rows, schema)

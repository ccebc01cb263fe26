"""Rows that meet under a key: packed, dealt out by key and met in bounded groups.

A row that has to meet others is a record of a few numbers. Tasks send them as blobs, each of one part of the key
space, so that Spark moves thousands of records as one row; the reader takes a part at a time. A key with more than
`most` records is not met but refused: its key and count are given back, for the caller to deal it out by a longer key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64
BLOB = 256  # records
FLUSH = 1 << 17  # records that a sender holds
HELD = 1 << 20  # records of one part that a reader holds before it looks for keys to refuse
PER_PARTITION = 8  # parts
SENT = "part int, n int, blob binary"


def parts(spark: SparkSession, records: int) -> int:
    """Parts of the key space: several a partition, and few enough records in each."""
    return max(PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // (HELD // 8)))


def pack(rows: Iterator[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Blobs of structured arrays with a field `key` (64 bits)."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        part = ((rows["key"] >> _U(32)) * _U(n_parts)) >> _U(32)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order].astype(np.int32)
        edge = np.flatnonzero(np.r_[True, np.diff(part) != 0, True])
        cuts = np.concatenate([np.arange(a, b, BLOB) for a, b in zip(edge[:-1], edge[1:])])
        ends = np.r_[cuts[1:], len(rows)]
        columns = [np.ascontiguousarray(rows[f]) for f in rows.dtype.names]
        blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts.tolist(), ends.tolist())]
        return pa.record_batch([pa.array(part[cuts]), pa.array((ends - cuts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])

    held, size = [], 0
    for x in rows:
        if len(x):
            held.append(x)
            size += len(x)
            if size >= FLUSH:
                yield out(held)
                held, size = [], 0
    if held:
        yield out(held)


def deal(sent: DataFrame) -> DataFrame:
    return sent.repartition("part").sortWithinPartitions("part")


def unpack(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(part, records) of each blob."""
    for batch in batches:
        for part, n, blob in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["blob"]):
            rows, at, data = np.empty(n, kind), 0, blob.as_buffer()
            for f in kind.names:
                rows[f] = np.frombuffer(data, kind[f], n, at)
                at += n * kind[f].itemsize
            yield part, rows


def _counted(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the keys with more than `most` records."""
    key, n = np.unique(rows["key"], return_counts=True)
    over = n > most
    return key[over], n[over]


def meet(batches: Iterator[pa.RecordBatch], kind: np.dtype, most: int | None, settle: Callable[[np.ndarray], Iterator[pa.RecordBatch]], refused: Callable[[np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`settle` of the records of each part, without the keys over `most`, which `refused` gets with their counts."""

    def whole(held: list[np.ndarray], count: dict[int, int]) -> Iterator[pa.RecordBatch]:
        rows = drop(held, count)
        if count:
            yield refused(np.array(list(count), _U), np.array(list(count.values()), np.int64))
        if len(rows):
            yield from settle(rows)

    def drop(held: list[np.ndarray], count: dict[int, int]) -> np.ndarray:
        rows = np.concatenate(held)
        if most is None:
            return rows
        if count:
            known = np.isin(rows["key"], np.array(list(count), _U))
            for k, n in zip(*np.unique(rows["key"][known], return_counts=True)):
                count[int(k)] += int(n)
            rows = rows[~known]
        key, n = _counted(rows, most)
        for k, c in zip(key.tolist(), n.tolist()):
            count[k] = c
        return rows[~np.isin(rows["key"], key)] if len(key) else rows

    held, size, limit, count, now = [], 0, HELD, {}, None
    for part, rows in unpack(batches, kind):
        if part != now:
            if held:
                yield from whole(held, count)
            held, size, limit, count, now = [], 0, HELD, {}, part
        held.append(rows)
        size += len(rows)
        if size >= limit and most is not None:
            held = [drop(held, count)]
            size = len(held[0])
            limit = max(HELD, 2 * size)
    if held:
        yield from whole(held, count)

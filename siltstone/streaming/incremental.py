"""Structured Streaming forms of the incremental paths: index upserts, partial refreshes, event windows, duplicate content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.documents import merge_rows
from ..sources.tables import current_version, read_snapshot, write_snapshot


def upsert_stream(changes: DataFrame, root: str, key: list[str], order: str, checkpoint: str, columns: list[str] | None = None, build: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Merge each micro-batch of `changes` into the snapshot at `root`; of several changes of a key the last by `order` counts.

    Where the snapshot holds `order`, a change that comes late, after one that is newer, is left out. `columns` limits the merge to a part of the columns; `build` makes documents of changes. A batch that is run again
    after a failure gives the same snapshot, since the merge is by key.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
        rows = build(last) if build else last
        if current_version(spark, root) is None:
            write_snapshot(rows, root)
        else:
            old = read_snapshot(spark, root)
            if order in old.columns and order in rows.columns:
                newer = old.select(*key, F.col(order).alias("__had"))
                rows = rows.join(newer, key, "left").where(F.col("__had").isNull() | (F.col(order) >= F.col("__had"))).drop("__had")
            write_snapshot(merge_rows(old, rows, key, columns or [c for c in rows.columns if c not in key]), root)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("update")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n, total): tumbling windows with a watermark; works on streams and on tables."""
    w = F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def distinct_content(files: DataFrame, late: str = "1 hour", time: str = "created_at") -> DataFrame:
    """First registered or deferred row of each content hash within the watermark."""
    own = files.where(F.col("status").isin("registered", "deferred") & F.col("file_hash").isNotNull())
    return own.withWatermark(time, late).dropDuplicatesWithinWatermark(["file_hash"])

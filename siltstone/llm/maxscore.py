"""Exact top-k inner-product search by MaxScore.

Vectors are bags of weighted terms: term d of a vector is its component d. For a query and a block of
candidates every term has a lowest and a highest possible contribution; shifting by the lowest makes all
contributions non-negative, as MaxScore needs. Terms are ordered by bound. While the bounds of the weakest
terms together cannot lift a candidate to the query's k-th best score, those terms are non-essential:
the essential postings are traversed, the others are only probed for candidates still competitive.
Each shard (partition) keeps its k best per query; shards are merged by a ranked window.

Queries are taken in blocks of bounded size, so the broadcast never grows with the data; each block is
run against all rows.

Null vectors and vectors with null or non-finite components take no part. Vectors of unequal length are
compared over the shorter length (missing components are zero). A null id is never a query; as a candidate
it ranks after all others on a tie. Repeated rows are separate rows: a query skips its own row only.
Components are floored to 64-bit integers and scores are exact while they fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table, written

QUERY_BLOCK = 4096
CHUNK = 1024
PROBE = 8
_NO_ID = np.iinfo(np.int64).max
_OUT = "query_uid long, query_id long, uid long, vec_id long, score long"


def _matrix(col: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as one zero-padded integer matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lens.max(initial=0))
    out = np.zeros((len(col), wide), np.int64)
    if len(flat):
        rows = np.repeat(np.arange(len(col)), lens)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    if width is None or width == wide:
        return out
    return out[:, :width] if width < wide else np.pad(out, ((0, 0), (0, width - wide)))


class _Best:
    """The k best (score, id, uid) of each query so far, ordered by score desc, id asc, uid asc."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids, self.uid = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def bar(self, q: int) -> int | None:
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else None

    def add(self, q: int, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if len(score) > 4 * self.k:  # all scores that tie with the k-th stay
            bar = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= bar
            score, ids, uid = score[keep], ids[keep], uid[keep]
        score, ids, uid = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids]), np.concatenate([self.uid[q], uid])
        order = np.lexsort((uid, ids, -score))[: self.k]
        self.score[q], self.ids[q], self.uid[q] = score[order], ids[order], uid[order]


def maxscore_block(queries: np.ndarray, query_uid: np.ndarray, block: np.ndarray, ids: np.ndarray, uid: np.ndarray, best: _Best) -> None:
    """Offer every row of `block` to every query; `best` afterwards holds the exact k best."""
    if not len(block):
        return
    top, low = block.max(axis=0, initial=0), block.min(axis=0, initial=0)
    high = max(1, int(np.abs(block).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, block.shape[1])
    kind = np.float64 if high < 2**53 else np.int64
    cols = np.ascontiguousarray(block.T.astype(kind))
    at = {int(u): i for i, u in enumerate(uid)}
    for q, query in enumerate(queries.astype(kind)):
        hi, lo = np.maximum(query * top, query * low), np.minimum(query * top, query * low)
        order = np.argsort(-(hi - lo), kind="stable")
        bar, own = best.bar(q), at.get(int(query_uid[q]))
        floor = lo.sum()
        if bar is None:
            score, alive = query @ cols, None
        else:
            # the longest tail of weak terms that cannot reach the bar together
            tail = np.cumsum((hi - lo)[order][::-1])
            weak = int(np.searchsorted(tail, bar - floor, side="left"))
            if weak == len(order):
                continue
            essential, rest = order[: len(order) - weak], order[len(order) - weak :]
            score, alive = query[essential] @ cols[essential], None
            left = hi[rest].sum()
            while True:
                ok = score + left >= bar
                if not ok.all():
                    alive = np.flatnonzero(ok) if alive is None else alive[ok]
                    score = score[ok]
                if not len(rest) or not len(score):
                    break
                step, rest = rest[:PROBE], rest[PROBE:]
                score = score + query[step] @ (cols[step] if alive is None else cols[np.ix_(step, alive)])
                left = hi[rest].sum()
        alive = np.arange(len(block)) if alive is None else alive
        if own is not None:
            score, alive = score[alive != own], alive[alive != own]
        if len(score):
            best.add(q, score.astype(np.int64), ids[alive], uid[alive])


def exact_topk(vectors: DataFrame, is_query, *, k: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """`k` best rows of `vectors` for each row where `is_query`, an expression over the column vec_id, holds.

    Returns query_id, rank, vec_id, score; fewer than k rows where there are fewer candidates.
    """
    spark = vectors.sparkSession
    vec = F.col("vector")
    good = pick(vectors, vec_id=id_col, vector=vector_col).where(vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = written(
        good.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("is_query"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "vectors",
    )
    asked = rows.where(F.col("is_query") & F.col("vec_id").isNotNull())
    blocks = -(-asked.count() // query_block)
    parts = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).select("uid", "vec_id", "v").toArrow()
        if not own.num_rows:
            continue
        held = spark.sparkContext.broadcast((_matrix(own["v"]), own["uid"].to_numpy(), own["vec_id"].to_numpy()))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            queries, query_uid, query_id = held.value
            best = _Best(len(queries), k)
            for batch in batches:
                ids, uid, block = batch["vec_id"].fill_null(_NO_ID).to_numpy(), batch["uid"].to_numpy(), _matrix(batch["v"], queries.shape[1])
                for i in range(0, len(block), CHUNK):
                    maxscore_block(queries, query_uid, block[i : i + CHUNK], ids[i : i + CHUNK], uid[i : i + CHUNK], best)
            for i in range(0, len(queries), 512):
                n = [len(x) for x in best.score[i : i + 512]]
                if sum(n):
                    ids = np.concatenate(best.ids[i : i + 512])
                    yield pa.record_batch(
                        [np.repeat(query_uid[i : i + 512], n), np.repeat(query_id[i : i + 512], n), np.concatenate(best.uid[i : i + 512]), pa.array(ids, mask=ids == _NO_ID), np.concatenate(best.score[i : i + 512])],
                        names=["query_uid", "query_id", "uid", "vec_id", "score"],
                    )

        part = rows.select("vec_id", "uid", "v").mapInArrow(scan, _OUT)
        parts.append(written(part, "shard-tops") if blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tops = parts[0]
    for p in parts[1:]:
        tops = tops.unionByName(p)
    merge = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("uid"))
    return tops.withColumn("rank", F.row_number().over(merge)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir):
    """20 best inner products of floor(64 x) for every vector whose id is divisible by 20."""
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.uid AS quid, q.vec_id AS query_id, c.vec_id AS vec_id, c.uid AS uid,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id ASC NULLS LAST, uid) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Extendible hashing into byte-limited shards, with DataFrame functions only.

Every row gets a 60-bit hash. The directory is indexed by the leading bits; a bucket is split on one more
bit only while its bytes exceed the limit. The sizes of all buckets of all depths come from one histogram
over a fine prefix (a few bits more than an even split would need), rolled up level by level; prefixes that
are still too large at the finest level are refined in further rounds over their rows alone, so no round
depends on how the bytes are spread. The histogram holds a row per fine prefix, about 16 per shard.

The hash is the MD5 digest of the id and of the text's digest, so copies with other ids are spread. Rows
alike in both cannot be told apart by it; where such rows overfill a bucket at full depth, further bits
come from the row's position in the scan. A row that alone exceeds the limit is a shard of its own with
`oversized` set. A null text has 0 bytes; a null id is hashed as empty. No rows: no shards. Names of other columns do
not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, table, written

BITS = 60
SPARE = 4
ROUND = 8
SHARD_BYTES = 1 << 20


def row_hash(id_col: Column, text_col: Column) -> Column:
    """60 bits of MD5 over id and text digest, as a non-negative long."""
    text = F.coalesce(text_col, F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.md5(text)))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth) -> Column:
    return F.expr(f"shiftright({h}, cast({BITS} - {depth} as int))")


def _leaves(fine: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The bucket (depth, bytes, rows, fits) that each fine prefix of each stem falls in.

    A bucket is a leaf at the smallest depth in low..high where it fits, or at `high` where none does.
    """
    levels = fine.select("stem", "fine", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(fine, cast({high} - depth as int))"))
    sums = levels.groupBy("stem", "depth", "prefix").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    fit = levels.select("stem", "fine", "depth", "prefix").join(sums, ["stem", "depth", "prefix"]).withColumn("fits", (F.col("b") <= limit) | (F.col("r") == 1))
    # booleans sort false first: the smallest of (does not fit, depth if it fits or else reversed)
    rank = F.struct((~F.col("fits")).alias("bad"), F.when(F.col("fits"), F.col("depth")).otherwise(-F.col("depth")).alias("order"), "depth", "b", "r")
    best = F.col("best")
    return fit.groupBy("stem", "fine").agg(F.min(rank).alias("best")).select("stem", "fine", best["depth"].alias("depth"), best["b"].alias("shard_bytes"), best["r"].alias("shard_rows"), (~best["bad"]).alias("fits"))


def _rounds(rows: DataFrame, limit: int, base: int) -> DataFrame:
    """Leaves of all rows by the bits of column h below their stem; `base` bits were used up before."""
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    low, parts, on = 0, [], ["stem", "fine"]
    while True:
        keyed = rows.withColumn("fine", _prefix("h", high))
        fine = keyed.groupBy(on).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        leaves = written(_leaves(fine, low, high, limit), "directory")
        done = keyed.join(leaves if high >= BITS else leaves.where("fits"), on)
        bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix("h", "depth")), F.col("depth"), F.lit("0")))
        parts.append(done.withColumn("shard", F.concat("stem", bits)).withColumn("depth", F.col("depth") + base).drop("fine"))
        if high >= BITS or leaves.where(~F.col("fits")).isEmpty():
            break
        rows = written(keyed.join(leaves.where(~F.col("fits")).select(on), on, "left_semi").drop("fine"), "overfull")
        low, high = high + 1, min(BITS, high + ROUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extendible_shards(docs: DataFrame, max_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of `docs`: id, bytes, shard (its leading hash bits, "" for the root), depth, shard_bytes, shard_rows, oversized.

    With `carry` the whole input row comes along as the struct `row`, its fields numbered c0, c1, ...
    """
    own, id_, text = numbered(docs), F.col(f"c{place(docs, id_col)}"), F.col(f"c{place(docs, text_col)}").cast("string")
    rows = own.select(
        id_.alias("id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        row_hash(id_, text).alias("h"),
        F.monotonically_increasing_id().alias("uid"),
        F.lit("").alias("stem"),
        *([F.struct(*own.columns).alias("row")] if carry else []),
    )
    out = _rounds(written(rows, "row-hashes"), max_bytes, 0)
    alike = out.where(~F.col("fits"))
    if not alike.isEmpty():  # rows alike in id and text: their place in the scan tells them apart
        more = alike.withColumn("stem", F.col("shard")).withColumn("h", F.expr(f"shiftrightunsigned(xxhash64(uid), {64 - BITS})")).drop("shard", "depth", "shard_bytes", "shard_rows", "fits")
        out = out.where("fits").unionByName(_rounds(written(more, "alike"), max_bytes, BITS))
    return out.select("id", "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > max_bytes).alias("oversized"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, max_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of `docs` as one folder per shard; the rows of a shard meet in one task."""
    extendible_shards(docs, max_bytes, id_col, text_col, carry=True).select("shard", F.col("row").cast(docs.schema).alias("row")).repartition("shard").write.partitionBy("shard").parquet(path)


def op3_shards(spark, sf_dir):
    """Shards of at most 1 MiB of text (production would use 256 MiB; the tables here are small)."""
    return extendible_shards(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = f"""
WITH h AS (
  SELECT doc_id, row_number() OVER () AS uid, coalesce(octet_length(encode(text)), 0) AS bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), b AS (
  SELECT d.depth, h.h >> ({BITS} - d.depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM h, (SELECT CAST(unnest(range(0, 31)) AS INTEGER) AS depth) d GROUP BY 1, 2
), f AS (
  SELECT h.uid, min(b.depth) AS depth FROM h, b
  WHERE b.prefix = h.h >> ({BITS} - b.depth) AND (b.shard_bytes <= {SHARD_BYTES} OR b.shard_rows = 1) GROUP BY 1
)
SELECT h.doc_id, CAST(h.bytes AS BIGINT) AS bytes, CASE WHEN f.depth = 0 THEN '' ELSE right(lpad(bin(h.h), {BITS}, '0'), {BITS})[1:f.depth] END AS shard,
       f.depth, b.shard_bytes, b.shard_rows, b.shard_bytes > {SHARD_BYTES} AS oversized
FROM h JOIN f USING (uid) JOIN b ON b.depth = f.depth AND b.prefix = h.h >> ({BITS} - f.depth)
"""

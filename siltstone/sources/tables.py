"""Tables of the catalogue: loading, snapshots, and the views that queries derive from the shared test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_snapshot(df: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Write a new version folder below `root` and point `root`/CURRENT at it; readers of the old one are not disturbed.

    mode: overwrite (always a new version), noop (keep what is there), error (fail if there is one).
    """
    spark = df.sparkSession
    old = current_version(spark, root)
    if old and mode == "noop":
        return old
    if old and mode == "error":
        raise FileExistsError(root)
    version = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/CURRENT")
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.text(f"{root}/CURRENT").first()[0]


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(version)


def append_lineage(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Append provenance rows (asset_id, activity, agent, payload), stamped with the time of the job."""
    rows.withColumn("occurred_at", F.current_timestamp()).write.mode("append").parquet(root)


def _pick(i: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    pos = F.expr("doc_id div 20")
    return load(spark, folder, "documents").select(
        F.col("doc_id").alias("asset_id"),
        _pick(pos % 4, ["text", "image", "video", "audio"]).alias("modality"),
        F.when(pos % 10 == 0, "failed").otherwise("registered").alias("status"),
        F.concat(F.lit("/data/"), "source", F.lit("/f"), F.expr("doc_id div 60").cast("string"), _pick(pos % 3, ["_v1.txt", "_v2.txt", "_summary.txt"])).alias("fs_path"),
        F.col("text").alias("summary"),
        F.col("n_chars").alias("file_size"),
        _pick(pos % 3, ["medical", "general", "review"]).alias("domain_label"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("created_at"),
        "lang",
    )


def asset_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(
        F.expr("vec_id div 4").alias("asset_id"), F.when(F.col("label") < 7, "st").otherwise("clip").alias("channel"), (F.col("vec_id") % 4).cast("int").alias("chunk_index"), "embedding"
    )


def asset_topics(spark: SparkSession, folder: str) -> DataFrame:
    pos = F.expr("doc_id div 20")
    return load(spark, folder, "documents").where(pos % 7 != 0).select(F.col("doc_id").alias("asset_id"), F.col("lang").alias("topic"), F.when(pos % 5 == 0, "").otherwise(F.col("source")).alias("subtopic"))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    part, supp, flag = "l_partkey", "l_suppkey", "l_returnflag"
    got = load(spark, folder, "lineitem").groupBy(part, supp, flag).agg(F.max("l_discount").alias("d"), F.max("l_linestatus").alias("s"), F.max("l_shipdate").alias("reviewed_at"))
    return got.select(
        F.concat(F.lit("p"), part).alias("src"),
        F.concat(F.lit("s"), supp).alias("dst"),
        F.col(flag).alias("kind_code"),
        (F.col(flag) != "R").alias("is_symmetric"),
        F.round(F.col("d") * 10, 2).alias("confidence"),
        F.when(F.col(part) % 11 == 0, "rejected").when(F.col("s") == "F", "active").otherwise("proposed").alias("status"),
        "reviewed_at",
    )


# The same views for SQL engines.
SQL_VIEWS = {
    "asset": """SELECT doc_id AS asset_id, ['text','image','video','audio'][(doc_id // 20) % 4 + 1] AS modality, CASE WHEN (doc_id // 20) % 10 = 0 THEN 'failed' ELSE 'registered' END AS status,
      '/data/' || source || '/f' || (doc_id // 60) || ['_v1.txt','_v2.txt','_summary.txt'][(doc_id // 20) % 3 + 1] AS fs_path, text AS summary, n_chars AS file_size,
      ['medical','general','review'][(doc_id // 20) % 3 + 1] AS domain_label, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS created_at, lang FROM documents""",
    "emb": "SELECT vec_id // 4 AS asset_id, CASE WHEN label < 7 THEN 'st' ELSE 'clip' END AS channel, vec_id % 4 AS chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "topic": "SELECT doc_id AS asset_id, lang AS topic, CASE WHEN (doc_id // 20) % 5 = 0 THEN '' ELSE source END AS subtopic FROM documents WHERE (doc_id // 20) % 7 <> 0",
    "edge": """SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS kind_code, l_returnflag <> 'R' AS is_symmetric, round(max(l_discount) * 10, 2) AS confidence,
      CASE WHEN l_partkey % 11 = 0 THEN 'rejected' WHEN max(l_linestatus) = 'F' THEN 'active' ELSE 'proposed' END AS status, max(l_shipdate) AS reviewed_at FROM lineitem GROUP BY l_partkey, l_suppkey, l_returnflag""",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + ("," if sql.lstrip().startswith(",") else " ") + sql.lstrip().lstrip(",")

"""Field registry, seeds, and the one-off transforms of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TOPIC_SEED = "version int, topics array<struct<topic_ko:string,topic_en:string>>"
ALIAS_SEED = "version int, aliases array<struct<raw_ko:string,canonical_ko:string>>"
SUBTOPIC_SEED = "version int, source string, subtopics array<struct<parent_ko:string,subtopic_ko:string>>"
CANONICAL_TEXT = ["txt", "pdf", "json", "word", "excel", "powerpoint"]  # fixed values: media that are all "text"


def allowed_keys(fields: DataFrame, domain: str) -> list[str]:
    """Active keys of a domain, sorted; the registry is small."""
    return sorted(r[0] for r in fields.where((F.col("domain") == domain) & (F.col("status") == "active")).select("meta_key").distinct().collect())


def key_schemas(fields: DataFrame, domain: str) -> dict[str, dict]:
    """JSON Schemas of a domain's active keys; those without a type check nothing and are left out."""
    import json

    rows = fields.where((F.col("domain") == domain) & (F.col("status") == "active") & F.col("json_schema").isNotNull()).select("meta_key", "json_schema").collect()
    out = {r["meta_key"]: json.loads(r["json_schema"]) for r in rows}
    return {k: s for k, s in out.items() if isinstance(s, dict) and s.get("type")}


def read_seed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Rows of a seed file ("topics", "aliases" or "subtopics") with their place `i` in it."""
    schema = {"topics": TOPIC_SEED, "aliases": ALIAS_SEED, "subtopics": SUBTOPIC_SEED}[kind]
    return spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode(kind).alias("i", "x")).select("i", "x.*")


def seed_subtopics(registry: DataFrame, seeds: DataFrame) -> DataFrame:
    """The registry with the subtopics of `seeds` (parent_ko, subtopic_ko) that it lacks, from the seed."""
    new = seeds.select(F.col("subtopic_ko").alias("topic_ko"), F.col("parent_ko").alias("parent_topic")).distinct().join(registry.select("topic_ko", "parent_topic"), ["topic_ko", "parent_topic"], "left_anti")
    rest = [c for c in registry.columns if c not in ("topic_ko", "parent_topic", "source")]
    made = new.withColumn("source", F.lit("seed")).withColumns({c: F.lit(None).cast(registry.schema[c].dataType) for c in rest})
    return registry.unionByName(made.select(registry.columns))


def canonical_modality(assets: DataFrame) -> DataFrame:
    """Text-like kinds of file become "text"; other media stay, what is none of ours is "unknown"."""
    m = F.col("modality")
    return assets.withColumn("modality", F.when(m.isin(CANONICAL_TEXT), "text").when(m.isin("text", "image", "video", "audio"), m).otherwise("unknown"))


def backfill_kinds(edges: DataFrame, types: DataFrame, subtopics: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges with kind and topic (JSON text) of their old type; an update from two joins, rows without a type stay as they are.

    types: relation_type_id, kind_code, subtopic_id; subtopics: subtopic_id, topic_id, subtopic_ko, subtopic_en; parents: topic_id, topic_ko, topic_en.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    made = types.join(subtopics, "subtopic_id").join(parents, "topic_id").select("relation_type_id", F.col("kind_code").alias("new_kind"), F.to_json(F.struct(*map(text, ("topic_ko", "subtopic_ko", "topic_en", "subtopic_en")))).alias("new_topic"))
    out = edges.join(made, "relation_type_id", "left")
    return out.withColumns({"kind_code": F.coalesce("new_kind", "kind_code"), "topic": F.coalesce("new_topic", "topic")}).drop("new_kind", "new_topic")


def copy_domain(fields: DataFrame, source: str, target: str, tier: str) -> DataFrame:
    """Fields of one domain copied to another with a tier of their own; existing keys of the target are overwritten."""
    new = fields.where(F.col("domain") == source).withColumns({"domain": F.lit(target), "access_tier": F.lit(tier)})
    return fields.join(new.select("domain", "meta_key"), ["domain", "meta_key"], "left_anti").select(fields.columns).unionByName(new.select(fields.columns))


def seed_types(kinds: DataFrame, subtopics: DataFrame, existing: DataFrame) -> DataFrame:
    """Active kinds with each of the default subtopics (kind_code, subtopic_id), those that exist left out. Both catalogues are small; the product is of their rows."""
    return kinds.where("status = 'active'").select("kind_code").crossJoin(subtopics.select("subtopic_id")).join(existing, ["kind_code", "subtopic_id"], "left_anti")


def list_items(rows: DataFrame, keywords: int = 8, labels: int = 5) -> DataFrame:
    """asset_id, file_name, modality, keywords and labels of a listing: the first that are not empty."""
    some = lambda c, n: F.slice(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), 1, n)
    return rows.select("asset_id", T.display_name(F.col("fs_path")).alias("file_name"), "modality", some("keywords", keywords).alias("keywords"), some("labels", labels).alias("labels"))

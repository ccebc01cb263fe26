"""Topics: facets, groups, listings, canonical names over closed vocabularies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Names of media, which are no subtopics; the topic of what fits nowhere.
MEDIA_WORDS = ["텍스트", "오디오", "영상", "이미지", "text", "audio", "video", "image"]
UNASSIGNED = "미분류"


def facets(topics: DataFrame) -> DataFrame:
    """(topic, subtopic, n_assets, topic_assets): distinct assets at both levels; rows without a topic do not count."""
    own = topics.where(F.coalesce("topic", F.lit("")) != "").select("asset_id", "topic", T.blank_to_null(F.col("subtopic")).alias("subtopic"))
    low = own.groupBy("topic", "subtopic").agg(F.countDistinct("asset_id").alias("n_assets"))
    top = own.groupBy("topic").agg(F.countDistinct("asset_id").alias("topic_assets"))
    return low.join(top, "topic")


def topic_assets(topics: DataFrame, assets: DataFrame, topic: str, subtopic: str | None = None, unassigned_only: bool = False, modality: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(modality, n) before the modality filter, and a page of the topic's assets by id."""
    where = F.col("topic") == topic
    if unassigned_only:
        where &= T.blank_to_null(F.col("subtopic")).isNull()
    elif subtopic:
        where &= F.col("subtopic") == subtopic
    own = assets.join(topics.where(where).select("asset_id", "topic", "subtopic"), "asset_id")
    return _page(own, modality, offset, limit)


def unclassified(topics: DataFrame, assets: DataFrame, modality: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """The same of registered assets without a topic row."""
    return _page(assets.where("status = 'registered'").join(topics.select("asset_id"), "asset_id", "left_anti"), modality, offset, limit)


def _page(own: DataFrame, modality: str | None, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    counts = own.groupBy("modality").agg(F.count("*").alias("n"))
    page = own.where(F.col("modality") == modality) if modality else own
    return counts, page.orderBy("asset_id").offset(offset).limit(limit)


def linked_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, so that "already linked" is an equi-join."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def same_topic_groups(topics: DataFrame, sources: DataFrame, edges: DataFrame, max_topics: int = 12, max_subtopics: int = 12, max_assets: int = 8) -> DataFrame:
    """(source, topic, subtopic, n, asset, already_linked, position): assets of the sources' topics, grouped.

    Counts are taken before the caps. Named subtopics come first, the larger before the smaller. Assets are ranked and capped
    within their own group once, so a source meets a few of each group, not all members of its topic.
    """
    own = topics.where(F.coalesce("topic", F.lit("")) != "").select("asset_id", "topic", F.coalesce(T.blank_to_null(F.col("subtopic")), F.lit("")).alias("subtopic"))
    group = ["topic", "subtopic"]
    sizes = own.groupBy(*group).agg(F.count("*").alias("total"))
    heads = own.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("asset_id"))).where(F.col("r") <= max_assets + 1)  # one may be the source
    mine = own.join(sources.select("asset_id"), "asset_id", "left_semi").groupBy(F.col("asset_id").alias("source"), *group).agg(F.count("*").alias("own"))
    met = mine.select("source", "topic").distinct().join(sizes, "topic").join(mine, ["source", *group], "left")
    met = met.withColumn("n", F.col("total") - F.coalesce("own", F.lit(0))).where("n > 0")
    sub = Window.partitionBy("source", "topic").orderBy(F.col("subtopic") == "", F.desc("n"), F.asc("subtopic"))
    ranked = met.withColumn("sub_rank", F.row_number().over(sub)).withColumn("t", F.sum("n").over(Window.partitionBy("source", "topic")))
    ranked = ranked.withColumn("topic_rank", F.dense_rank().over(Window.partitionBy("source").orderBy(F.desc("t"), "topic")))
    kept = ranked.where((F.col("sub_rank") <= max_subtopics) & (F.col("topic_rank") <= max_topics)).select("source", *group, "n", "sub_rank", "topic_rank")
    rows = kept.join(heads.select(*group, F.col("asset_id").alias("asset")), group).where("source <> asset")
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("source", *group).orderBy("asset"))).where(F.col("position") <= max_assets)
    pairs = linked_pairs(edges).select(F.col("a").alias("source"), F.col("b").alias("asset"), F.lit(True).alias("l"))
    return rows.join(pairs, ["source", "asset"], "left").select("source", "topic", F.nullif("subtopic", F.lit("")).alias("subtopic"), "n", "asset", "position", "sub_rank", "topic_rank", F.coalesce("l", F.lit(False)).alias("already_linked"))


def own_topic(topics: DataFrame) -> DataFrame:
    """The topic rows of assets with weight 1."""
    return topics.where(F.coalesce("topic", F.lit("")) != "").withColumn("weight", F.lit(1))


def english_labels(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """`rows` with topic_en of their topic from the top level of the registry, null where it has none."""
    top = registry.where("parent_topic is null").groupBy(F.col("topic_ko").alias("topic")).agg(F.min(T.blank_to_null(F.col("topic_en"))).alias("topic_en"))
    return rows.join(top, "topic", "left")


def canonical_topics(raw: DataFrame, registry: DataFrame, aliases: DataFrame, classify: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw with canonical and decided_by, aliases to freeze) for topic names (column topic).

    The closed vocabulary is the registry's top level from the taxonomy (column source, where there is one).
    Blank names and an empty registry pass names through; then an exact name, an alias, and last `classify`, which gets the distinct
    residue (topic) and returns (topic, canonical); what it leaves or names outside the registry is UNASSIGNED.
    """
    own = registry.where("source = 'taxonomy'") if "source" in registry.columns else registry
    top = own.where("parent_topic is null").select("topic_ko").distinct()
    if top.isEmpty():
        return raw.withColumns({"canonical": F.col("topic"), "decided_by": F.lit("passthrough")}), aliases.where("false")
    exact = top.select(F.col("topic_ko").alias("topic"), F.col("topic_ko").alias("exact"))
    alias = aliases.where("parent_topic is null").select(F.col("raw_ko").alias("topic"), F.col("canonical_ko").alias("alias"))
    own = raw.withColumn("topic", T.strip(F.col("topic"))).join(exact, "topic", "left").join(alias, "topic", "left")
    rest = own.where("topic <> '' and exact is null and alias is null").select("topic").distinct()
    given = (classify(rest) if classify else rest.withColumn("canonical", F.lit(None).cast("string"))).join(top.withColumnRenamed("topic_ko", "canonical"), "canonical", "left_semi")
    decided = rest.join(given, "topic", "left").select("topic", F.coalesce("canonical", F.lit(UNASSIGNED)).alias("judged"))
    out = own.join(decided, "topic", "left").select(
        *[c for c in raw.columns],
        F.when(F.coalesce("topic", F.lit("")) == "", F.col("topic")).otherwise(F.coalesce("exact", "alias", "judged")).alias("canonical"),
        F.when(F.coalesce("topic", F.lit("")) == "", "passthrough").when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").otherwise("classified").alias("decided_by"),
    )
    frozen = decided.select(F.col("topic").alias("raw_ko"), F.col("judged").alias("canonical_ko"), F.lit("auto").alias("decided_by"), F.lit(None).cast("string").alias("parent_topic"))
    return out, frozen


def canonical_subtopics(raw: DataFrame, aliases: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
    """`raw` (parent, subtopic) with canonical: null for blanks, media words and the parent's own name; then alias within the parent; then `nearest` (parent, subtopic, judged synonym); else itself."""
    sub = T.topic_word(F.col("subtopic"))
    own = raw.withColumn("sub", F.when((F.coalesce(sub, F.lit("")) != "") & ~F.lower(sub).isin(MEDIA_WORDS) & ~sub.eqNullSafe(F.col("parent")), sub))
    alias = aliases.where("parent_topic is not null").select(F.col("parent_topic").alias("parent"), F.col("raw_ko").alias("sub"), F.col("canonical_ko").alias("alias"))
    own = own.join(alias, ["parent", "sub"], "left")
    own = own.join(nearest.select("parent", F.col("subtopic").alias("sub"), "synonym"), ["parent", "sub"], "left") if nearest is not None else own.withColumn("synonym", F.lit(None).cast("string"))
    return own.select(*raw.columns, F.when(F.col("sub").isNotNull(), F.coalesce("alias", "synonym", "sub")).alias("canonical"))


def insert_ignore(table: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """`table` with rows of `incoming` whose key (null-safe) is new; of several new ones the first in column order."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c) for c in incoming.columns if c not in key] or [F.lit(1)])
    once = incoming.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")
    old = table.select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    on: Column = F.lit(True)
    for c in key:
        on = on & once[c].eqNullSafe(old[f"__{c}"])
    return table.unionByName(once.join(old, on, "left_anti").select(table.columns))


def apply_seed(registry: DataFrame, aliases: DataFrame, topics: DataFrame, seed_aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the topic layer by the seed, keep subtopics, freeze the seed's aliases."""
    subs = registry.where("parent_topic is not null")
    new = topics.withColumns({"source": F.lit("taxonomy"), "parent_topic": F.lit(None).cast("string")}).select(registry.columns)
    return subs.unionByName(new), insert_ignore(aliases, seed_aliases.withColumns({"decided_by": F.lit("seed"), "parent_topic": F.lit(None).cast("string")}).select(aliases.columns), ["raw_ko", "parent_topic"])


def seed_problems(topics: DataFrame, subtopics: DataFrame) -> DataFrame:
    """(parent, subtopic, problem): parents that are no topic; names that overlap a topic by a word of a "·" list. A subtopic within its parent's name is skipped."""
    names = topics.select(F.col("topic_ko").alias("t"), F.split("topic_ko", "·").alias("tw"))
    unknown = subtopics.join(topics.select(F.col("topic_ko").alias("parent")), "parent", "left_anti").select("parent", "subtopic", F.lit("unknown_parent").alias("problem"))
    words = subtopics.where(~F.contains(F.col("parent"), F.col("subtopic"))).select("parent", "subtopic", F.explode(F.split("subtopic", "·")).alias("w"))
    clash = words.join(names.select("t", F.explode("tw").alias("w")), "w").where("t <> parent").select("parent", "subtopic", F.lit("overlaps_topic").alias("problem")).distinct()
    return unknown.unionByName(clash)

"""Proposing relations for all sources at once: source rows, candidates with their data, prompts, acceptance, edges, counts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from . import relations as R
from .vectors import similarity_candidates

# Lengths at which texts are cut for a prompt.
SOURCE_CHARS, SUMMARY_CHARS, KEYWORD_CHARS, NAME_CHARS, KIND_CHARS = 1200, 500, 150, 120, 200
# Default wording around the data; `{...}` are filled in.
TEMPLATE = """Give the relations between one source and some candidates as one JSON object {{"edges": [...]}} and nothing else.
Each edge has target_media_item_id, relation_type_code, confidence (0 to 1), reason, topic_ko, subtopic_ko, topic_en, subtopic_en.
{kinds}
Topics (topic_ko is one of these): {topics}

Source summary: {summary}
Source medium: {medium}
Source topic: {topic}{keywords}{file_name}

Candidates (signal "path" means found by name and folder; a topic is a hint, the content decides):
{candidates}
"""
NO_KINDS = "There is no active kind of relation; give no edges."


def source_rows(assets: DataFrame, metadata: DataFrame, topics: DataFrame) -> DataFrame:
    """asset_id, fs_path, modality, summary, keywords (empty text where missing), topic, subtopic of assets that have a topic; others are not proposed for."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = assets.join(metadata, "asset_id", "left").select("asset_id", "fs_path", "modality", text("summary"), text("keywords"))
    return own.join(topics.where(F.coalesce("topic", F.lit("")) != "").select("asset_id", "topic", "subtopic"), "asset_id")


def reachable(assets: DataFrame, topics: DataFrame) -> DataFrame:
    """asset_ids that may be a candidate: registered, with a topic."""
    return assets.where("status = 'registered'").select("asset_id").join(topics.where(F.coalesce("topic", F.lit("")) != "").select("asset_id"), "asset_id", "left_semi")


def candidate_rows(candidates: DataFrame, assets: DataFrame, metadata: DataFrame, topics: DataFrame) -> DataFrame:
    """Candidates (source, target, sim, position) with file name, medium, summary, keywords and topic of the target; those that may not be found drop out."""
    own = reachable(assets, topics).join(assets.select("asset_id", "fs_path", "modality"), "asset_id").join(metadata.select("asset_id", "summary", "keywords"), "asset_id", "left").join(topics.select("asset_id", "topic", "subtopic"), "asset_id")
    own = own.select(F.col("asset_id").alias("target"), T.basename(F.col("fs_path")).alias("file_name"), "modality", "summary", "keywords", "topic", "subtopic")
    return candidates.join(own, "target")


def _cut(c: Column, n: int) -> Column:
    return F.left(F.coalesce(c.cast("string"), F.lit("")), F.lit(n))


def topic_line(topic: Column, sub: Column) -> Column:
    """"topic / subtopic", one of them alone, or a mark that there is none."""
    t, s = (F.coalesce(T.strip(c), F.lit("")) for c in (topic, sub))
    return F.when((t != "") & (s != ""), F.concat_ws(" / ", t, s)).when(t != "", t).when(s != "", s).otherwise("(none)")


def candidate_lines(rows: DataFrame) -> DataFrame:
    """(source, candidates): one JSON object a candidate, in order of position; a similarity of 0 was found by path."""
    sim = F.round("sim", 6)
    one = F.to_json(
        F.struct(
            F.col("target").cast("string").alias("target_media_item_id"),
            "file_name",
            F.col("modality").alias("media_type"),
            _cut(F.col("summary"), SUMMARY_CHARS).alias("summary"),
            F.when(_cut(F.col("keywords"), KEYWORD_CHARS) != "", _cut(F.col("keywords"), KEYWORD_CHARS)).alias("keywords"),
            sim.alias("embedding_similarity"),
            F.when(sim == 0, "path").otherwise("embedding").alias("signal"),
            F.col("topic").alias("topic_ko"),
            F.col("subtopic").alias("subtopic_ko"),
        )
    )
    listed = F.array_sort(F.collect_list(F.struct("position", one.alias("line"))))
    return rows.groupBy("source").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("candidates"))


def kind_guide(kinds: list[dict], hints: dict[str, str] | None = None) -> str:
    """A line for each active kind: its hint, or the beginning of its description; the catalogue is small and read on the driver."""
    own = sorted((k for k in kinds if (k.get("kind_code") or "").strip()), key=lambda k: k["kind_code"])
    if not own:
        return NO_KINDS
    lines = [f"- {k['kind_code']}: {(hints or {}).get(k['kind_code']) or (k.get('description') or '')[:KIND_CHARS]}" for k in own]
    catalogue = json.dumps([{c: str(k.get(c) or "") for c in ("kind_code", "kind_name", "description")} for k in own], ensure_ascii=False)
    return f"relation_type_code is one of this list: {catalogue}\n" + "\n".join(lines)


def prompts(sources: DataFrame, candidates: DataFrame, kinds: DataFrame, topics: list[str], template: str = TEMPLATE, hints: dict[str, str] | None = None) -> DataFrame:
    """(source, prompt) of sources (see `source_rows`) and their candidates (see `candidate_rows`); paths are given as file names only."""
    guide = kind_guide([r.asDict() for r in kinds.where("status = 'active'").collect()], hints)
    fixed = dict(kinds=guide, topics=", ".join(topics))
    own = sources.join(candidate_lines(candidates), sources.asset_id == F.col("source"), "left")
    name = T.basename(F.col("fs_path"))
    parts = {
        "summary": F.left("summary", F.lit(SOURCE_CHARS)),
        "medium": F.coalesce("modality", F.lit("")),
        "topic": topic_line(F.col("topic"), F.col("subtopic")),
        "keywords": F.when(_cut(F.col("keywords"), 1) != "", F.concat(F.lit("\nSource keywords: "), _cut(F.col("keywords"), KEYWORD_CHARS))).otherwise(""),
        "file_name": F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("\nSource file: "), _cut(name, NAME_CHARS))).otherwise(""),
        "candidates": F.coalesce("candidates", F.lit("(none)")),
    }

    names = list(parts)

    @F.pandas_udf("string")
    def fill(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([template.format(**fixed, **dict(zip(names, row))) for row in zip(*columns)], dtype="object")

    return own.select(F.col("asset_id").alias("source"), fill(*parts.values()).alias("prompt"))


def sync_edges(existing: DataFrame, proposals: DataFrame, candidates: DataFrame, kinds: DataFrame, auto_approve_min: float = R.AUTO_APPROVE_OFF, auto_approve_sim_min: float = 0.0, persist_floor: float = 0.0, excluded: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(edges after, counts): accepted proposals (see `relations.parse_proposals`) go into the edges in order of source and seq.

    Turned down, in this order: targets that are no UUID, no candidate or the source itself; proposals without a kind; kinds that are not
    active; similarity kinds under the floor. counts: source, upserted, skipped, gated_low_conf, and a row of each reason is in skipped.
    A status once set stays (see `relations.merge_edges`).
    """
    sims = candidates.groupBy("source", "target").agg(F.max("sim").alias("sim"))
    own = R.accepted(proposals, candidates, kinds).join(sims, ["source", "target"], "left")
    low = F.col("reject_reason").isNull() & ~R.should_persist(F.col("kind_code"), F.col("confidence"), persist_floor)
    own = written(own.withColumn("reject_reason", F.when(low, "low_confidence").otherwise(F.col("reject_reason"))), "accepted")
    kept = own.where("reject_reason is null").select(
        F.col("source").alias("src"),
        F.col("target").alias("dst"),
        "is_symmetric",
        "kind_code",
        "confidence",
        T.blank_to_null(F.col("reason")).alias("reason"),
        F.col("topic_ko").alias("topic"),
        R.decide_status(F.col("kind_code"), F.col("confidence"), excluded, auto_approve_min, F.coalesce("sim", F.lit(0.0)), auto_approve_sim_min).alias("status"),
        F.struct("source", "seq").alias("at"),
    )
    kept = R.canonical(kept)
    first = kept.select("at").distinct().orderBy("at").withColumn("seq", F.monotonically_increasing_id())
    kept = kept.join(first, "at").select(*R.KEY, "confidence", "reason", "topic", "status", "seq")
    counts = own.where("not malformed").groupBy("source").agg(F.count_if(F.col("reject_reason").isNull()).alias("upserted"), F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"), F.count_if(F.col("reject_reason") == "low_confidence").alias("gated_low_conf"))
    return R.merge_edges(existing, kept), counts


def auto_approvable(proposals: DataFrame, min_conf: float, excluded: list[str] = ()) -> DataFrame:
    """Edges that a lower bar would approve without review."""
    return proposals.where(R.decide_status(F.col("kind_code"), F.col("confidence"), excluded, min_conf) == "active")


def propose(
    assets: DataFrame, metadata: DataFrame, topics: DataFrame, embeddings: DataFrame, kinds: DataFrame, edges: DataFrame, complete: Callable[[Column], Column], vocabulary: list[str], sources: DataFrame | None = None, top_k: int = 10, path_top_k: int = 10, min_sim: float = 0.2, channel: str = "st", **gates
) -> dict[str, DataFrame]:
    """One batch over all sources: edges, kinds and lineage afterwards, and counts by source.

    `complete` is a column function prompt -> answer. Sources without a row or a topic count nothing and are left out. A malformed answer
    counts as one and changes nothing. lineage: asset_id, activity, agent, payload (counts as JSON), one row a source.
    """
    own = source_rows(assets, metadata, topics)
    own = own if sources is None else own.join(sources.select("asset_id").distinct(), "asset_id", "left_semi")
    own = written(own, "sources")
    may = reachable(assets, topics)
    by_vector = similarity_candidates(embeddings.where(F.col("channel") == channel), own.select("asset_id"), top_k, min_sim, targets=may)
    by_path = R.path_candidates(assets.join(may, "asset_id", "left_semi"), path_top_k)
    met = written(R.union_candidates(by_vector, by_path).join(own.select(F.col("asset_id").alias("source")), "source", "left_semi"), "candidates")
    asked = prompts(own, candidate_rows(met, assets, metadata, topics), kinds, vocabulary)
    answers = written(asked.select("source", complete(F.col("prompt")).alias("answer")), "answers")
    proposals = written(R.parse_proposals(answers), "proposals")
    news = proposals.where("not malformed").select("kind_code", "reason", F.col("seq").alias("seq"))
    after = R.register_kinds(kinds, news)
    merged, counts = sync_edges(edges, proposals, met, kinds, **gates)
    failed = proposals.where("malformed").groupBy("source").agg(F.count("*").alias("malformed"))
    counts = own.select(F.col("asset_id").alias("source")).join(counts, "source", "left").join(failed, "source", "left").fillna(0, ["upserted", "skipped", "gated_low_conf", "malformed"])
    lineage = counts.select(F.col("source").cast("string").alias("asset_id"), F.lit("relations.proposed.v1").alias("activity"), F.lit("llm_propose").alias("agent"), F.to_json(F.struct("upserted", "skipped", "gated_low_conf", F.lit(top_k).alias("top_k"), F.lit(channel).alias("embedding_kind"))).alias("payload"))
    return {"edges": merged, "kinds": after, "counts": counts, "lineage": lineage, "proposals": proposals, "candidates": met}

"""Relation graph: candidates by path, proposals, policies, edge merges, neighbours, review, retry queue, invariants.

An edge frame: src, dst, kind_code, confidence, reason, topic, status. Statuses: proposed, active, rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T

# Kinds that rest on similarity alone; defaults of the policies; topic of a proposal that names none.
SIMILARITY_KINDS = ["duplicate_near", "same_domain"]
PERSIST_FLOOR, AUTO_APPROVE_OFF, MAX_ATTEMPTS = 0.70, 1.01, 3
TOPIC_KO, TOPIC_EN = "일반", "general"
UUID_TEXT = f"^{T.UUID}$"


def path_candidates(assets: DataFrame, limit: int, drop_id: bool = False) -> DataFrame:
    """(source, target, rank_score, rank): files of one directory with the same stem (2) or base stem (1); `assets` has asset_id, fs_path.

    Two equi-joins within (directory, stem); empty stems never match.
    """
    own = assets.select("asset_id", T.directory(F.col("fs_path")).alias("dir"), T.stem(F.col("fs_path"), drop_id).alias("raw"), T.base_stem(F.col("fs_path"), drop_id).alias("base"))

    def same(key: str, score: int) -> DataFrame:
        a = own.where(F.col(key) != "").select(F.col("asset_id").alias("source"), "dir", key)
        b = own.where(F.col(key) != "").select(F.col("asset_id").alias("target"), "dir", key)
        return a.join(b, ["dir", key]).where("source <> target").select("source", "target", F.lit(score).alias("rank_score"))

    best = same("raw", 2).unionByName(same("base", 1)).groupBy("source", "target").agg(F.max("rank_score").alias("rank_score"))
    order = Window.partitionBy("source").orderBy(F.desc("rank_score"), F.asc("target"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def union_candidates(by_embedding: DataFrame, by_path: DataFrame) -> DataFrame:
    """Embedding candidates (source, target, sim, rank), then path candidates that are not among them (sim 0)."""
    both = by_embedding.select("source", "target", "sim", "rank", F.lit(0).alias("side")).unionByName(by_path.select("source", "target", F.lit(0.0).alias("sim"), "rank", F.lit(1).alias("side")))
    first = Window.partitionBy("source", "target").orderBy("side", "rank")
    kept = both.withColumn("i", F.row_number().over(first)).where("i = 1")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("side", "rank"))).select("source", "target", "sim", "side", "position")


def proposal_topics(e: Column) -> Column:
    """struct(topic_ko, subtopic_ko, topic_en, subtopic_en, topic_auto) of a proposed edge.

    Other names of a field count where it is blank. Without a topic the first word of the reason's first line stands in, or else the default;
    topic_auto says so.
    """
    some = lambda *names: F.coalesce(*[T.blank_to_null(e[n]) for n in names])
    ko = T.blank_to_null(T.topic_word(some("topic_ko", "topic")))
    first = T.blank_to_null(T.topic_word(T.blank_to_null(F.substring_index(T.strip(e["reason"]), "\n", 1))))
    return F.struct(
        F.coalesce(ko, first, F.lit(TOPIC_KO)).alias("topic_ko"),
        F.coalesce(T.topic_word(some("subtopic_ko", "sub_topic_ko", "subtopic")), F.lit("")).alias("subtopic_ko"),
        F.coalesce(T.blank_to_null(T.topic_words_en(some("topic_en"))), F.lit(TOPIC_EN)).alias("topic_en"),
        F.coalesce(T.topic_words_en(some("subtopic_en", "sub_topic_en")), F.lit("")).alias("subtopic_en"),
        ko.isNull().alias("topic_auto"),
    )


def parse_proposals(raw: DataFrame) -> DataFrame:
    """(source, seq, target, kind_code, confidence, reason, topic_ko, subtopic_ko, topic_en, subtopic_en, topic_auto, malformed) from model answers (source, answer).

    An answer holds "edges" or "items", or is one edge; what is no JSON object gives one malformed row.
    """
    names = ["target_media_item_id", "relation_type_code", "confidence", "reason", "topic_ko", "topic", "subtopic_ko", "sub_topic_ko", "subtopic", "topic_en", "subtopic_en", "sub_topic_en"]
    one = f"struct<{','.join(f'{n}:string' for n in names)}>"
    edge = f"array<{one}>"
    got = raw.select(
        "source",
        F.from_json("answer", f"struct<edges:{edge},items:{edge},target_media_item_id:string>").alias("a"),
        F.from_json("answer", one).alias("single"),
        (F.coalesce(T.strip(F.col("answer")), F.lit("")).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(F.col("answer")).isNotNull()).alias("ok"),
    )
    listed = F.coalesce(F.col("a.edges"), F.col("a.items"), F.when(F.col("a.target_media_item_id").isNotNull(), F.array("single")), F.array().cast(edge))
    each = got.select("source", "ok", F.posexplode_outer(F.when(F.col("ok"), listed)).alias("seq", "e"))
    out = each.select(
        "source",
        "seq",
        T.blank_to_null(F.col("e.target_media_item_id")).alias("target"),
        T.kind_code(F.col("e.relation_type_code")).alias("kind_code"),
        N.confidence(F.col("e.confidence")).alias("confidence"),
        F.col("e.reason").alias("reason"),
        proposal_topics(F.col("e")).alias("t"),
        (~F.coalesce("ok", F.lit(False))).alias("malformed"),
    )
    return out.where("malformed or target is not null").select("source", "seq", "target", "kind_code", "confidence", "reason", "t.*", "malformed")


def accepted(proposals: DataFrame, candidates: DataFrame, kinds: DataFrame) -> DataFrame:
    """Proposals with reject_reason: target must be a UUID, a candidate of the source and another asset, the kind known and active."""
    own = proposals.join(candidates.select("source", "target", F.lit(True).alias("is_candidate")).distinct(), ["source", "target"], "left")
    own = own.join(kinds.where("status = 'active'").select("kind_code", "is_symmetric"), "kind_code", "left")
    reason = (
        F.when(~F.coalesce("target", F.lit("")).rlike(UUID_TEXT), "target_not_uuid")
        .when(F.col("is_candidate").isNull(), "not_a_candidate")
        .when(F.col("source") == F.col("target"), "self")
        .when(F.col("kind_code").isNull(), "no_kind")
        .when(F.col("is_symmetric").isNull(), "kind_not_active")
    )
    return own.withColumn("reject_reason", reason)


def should_persist(kind: Column, conf: Column, floor: float = PERSIST_FLOOR) -> Column:
    if floor <= 0:
        return F.lit(True)
    return ~kind.isin(SIMILARITY_KINDS) | (conf.isNotNull() & (conf >= floor))


def decide_status(kind: Column, conf: Column, excluded: list[str] = (), min_conf: float = AUTO_APPROVE_OFF, sim: Column | None = None, min_sim: float = 0.0) -> Column:
    ok = conf.isNotNull() & (conf >= min_conf)
    if excluded:
        ok &= ~kind.isin(list(excluded))
    if min_sim > 0 and sim is not None:
        ok &= F.coalesce(sim >= min_sim, F.lit(False))
    return F.when(ok, "active").otherwise("proposed")


def exposure_tier(status: Column, kind: Column, conf: Column, floor: float = PERSIST_FLOOR) -> Column:
    return F.when(status == "active", "strong").when((status == "proposed") & should_persist(kind, conf, floor), "weak")


def is_review_exempt(kind: Column, exempt: list[str]) -> Column:
    return kind.isin(list(exempt)) if exempt else F.lit(False)


def canonical(edges: DataFrame) -> DataFrame:
    """Ends of symmetric edges in order; `edges` has src, dst, is_symmetric."""
    swap = F.col("is_symmetric") & (F.col("dst") < F.col("src"))
    return edges.withColumns({"src": F.when(swap, F.col("dst")).otherwise(F.col("src")), "dst": F.when(swap, F.col("src")).otherwise(F.col("dst"))})


KEY = ["src", "dst", "kind_code"]


def reduce_batch(incoming: DataFrame) -> DataFrame:
    """What applying a batch row by row (column seq) leaves of each key: greatest confidence, text of the surest (the earliest of equals), first status.

    A fresh single row keeps a null confidence; a repeated key counts nulls as 0.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    surest = F.struct(conf, -F.col("seq"), F.coalesce("reason", F.lit("")), F.coalesce("topic", F.lit("")))  # rows of one seq: the later texts
    return incoming.groupBy(*KEY).agg(
        F.when(F.count("*") == 1, F.max("confidence")).otherwise(F.max(conf)).alias("confidence"),
        F.max_by("reason", surest).alias("reason"),
        F.max_by("topic", surest).alias("topic"),
        F.min_by("status", "seq").alias("status"),
    )


def merge_edges(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The edge table after an upsert; inputs stay as they are.

    Confidence is the greater one (null as 0 where both exist); reason and topic are taken over only from a strictly greater
    confidence; a status is never overwritten. `incoming` has a column seq.
    """
    old = existing.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("confidence", "reason", "topic", "status")], F.lit(True).alias("o"))
    new = reduce_batch(incoming).select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("confidence", "reason", "topic", "status")], F.lit(True).alias("n"))
    both = old.join(new, KEY, "full_outer")
    a, b = F.coalesce("o_confidence", F.lit(0.0)), F.coalesce("n_confidence", F.lit(0.0))
    fresh, kept = F.col("o").isNull(), F.col("n").isNull()
    surer = fresh | (F.coalesce("n", F.lit(False)) & (b > a))
    return both.select(
        *KEY,
        F.when(fresh, F.col("n_confidence")).when(kept, F.col("o_confidence")).otherwise(F.greatest(a, b)).alias("confidence"),
        F.when(surer, F.col("n_reason")).otherwise(F.col("o_reason")).alias("reason"),
        F.when(surer, F.col("n_topic")).otherwise(F.col("o_topic")).alias("topic"),
        F.coalesce("o_status", "n_status").alias("status"),
    )


def neighbours(edges: DataFrame, assets: DataFrame, ids: DataFrame | None = None, statuses: list[str] = ("active",), include_weak: bool = False, floor: float = PERSIST_FLOOR) -> DataFrame:
    """(asset, other, direction, kind_code, confidence, tier, ...) seen from each asset; weak (proposed) edges only if asked for.

    Both directions are two equi-joins, never an OR. Order column: tier, confidence (nulls last), edge key.
    """
    read = list(statuses) + (["proposed"] if include_weak and "proposed" not in statuses else [])
    own = edges.where(F.col("status").isin(read)).withColumn("tier", exposure_tier(F.col("status"), F.col("kind_code"), F.col("confidence"), floor)).where("tier is not null")
    out = own.select(F.col("src").alias("asset"), F.col("dst").alias("other"), F.when(F.col("is_symmetric"), "undirected").otherwise("outbound").alias("direction"), "kind_code", "confidence", "tier")
    into = own.select(F.col("dst").alias("asset"), F.col("src").alias("other"), F.when(F.col("is_symmetric"), "undirected").otherwise("inbound").alias("direction"), "kind_code", "confidence", "tier")
    both = out.unionByName(into)
    both = both.join(ids.select(F.col(ids.columns[0]).alias("asset")).distinct(), "asset", "left_semi") if ids is not None else both
    named = both.join(assets.select(F.col("asset_id").alias("other"), "modality", "fs_path"), "other", "left").withColumn("file_name", T.display_name(F.col("fs_path")))
    order = Window.partitionBy("asset").orderBy(F.when(F.col("tier") == "strong", 0).otherwise(1), F.desc_nulls_last("confidence"), "other", "kind_code")
    return named.withColumn("position", F.row_number().over(order)).drop("fs_path")


def review_filter(q: str | None = None, asset: str | None = None, kind: str | None = None, exempt: list[str] = (), modality: str | None = None, conf_min: float | None = None, conf_max: float | None = None, reviewed_by: str | None = None, since=None, until=None, date_col: str = "created_at", status: str = "proposed") -> Column:
    """Condition on edges (edge_id, src, dst, src_path, dst_path, src_modality, dst_modality, reason, topic_ko, topic_en, ...).

    An explicit kind beats exemption; `since` is inclusive, `until` exclusive; an unknown date column is an error.
    """
    if date_col not in ("created_at", "updated_at", "reviewed_at"):
        raise ValueError(f"unknown date column: {date_col}")
    c = F.col("status") == status
    if q:
        texts = ("edge_id", "src", "dst", "src_path", "dst_path", "reason", "topic_ko", "topic_en")
        hit = F.lit(False)
        for f in texts:
            hit |= F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(q.lower()))
        c &= hit
    if asset:
        c &= (F.col("src") == asset) | (F.col("dst") == asset)
    if kind:
        c &= F.col("kind_code") == kind
    elif exempt:
        c &= ~F.col("kind_code").isin(list(exempt))
    if modality:
        c &= (F.col("src_modality") == modality) | (F.col("dst_modality") == modality)
    if conf_min is not None:
        c &= F.col("confidence") >= conf_min
    if conf_max is not None:
        c &= F.col("confidence") <= conf_max
    if reviewed_by:
        c &= F.col("reviewed_by") == reviewed_by
    if since is not None:
        c &= F.col(date_col) >= F.lit(since)
    if until is not None:
        c &= F.col(date_col) < F.lit(until)
    return c


def review_page(edges: DataFrame, where: Column, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row with the total, the page): surest first, nulls last, then the edge id."""
    own = edges.where(where)
    return own.agg(F.count("*").alias("total")), own.orderBy(F.desc_nulls_last("confidence"), F.asc("edge_id")).offset(offset).limit(limit)


def review_decisions(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges after, seq and ok of each decision). `decisions`: edge_id, seq, action (approve, reject), by.

    Only proposed edges change, so of several decisions on an edge the first counts and the others fail.
    """
    action = F.when(F.col("action").isin("approve", "reject"), F.col("action")).otherwise(F.raise_error(F.lit("unknown action")).cast("string"))
    ranked = decisions.select("edge_id", "seq", action.alias("action"), "by").withColumn("i", F.row_number().over(Window.partitionBy("edge_id").orderBy("seq")))
    open_ = edges.where("status = 'proposed'").select("edge_id", F.lit(True).alias("open"))
    judged = ranked.join(open_, "edge_id", "left").withColumn("ok", F.coalesce("open", F.lit(False)) & (F.col("i") == 1))
    change = judged.where("ok").select("edge_id", F.when(F.col("action") == "approve", "active").otherwise("rejected").alias("to"), "by")
    after = edges.join(change, "edge_id", "left").withColumns({"status": F.coalesce("to", "status"), "reviewed_by": F.coalesce("by", "reviewed_by")}).drop("to", "by")
    return after, judged.select("seq", "edge_id", "ok")


def revise(edges: DataFrame, revisions: DataFrame) -> DataFrame:
    """Set the status of edges (edge_id, to), whatever it was."""
    return edges.join(revisions.select("edge_id", "to"), "edge_id", "left").withColumn("status", F.coalesce("to", "status")).drop("to")


def register_kinds(kinds: DataFrame, proposals: DataFrame) -> DataFrame:
    """`kinds` with unseen, usable codes of proposals (kind_code, reason, seq) added as inactive, described by the first reason."""
    new = proposals.withColumn("kind_code", T.usable_kind(F.col("kind_code"))).where("kind_code is not null").groupBy("kind_code").agg(F.min_by("reason", "seq").alias("reason"))
    new = new.join(kinds.select("kind_code"), "kind_code", "left_anti")
    rows = new.select("kind_code", T.kind_label(F.col("kind_code")).alias("kind_name"), F.left(F.concat_ws("\n", T.kind_label(F.col("kind_code")), "reason"), F.lit(4000)).alias("description"), F.lit(True).alias("is_symmetric"), F.lit("inactive").alias("status"))
    return kinds.select(rows.columns).unionByName(rows)


def upsert_kinds(kinds: DataFrame, incoming: DataFrame) -> DataFrame:
    """New names and descriptions win if not blank; the status is left alone; new kinds are symmetric and inactive unless they say otherwise."""
    new = incoming.select("kind_code", *[F.col(c).alias(f"n_{c}") for c in ("kind_name", "description", "is_symmetric", "status")])
    both = kinds.join(new, "kind_code", "full_outer")
    blank = lambda c: T.blank_to_null(F.col(c))
    return both.select("kind_code", F.coalesce(blank("n_kind_name"), "kind_name").alias("kind_name"), F.coalesce(blank("n_description"), "description").alias("description"), F.coalesce("is_symmetric", "n_is_symmetric", F.lit(True)).alias("is_symmetric"), F.coalesce("status", "n_status", F.lit("inactive")).alias("status"))


def promote_kind(kinds: DataFrame, code: str) -> DataFrame:
    return kinds.withColumn("status", F.when((F.col("kind_code") == code) & (F.col("status") == "inactive"), "active").otherwise(F.col("status")))


def list_kinds(kinds: DataFrame, status: str | None = None, hide_legacy: bool = False, code: str | None = None) -> DataFrame:
    """The catalogue by code, of a status, without codes that are no longer proposed, or the row of one code."""
    own = kinds.where(F.col("status") == status) if status else kinds
    own = own.where(F.col("kind_code") == T.kind_code(F.lit(code))) if code else own
    own = own.where(~F.col("kind_code").isin(T.LEGACY_KINDS)) if hide_legacy else own
    return own.orderBy("kind_code")


def resolution_status(error: Column, n_edges: Column, attempts: Column, most: int = MAX_ATTEMPTS) -> Column:
    """struct(status, attempts) after a run: resolved or isolated without an error, else pending until `most` attempts failed."""
    tried = F.coalesce(attempts, F.lit(0)) + 1
    failed = F.struct(F.when(tried >= most, "failed").otherwise("pending").alias("status"), tried.alias("attempts"))
    done = F.struct(F.when(F.coalesce(n_edges, F.lit(0)) > 0, "resolved").otherwise("isolated").alias("status"), F.coalesce(attempts, F.lit(0)).alias("attempts"))
    return F.when(error.isNotNull(), failed).otherwise(done)


def upsert_resolution(queue: DataFrame, results: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The queue (asset_id, status, attempts, last_reason) after results (asset_id, error, n_edges), one a asset."""
    both = queue.join(results.withColumn("ran", F.lit(True)), "asset_id", "full_outer")
    to = resolution_status(F.col("error"), F.col("n_edges"), F.col("attempts"), most)
    return both.select("asset_id", F.when(F.col("ran"), to["status"]).otherwise(F.col("status")).alias("status"), F.when(F.col("ran"), to["attempts"]).otherwise(F.col("attempts")).alias("attempts"), F.when(F.col("ran"), F.col("error")).otherwise(F.col("last_reason")).alias("last_reason"))


def unresolved(assets: DataFrame, embeddings: DataFrame, queue: DataFrame) -> DataFrame:
    """Registered assets with a vector that are pending or not queued yet, by attempts (nulls first), age, id."""
    own = assets.where("status = 'registered'").join(embeddings.select("asset_id").distinct(), "asset_id", "left_semi")
    left = own.join(queue.select("asset_id", F.col("status").alias("queue_status"), "attempts"), "asset_id", "left")
    return left.where("queue_status is null or queue_status = 'pending'").orderBy(F.asc_nulls_first("attempts"), "created_at", "asset_id")


def reset_for_rescore(edges: DataFrame) -> DataFrame:
    """Unreviewed edges back to proposed without confidence."""
    open_ = F.col("reviewed_by").isNull()
    return edges.withColumns({"status": F.when(open_, "proposed").otherwise(F.col("status")), "confidence": F.when(~open_, F.col("confidence"))})


def clear_edges(edges: DataFrame) -> DataFrame:
    """No edges; an error if a reviewed one would be lost."""
    if not edges.where("reviewed_by is not null").isEmpty():
        raise ValueError("reviewed edges would be lost")
    return edges.where("false")


def purge_unscored(edges: DataFrame, pending: int) -> DataFrame:
    """Without unreviewed edges that have no confidence; an error while scoring is pending."""
    if pending > 0:
        raise ValueError(f"{pending} assets are still to be scored")
    return edges.where("confidence is not null or reviewed_by is not null")


def invariants(edges: DataFrame, nodes: DataFrame, kinds: DataFrame, floor: float = PERSIST_FLOOR) -> DataFrame:
    """(invariant, violations) of nine conditions that the merged edges must meet."""
    known = edges.join(kinds.select("kind_code", "is_symmetric", F.col("status").alias("kind_status")), "kind_code", "left")
    single = known.agg(
        *[
            F.count_if(c).alias(n)
            for n, c in {
                "self_edge": F.col("src") == F.col("dst"),
                "unknown_kind": F.col("is_symmetric").isNull(),
                "inactive_kind": F.col("kind_status") != "active",
                "not_canonical": F.col("is_symmetric") & (F.col("dst") < F.col("src")),
                "bad_status": ~F.col("status").isin("proposed", "active", "rejected"),
                "bad_confidence": (F.col("confidence") < 0) | (F.col("confidence") > 1),
                "below_floor": ~should_persist(F.col("kind_code"), F.col("confidence"), floor) & (F.col("status") == "proposed"),
            }.items()
        ]
    )
    names = single.columns
    flat = single.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(n).alias("violations")) for n in names])).alias("x")).select("x.*")
    pairs = known.select(F.when(F.col("is_symmetric"), F.least("src", "dst")).otherwise(F.col("src")).alias("a"), F.when(F.col("is_symmetric"), F.greatest("src", "dst")).otherwise(F.col("dst")).alias("b"), "kind_code")
    twice = pairs.groupBy("a", "b", "kind_code").count().where("count > 1").agg(F.lit("duplicate_pair").alias("invariant"), F.count("*").alias("violations"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    lost = ends.join(nodes.select("node"), "node", "left_anti").agg(F.lit("dangling_node").alias("invariant"), F.count("*").alias("violations"))
    return flat.unionByName(twice).unionByName(lost)

"""Reports, snapshots and golden sets: reading with checks, assembling, comparing, drafting, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics as M

# Versions and key kinds of the files, verdicts, the default grid of a report, the part of a reason that is kept.
VERSION = 1
KEY_TYPES = ["fs_path", "content_hash"]
VERDICTS = ["strong", "weak", "none", "error"]
THRESHOLDS = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
WHY_CHARS = 20
FAILED_SHARE = 0.05

GOLDEN = "version int, key_type string, pairs array<struct<a:string,b:string,kind:string,note:string>>, isolated array<string>"
SNAPSHOT = "version int, config map<string,string>, sources map<string,struct<candidates:array<array<string>>,proposed:array<struct<target:string,kind:string,confidence:double,topic_ko:string,emb_score:double>>>>"
VERDICT_SET = "version int, measure_id string, sample_edge_ids array<string>, verdicts array<struct<edge_id:string,verdict:string,why:string,prompt_sha256:string,judged_by_human:string>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of a JSON file or folder, one a line, or else one that goes over several lines; their versions checked."""
    lines = spark.read.schema(f"{schema}, _bad string").json(path, columnNameOfCorruptRecord="_bad")
    ok = F.coalesce(F.col("version") == VERSION, F.lit(False)) & F.col("_bad").isNull()
    n = lines.select(F.struct("*").alias("x"), ok.alias("ok"), F.col("_bad").isNotNull().alias("bad"), "version").agg(F.count("x").alias("n"), F.count_if("ok").alias("ok"), F.count_if("bad").alias("bad"), F.min(F.when(~F.col("ok") & ~F.col("bad"), F.coalesce(F.col("version").cast("string"), F.lit("None")))).alias("wrong")).first()
    if n["n"] and n["n"] == n["ok"]:
        return lines.drop("_bad")
    if n["ok"] or n["n"] and not n["bad"]:
        raise ValueError(f"{path}: version {n['wrong']}, not {VERSION}" if n["wrong"] else f"{path}: {n['bad']} lines are no documents")
    return _one(spark, path, schema)


def _one(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one row of a JSON file, its version checked."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    version = df.select("version").first()
    if version is None or version[0] != VERSION:
        raise ValueError(f"{path}: version {version and version[0]}, not {VERSION}")
    return df


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, kind, note; isolated: key). A wrong version or key kind, a pair without a, b or kind, or of one key with itself is an error."""
    df = _one(spark, path, GOLDEN)
    kind = df.select("key_type").first()[0]
    if kind not in KEY_TYPES:
        raise ValueError(f"{path}: key_type {kind}")
    pairs = df.select(F.explode("pairs").alias("p")).select("p.a", "p.b", "p.kind", F.coalesce("p.note", F.lit("")).alias("note"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    if not pairs.where(blank("a") | blank("b") | blank("kind") | (F.col("a") == F.col("b"))).isEmpty():
        raise ValueError(f"{path}: a pair needs two different keys and a kind")
    return pairs, df.select(F.explode("isolated").alias("key"))


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidates: source, target, score; proposed: source, target, kind, confidence, topic_ko, emb_score). A candidate without a score has 0, as older files have it."""
    each = _documents(spark, path, SNAPSHOT).select(F.explode("sources").alias("source", "s"))
    c = each.select("source", F.explode("s.candidates").alias("c")).select("source", F.get("c", F.lit(0)).alias("target"), F.coalesce(F.get("c", F.lit(1)).cast("double"), F.lit(0.0)).alias("score"))
    p = each.select("source", F.explode("s.proposed").alias("p")).select("source", "p.target", "p.kind", "p.confidence", F.coalesce("p.topic_ko", F.lit("")).alias("topic_ko"), F.coalesce("p.emb_score", F.lit(0.0)).alias("emb_score"))
    return c, p


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """edge_id, verdict, why, prompt_sha256, judged_by_human; an unknown verdict is an error."""
    v = _documents(spark, path, VERDICT_SET).select(F.explode("verdicts").alias("v")).select("v.*")
    if not v.where(~F.coalesce("verdict", F.lit("")).isin(VERDICTS)).isEmpty():
        raise ValueError(f"{path}: unknown verdict")
    return v


def snapshot_json(candidates: DataFrame, proposed: DataFrame, config: dict[str, str]) -> DataFrame:
    """Rows `value`, each a snapshot of one source as JSON, in order of the sources: together the whole, without one row that holds all. Candidates are [id, score] in order of score."""
    c = candidates.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "target", "score"))), lambda x: F.array(x["target"].cast("string"), x["score"].cast("string"))).alias("candidates"))
    p = proposed.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "kind", "confidence", "topic_ko", "emb_score"))).alias("proposed"))
    empty = lambda name: F.coalesce(name, F.array().cast(dict((c.join(p, "source")).dtypes)[name])).alias(name)
    each = c.join(p, "source", "full_outer").select(F.col("source").cast("string").alias("k"), F.struct(empty("candidates"), empty("proposed")).alias("v"))
    held = F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv]) if config else F.create_map().cast("map<string,string>")
    none = candidates.sparkSession.range(1).select(F.to_json(F.struct(held.alias("config"), F.create_map().cast("map<string,string>").alias("sources"), F.lit(VERSION).alias("version"))).alias("value"))  # an empty snapshot has a document as well
    return none.unionByName(each.orderBy("k").select(F.to_json(F.struct(held.alias("config"), F.create_map("k", "v").alias("sources"), F.lit(VERSION).alias("version"))).alias("value")))


def verdict_json(verdicts: DataFrame, measure_id: str) -> DataFrame:
    """Rows `value`, each a set of one verdict as JSON, in order of the edges; of a verdict five fields only, the reason cut."""
    row = F.struct("edge_id", "judged_by_human", "prompt_sha256", "verdict", F.left("why", F.lit(WHY_CHARS)).alias("why"))
    listed = lambda rows: rows.select(F.to_json(F.struct(F.lit(measure_id).alias("measure_id"), F.transform("verdicts", lambda x: x["edge_id"]).alias("sample_edge_ids"), "verdicts", F.lit(VERSION).alias("version"))).alias("value"))
    each = verdicts.select(row.alias("x")).orderBy("x").select(F.array("x").alias("verdicts"))
    none = verdicts.sparkSession.range(1).select(F.array().cast(each.schema["verdicts"].dataType).alias("verdicts"))  # an empty set has a document as well
    return listed(none).unionByName(listed(each))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows with a column `value` as text, one JSON object a line, in the parts that the rows come in."""
    rows.select("value").write.mode("overwrite").text(path)


def resolved(pairs: DataFrame, isolated: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs by asset_id, isolated asset_ids, keys without an asset, sorted); `keys` has key, asset_id. A pair counts only if both ends are found."""
    a, b = keys.toDF("a", "a_id"), keys.toDF("b", "b_id")
    found = pairs.join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "kind")
    every = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(isolated).distinct()
    return found, isolated.join(keys, "key").select("asset_id").distinct(), every.join(keys, "key", "left_anti").orderBy("key")


def report(pairs: DataFrame, isolated: DataFrame, keys: DataFrame, candidates: DataFrame, proposed: DataFrame, confidence_min: float = 0.0, thresholds: list[float] = THRESHOLDS) -> dict[str, DataFrame]:
    """The report of a golden set and a snapshot: summary (one row), sweep (one row a threshold), unresolved_keys. Unresolved keys are left out and named, not counted as misses."""
    gold, alone, unresolved = resolved(pairs, isolated, keys)
    edges = proposed.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("kind").alias("kind_code"), "confidence")
    counts = gold.agg(F.count("*").alias("n_golden_pairs")).crossJoin(alone.agg(F.count("*").alias("n_isolated"))).crossJoin(unresolved.agg(F.count("*").alias("n_unresolved")))  # one row each
    of = lambda t: M.relation_metrics(edges.where(F.col("confidence") >= t), gold, alone)
    summary = counts.crossJoin(M.candidate_recall(candidates, gold).withColumnRenamed("recall", "candidate_recall")).crossJoin(of(confidence_min))
    sweep = None
    for t in sorted(thresholds):
        row = of(t).select(F.lit(float(t)).alias("threshold"), "precision", "recall", "kind_accuracy", "isolation_accuracy")
        sweep = row if sweep is None else sweep.unionByName(row)
    return {"summary": summary, "sweep": sweep, "unresolved_keys": unresolved}


def gated(candidates: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals with gate: self, hallucinated (no candidate of the source), or kept."""
    allowed = candidates.select("source", "target", F.lit(True).alias("ok")).distinct()
    return proposed.join(allowed, ["source", "target"], "left").withColumn("gate", F.when(F.col("source") == F.col("target"), "self").when(F.col("ok").isNull(), "hallucinated").otherwise("kept")).drop("ok")


def gate_stats(candidates: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row: proposed, hallucinated, self_ref, kept."""
    g = F.col("gate")
    return gated(candidates, proposed).agg(F.count("*").alias("proposed"), F.count_if(g == "hallucinated").alias("hallucinated"), F.count_if(g == "self").alias("self_ref"), F.count_if(g == "kept").alias("kept"))


def compare_arms(arms: DataFrame, verdicts: DataFrame) -> DataFrame:
    """By arm: edge_count, pair_count, rated, strong_count, weak_count, none_count, assets_with_edge of kept proposals (arm, source, target, kind); verdicts: lo, hi, verdict of unordered pairs."""
    own = M.unordered(arms, "source", "target")
    n = own.groupBy("arm").agg(F.count("*").alias("edge_count"))
    pairs = own.select("arm", "lo", "hi").distinct().join(verdicts, ["lo", "hi"], "left")
    v = lambda x: F.count_if(F.col("verdict") == x)
    judged = pairs.groupBy("arm").agg(F.count("*").alias("pair_count"), F.count_if(F.col("verdict").isin(M.JUDGED)).alias("rated"), v("strong").alias("strong_count"), v("weak").alias("weak_count"), v("none").alias("none_count"))
    ends = own.select("arm", F.explode(F.array("source", "target")).alias("a")).groupBy("arm").agg(F.countDistinct("a").alias("assets_with_edge"))
    return n.join(judged, "arm").join(ends, "arm")


def kind_counts(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, kind, n): how often each kind or label occurs."""
    return rows.groupBy(*by, F.coalesce(T.blank_to_null(F.col(kind)), F.lit("(none)")).alias("kind")).agg(F.count("*").alias("n"))


def in_list_rate(labels: DataFrame, column: str, closed: DataFrame) -> DataFrame:
    """One row (total, in_list, rate): labels that are in the closed vocabulary (a column of its own); blank ones do not count."""
    own = labels.select(T.blank_to_null(F.col(column)).alias("v")).where("v is not null")
    known = closed.toDF("v").distinct().withColumn("ok", F.lit(True))
    return own.join(known, "v", "left").agg(F.count("*").alias("total"), F.count("ok").alias("in_list"), F.round(M.ratio(F.count("ok"), F.count("*")), 4).alias("rate"))


def build_snapshot(answers: DataFrame, candidates: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposed rows to freeze, one row: sources, failed, flagged): failed answers (malformed) are counted, and flagged above FAILED_SHARE of all sources."""
    sims = candidates.groupBy("source", "target").agg(F.max("sim").alias("emb_score"))
    rows = proposals.where("not malformed").join(sims, ["source", "target"], "left").select("source", "target", F.col("kind_code").alias("kind"), "confidence", "topic_ko", F.coalesce("emb_score", F.lit(0.0)).alias("emb_score"))
    bad = proposals.where("malformed").select("source").distinct().withColumn("bad", F.lit(True))
    status = answers.select("source").distinct().join(bad, "source", "left").agg(F.count("*").alias("sources"), F.count("bad").alias("failed"))
    return rows, status.withColumn("flagged", F.col("failed") > FAILED_SHARE * F.col("sources"))


def judging_rows(edges: DataFrame, assets: DataFrame, metadata: DataFrame, topics: DataFrame, status: str = "active", chars: int = 300) -> DataFrame:
    """Edges of a status with name, medium, topic, summary and keywords of both ends, for a judge; edges whose ends are no assets drop out."""
    own = assets.select("asset_id", "modality", T.basename(F.col("fs_path")).alias("name")).join(metadata.select("asset_id", F.left(F.coalesce("summary", F.lit("")), F.lit(chars)).alias("summary"), F.coalesce("keywords", F.lit("[]")).alias("keywords")), "asset_id", "left").join(topics.select("asset_id", F.col("topic")), "asset_id", "left").fillna({"topic": "(none)", "summary": "", "keywords": "[]"})
    end = lambda p: own.select(F.col("asset_id").alias("src" if p == "a" else "dst"), *[F.col(c).alias(f"{p}_{c}") for c in ("modality", "name", "topic", "summary", "keywords")])
    return edges.where(F.col("status") == status).join(end("a"), "src").join(end("b"), "dst")


def topic_of_name(name: Column) -> Column:
    """struct(key, label) of a file name: a topic in brackets before the extension, the second word after a source name, or what stands before an 11-character id; null if none."""
    bracket = T.blank_to_null(F.regexp_extract(name, r"_\(([^)]+)\)\.[^.]+$", 1))
    words = F.split(name, "_")
    second = F.when(F.get(words, F.lit(0)).isin("youtube", "wikipedia") & (F.size(words) >= 3), T.strip(F.get(words, F.lit(1))))
    before = T.blank_to_null(F.regexp_extract(name, r"^(.+?)_[A-Za-z0-9_-]{11}_", 1))
    label = F.coalesce(bracket, F.when(second.isNotNull(), F.nullif(second, F.lit(""))).otherwise(before))
    key = F.when(bracket.isNotNull() | second.isNotNull(), label).otherwise(F.substring_index(label, "_", 1))
    return F.when(label.isNotNull(), F.struct(key.alias("key"), label.alias("label")))


def golden_draft(assets: DataFrame, min_group: int = 2, exclude: list[str] = ()) -> DataFrame:
    """(key, query, relevant): registered assets grouped by the topic of their name, ids sorted; groups under `min_group` drop out. The longest label, underscores as spaces, is the query."""
    named = assets.where("status = 'registered'").select("asset_id", T.display_name(F.col("fs_path")).alias("name"))
    named = named.where(~F.col("name").isin(list(exclude))) if exclude else named
    own = named.select("asset_id", topic_of_name(F.col("name")).alias("t")).where("t is not null").select("asset_id", "t.key", "t.label")
    groups = own.groupBy("key").agg(F.array_sort(F.collect_set("asset_id")).alias("relevant"), F.min(F.struct((-F.length("label")).alias("o"), "label")).alias("l"))
    return groups.where(F.size("relevant") >= min_group).select("key", T.strip(F.replace(F.col("l.label"), F.lit("_"), F.lit(" "))).alias("query"), "relevant")


def uncovered(corpus: DataFrame, golden: DataFrame) -> DataFrame:
    """Topics (one column each) of the corpus that no golden query has, sorted."""
    return corpus.toDF("topic").where("topic is not null").distinct().subtract(golden.toDF("topic").distinct()).orderBy("topic")


def partial_only(queries: DataFrame) -> DataFrame:
    """`queries` (partial, relevant: arrays) with partial less what is relevant anyway."""
    return queries.withColumn("partial", F.array_sort(F.array_except("partial", "relevant")))


def having_all(rows: DataFrame, by: str, kind: str, wanted: list[str]) -> DataFrame:
    """Groups that have every one of the wanted kinds (division)."""
    return rows.where(F.col(kind).isin(wanted)).groupBy(by).agg(F.countDistinct(kind).alias("n")).where(F.col("n") == len(set(wanted))).select(by)

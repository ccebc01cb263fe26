"""Hybrid retrieval: BM25 postings, exact kNN, score fusion, gate, cut, rescue, evidence, rerank, buckets.

Every operator works on all (query, bucket) groups at once. Rows of a fused frame:
query_id, bucket, asset_id, similarity, cos (null if only lexical), lexical, matched_queries (null: not observed).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from datetime import date, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..sources.scratch import written
from .vectors import with_direction

K1, B = 1.2, 0.75
SAMPLE = 50
QUERY_BLOCK = 1024
DIGITS = 9  # scores are rounded before they are ranked, so that sums in another order do not change ties
TERM_ROWS = 1_000_000
GROUP = ["query_id", "bucket"]

# Fields of the lexical query with boost and the name under which a hit is observed.
CLAUSES = {"keywords": (2.0, "hit_keywords"), "labels": (1.0, "hit_labels"), "file_name": (0.5, "hit_file_name"), "summary": (3.0, "hit_summary"), "cross": (1.0, "hit_cross_meta")}
CROSS = {"summary": 3.0, "keywords": 2.0}
# Evidence weight of each observed hit.
EVIDENCE = {"hit_keywords": 3.0, "hit_labels": 2.0, "hit_file_name": 1.5, "hit_summary": 0.7, "hit_cross_meta": 0.3}
STRONG = ["hit_keywords", "hit_labels", "hit_file_name"]
RESCUE_NORMAL, RESCUE_KEYWORD = 1.5, 0.7
# Labels under which the text bucket is stored, nouns that say nothing in a query, noun tags.
MODALITIES = {"text": ["text", "txt", "json", "pdf", "word", "excel", "powerpoint"], "image": ["image"], "video": ["video"], "audio": ["audio"]}
STOP_NOUNS = ["영상", "사진", "이미지", "동영상", "그림", "문서", "자료", "정보", "추천", "소개", "방법", "법", "모습", "관련", "내용", "종류", "장면", "클립"]
NOUN_TAGS = ["NNG", "NNP", "SL", "SH", "SN"]


@dataclass(frozen=True)
class Tuning:
    cutoff_enabled: bool = True
    cutoff_eps: float = 0.18
    cutoff_floor: float = 0.35
    result_floor: float = 0.20
    bm25_operator: str = "and"
    weight_bm25: float = 0.5
    weight_knn: float = 0.5
    rerank_enabled: bool = False
    rerank_top_r: int = 10
    rerank_tau: float = 0.0
    evidence_rescue_enabled: bool = True
    about_filter_enabled: bool = False
    about_max_ratio: float = 0.5

    @classmethod
    def of(cls, settings: dict) -> Tuning:
        return cls(**{f.name: settings[f.name] for f in fields(cls) if f.name in settings})


@dataclass(frozen=True)
class Filters:
    """Conditions on assets before scoring; unset ones do not filter."""

    file_ext: tuple[str, ...] = ()
    created_from: date | datetime | None = None
    created_to: date | datetime | None = None
    topic: str | None = None
    subtopic: str | None = None

    @classmethod
    def parse(cls, file_ext: str | list[str] | None = None, created_from: str | None = None, created_to: str | None = None, topic: str | None = None, subtopic: str | None = None) -> Filters | None:
        """From request values; None if nothing is set. A bad date is an error."""

        def when(x: str | None):
            x = (x or "").strip()
            if not x:
                return None
            return date.fromisoformat(x) if len(x) == 10 else datetime.fromisoformat(x.replace("Z", "+00:00"))

        exts = file_ext.split(",") if isinstance(file_ext, str) else file_ext or []
        fold = lambda e: unicodedata.normalize("NFKC", e).strip().lstrip(".").casefold()
        out = cls(tuple(sorted({fold(e) for e in exts} - {""})), when(created_from), when(created_to), (topic or "").strip() or None, (subtopic or "").strip() or None)
        return out if out != cls() else None

    def column(self) -> Column:
        """The conjunction; both date bounds are inclusive, times count as their day."""
        day = lambda x: x.date() if isinstance(x, datetime) else x
        c = F.lit(True)
        if self.file_ext:
            c &= F.col("file_ext").isin(list(self.file_ext))
        if self.created_from:
            c &= F.to_date("created_at") >= F.lit(day(self.created_from))
        if self.created_to:
            c &= F.to_date("created_at") <= F.lit(day(self.created_to))
        if self.topic:
            c &= F.array_contains("topics", self.topic)
        if self.subtopic:
            c &= F.array_contains("subtopics", self.subtopic)
        return c


def buckets(assets: DataFrame, wanted: list[str]) -> DataFrame:
    """`assets` with the bucket that their modality falls in; a bucket without a list of labels stands for itself."""
    of = F.lit(None).cast("string")
    for b in wanted:
        of = F.when(F.col("modality").isin(MODALITIES.get(b, [b])), F.lit(b)).otherwise(of)
    return assets.withColumn("bucket", of).where("bucket is not null")


def field_words(docs: DataFrame, field: str, id_col: str = "asset_id") -> DataFrame:
    """(id, w): the words of a text or array-of-text column."""
    text = F.col(field) if dict(docs.dtypes)[field] == "string" else F.array_join(field, " ")
    return docs.select(id_col, T.tokens(F.coalesce(text, F.lit(""))).alias("w"))


def postings(docs: DataFrame, field: str, id_col: str = "asset_id", terms: DataFrame | None = None) -> DataFrame:
    """(field, term, id, tf, dl) of a column; documents without a term have no row. With `terms` only of these terms.

    The terms of a bounded query set are broadcast, so that other words are dropped before the count.
    """
    each = field_words(docs, field, id_col).select(id_col, F.size("w").alias("dl"), F.explode("w").alias("term"))
    if terms is not None:
        own = terms.select("term").distinct()
        each = each.join(F.broadcast(own) if own.limit(TERM_ROWS + 1).count() <= TERM_ROWS else own, "term", "left_semi")
    return each.groupBy(id_col, "term", "dl").agg(F.count("*").alias("tf")).withColumn("field", F.lit(field))


def stored_postings(docs: DataFrame, field: str, terms: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """The same, written once to the shared folder for all that reads them.

    They are dealt out by document into a set number of tasks: a join with the queries multiplies a small table of postings.
    """
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(postings(docs, field, id_col, terms), f"postings-{field}").repartition(spread, id_col)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) of distinct terms."""
    words = queries.select("query_id", F.array_distinct(T.tokens(F.col("query"))).alias("w"))
    return words.select("query_id", F.size("w").alias("n_terms"), F.explode("w").alias("term"))


def bm25(index: DataFrame, n_docs: DataFrame, terms: DataFrame, operator: str = "or", id_col: str = "asset_id") -> DataFrame:
    """(query_id, id, score, hits) of one field from its postings, of query terms at least.

    With "and" a document needs every term. `n_docs` has one row (n, avgdl).
    """
    own = index.join(terms.select("term").distinct(), "term", "left_semi")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    weighted = own.join(df, "term").crossJoin(F.broadcast(n_docs))  # n_docs is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    per_term = weighted.select("term", id_col, (idf * tf).alias("s"))
    scored = terms.join(per_term, "term").groupBy("query_id", id_col, "n_terms").agg(F.sum("s").alias("score"), F.count("*").alias("hits"))
    return (scored.where("hits = n_terms") if operator == "and" else scored).select("query_id", id_col, "score", "hits")


def field_stats(docs: DataFrame, field: str, id_col: str = "asset_id") -> DataFrame:
    """One row (n, avgdl) over documents that hold the field; words are counted, not listed."""
    return field_words(docs, field, id_col).select(F.size("w").alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def lexical(docs: DataFrame, queries: DataFrame, k: int, operator: str = "and", id_col: str = "asset_id") -> DataFrame:
    """The five clauses over docs (id, bucket, keywords, labels, file_name, summary): best k per query and bucket.

    Returns query_id, bucket, id, score, matched_queries, rank. A clause counts by its boost; labels match the whole
    lower-cased query against the stored label as it is; the cross clause takes a term from whichever of its
    fields scores it best.
    """
    terms = query_terms(queries)
    parts, cross = [], []
    for field in ("keywords", "file_name", "summary"):
        index = stored_postings(docs, field, terms, id_col)
        boost, name = CLAUSES[field]
        parts.append(bm25(index, field_stats(docs, field, id_col), terms, operator, id_col).select("query_id", id_col, (F.col("score") * boost).alias("score"), F.lit(name).alias("name")))
        if field in CROSS:
            cross.append(index.withColumn("boost", F.lit(CROSS[field])))
    whole = cross[0].unionByName(cross[1])
    n = docs.agg(F.count("*").alias("n"))
    avg = field_stats(docs, "keywords", id_col).withColumn("field", F.lit("keywords")).unionByName(field_stats(docs, "summary", id_col).withColumn("field", F.lit("summary"))).select("field", "avgdl")
    df = whole.groupBy("term", "field").agg(F.count("*").alias("f")).groupBy("term").agg(F.max("f").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    best = whole.join(avg, "field").join(df, "term").crossJoin(F.broadcast(n)).groupBy("term", id_col).agg(F.max(F.col("boost") * idf * tf).alias("s"))
    met = terms.join(best, "term").groupBy("query_id", id_col, "n_terms").agg(F.sum("s").alias("score"), F.count("*").alias("hits"))
    met = met.where("hits = n_terms") if operator == "and" else met
    parts.append(met.select("query_id", id_col, (F.col("score") * CLAUSES["cross"][0]).alias("score"), F.lit(CLAUSES["cross"][1]).alias("name")))
    label = docs.select(id_col, F.explode("labels").alias("label")).distinct()
    asked = queries.select("query_id", F.lower(T.strip(F.col("query"))).alias("label"))
    share = label.groupBy("label").agg(F.count("*").alias("df"))
    parts.append(asked.join(label, "label").join(share, "label").crossJoin(F.broadcast(n)).select("query_id", id_col, (F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * CLAUSES["labels"][0]).alias("score"), F.lit(CLAUSES["labels"][1]).alias("name")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    total = hits.groupBy("query_id", id_col).agg(F.round(F.sum("score"), DIGITS).alias("score"), F.array_sort(F.collect_set("name")).alias("matched_queries")).join(docs.select(id_col, "bucket"), id_col)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("score"), F.asc(id_col))
    return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*GROUP, id_col, "score", "matched_queries", "rank")


def vector_hits(docs: DataFrame, queries: DataFrame, sample: int, id_col: str = "asset_id") -> DataFrame:
    """Best `sample` by cosine per query and bucket; docs (id, bucket, embedding) are filtered before, queries have query_id, vector.

    Queries are taken in blocks of bounded size, each broadcast as a matrix; a task multiplies it with its documents and
    gives its own best of each query and bucket, which a ranked window merges. Vectors without direction, and documents
    whose length differs from the query's, have no cosine.
    """
    good = with_direction(docs).select(id_col, "bucket", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = with_direction(queries, "vector").select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    q_kind, d_kind = (kinds[df.schema[c].dataType.simpleString()] for df, c in ((asked, "query_id"), (good, id_col)))
    out = f"query_id {asked.schema['query_id'].dataType.simpleString()}, bucket string, {id_col} {good.schema[id_col].dataType.simpleString()}, cos double"
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        held: dict[int, tuple[list, np.ndarray]] = {}
        for qid, v in zip(rows["query_id"].to_pylist(), rows["v"].to_pylist()):
            ids, vectors = held.setdefault(len(v), ([], []))
            ids.append(qid)
            vectors.append(np.array(v) / np.linalg.norm(v))
        shared = docs.sparkSession.sparkContext.broadcast({n: (ids, np.array(m)) for n, (ids, m) in held.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int, str], tuple[np.ndarray, list]] = {}
            for whole in batches:
                for i in range(0, whole.num_rows, 1024):
                    batch = whole.slice(i, 1024)
                    size = np.diff(batch["v"].offsets.to_numpy())
                    flat, edge = batch["v"].values.to_numpy(zero_copy_only=False), batch["v"].offsets.to_numpy()
                    ids, bucket = batch[id_col].to_pylist(), np.array(batch["bucket"].to_pylist(), object)
                    for n, (_, matrix) in shared.value.items():
                        for name in set(bucket[size == n].tolist()):
                            at = np.flatnonzero((size == n) & (bucket == name))
                            v = flat[(edge[at][:, None] + np.arange(n)).astype(np.int64)]
                            cos = matrix @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                            for k in range(len(matrix)):
                                old = best.get((n, k, name))
                                score = cos[k] if old is None else np.r_[old[0], cos[k]]
                                own = [ids[j] for j in at] if old is None else [*old[1], *(ids[j] for j in at)]
                                if len(own) > sample:  # all that tie with the last stay
                                    bar = np.partition(score, len(score) - sample)[len(score) - sample]
                                    keep = np.flatnonzero(score >= bar - 2 * 10.0**-DIGITS)
                                    score, own = score[keep], [own[j] for j in keep]
                                best[n, k, name] = score, own
            for (n, k, name), (score, own) in best.items():
                qid = shared.value[n][0][k]
                yield pa.record_batch([pa.array([qid] * len(own), q_kind), pa.array([name] * len(own)), pa.array(own, d_kind), pa.array(score)], names=["query_id", "bucket", id_col, "cos"])

        parts.append(good.mapInArrow(run, out))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("cos"), F.asc(id_col))
    return hits.withColumn("cos", F.round("cos", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)


def fuse(lex: DataFrame, knn: DataFrame, k: int, w_bm25: float = 0.5, w_knn: float = 0.5, id_col: str = "asset_id", carry: DataFrame | None = None) -> DataFrame:
    """Min-max each side within its group, add the weighted sides over a full outer join; only the first k vector hits take part.

    Columns of `carry` (id, ...: metadata, about, kwtext, rrtext) come along with the ids that are left.
    """
    a = lex.withColumn("a", N.min_max(F.col("score"), *GROUP)).select(*GROUP, id_col, "a", *[c for c in ("matched_queries",) if c in lex.columns])
    b = knn.where(F.col("rank") <= k).withColumn("b", N.min_max(F.col("cos"), *GROUP)).select(*GROUP, id_col, "b", "cos")
    both = a.join(b, [*GROUP, id_col], "full_outer")
    out = both.select(
        *GROUP,
        id_col,
        (w_bm25 * F.coalesce("a", F.lit(0.0)) + w_knn * F.coalesce("b", F.lit(0.0))).alias("similarity"),
        "cos",
        F.col("a").isNotNull().alias("lexical"),
        (F.col("matched_queries") if "matched_queries" in lex.columns else F.lit(None).cast("array<string>")).alias("matched_queries"),
    )
    return out if carry is None else out.join(carry, id_col, "left")


def fuse(lex: DataFrame, knn: DataFrame, k: int, w_bm25: float = 0.5, w_knn: float = 0.5, id_col: str = "asset_id") -> DataFrame:
    """Min-max each side within its group, add the weighted sides over a full outer join; only the first k vector hits take part."""
    a = lex.withColumn("a", N.min_max(F.col("score"), *GROUP)).select(*GROUP, id_col, "a", *[c for c in ("matched_queries",) if c in lex.columns])
    b = knn.where(F.col("rank") <= k).withColumn("b", N.min_max(F.col("cos"), *GROUP)).select(*GROUP, id_col, "b", "cos")
    both = a.join(b, [*GROUP, id_col], "full_outer")
    return both.select(
        *GROUP,
        id_col,
        (w_bm25 * F.coalesce("a", F.lit(0.0)) + w_knn * F.coalesce("b", F.lit(0.0))).alias("similarity"),
        "cos",
        F.col("a").isNotNull().alias("lexical"),
        (F.col("matched_queries") if "matched_queries" in lex.columns else F.lit(None).cast("array<string>")).alias("matched_queries"),
    )


def gate_signal(knn: DataFrame) -> DataFrame:
    """(query_id, bucket, top, baseline): best cosine, and the mean of the lower half of the sample (0 for fewer than two)."""
    w = Window.partitionBy(*GROUP)
    ranked = knn.withColumn("c", N.finite(F.col("cos"))).withColumn("i", F.row_number().over(w.orderBy("c", "rank"))).withColumn("m", F.count("*").over(w))
    half = F.when(F.col("i") <= F.floor(F.col("m") / 2), F.col("c"))
    return ranked.groupBy(*GROUP).agg(F.max("c").alias("top"), F.coalesce(F.avg(half), F.lit(0.0)).alias("baseline"))


def gate(signal: DataFrame, eps: float = 0.18, floor: float = 0.35) -> DataFrame:
    return signal.withColumn("passed", (F.col("top") - F.col("baseline") >= eps - N.EPS) & (F.col("top") >= floor - N.EPS))


def survives_cut(result_floor: float = 0.20) -> Column:
    return F.col("lexical") | (F.col("cos").isNotNull() & (F.col("cos") >= result_floor - N.EPS))


def evidence_score(matched: Column, strong_only: bool = False) -> Column:
    """Sum of the weights of observed names (repeats add again); the cross clause adds nothing beside a strong one."""
    names = F.coalesce(matched, F.array().cast("array<string>"))
    strong = F.exists(names, lambda n: n.isin(STRONG))
    weight = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])
    own = lambda n: F.when(F.lit(strong_only) & ~n.isin(STRONG), 0.0).when((n == "hit_cross_meta") & strong, 0.0).otherwise(F.coalesce(F.element_at(weight, n), F.lit(0.0)))
    return F.aggregate(names, F.lit(0.0), lambda s, n: s + own(n))


def rescue_reason(matched: Column, mode: str = "auto", enabled: bool = True) -> Column:
    """Why a lexical row is kept or dropped when the gate fails; reasons that begin with "dropped" drop."""
    if not enabled:
        return F.lit("legacy_lexical")
    bar, name = (RESCUE_KEYWORD, "evidence_keyword") if mode == "keyword" else (RESCUE_NORMAL, "evidence_normal")
    return F.when(matched.isNull(), "legacy_no_matched_queries").when(F.size(matched) == 0, "dropped_no_evidence").when(evidence_score(matched) >= bar, name).otherwise("dropped_weak")


def about_filter(rows: DataFrame, queries: DataFrame, max_ratio: float = 0.5) -> DataFrame:
    """Keep rows (with about, kwtext) that share an entity or a telling noun with the query; a group that would lose all rows keeps all.

    `queries` has query_id, query; its words are the nouns.
    """
    w = Window.partitionBy(*GROUP)
    q = queries.select("query_id", F.filter(F.split(T.squeeze(F.coalesce("query", F.lit(""))), " "), lambda x: x != "").alias("nouns"))
    own = rows.join(q, "query_id", "left").withColumn("kw", F.coalesce("kwtext", F.lit(""))).withColumn("key", F.monotonically_increasing_id())
    has = own.select(*GROUP, "key", F.explode(F.array_distinct(F.filter("nouns", lambda n: F.length(n) >= 2))).alias("noun"), "kw").withColumn("in", F.col("kw").contains(F.col("noun")))
    usable = has.groupBy(*GROUP, "noun").agg((F.sum(F.col("in").cast("int")) / F.count("*")).alias("ratio")).where(F.col("ratio") <= max_ratio)
    usable = usable.groupBy(*GROUP).agg(F.collect_set("noun").alias("usable"))
    met = own.join(usable, GROUP, "left")
    about = F.coalesce("about", F.array().cast("array<string>"))
    entity = F.exists("nouns", lambda n: F.exists(about, lambda a: (n == a) | ((F.length(n) >= 2) & a.contains(n)) | ((F.length(a) >= 2) & n.contains(a))))
    word = F.exists(F.coalesce("usable", F.array().cast("array<string>")), lambda n: F.col("kw").contains(n))
    observed = F.max(F.col("about").isNotNull() | F.col("kwtext").isNotNull()).over(w)
    keep = F.coalesce(entity | word, F.lit(False)) | ~observed | (F.size("nouns") == 0) | F.col("nouns").isNull()
    return met.withColumn("keep", keep).withColumn("any", F.max("keep").over(w)).where("keep or not any").select(*rows.columns)


def rerank(rows: DataFrame, top_r: int = 10, tau: float = 0.0, id_col: str = "asset_id") -> DataFrame:
    """Reorder the first `top_r` rows of each group by rerank_score; the i-th best fused score goes to the i-th row of the new order.

    With tau > 0 rows of the head below it are dropped. The tail stays as it is.
    """
    w = Window.partitionBy(*GROUP)
    ranked = rows.withColumn("i", F.row_number().over(w.orderBy(F.desc("similarity"), F.asc(id_col))))
    head = ranked.where(F.col("i") <= top_r)
    if tau > 0:
        head = head.where(F.col("rerank_score") >= tau)
    moved = head.withColumn("j", F.row_number().over(w.orderBy(F.desc(N.finite(F.col("rerank_score"))), F.asc(id_col)))).drop("similarity", "i")
    slots = head.withColumn("j", F.row_number().over(w.orderBy("i"))).select(*GROUP, "j", "similarity")
    tail = ranked.where(F.col("i") > top_r).withColumn("pos", F.col("i")).drop("i")
    return moved.join(slots, [*GROUP, "j"]).withColumn("pos", F.col("j")).drop("j").unionByName(tail)


@dataclass(frozen=True)
class Policy:
    """The functions that decide within a bucket; replace one to try another rule."""

    passes: Callable[[DataFrame, float, float], DataFrame] = gate
    cut: Callable[[float], Column] = survives_cut
    rescue: Callable[[Column, str, bool], Column] = rescue_reason
    reorder: Callable[[DataFrame, int, float, str], DataFrame] = rerank


def bucket_policy(fused: DataFrame, signal: DataFrame, k: int, tuning: Tuning = Tuning(), mode: str = "auto", queries: DataFrame | None = None, id_col: str = "asset_id", policy: Policy = Policy()) -> DataFrame:
    """Gate, cut, lexical rescue, evidence filter and limit of every group, with gate_passed, keep_reason, rank and cut_count.

    Order: without cutoff all rows pass; a passed gate cuts rows (and reranks, by the column rerank_score); a failed one keeps lexical rows
    with evidence if the operator is "and", else none. cut_count is what gate, cut, rerank, rescue and filter took from the group, the
    limit left out. A switch whose columns are missing is an error.
    """
    if tuning.rerank_enabled and "rerank_score" not in fused.columns:
        raise ValueError("reranking needs a column rerank_score")
    if tuning.about_filter_enabled and (queries is None or not {"about", "kwtext"} <= set(fused.columns)):
        raise ValueError("the evidence filter needs queries and the columns about and kwtext")
    gated = fused.join(policy.passes(signal, tuning.cutoff_eps, tuning.cutoff_floor).select(*GROUP, "passed"), GROUP, "left").withColumn("gate_passed", F.lit(not tuning.cutoff_enabled) | F.coalesce("passed", F.lit(False))).drop("passed")
    gated = gated.withColumn("fused_count", F.count("*").over(Window.partitionBy(*GROUP)))
    reason = policy.rescue(F.col("matched_queries"), mode, tuning.evidence_rescue_enabled)
    rescue = F.when(F.lit(tuning.bm25_operator == "and") & F.col("lexical"), reason)
    own = gated.withColumn("keep_reason", F.when(F.lit(not tuning.cutoff_enabled), "gate_passed").when(F.col("gate_passed"), F.when(policy.cut(tuning.result_floor), "gate_passed")).otherwise(rescue))
    kept = own.where(F.col("keep_reason").isNotNull() & ~F.startswith(F.col("keep_reason"), F.lit("dropped")))
    if tuning.rerank_enabled and tuning.cutoff_enabled:
        passed = policy.reorder(kept.where("gate_passed"), tuning.rerank_top_r, tuning.rerank_tau, id_col)
        kept = passed.unionByName(kept.where("not gate_passed").withColumn("pos", F.lit(None).cast("int")))
    if tuning.about_filter_enabled:
        kept = about_filter(kept, queries, tuning.about_max_ratio)
    order = [F.asc_nulls_last("pos")] if "pos" in kept.columns else []
    w = Window.partitionBy(*GROUP)
    kept = kept.withColumn("cut_count", F.col("fused_count") - F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order, F.desc("similarity"), F.asc(id_col))))
    return kept.where(F.col("rank") <= k).drop("pos", "rerank_score", "about", "kwtext", "rrtext", "fused_count")


def gate_report(fused: DataFrame, signal: DataFrame, kept: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """(query_id, bucket, top, baseline, gate_passed, lexical_evidence, cut_count, error): one row a group that had any hit; error is false, since a failed part fails the job."""
    n = fused.groupBy(*GROUP).agg(F.count("*").alias("n"), F.max("lexical").alias("lexical_evidence"))
    cut = kept.groupBy(*GROUP).agg(F.max("cut_count").alias("cut"))
    own = n.join(gate(signal, tuning.cutoff_eps, tuning.cutoff_floor), GROUP, "full_outer").join(cut, GROUP, "left")
    return own.select(*GROUP, F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("baseline", F.lit(0.0)).alias("baseline"), (F.lit(not tuning.cutoff_enabled) | F.coalesce("passed", F.lit(False))).alias("gate_passed"), F.coalesce("lexical_evidence", F.lit(False)).alias("lexical_evidence"), F.coalesce("cut", "n", F.lit(0)).alias("cut_count"), F.lit(False).alias("error"))


def normalise_query(tagged: DataFrame) -> DataFrame:
    """(query_id, query) from queries with `tokens` array<struct<token, pos>>: nouns of queries of three words or more, else the raw query."""
    nouns = F.array_distinct(F.transform(F.filter("tokens", lambda t: t["pos"].isin(NOUN_TAGS) & ~t["token"].isin(STOP_NOUNS)), lambda t: t["token"]))
    raw = F.col("query")
    return tagged.select("query_id", F.when(F.size(F.split(T.squeeze(raw), " ")) < 3, raw).otherwise(F.coalesce(T.blank_to_null(F.array_join(nouns, " ")), raw)).alias("query"))


def merged_ranking(rows: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """One ranking a query over all buckets: the best row of each id."""
    w = Window.partitionBy("query_id")
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("query_id", id_col).orderBy(F.desc("similarity"), F.asc("bucket")))).where("i = 1").drop("i")
    return first.withColumn("rank", F.row_number().over(w.orderBy(F.desc("similarity"), F.asc(id_col))))


def verified(rows: DataFrame, verdicts: DataFrame, top_n: int = 3, id_col: str = "asset_id") -> DataFrame:
    """Drop, from every bucket, ids of the merged top `top_n` that `verdicts` (query_id, id, keep) rejects; a query without a full set of verdicts is left alone."""
    top = merged_ranking(rows, id_col).where(F.col("rank") <= top_n).select("query_id", id_col)
    judged = top.join(verdicts, ["query_id", id_col], "left").withColumn("full", F.min(F.col("keep").isNotNull()).over(Window.partitionBy("query_id")))
    return rows.join(judged.where("full and not keep").select("query_id", id_col), ["query_id", id_col], "left_anti")


def rerank_texts(docs: DataFrame, ids: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """(id, rrtext): the text that a reranker reads, of the wanted ids alone."""
    return docs.join(ids.select(id_col).distinct(), id_col, "left_semi").select(id_col, T.rerank_text(F.col("summary"), F.col("keywords")).alias("rrtext"))


def search_hybrid(
    docs: DataFrame,
    queries: DataFrame,
    modalities: list[str],
    k: int = 20,
    tuning: Tuning = Tuning(),
    filters: Filters | None = None,
    mode: str = "auto",
    exclude_medical: bool = False,
    normalise: Callable[[DataFrame], DataFrame] | None = None,
    rerank_fn: Callable[[Column, Column], Column] | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    policy: Policy = Policy(),
) -> tuple[DataFrame, DataFrame]:
    """The whole read path: (rows, one row of gate figures a group).

    docs: asset_id, modality, keywords, labels, file_name, summary, embedding, perhaps about, kwtext, domain_label and columns that
    `filters` names; queries: query_id, query, vector. `normalise` gets (query_id, query) and gives what the lexical side, the reranker and
    the filter read. `rerank_fn` scores (query, text) where tuning says so. `judge` gets the rows of each query's first three and gives
    (query_id, asset_id, keep); it is asked for queries of three words or more.
    """
    unknown = [m for m in modalities if m not in MODALITIES]
    if unknown:
        raise ValueError(f"unknown modality: {unknown}")
    if tuning.rerank_enabled and rerank_fn is None:
        raise ValueError("reranking needs a function")
    own = docs.where(filters.column()) if filters else docs
    own = buckets(own.where("domain_label is null or domain_label <> 'medical'") if exclude_medical else own, modalities)
    asked = queries if normalise is None else normalise(queries.select("query_id", "query")).join(queries.drop("query"), "query_id")
    lex = written(lexical(own, asked, k, tuning.bm25_operator), "lexical")
    knn = written(vector_hits(own.select("asset_id", "bucket", "embedding"), asked, max(k, SAMPLE)), "vector-hits")
    fused = fuse(lex, knn, k, tuning.weight_bm25, tuning.weight_knn)
    if tuning.about_filter_enabled:
        fused = fused.join(own.select("asset_id", "about", "kwtext"), "asset_id", "left")
    if tuning.rerank_enabled:
        fused = fused.join(rerank_texts(own, fused), "asset_id", "left").join(asked.select("query_id", "query"), "query_id").withColumn("rerank_score", rerank_fn(F.col("query"), F.col("rrtext"))).drop("query")
    fused = written(fused, "fused")
    signal = gate_signal(knn)
    rows = bucket_policy(fused, signal, k, tuning, mode, asked.select("query_id", "query"), policy=policy)
    meta = gate_report(fused, signal, rows, tuning)
    if judge is not None:
        long_ = queries.where(F.size(F.split(T.squeeze(F.col("query")), " ")) >= 3).select("query_id")
        rows = written(rows, "unverified")
        rows = verified(rows, judge(merged_ranking(rows).where("rank <= 3").join(long_, "query_id", "left_semi")))
    return rows, meta

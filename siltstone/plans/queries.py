"""Queries over the test tables, one or more for each operator family, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import documents as D
from ..operators import metrics as M
from ..operators import relations as R
from ..operators import search as S
from ..operators import topics as P
from ..operators import vectors as V
from ..sources import tables as X
from ..sources.tables import with_views
from ..streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _golden(spark, d):
    """Pairs of documents that share source and language, next to each other."""
    docs = X.load(spark, d, "documents")
    return docs.where("doc_id % 40 < 20").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b"), F.lit("x").alias("kind"))


# --- retrieval -------------------------------------------------------------------------------------------------

_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_BM25 = f"""
docs AS (SELECT doc_id, {_TOK} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM docs WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), nq AS (SELECT query_id, count(*) AS n_terms FROM q GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS hits
       FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY 1, 2)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS r FROM sc) WHERE r <= 10")
def bm25_or(spark, d):
    """BM25 over all documents for every benchmark item, best ten."""
    got = _bm25(spark, d, "or").withColumn("score", F.round("score", 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return got.withColumn("r", F.row_number().over(w)).where("r <= 10").select("query_id", "doc_id", "score")


def _bm25(spark, d, operator):
    docs = X.load(spark, d, "documents")
    terms = S.query_terms(X.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))
    return S.bm25(S.stored_postings(docs, "text", terms, "doc_id"), S.field_stats(docs, "text", "doc_id"), terms, operator, "doc_id")


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 5) AS score FROM sc JOIN nq USING (query_id) WHERE hits = n_terms")
def bm25_and(spark, d):
    return _bm25(spark, d, "and").select("query_id", "doc_id", F.round("score", 5).alias("score"))


def _sides(spark, d):
    """Lexical and vector scores made of orders: 40 customers as queries, parts of their lines as hits."""
    lines = X.load(spark, d, "lineitem")
    rows = lines.select((F.col("l_suppkey") % 40).alias("query_id"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("bucket"), F.col("l_partkey").alias("asset_id"), "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    agg = rows.groupBy("query_id", "bucket", "asset_id").agg(F.max("l_extendedprice").alias("x"), F.max("l_discount").alias("c"), F.min("l_tax").alias("t"), F.max("l_linenumber").alias("l"))
    lex = agg.where("l >= 4").select(*S.GROUP, "asset_id", F.col("x").alias("score"), F.when(F.col("l") == 4, F.array(F.lit("hit_summary"))).when(F.col("l") == 5, F.array(F.lit("hit_keywords"), F.lit("hit_cross_meta"))).when(F.col("l") == 6, F.array().cast("array<string>")).alias("matched_queries"))
    cos = agg.where("l <= 5").select(*S.GROUP, "asset_id", F.round(0.2 + F.col("c") * 4 + F.col("t"), 4).alias("cos"))
    w = Window.partitionBy(*S.GROUP).orderBy(F.desc("cos"), "asset_id")
    return lex, cos.withColumn("rank", F.row_number().over(w)).where("rank <= 50")


_SIDES = """
agg AS (SELECT l_suppkey % 40 AS query_id, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'text' END AS bucket, l_partkey AS asset_id, max(l_extendedprice) AS x, max(l_discount) AS c, min(l_tax) AS t, max(l_linenumber) AS l FROM lineitem GROUP BY 1, 2, 3),
lex AS (SELECT query_id, bucket, asset_id, x AS score, CASE l WHEN 4 THEN 'S' WHEN 5 THEN 'KX' WHEN 6 THEN '' END AS mq FROM agg WHERE l >= 4),
knn AS (SELECT * FROM (SELECT query_id, bucket, asset_id, round(0.2 + c * 4 + t, 4) AS cos, row_number() OVER (PARTITION BY query_id, bucket ORDER BY round(0.2 + c * 4 + t, 4) DESC, asset_id) AS rank FROM agg WHERE l <= 5) WHERE rank <= 50),
na AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS a FROM lex WINDOW w AS (PARTITION BY query_id, bucket)),
nb AS (SELECT *, CASE WHEN max(cos) OVER w = min(cos) OVER w THEN 1.0 ELSE (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) END AS b FROM knn WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id, bucket)),
fused AS (SELECT query_id, bucket, asset_id, 0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0) AS similarity, cos, a IS NOT NULL AS lexical, mq FROM na FULL JOIN nb USING (query_id, bucket, asset_id)),
sig AS (SELECT query_id, bucket, max(cos) AS top, coalesce(avg(CASE WHEN i <= m // 2 THEN cos END), 0) AS baseline FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY cos, rank) AS i, count(*) OVER (PARTITION BY query_id, bucket) AS m FROM knn) GROUP BY 1, 2)"""


@query(f"WITH {_SIDES} SELECT query_id, bucket, asset_id, round(similarity, 6) AS similarity, cos, lexical FROM fused")
def hybrid_fuse(spark, d):
    lex, knn = _sides(spark, d)
    return S.fuse(lex, knn, 20).select(*S.GROUP, "asset_id", F.round("similarity", 6).alias("similarity"), "cos", "lexical")


@query(f"WITH {_SIDES} SELECT query_id, bucket, round(top, 6) AS top, round(baseline, 6) AS baseline, top - baseline >= 0.18 - 1e-9 AND top >= 0.35 - 1e-9 AS passed FROM sig")
def hybrid_gate(spark, d):
    return S.gate(S.gate_signal(_sides(spark, d)[1])).select(*S.GROUP, F.round("top", 6).alias("top"), F.round("baseline", 6).alias("baseline"), "passed")


@query(
    f"""WITH {_SIDES}, g AS (SELECT f.*, coalesce(top - baseline >= 0.3 - 1e-9 AND top >= 0.55 - 1e-9, false) AS gp FROM fused f LEFT JOIN sig USING (query_id, bucket)),
k AS (SELECT *, CASE WHEN gp THEN CASE WHEN lexical OR (cos IS NOT NULL AND cos >= 0.3 - 1e-9) THEN 'gate_passed' END
      WHEN lexical THEN CASE WHEN mq IS NULL THEN 'legacy_no_matched_queries' WHEN mq = 'KX' THEN 'evidence_normal' END END AS keep_reason FROM g)
SELECT query_id, bucket, asset_id, gp AS gate_passed, keep_reason, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY round(similarity, 9) DESC, asset_id) AS rank FROM k WHERE keep_reason IS NOT NULL) WHERE rank <= 10"""
)
def bucket_policy(spark, d):
    """Gate, cut and lexical rescue of every bucket (a higher gate than the default, so that both branches occur)."""
    lex, knn = _sides(spark, d)
    fused = S.fuse(lex, knn, 20).withColumn("similarity", F.round("similarity", 9))
    out = S.bucket_policy(fused, S.gate_signal(knn), 10, S.Tuning(cutoff_eps=0.3, cutoff_floor=0.55, result_floor=0.3))
    return out.select(*S.GROUP, "asset_id", "gate_passed", "keep_reason", "rank")


@query(
    f"""WITH {_SIDES}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY round(similarity, 9) DESC, asset_id) AS i, (asset_id * 7) % 101 / 101.0 AS rs FROM fused),
a AS (SELECT query_id, bucket, asset_id, row_number() OVER (PARTITION BY query_id, bucket ORDER BY rs DESC, asset_id) AS j FROM h WHERE i <= 10)
SELECT a.query_id, a.bucket, a.asset_id, CAST(a.j AS INTEGER) AS pos, round(s.similarity, 9) AS similarity FROM a JOIN h s ON s.query_id = a.query_id AND s.bucket = a.bucket AND s.i = a.j
UNION ALL SELECT query_id, bucket, asset_id, CAST(i AS INTEGER), round(similarity, 9) FROM h WHERE i > 10"""
)
def rerank_slots(spark, d):
    lex, knn = _sides(spark, d)
    fused = S.fuse(lex, knn, 20).withColumn("similarity", F.round("similarity", 9)).withColumn("rerank_score", (F.col("asset_id") * 7) % 101 / 101.0)
    return S.rerank(fused, 10).select(*S.GROUP, "asset_id", "pos", "similarity")


@query(
    f"""WITH {_SIDES}, one AS (SELECT *, row_number() OVER (PARTITION BY query_id, asset_id ORDER BY round(similarity, 9) DESC, bucket) AS i FROM fused)
SELECT query_id, asset_id, bucket, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, asset_id) AS rank FROM one WHERE i = 1) WHERE rank <= 20"""
)
def merged_ranking(spark, d):
    lex, knn = _sides(spark, d)
    return S.merged_ranking(S.fuse(lex, knn, 20).withColumn("similarity", F.round("similarity", 9))).where("rank <= 20").select("query_id", "asset_id", "bucket", "rank")


@query(f"WITH {_SIDES} SELECT query_id, bucket, asset_id, CAST(CASE mq WHEN 'S' THEN 0.7 WHEN 'KX' THEN 3.0 ELSE 0.0 END AS DOUBLE) AS evidence, CAST(CASE mq WHEN 'KX' THEN 3.0 ELSE 0.0 END AS DOUBLE) AS strong_evidence FROM lex")
def evidence_scores(spark, d):
    mq = F.col("matched_queries")
    return _sides(spark, d)[0].select(*S.GROUP, "asset_id", S.evidence_score(mq).alias("evidence"), S.evidence_score(mq, strong_only=True).alias("strong_evidence"))


@query(with_views("SELECT asset_id, modality FROM asset WHERE modality IN ('text', 'image') AND created_at >= DATE '2024-03-01' AND created_at <= DATE '2024-06-30' AND regexp_extract(fs_path, '[.]([^.]+)$', 1) = 'txt'", "asset"))
def asset_filters(spark, d):
    from datetime import date

    own = X.assets(spark, d).withColumn("file_ext", T.extension(F.col("fs_path")))
    return S.buckets(own.where(S.Filters(("txt",), date(2024, 3, 1), date(2024, 6, 30)).column()), ["text", "image"]).select("asset_id", "modality")


# --- vectors ---------------------------------------------------------------------------------------------------


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2")
def mean_vectors(spark, d):
    m = V.mean_vector(X.load(spark, d, "embeddings"), ["label"])
    return m.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("mean"))


_SIMILAR = """, p AS (SELECT s.asset_id AS source, t.asset_id AS target, s.channel, list_dot_product(s.v, t.v) / sqrt(list_dot_product(s.v, s.v) * list_dot_product(t.v, t.v)) AS sim FROM emb s JOIN emb t ON s.channel = t.channel AND s.asset_id <> t.asset_id),
b AS (SELECT source, target, round(max(sim), 6) AS sim FROM p GROUP BY 1, 2 HAVING round(max(sim), 6) >= 0.2)
SELECT source, target, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM b) WHERE rank <= 10"""


@query(with_views(_SIMILAR, "emb"))
def similarity_candidates(spark, d):
    """Best chunk similarity within a channel for every asset."""
    e = X.asset_embeddings(spark, d)
    return V.similarity_candidates(e, e.select("asset_id"), 10, 0.2)


@query("SELECT vec_id, round(cos, 6) AS cos FROM (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q)) AS cos FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3) WHERE label <> 1) ORDER BY cos DESC, vec_id LIMIT 25")
def nearest_vectors(spark, d):
    e = X.load(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 3").first()["embedding"]])
    return V.nearest(e, q, 25, F.col("label") != 1, "vec_id").select("vec_id", F.round("cos", 6).alias("cos"))


# --- relation graph --------------------------------------------------------------------------------------------

_PATHS = """, p AS (SELECT asset_id, regexp_replace(fs_path, '/[^/]*$', '') AS dir, lower(regexp_replace(regexp_replace(fs_path, '^.*/', ''), '[.][^.]*$', '')) AS raw FROM asset), s AS (SELECT *, regexp_replace(raw, '(_v[0-9]+|_summary)$', '') AS base FROM p),
m AS (SELECT a.asset_id AS source, b.asset_id AS target, max(CASE WHEN a.raw = b.raw THEN 2 ELSE 1 END) AS rank_score FROM s a JOIN s b ON a.dir = b.dir AND (a.raw = b.raw OR a.base = b.base) AND a.asset_id <> b.asset_id GROUP BY 1, 2)"""


@query(with_views(_PATHS + " SELECT source, target, rank_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, target) AS rank FROM m) WHERE rank <= 5", "asset"))
def path_candidates(spark, d):
    return R.path_candidates(X.assets(spark, d), 5)


@query(
    with_views(
        _PATHS
        + """, pc AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY rank_score DESC, target) AS rank FROM m),
pp AS (SELECT s.asset_id AS source, t.asset_id AS target, list_dot_product(s.v, t.v) / sqrt(list_dot_product(s.v, s.v) * list_dot_product(t.v, t.v)) AS sim FROM emb s JOIN emb t ON s.channel = t.channel AND s.asset_id <> t.asset_id),
eb AS (SELECT source, target, round(max(sim), 6) AS sim FROM pp GROUP BY 1, 2 HAVING round(max(sim), 6) >= 0.2), ec AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM eb),
u AS (SELECT source, target, sim, rank, 0 AS side FROM ec WHERE rank <= 10 UNION ALL SELECT source, target, 0.0, rank, 1 FROM pc WHERE rank <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY side, rank) AS i FROM u)
SELECT source, target, sim, side, CAST(row_number() OVER (PARTITION BY source ORDER BY side, rank) AS INTEGER) AS position FROM f WHERE i = 1""",
        "asset",
        "emb",
    )
)
def candidate_union(spark, d):
    return R.union_candidates(similarity_candidates(spark, d), R.path_candidates(X.assets(spark, d), 5))


def _incoming(spark, d):
    """A batch with repeated keys: one row a line item."""
    lines = X.load(spark, d, "lineitem")
    return lines.select(
        F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("kind_code"), F.when(F.col("l_quantity") > 45, None).otherwise(F.round(F.col("l_tax") * 12, 2)).alias("confidence"),
        F.col("l_linestatus").alias("reason"), F.concat(F.lit("t"), "l_linenumber").alias("topic"), F.lit("proposed").alias("status"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def _existing(spark, d):
    return X.graph_edges(spark, d).where("kind_code <> 'N'").select(*R.KEY, "confidence", F.lit("old").alias("reason"), F.lit("old").alias("topic"), "status")


_MERGE = """, inc AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS kind_code, CASE WHEN l_quantity > 45 THEN NULL ELSE round(l_tax * 12, 2) END AS confidence, l_linestatus AS reason, 't' || l_linenumber AS topic, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY src, dst, kind_code ORDER BY coalesce(confidence, 0) DESC, seq, reason DESC, topic DESC) AS i, count(*) OVER (PARTITION BY src, dst, kind_code) AS c FROM inc),
n AS (SELECT src, dst, kind_code, CASE WHEN c = 1 THEN confidence ELSE coalesce(confidence, 0) END AS confidence, reason, topic FROM rk WHERE i = 1),
o AS (SELECT src, dst, kind_code, confidence, 'old' AS reason, 'old' AS topic, status FROM edge WHERE kind_code <> 'N')
SELECT src, dst, kind_code, CASE WHEN o.status IS NULL THEN n.confidence WHEN n.reason IS NULL THEN o.confidence ELSE greatest(coalesce(o.confidence, 0), coalesce(n.confidence, 0)) END AS confidence,
 CASE WHEN o.status IS NULL OR coalesce(n.confidence, 0) > coalesce(o.confidence, 0) THEN n.reason ELSE o.reason END AS reason, CASE WHEN o.status IS NULL OR coalesce(n.confidence, 0) > coalesce(o.confidence, 0) THEN n.topic ELSE o.topic END AS topic,
 coalesce(o.status, 'proposed') AS status FROM o FULL JOIN n USING (src, dst, kind_code)"""


@query(with_views(_MERGE, "edge"))
def edge_upsert(spark, d):
    return R.merge_edges(_existing(spark, d), _incoming(spark, d))


@query(with_views("SELECT CASE WHEN is_symmetric AND dst < src THEN dst ELSE src END AS src, CASE WHEN is_symmetric AND dst < src THEN src ELSE dst END AS dst, kind_code FROM (SELECT dst AS src, src AS dst, kind_code, is_symmetric FROM edge)", "edge"))
def canonical_edges(spark, d):
    return R.canonical(X.graph_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind_code", "is_symmetric")).select(*R.KEY)


_TIER = "CASE WHEN status = 'active' THEN 'strong' WHEN status = 'proposed' AND (kind_code <> 'same_domain' OR confidence >= 0.7) THEN 'weak' END"
_NEAR = f""", t AS (SELECT * FROM (SELECT src, dst, is_symmetric, CASE kind_code WHEN 'A' THEN 'same_domain' ELSE kind_code END AS kind_code, confidence, status FROM edge)), u AS (SELECT *, {_TIER} AS tier FROM t WHERE status IN ('active', 'proposed')),
b AS (SELECT src AS asset, dst AS other, CASE WHEN is_symmetric THEN 'undirected' ELSE 'outbound' END AS direction, kind_code, confidence, tier FROM u WHERE tier IS NOT NULL UNION ALL SELECT dst, src, CASE WHEN is_symmetric THEN 'undirected' ELSE 'inbound' END, kind_code, confidence, tier FROM u WHERE tier IS NOT NULL)
SELECT asset, other, direction, kind_code, confidence, tier, CAST(row_number() OVER (PARTITION BY asset ORDER BY CASE tier WHEN 'strong' THEN 0 ELSE 1 END, confidence DESC NULLS LAST, other, kind_code) AS INTEGER) AS position FROM b"""


@query(with_views(_NEAR, "edge"))
def neighbours(spark, d):
    """All neighbours of all nodes in both directions, with exposure tiers."""
    e = X.graph_edges(spark, d).withColumn("kind_code", F.when(F.col("kind_code") == "A", "same_domain").otherwise(F.col("kind_code")))
    none = spark.createDataFrame([], "asset_id string, modality string, fs_path string")
    return R.neighbours(e, none, include_weak=True).select("asset", "other", "direction", "kind_code", "confidence", "tier", "position")


@query(with_views("SELECT src, dst, kind_code, CASE WHEN kind_code <> 'A' AND confidence >= 0.9 THEN 'active' ELSE 'proposed' END AS decided, kind_code NOT IN ('N') OR confidence >= 0.7 AS keeps FROM (SELECT src, dst, kind_code, confidence FROM edge)", "edge"))
def edge_policies(spark, d):
    e = X.graph_edges(spark, d)
    kind = F.when(F.col("kind_code") == "N", "same_domain").otherwise(F.col("kind_code"))
    return e.select(*R.KEY, R.decide_status(F.col("kind_code"), F.col("confidence"), ["A"], 0.9).alias("decided"), R.should_persist(kind, F.col("confidence")).alias("keeps"))


@query(with_views("SELECT edge_id, kind_code, confidence FROM (SELECT src || ':' || dst || ':' || kind_code AS edge_id, * FROM edge) WHERE status = 'proposed' AND contains(lower(edge_id), 'p1') AND kind_code <> 'A' AND confidence >= 0.2 AND reviewed_at >= TIMESTAMP '1995-01-01' AND reviewed_at < TIMESTAMP '1998-01-01' ORDER BY confidence DESC NULLS LAST, edge_id LIMIT 40 OFFSET 20", "edge"))
def review_page(spark, d):
    from datetime import datetime

    e = X.graph_edges(spark, d).withColumn("edge_id", F.concat_ws(":", *R.KEY))
    e = e.select("*", *[F.lit(None).cast("string").alias(c) for c in ("src_path", "dst_path", "reason", "topic_ko", "topic_en")]).withColumns({"src": F.lit(""), "dst": F.lit("")})
    where = R.review_filter(q="P1", exempt=["A"], conf_min=0.2, since=datetime(1995, 1, 1), until=datetime(1998, 1, 1), date_col="reviewed_at")
    return R.review_page(e, where, 20, 40)[1].select("edge_id", "kind_code", "confidence")


@query(with_views("SELECT kind_code, status, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.5) AS sure, count(DISTINCT src) AS parts FROM edge GROUP BY 1, 2", "edge"))
def edge_counts(spark, d):
    return X.graph_edges(spark, d).groupBy("kind_code", "status").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.5).alias("sure"), F.countDistinct("src").alias("parts"))


@query(with_views("SELECT count(DISTINCT a) AS n_assets FROM (SELECT src AS a FROM edge UNION ALL SELECT dst FROM edge)", "edge"))
def linked_assets(spark, d):
    return M.linked_assets(X.graph_edges(spark, d))


@query(
    with_views(
        """, k AS (SELECT * FROM edge), p AS (SELECT CASE WHEN is_symmetric THEN least(src, dst) ELSE src END AS a, CASE WHEN is_symmetric THEN greatest(src, dst) ELSE dst END AS b, kind_code FROM k)
SELECT 'self_edge' AS invariant, count(*) AS violations FROM k WHERE src = dst UNION ALL SELECT 'unknown_kind', 0 UNION ALL SELECT 'inactive_kind', count(*) FROM k WHERE kind_code = 'N' UNION ALL
SELECT 'not_canonical', count(*) FROM k WHERE is_symmetric AND dst < src UNION ALL SELECT 'bad_status', 0 UNION ALL SELECT 'bad_confidence', count(*) FROM k WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT 'below_floor', 0 UNION ALL
SELECT 'duplicate_pair', (SELECT count(*) FROM (SELECT a, b, kind_code FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1)) UNION ALL SELECT 'dangling_node', (SELECT count(*) FROM (SELECT src AS x FROM k UNION ALL SELECT dst FROM k) WHERE substr(x, 1, 1) = 's')""",
        "edge",
    )
)
def invariants(spark, d):
    e = X.graph_edges(spark, d)
    kinds = spark.createDataFrame([("A", True, "active"), ("N", True, "inactive"), ("R", False, "active")], "kind_code string, is_symmetric boolean, status string")
    return R.invariants(e.drop("is_symmetric"), e.select(F.col("src").alias("node")).distinct(), kinds)


@query(
    """WITH q AS (SELECT user_id AS asset_id, count(*) AS attempts, max(event_type) AS last FROM events GROUP BY 1), r AS (SELECT o_custkey AS asset_id, CASE WHEN max(o_orderstatus) = 'P' THEN 'failed run' END AS error, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1)
SELECT asset_id, CASE WHEN r.n IS NULL THEN 'pending' WHEN error IS NULL THEN CASE WHEN n > 0 THEN 'resolved' ELSE 'isolated' END WHEN coalesce(attempts % 4, 0) + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
CAST(CASE WHEN r.n IS NULL OR error IS NULL THEN coalesce(attempts % 4, 0) ELSE coalesce(attempts % 4, 0) + 1 END AS INTEGER) AS attempts FROM q FULL JOIN r USING (asset_id)"""
)
def retry_queue(spark, d):
    queue = X.load(spark, d, "events").groupBy(F.col("user_id").alias("asset_id")).agg((F.count("*") % 4).cast("int").alias("attempts")).withColumns({"status": F.lit("pending"), "last_reason": F.lit(None).cast("string")})
    runs = X.load(spark, d, "orders").groupBy(F.col("o_custkey").alias("asset_id")).agg(F.when(F.max("o_orderstatus") == "P", "failed run").alias("error"), F.count_if(F.col("o_orderstatus") == "F").alias("n_edges"))
    return R.upsert_resolution(queue, runs).select("asset_id", "status", F.col("attempts").cast("int").alias("attempts"))


@query(with_views("SELECT asset_id, created_at FROM asset WHERE status = 'registered' AND asset_id IN (SELECT asset_id FROM emb) AND asset_id % 3 <> 0", "asset", "emb"))
def unresolved_assets(spark, d):
    a = X.assets(spark, d)
    queue = a.where("asset_id % 3 < 2").select("asset_id", F.when(F.col("asset_id") % 3 == 0, "resolved").otherwise("pending").alias("status"), F.lit(1).alias("attempts"))
    return R.unresolved(a, X.asset_embeddings(spark, d), queue).select("asset_id", "created_at")


# --- topics ----------------------------------------------------------------------------------------------------


@query(with_views("SELECT topic, nullif(subtopic, '') AS subtopic, count(DISTINCT asset_id) AS n_assets, max(t.n) AS topic_assets FROM topic JOIN (SELECT topic, count(DISTINCT asset_id) AS n FROM topic GROUP BY 1) t USING (topic) GROUP BY 1, 2", "topic"))
def topic_facets(spark, d):
    return P.facets(X.asset_topics(spark, d))


@query(with_views("SELECT modality, count(*) AS n FROM asset WHERE status = 'registered' AND asset_id NOT IN (SELECT asset_id FROM topic) GROUP BY 1", "asset", "topic"))
def unclassified_counts(spark, d):
    return P.unclassified(X.asset_topics(spark, d), X.assets(spark, d))[0]


@query(with_views("SELECT asset_id, modality, subtopic FROM asset JOIN topic USING (asset_id) WHERE topic = 'en' AND subtopic = 'src3' AND modality = 'text' ORDER BY asset_id LIMIT 10 OFFSET 2", "asset", "topic"))
def topic_assets(spark, d):
    return P.topic_assets(X.asset_topics(spark, d), X.assets(spark, d), "en", "src3", modality="text", offset=2, limit=10)[1].select("asset_id", "modality", "subtopic")


@query(
    with_views(
        """, o AS (SELECT asset_id, topic, nullif(subtopic, '') AS subtopic FROM topic), m AS (SELECT s.asset_id AS source, topic, o.subtopic, o.asset_id AS asset FROM o s JOIN o USING (topic) WHERE s.asset_id <> o.asset_id),
n AS (SELECT source, topic, subtopic, count(*) AS n FROM m GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY subtopic IS NULL, n DESC, subtopic) AS sub_rank FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY source, topic, subtopic ORDER BY asset) AS position FROM m)
SELECT r.source, r.topic, r.subtopic, k.n, r.asset, CAST(r.position AS INTEGER) AS position, abs(r.asset - r.source) = 20 AS already_linked FROM r JOIN k ON k.source = r.source AND k.topic = r.topic AND k.subtopic IS NOT DISTINCT FROM r.subtopic WHERE sub_rank <= 12 AND position <= 8""",
        "topic",
    )
)
def same_topic_groups(spark, d):
    """The groups of all assets that have a topic."""
    t = X.asset_topics(spark, d)
    edges = t.select(F.col("asset_id").alias("src"), (F.col("asset_id") + 20).alias("dst"))
    return P.same_topic_groups(t, t, edges).select("source", "topic", "subtopic", "n", "asset", "position", "already_linked")


@query("SELECT doc_id, topic, CASE WHEN topic IN ('en', 'de') THEN topic WHEN topic = 'fr' THEN 'de' ELSE '미분류' END AS canonical, CASE WHEN topic IN ('en', 'de') THEN 'exact' WHEN topic = 'fr' THEN 'alias' ELSE 'classified' END AS decided_by FROM (SELECT doc_id, lang AS topic FROM documents)")
def canonical_topics(spark, d):
    registry = spark.createDataFrame([("en", None, "taxonomy"), ("de", None, "taxonomy"), ("es", None, "auto"), ("x", "en", "taxonomy")], "topic_ko string, parent_topic string, source string")
    aliases = spark.createDataFrame([("fr", "de", "seed", None)], "raw_ko string, canonical_ko string, decided_by string, parent_topic string")
    return P.canonical_topics(X.load(spark, d, "documents").select("doc_id", F.col("lang").alias("topic")), registry, aliases)[0]


# --- documents and text ----------------------------------------------------------------------------------------


@query("SELECT page_id, split_part(split_part(list_extract(string_split(rtrim(url, '/'), '/'), -1), '?', 1), '#', 1) AS name FROM pages WHERE split_part(split_part(list_extract(string_split(rtrim(url, '/'), '/'), -1), '?', 1), '#', 1) <> ''")
def url_basenames(spark, d):
    return X.load(spark, d, "pages").select("page_id", T.basename(F.col("url")).alias("name")).where("name <> ''")


@query(with_views("SELECT asset_id, lower(regexp_extract(fs_path, '[.]([^.]+)$', 1)) AS ext, regexp_replace(fs_path, '/[^/]*$', '') AS dir, lower(regexp_replace(regexp_replace(regexp_replace(fs_path, '^.*/', ''), '[.][^.]*$', ''), '(_v[0-9]+|_summary)$', '')) AS base FROM asset", "asset"))
def path_parts(spark, d):
    p = F.col("fs_path")
    return X.assets(spark, d).select("asset_id", T.extension(p).alias("ext"), T.directory(p).alias("dir"), T.base_stem(p).alias("base"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def conversation_timeline(spark, d):
    rows = X.load(spark, d, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    return D.timeline(rows, "conv_id", ["turn"], "line")


@query("SELECT user_id AS asset_id, event_type AS activity, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_total FROM events GROUP BY 1, 2")
def lineage_activity(spark, d):
    e = X.load(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("asset_id"), F.col("event_type").alias("activity")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_total"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return I.event_windows(X.load(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT doc_id, sha256(text) AS file_hash, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents")
def content_hashes(spark, d):
    docs = X.load(spark, d, "documents").select(F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("file_hash"), F.lit("registered").alias("status"), F.lit(0).alias("created_at"))
    twice = D.content_duplicates(docs).select("asset_id", F.lit(True).alias("t"))
    return docs.join(twice, "asset_id", "left").select(F.col("asset_id").alias("doc_id"), "file_hash", F.coalesce("t", F.lit(False)).alias("duplicate"))


@query(with_views(", m AS (SELECT asset_id, count(*) AS chunks, max(len(v)) AS dim FROM emb WHERE channel = 'st' GROUP BY 1) SELECT a.asset_id, a.modality, a.summary, a.lang AS topic, dim FROM asset a JOIN m USING (asset_id) WHERE status = 'registered'", "asset", "emb"))
def index_rows(spark, d):
    """Rows of the search index: registered assets with the mean vector of their channel."""
    a = X.assets(spark, d)
    rows = D.index_rows(a.drop("summary", "lang"), a.select("asset_id", "summary", "lang"), X.asset_embeddings(spark, d), "st")
    return rows.select("asset_id", "modality", "summary", F.col("lang").alias("topic"), F.size("embedding").cast("long").alias("dim"))


@query(
    with_views(
        """, o AS (SELECT asset_id, modality, summary FROM asset WHERE status = 'registered'), i AS (SELECT asset_id, CASE WHEN lang <> 'en' THEN reverse(summary) END AS summary FROM asset WHERE status <> 'registered' OR modality = 'text')
SELECT asset_id, modality, CASE WHEN i.asset_id IS NULL THEN o.summary ELSE i.summary END AS summary FROM o FULL JOIN i USING (asset_id)""",
        "asset",
    )
)
def index_upsert(spark, d):
    """A column-subset merge of registered assets with a batch of texts and of assets that are new: nulls of the incoming rows overwrite."""
    a = X.assets(spark, d)
    new = a.where("status <> 'registered' or modality = 'text'").select("asset_id", F.when(F.col("lang") != "en", F.reverse("summary")).alias("summary"))
    return D.merge_rows(a.where("status = 'registered'").select("asset_id", "modality", "summary"), new, ["asset_id"])


@query("SELECT user_id, array_to_string(list_sort(list(k)), ',') AS readable FROM (SELECT DISTINCT user_id, event_type AS k FROM events WHERE event_type <> 'error') GROUP BY 1")
def readable_fields(spark, d):
    e = X.load(spark, d, "events").select("user_id", "event_type").distinct()
    meta = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.lit("x")))).alias("meta"))
    tiers = spark.createDataFrame([("error", "regulated"), ("click", "public")], "meta_key string, access_tier string")
    got = meta.select("user_id", F.array_sort(F.map_keys(D.readable(F.col("meta"), F.lit("general"), tiers, F.lit("authorized")))).alias("k"))
    return got.where(F.size("k") > 0).select("user_id", F.array_join("k", ",").alias("readable"))


# --- quality ---------------------------------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c),
e AS (SELECT sum(x * y) AS e FROM (SELECT a AS v, sum(n) AS x FROM c GROUP BY 1) JOIN (SELECT b AS v, sum(n) AS y FROM c GROUP BY 1) USING (v))
SELECT CAST(n AS BIGINT) AS n, round(same / n, 6) AS observed, round(e / (n * n), 6) AS expected, round((same / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e"""
)
def rater_kappa(spark, d):
    k = M.cohen_kappa(X.load(spark, d, "labels"), "quality", "toxic")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("SELECT source, count(*) AS n, sum(quality)::BIGINT AS hits, round((p + 3.8416 / (2 * n0) - 1.96 * sqrt(p * (1 - p) / n0 + 3.8416 / (4 * n0 * n0))) / (1 + 3.8416 / n0), 6) AS low, round((p + 3.8416 / (2 * n0) + 1.96 * sqrt(p * (1 - p) / n0 + 3.8416 / (4 * n0 * n0))) / (1 + 3.8416 / n0), 6) AS high FROM (SELECT source, quality, avg(quality) OVER (PARTITION BY source) AS p, count(*) OVER (PARTITION BY source) AS n0 FROM labels JOIN documents USING (doc_id)) GROUP BY source, p, n0")
def wilson_by_source(spark, d):
    g = X.load(spark, d, "labels").join(X.load(spark, d, "documents"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("hits"))
    w = N.wilson(F.col("hits"), F.col("n"))
    return g.select("source", "n", "hits", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


def _ranked(spark, d):
    return bm25_or(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).withColumnRenamed("doc_id", "id")


def _relevant(spark, d):
    items = X.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(X.load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), F.col("id") % 40 == F.col("query_id") % 40)


@query(
    f"""WITH {_BM25}, rk AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM sc), top AS (SELECT * FROM rk WHERE rank <= 10),
rel AS (SELECT DISTINCT item_id AS query_id, doc_id AS id FROM benchmark JOIN labels ON doc_id % 40 = item_id % 40 WHERE quality = 1), nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
o AS (SELECT top.*, rel.id IS NOT NULL AS hit FROM top LEFT JOIN rel USING (query_id, id)),
a AS (SELECT query_id, count(*) FILTER (WHERE hit) AS hits, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr, coalesce(sum(CASE WHEN hit THEN 1 / log2(rank + 1) END), 0) AS dcg, coalesce(avg(CASE WHEN NOT hit THEN rank END), 0) AS nmr, count(*) FILTER (WHERE NOT hit) / count(*) AS nex FROM o GROUP BY 1)
SELECT query_id, round(CASE WHEN coalesce(n_rel, 0) > 0 THEN coalesce(hits, 0) / n_rel ELSE 0 END, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(rr, 0), 6) AS reciprocal_rank,
round(CASE WHEN coalesce(n_rel, 0) > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg, round(coalesce(nmr, 0), 6) AS nonrelevant_mean_rank, round(coalesce(nex, 0), 6) AS nonrelevant_exposure FROM a FULL JOIN nr USING (query_id)"""
)
def retrieval_metrics(spark, d):
    m = M.retrieval_metrics(_ranked(spark, d), _relevant(spark, d), 10)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def _judged(spark, d):
    e = X.graph_edges(spark, d).withColumn("edge_id", F.concat_ws(":", *R.KEY))
    return e, e.where("status <> 'rejected'").select("edge_id", F.when(F.col("status") == "active", "strong").when(F.col("kind_code") == "R", "error").otherwise("weak").alias("verdict"))


@query(
    with_views(
        """, t AS (SELECT unnest([0.1, 0.5, 0.9]) AS threshold), k AS (SELECT t.threshold, e.*, CASE WHEN status = 'rejected' THEN NULL WHEN status = 'active' THEN 'strong' WHEN kind_code = 'R' THEN 'error' ELSE 'weak' END AS verdict FROM t JOIN edge e ON confidence >= threshold),
n AS (SELECT threshold, count(*) AS edge_count, count(*) FILTER (WHERE verdict IN ('strong', 'weak', 'none')) AS rated_count, count(*) FILTER (WHERE verdict = 'strong') AS strong_count FROM k GROUP BY 1),
a AS (SELECT threshold, count(DISTINCT x) AS assets_with_edge FROM (SELECT threshold, src AS x FROM k UNION ALL SELECT threshold, dst FROM k) GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, edge_count, rated_count, strong_count, round(strong_count / rated_count, 6) AS strong_rate, assets_with_edge FROM n JOIN a USING (threshold)""",
        "edge",
    )
)
def coverage_curve(spark, d):
    return M.coverage_curve(*_judged(spark, d), [0.9, 0.1, 0.5]).withColumn("strong_rate", F.round("strong_rate", 6))


@query(
    with_views(
        """, p AS (SELECT s.asset_id AS source, t.asset_id AS target, list_dot_product(s.v, t.v) / sqrt(list_dot_product(s.v, s.v) * list_dot_product(t.v, t.v)) AS sim FROM emb s JOIN emb t ON s.channel = t.channel AND s.asset_id <> t.asset_id),
b AS (SELECT source, target, round(max(sim), 6) AS sim FROM p GROUP BY 1, 2 HAVING round(max(sim), 6) >= 0.2), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM b) WHERE rank <= 10),
g AS (SELECT DISTINCT doc_id AS lo, doc_id + 20 AS hi FROM documents WHERE doc_id % 40 < 20), t AS (SELECT unnest([0.2, 0.3, 0.5]) AS threshold),
k AS (SELECT threshold, least(source, target) AS lo, greatest(source, target) AS hi FROM c JOIN t ON sim >= threshold), m AS (SELECT threshold, count(*) AS kept, count(DISTINCT CASE WHEN g.lo IS NOT NULL THEN (k.lo, k.hi) END) AS hits FROM k LEFT JOIN g ON g.lo = k.lo AND g.hi = k.hi GROUP BY 1)
SELECT CAST(threshold AS DOUBLE) AS threshold, coalesce(kept, 0) AS kept, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / (SELECT count(*) FROM g), 6) AS recall FROM t LEFT JOIN m USING (threshold)""",
        "emb",
    )
)
def min_sim_sweep(spark, d):
    return M.min_sim_sweep(similarity_candidates(spark, d), _golden(spark, d), [0.2, 0.3, 0.5]).withColumn("recall", F.round("recall", 6))


@query(
    with_views(
        """, m AS (SELECT * FROM (SELECT a.asset_id AS src, b.asset_id AS dst, 'x' AS kind_code FROM asset a JOIN asset b ON a.fs_path = b.fs_path AND a.asset_id < b.asset_id)), g AS (SELECT DISTINCT doc_id AS lo, doc_id + 20 AS hi FROM documents WHERE doc_id % 40 < 20),
j AS (SELECT m.*, g.lo FROM m LEFT JOIN g ON g.lo = least(src, dst) AND g.hi = greatest(src, dst)), i AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 0)
SELECT round(coalesce(count(lo) / nullif(count(*), 0), 0), 6) AS precision, round(coalesce(count(lo) / nullif(count(lo), 0), 0), 6) AS kind_accuracy, round((SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) FROM j WHERE lo IS NOT NULL) / (SELECT count(*) FROM g), 6) AS recall,
round((SELECT count(*) FROM i WHERE doc_id NOT IN (SELECT src FROM m UNION ALL SELECT dst FROM m)) / (SELECT count(*) FROM i), 6) AS isolation_accuracy FROM j""",
        "asset",
    )
)
def relation_metrics(spark, d):
    a = X.assets(spark, d).select("asset_id", "fs_path")
    edges = a.select(F.col("asset_id").alias("src"), "fs_path").join(a.select(F.col("asset_id").alias("dst"), "fs_path"), "fs_path").where("src < dst").select("src", "dst", F.lit("x").alias("kind_code"))
    m = M.relation_metrics(edges, _golden(spark, d), a.where("asset_id % 9 = 0"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(with_views("SELECT modality, count(*) FILTER (WHERE asset_id NOT IN (SELECT asset_id FROM emb)) AS hollow, count(*) AS total FROM asset GROUP BY 1", "asset", "emb"))
def hollow_assets(spark, d):
    return M.hollow_report(X.assets(spark, d), X.asset_embeddings(spark, d))


@query(with_views("SELECT count(*) AS total, count(*) FILTER (WHERE asset_id NOT IN (SELECT asset_id FROM topic)) AS missing, round(count(*) FILTER (WHERE asset_id NOT IN (SELECT asset_id FROM topic)) / count(*), 6) AS rate FROM asset WHERE status = 'registered'", "asset", "topic"))
def unclassified_rate(spark, d):
    return M.unclassified_report(X.assets(spark, d), X.asset_topics(spark, d)).withColumn("rate", F.round("rate", 6))


@query(with_views("SELECT asset_id FROM asset WHERE asset_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 40 < 20) AND asset_id NOT IN (SELECT doc_id + 20 FROM documents WHERE doc_id % 40 < 10)", "asset"))
def isolated_assets(spark, d):
    edges = _golden(spark, d).select(F.col("a").alias("src"), F.when(F.col("a") % 40 < 10, F.col("b")).otherwise(F.col("a")).alias("dst"))
    return M.isolated(X.assets(spark, d), edges)


@query("SELECT event_type, list_sort(list(value))[CAST(greatest(1, ceil(0.95 * count(*))) AS INTEGER)] AS p95, list_sort(list(value))[CAST(count(*) // 2 AS INTEGER) + 1] AS median FROM events GROUP BY 1")
def value_percentiles(spark, d):
    return M.percentiles(X.load(spark, d, "events"), "value", ["event_type"])


@query(with_views("SELECT src, dst, kind_code, CASE WHEN confidence < 0.6 THEN '<.60' WHEN confidence < 0.75 THEN '.60-.75' WHEN confidence < 0.9 THEN '.75-.90' WHEN confidence < 0.95 THEN '.90-.95' ELSE '>=.95' END AS band FROM edge", "edge"))
def confidence_bands(spark, d):
    return X.graph_edges(spark, d).select(*R.KEY, N.band(F.col("confidence")).alias("band"))


_CHUNKS = r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
t AS (SELECT doc_id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM l),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS seq, CASE WHEN length(s) <= 500 THEN s ELSE substr(s, CAST(j * 500 + 1 AS BIGINT), 500) END AS t, length(s) > 500 AS cut
      FROM (SELECT doc_id, i, s, unnest(CASE WHEN length(s) <= 500 THEN [0] ELSE range(0, (length(s) - 1) // 500 + 1) END) AS j FROM t WHERE s <> '')),
p AS (SELECT doc_id, seq, t, cut, 0 AS k, length(t) AS size FROM c WHERE seq = 1
      UNION ALL SELECT c.doc_id, c.seq, c.t, c.cut, CASE WHEN c.cut OR p.cut OR p.size + 1 + length(c.t) > 500 THEN p.k + 1 ELSE p.k END, CASE WHEN c.cut OR p.cut OR p.size + 1 + length(c.t) > 500 THEN length(c.t) ELSE p.size + 1 + length(c.t) END
      FROM p JOIN c ON c.doc_id = p.doc_id AND c.seq = p.seq + 1),
g AS (SELECT doc_id, k, string_agg(t, chr(10) ORDER BY seq) AS c FROM p GROUP BY 1, 2)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CASE WHEN k = 0 THEN c ELSE regexp_replace(right(lag(c) OVER (PARTITION BY doc_id ORDER BY k), 50) || chr(10) || c, '^\s+|\s+$', '', 'g') END AS chunk FROM g"""


@query(_CHUNKS)
def chunked_documents(spark, d):
    """Documents in chunks of 500 characters that overlap by 50."""
    return D.chunk_rows(X.load(spark, d, "documents"), 500, 50, "doc_id")


def _field_sql(name: str, words: str, boost: float) -> str:
    return f"""{name}_w AS (SELECT asset_id, {words} AS w FROM d), {name}_tf AS (SELECT asset_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT asset_id, len(w) AS dl, unnest(w) AS term FROM {name}_w) GROUP BY 1, 2),
{name}_st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {name}_w WHERE len(w) > 0), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_s AS (SELECT query_id, asset_id, '{name}' AS f, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_st GROUP BY query_id, asset_id, n_terms HAVING count(*) = n_terms)"""


_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')".format
_HYBRID = f""", d AS (SELECT asset_id, modality AS bucket, lang, regexp_replace(fs_path, '^.*/', '') AS file, summary FROM asset WHERE status = 'registered'),
ask AS (SELECT item_id AS query_id, text AS query, item_id AS vec_id FROM benchmark UNION ALL SELECT * FROM (VALUES (-1, 'en', 10), (-2, 'De ', 11), (-3, 'fr', 12), (-4, 'es es', 13)) AS v),
qt AS (SELECT query_id, len(w) AS n_terms, unnest(w) AS term FROM (SELECT query_id, list_distinct({_WORDS('query')}) AS w FROM ask)),
{_field_sql('k', _WORDS('lang'), 2.0)}, {_field_sql('f', _WORDS('file'), 0.5)}, {_field_sql('s', _WORDS('summary'), 3.0)},
nd AS (SELECT count(*) AS n FROM d), xt AS (SELECT asset_id, term, tf, dl, 2.0 AS b, avgdl FROM k_tf, k_st UNION ALL SELECT asset_id, term, tf, dl, 3.0, avgdl FROM s_tf, s_st),
xdf AS (SELECT term, max(df) AS df FROM (SELECT * FROM k_df UNION ALL SELECT * FROM s_df) GROUP BY 1),
xb AS (SELECT term, asset_id, max(b * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM xt JOIN xdf USING (term), nd GROUP BY 1, 2),
x_s AS (SELECT query_id, asset_id, 'x' AS f, sum(s) AS score FROM qt JOIN xb USING (term) GROUP BY query_id, asset_id, n_terms HAVING count(*) = n_terms),
l_s AS (SELECT query_id, asset_id, 'l' AS f, ln(1 + (n - df + 0.5) / (df + 0.5)) AS score FROM ask JOIN d ON lower(trim(query)) = lang JOIN (SELECT lang, count(*) AS df FROM d GROUP BY 1) USING (lang), nd),
hit AS (SELECT * FROM k_s UNION ALL SELECT * FROM f_s UNION ALL SELECT * FROM s_s UNION ALL SELECT * FROM x_s UNION ALL SELECT * FROM l_s),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, asset_id) AS rank FROM (SELECT query_id, bucket, asset_id, round(sum(score), 9) AS score, list(f) AS m FROM hit JOIN d USING (asset_id) GROUP BY 1, 2, 3)) WHERE rank <= 10),
mv AS (SELECT asset_id, list(x ORDER BY pos) AS v FROM (SELECT asset_id, pos, avg(x) AS x FROM (SELECT asset_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM emb WHERE channel = 'st') GROUP BY 1, 2) GROUP BY 1),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY cos DESC, asset_id) AS rank FROM (SELECT query_id, bucket, asset_id, round(list_dot_product(mv.v, q.v) / sqrt(list_dot_product(mv.v, mv.v) * list_dot_product(q.v, q.v)), 9) AS cos
  FROM mv JOIN d USING (asset_id), (SELECT query_id, CAST(embedding AS DOUBLE[]) AS v FROM ask JOIN embeddings USING (vec_id)) q)) WHERE rank <= 50),
na AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS a FROM lex WINDOW w AS (PARTITION BY query_id, bucket)),
nb AS (SELECT *, CASE WHEN max(cos) OVER w = min(cos) OVER w THEN 1.0 ELSE (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) END AS b FROM knn WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id, bucket)),
fused AS (SELECT query_id, bucket, asset_id, 0.5 * coalesce(a, 0) + 0.5 * coalesce(b, 0) AS similarity, cos, a IS NOT NULL AS lexical, m FROM na FULL JOIN nb USING (query_id, bucket, asset_id)),
sig AS (SELECT query_id, bucket, max(cos) AS top, coalesce(avg(CASE WHEN i <= c // 2 THEN cos END), 0) AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY cos, rank) AS i, count(*) OVER (PARTITION BY query_id, bucket) AS c FROM knn) GROUP BY 1, 2),
g AS (SELECT f.*, coalesce(top - baseline >= 0.12 - 1e-9 AND top >= 0.15 - 1e-9, false) AS gate_passed, count(*) OVER (PARTITION BY query_id, bucket) AS n_fused,
  CASE WHEN list_contains(m, 'k') THEN 3.0 ELSE 0 END + CASE WHEN list_contains(m, 'l') THEN 2.0 ELSE 0 END + CASE WHEN list_contains(m, 'f') THEN 1.5 ELSE 0 END + CASE WHEN list_contains(m, 's') THEN 0.7 ELSE 0 END + CASE WHEN list_contains(m, 'x') AND NOT list_has_any(m, ['k', 'l', 'f']) THEN 0.3 ELSE 0 END AS e FROM fused f LEFT JOIN sig USING (query_id, bucket)),
kr AS (SELECT *, CASE WHEN gate_passed THEN CASE WHEN lexical OR cos >= 0.1 - 1e-9 THEN 'gate_passed' END WHEN lexical AND e >= 1.5 THEN 'evidence_normal' END AS keep_reason FROM g),
kept AS (SELECT *, n_fused - count(*) OVER (PARTITION BY query_id, bucket) AS cut_count, row_number() OVER (PARTITION BY query_id, bucket ORDER BY similarity DESC, asset_id) AS rank FROM kr WHERE keep_reason IS NOT NULL)"""


def _hybrid(spark, d):
    own = X.assets(spark, d).where("status = 'registered'").join(V.mean_vector(X.asset_embeddings(spark, d).where("channel = 'st'"), ["asset_id"]), "asset_id", "left")
    docs = own.select("asset_id", "modality", F.array("lang").alias("keywords"), F.array("lang").alias("labels"), T.display_name(F.col("fs_path")).alias("file_name"), "summary", "embedding")
    few = spark.createDataFrame([(-1, "en", 10), (-2, "De ", 11), (-3, "fr", 12), (-4, "es es", 13)], "query_id long, query string, vec_id long")
    asked = X.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("item_id").alias("vec_id")).unionByName(few)
    asked = asked.join(X.load(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")
    return S.search_hybrid(docs, asked, ["text", "image", "video", "audio"], 10, S.Tuning(cutoff_eps=0.12, cutoff_floor=0.15, result_floor=0.1))


@query(with_views(_HYBRID + " SELECT query_id, bucket, asset_id, round(similarity, 6) AS similarity, gate_passed, keep_reason, cut_count, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 10", "asset", "emb"))
def hybrid_search(spark, d):
    """The whole read path over documents as assets: benchmark items and names of languages are queries, with the vectors of the embeddings table."""
    return _hybrid(spark, d)[0].select("query_id", "bucket", "asset_id", F.round("similarity", 6).alias("similarity"), "gate_passed", "keep_reason", "cut_count", "rank")


@query(
    with_views(
        _HYBRID
        + """ SELECT query_id, bucket, round(coalesce(top, 0), 6) AS top, round(coalesce(baseline, 0), 6) AS baseline, coalesce(top - baseline >= 0.12 - 1e-9 AND top >= 0.15 - 1e-9, false) AS gate_passed, coalesce(le, false) AS lexical_evidence, coalesce(c, n, 0) AS cut_count, false AS error
FROM (SELECT query_id, bucket, count(*) AS n, bool_or(lexical) AS le FROM fused GROUP BY 1, 2) FULL JOIN sig USING (query_id, bucket) LEFT JOIN (SELECT query_id, bucket, max(cut_count) AS c FROM kept GROUP BY 1, 2) USING (query_id, bucket)""",
        "asset",
        "emb",
    )
)
def hybrid_gates(spark, d):
    """The gate figures of the same searches, one row a query and bucket."""
    return _hybrid(spark, d)[1].select("query_id", "bucket", F.round("top", 6).alias("top"), F.round("baseline", 6).alias("baseline"), "gate_passed", "lexical_evidence", "cut_count", "error")


from . import catalogue  # noqa: E402, F401  registers further queries

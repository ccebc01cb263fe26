"""More queries over the test tables: names, topics, proposals, review, upserts, files, reports, streams; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import documents as D
from ..operators import metrics as M
from ..operators import proposals as O
from ..operators import registry as G
from ..operators import relations as R
from ..operators import reports as Q
from ..operators import search as S
from ..operators import topics as P
from ..sources import files as L
from ..sources import tables as X
from ..sources.scratch import shared_dir, written
from ..sources.tables import with_views
from ..streaming import incremental as I
from .queries import query

# --- names and texts -------------------------------------------------------------------------------------------

_UUID = "substr(md5(CAST(asset_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(asset_id AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(asset_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(asset_id AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(asset_id AS VARCHAR)), 21, 12)"


def _uuid(c):
    h = F.md5(c.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _paths(spark, d):
    """Assets with paths as they are stored: a folder of the source, an id before the name, a topic in it."""
    a = X.assets(spark, d)
    word = F.regexp_replace(F.split(F.regexp_replace("summary", r"\s+", " "), " ")[0], r"[^\p{L}\p{N}]", "")
    name = F.when(F.col("lang") == "en", F.concat(word, F.lit("_("), "lang", F.lit(").txt"))).when(F.col("lang") == "de", F.concat(F.lit("youtube_"), "lang", F.lit("_"), F.upper(F.substring(F.md5(F.col("summary")), 1, 11)), F.lit(".mp4"))).when(F.col("lang") == "fr", F.concat(word, F.lit("_"), F.substring(F.md5(F.col("summary")), 1, 11), F.lit("_x.jpg"))).otherwise(F.concat(word, F.lit(".TXT")))
    folder = F.when(F.col("modality") == "text", "/a/sample_data/data2/").when(F.col("modality") == "image", "/a/Wikipedia/").when(F.col("modality") == "video", "/a/youtube/").otherwise("/a/")
    return a.withColumn("fs_path", F.concat(folder, _uuid(F.col("asset_id")), F.lit("__"), name))


_PATHS = f""", w AS (SELECT *, regexp_replace(string_split(regexp_replace(summary, '\\s+', ' ', 'g'), ' ')[1], '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM asset),
n AS (SELECT *, CASE lang WHEN 'en' THEN word || '_(' || lang || ').txt' WHEN 'de' THEN 'youtube_' || lang || '_' || upper(substr(md5(summary), 1, 11)) || '.mp4' WHEN 'fr' THEN word || '_' || substr(md5(summary), 1, 11) || '_x.jpg' ELSE word || '.TXT' END AS name,
  CASE modality WHEN 'text' THEN '/a/sample_data/data2/' WHEN 'image' THEN '/a/Wikipedia/' WHEN 'video' THEN '/a/youtube/' ELSE '/a/' END AS folder FROM w)"""


@query(with_views(_PATHS + " SELECT asset_id, name AS file_name, CASE WHEN modality = 'text' THEN 'data2' WHEN modality = 'image' THEN 'wikipedia' WHEN contains(lower(folder || name), 'youtube') THEN 'youtube' ELSE 'unknown' END AS dataset, rtrim(folder, '/') AS dir, lower(regexp_extract(name, '[.]([^.]+)$', 1)) AS ext FROM n", "asset"))
def stored_names(spark, d):
    """Display names, source data sets, folders and extensions of stored paths."""
    p = F.col("fs_path")
    return _paths(spark, d).select("asset_id", T.display_name(p).alias("file_name"), T.source_dataset(p).alias("dataset"), T.directory(p).alias("dir"), T.extension(p).alias("ext"))


_ID_LIKE = """regexp_full_match(t, '[A-Za-z0-9-]{8,}') AND CASE WHEN length(regexp_replace(t, '[^aeiouAEIOU]', '', 'g')) < 0.25 * length(t) THEN NOT (regexp_full_match(t, '[a-z]+|[A-Z]+|[A-Z][a-z]+') AND regexp_matches(t, '[aeiouyAEIOUY]'))
  ELSE CAST(regexp_matches(t, '[A-Z]') AS INTEGER) + CAST(regexp_matches(t, '[a-z]') AS INTEGER) + CAST(regexp_matches(t, '[0-9]') AS INTEGER) >= 2 AND NOT regexp_full_match(t, '[a-z]+|[A-Z]+|[A-Z][a-z]+') END"""


@query(with_views(_PATHS + f" SELECT asset_id, coalesce(array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '[.][^.]*$', ''), '[_\\s]+'), lambda t: t <> '' AND NOT ({_ID_LIKE}) AND NOT regexp_matches(t, '^x$')), ' '), '') AS words FROM n", "asset"))
def name_words(spark, d):
    """Words of file names without ids and noise."""
    return _paths(spark, d).select("asset_id", T.clean_file_name(F.col("fs_path"), ["^x$"]).alias("words"))


@query(
    with_views(
        _PATHS
        + """, t AS (SELECT asset_id, CASE WHEN lang IN ('en', 'de') THEN lang WHEN lang = 'fr' AND word <> '' THEN trim(word) END AS label, lang FROM n WHERE status = 'registered'),
k AS (SELECT asset_id, label, CASE WHEN lang = 'fr' THEN string_split(label, '_')[1] ELSE label END AS key FROM t WHERE label IS NOT NULL AND label <> '')
SELECT key, replace(first(label ORDER BY length(label) DESC, label), '_', ' ') AS query, array_to_string(list_sort(list(DISTINCT asset_id)), ',') AS relevant FROM k GROUP BY 1 HAVING count(DISTINCT asset_id) >= 2""",
        "asset",
    )
)
def golden_drafts(spark, d):
    """Golden queries drafted from the topics of file names."""
    return Q.golden_draft(_paths(spark, d)).select("key", "query", F.array_join(F.transform("relevant", lambda x: x.cast("string")), ",").alias("relevant"))


_FIRST = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:12]"


def _first_words(spark, d):
    return X.load(spark, d, "documents").select("doc_id", "lang", "source", F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 12).alias("w"), "text")


@query(
    f"""WITH w AS (SELECT doc_id, lang, source, {_FIRST} AS w FROM documents), e AS (SELECT *, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c FROM w), s AS (SELECT *, left(regexp_replace(a, '^[\\s.,;:!?·、，。]+|[\\s.,;:!?·、，。]+$', '', 'g'), 200) AS topic FROM e)
SELECT doc_id, topic, left(CASE WHEN len(w) > 2 THEN regexp_replace(lower(a), '^[\\s.,;:!?]+|[\\s.,;:!?]+$', '', 'g') ELSE regexp_replace(lower(array_to_string(w, ' ')), '^[\\s.,;:!?]+|[\\s.,;:!?]+$', '', 'g') END, 200) AS topic_en,
CASE WHEN topic = '' THEN '' ELSE topic || '>' || lang END AS pair, CASE WHEN regexp_full_match(lower(source || '_' || lang), '[a-z][a-z0-9_]{{0,99}}') THEN lower(source || '_' || lang) END AS usable, source || ' ' || lang AS label FROM s"""
)
def topic_words(spark, d):
    """Topic words, pairs, and kinds made of source and language."""
    own = _first_words(spark, d)
    whole = F.array_join("w", " ")
    code = F.concat(F.upper("source"), F.lit("_"), "lang")
    return own.select("doc_id", F.coalesce(T.topic_word(whole), F.lit("")).alias("topic"), F.coalesce(T.topic_words_en(whole), F.lit("")).alias("topic_en"), T.topic_pair(T.topic_word(whole), F.col("lang")).alias("pair"), T.usable_kind(code).alias("usable"), T.kind_label(T.kind_code(code)).alias("label"))


@query(
    f"""WITH w AS (SELECT doc_id, list_filter({_FIRST}, lambda x: lower(upper(x)) NOT IN ('the', 'der', 'le', 'el')) AS w, list_transform({_FIRST}, lambda x: lower(upper(x))) AS all_low, {_FIRST} AS raw FROM documents),
k AS (SELECT doc_id, raw, w, list_transform(w, lambda x: lower(upper(x))) AS low FROM w)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(low, lower(upper(x))) = i)[1:5], '|') AS words, array_to_string(list_filter(w, lambda x, i: list_position(low, lower(upper(x))) = i)[1:8], '|') AS promoted,
len(list_distinct(raw)) AS n_distinct, '요약: ' || coalesce(raw[1], '') || chr(10) || '키워드: ' || array_to_string(raw, ', ') AS rerank FROM k"""
)
def keyword_lists(spark, d):
    """Keywords without repeats and generic words, filled up with objects, and the text that a reranker reads."""
    generic = ["the", "der", "le", "el"]
    own = _first_words(spark, d).withColumn("first", F.coalesce(F.get("w", F.lit(0)), F.lit("")))
    return own.select(
        "doc_id",
        F.array_join(T.keywords(F.col("w"), generic, 5), "|").alias("words"),
        F.array_join(T.promoted(F.slice("w", 1, 4), F.slice(F.col("w"), 5, 12), 8, generic), "|").alias("promoted"),
        F.size(T.distinct_texts(F.col("w"))).cast("long").alias("n_distinct"),
        T.rerank_text(F.col("first"), F.col("w")).alias("rerank"),
    )


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text || chr(8203) || chr(13) || chr(10) || chr(9312), chr(8203) || chr(13) || chr(10) || chr(9312), chr(10) || '1'), '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, replace(nfc_normalize(text), chr(160), ' ') AS text FROM documents)")
def embedding_texts(spark, d):
    """Texts as they go to an embedder; a zero-width space, a carriage return and a circled digit are added to each."""
    return X.load(spark, d, "documents").select("doc_id", T.embedding_text(F.concat("text", F.lit("​\r\n①"))).alias("text"))


@query(with_views("SELECT asset_id, regexp_replace(fs_path, '^.*/', '') AS file_name, modality, array_to_string(list_filter(string_split(regexp_replace(summary, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')[1:8], '|') AS keywords, lang || '|' || modality AS labels FROM asset", "asset"))
def list_items(spark, d):
    """Listing rows: the first keywords and labels that are not empty."""
    a = X.assets(spark, d).select("asset_id", "fs_path", "modality", F.split(F.regexp_replace("summary", r"\s+", " "), " ").alias("keywords"), F.array("lang", F.lit(""), F.lit(None), "modality").alias("labels"))
    got = G.list_items(a)
    return got.select("asset_id", "file_name", "modality", F.array_join("keywords", "|").alias("keywords"), F.array_join("labels", "|").alias("labels"))


# --- files and documents ---------------------------------------------------------------------------------------

_TYPES = ["application/pdf", "application/json", "text/plain", "image/png", "video/mp4", "audio/mpeg", "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/octet-stream"]
_KINDS = ["pdf", "json", "text", "image", "video", "audio", "word", "excel", "powerpoint", "unknown"]


@query(f"SELECT event_id, {_KINDS}[CAST(user_id % 10 + 1 AS INTEGER)] AS kind, {['text', 'text', 'text', 'image', 'video', 'audio', 'text', 'text', 'text', 'unknown']}[CAST(user_id % 10 + 1 AS INTEGER)] AS modality FROM events")
def file_kinds(spark, d):
    """File kinds and modalities of media types."""
    mime = F.get(F.array(*map(F.lit, _TYPES)), (F.col("user_id") % 10).cast("int"))
    return X.load(spark, d, "events").select("event_id", L.kind_of_type(mime).alias("kind"), L.modality_of(L.kind_of_type(mime)).alias("modality"))


@query("SELECT 'file-' || lpad(CAST(item_id AS VARCHAR), 4, '0') || '.txt' AS name, 'text' AS kind, sha256(text) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS file_size, text AS content FROM benchmark")
def stored_files(spark, d):
    """Benchmark texts written as files, listed, told apart by their bytes, hashed, decoded and read in parts."""
    import os

    folder = f"{shared_dir(spark)}/siltstone/files-{uuid.uuid4().hex}"
    items = X.load(spark, d, "benchmark").select(F.concat(F.lit("file-"), F.lpad("item_id", 4, "0"), F.lit(".txt")).alias("name"), "text")
    conf, root = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    for r in items.collect():  # the benchmark is a small table
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, r["name"])))
        out.write(bytearray(r["text"].encode()))
        out.close()
    files = written(L.list_files(spark, folder).withColumn("kind", L.sniffed_kind(F.col("content"), F.col("path"))), "files")
    parts = L.segments(files).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "").alias("content"))
    return files.drop("content").join(L.file_hashes(files), "path").join(parts, "path").select(T.basename(F.col("path")).alias("name"), "kind", "file_hash", "file_size", "content")


@query(
    """WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
r AS (SELECT doc_id, i, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE s <> '')
SELECT doc_id, string_agg(left(s, CAST(400 - before AS BIGINT)), '|' ORDER BY i) AS kept FROM r WHERE before < 400 GROUP BY 1"""
)
def limited_texts(spark, d):
    """Lines up to 400 characters in all, the last one cut."""
    got = X.load(spark, d, "documents").select("doc_id", F.array_join(D.limit_chars(F.split("text", "\n"), 400), "|").alias("kept"))
    return got.where("kept <> ''")


@query(
    with_views(
        """, m AS (SELECT asset_id, count(*) AS c FROM emb WHERE channel = 'st' GROUP BY 1), t AS (SELECT asset_id, list_sort(list(DISTINCT topic)) AS topics, list_sort(list(DISTINCT nullif(subtopic, ''))) AS subs, list_sort(list(DISTINCT CASE WHEN subtopic = '' THEN topic ELSE topic || '>' || subtopic END)) AS pairs FROM topic GROUP BY 1)
SELECT asset_id, modality, summary, lang AS labels, regexp_extract(fs_path, '[.]([^.]+)$', 1) AS file_ext, array_to_string(coalesce(topics, []), ',') AS topics, array_to_string(list_filter(coalesce(subs, []), lambda x: x IS NOT NULL), ',') AS subtopics, array_to_string(coalesce(pairs, []), ',') AS topic_pairs, topics IS NOT NULL AS has_topic
FROM asset JOIN m USING (asset_id) LEFT JOIN t USING (asset_id) WHERE status = 'registered'""",
        "asset",
        "emb",
        "topic",
    )
)
def search_documents(spark, d):
    """Documents of the index with labels, filter fields and topics."""
    a = X.assets(spark, d)
    rows = D.index_rows(a.drop("summary", "lang"), a.select("asset_id", "summary", F.array("lang").alias("keywords"), F.array(F.struct(F.concat(F.lit(" "), "lang").alias("label"), F.lit(0.5).alias("score")), F.struct(F.lit(" ").alias("label"), F.lit(0.1).alias("score"))).alias("labels")), X.asset_embeddings(spark, d), "st")
    got = D.search_documents(rows, X.asset_topics(spark, d))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return got.select("asset_id", "modality", "summary", text("labels"), "file_ext", text("topics"), text("subtopics"), text("topic_pairs"), F.col("topics").isNotNull().alias("has_topic"))


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS index, user_id FROM events WHERE event_type <> 'error'")
def running_index(spark, d):
    """Events that are kept, numbered within their user."""
    return D.running_index(X.load(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "error").select("event_id", "event_type", "index", "user_id")


@query(
    """WITH s AS (SELECT event_id, [value / 100, (user_id % 7) / 7.0, 0.5] AS s FROM events), e AS (SELECT event_id, list_transform(s, lambda x: exp(100 * x - 100 * list_max(s))) AS e FROM s), p AS (SELECT event_id, unnest(['a', 'b', 'c']) AS label, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p FROM e)
SELECT event_id, first(label ORDER BY p DESC, label) AS best, round(max(p), 6) AS score, string_agg(label, '' ORDER BY p DESC, label) AS labels FROM p GROUP BY 1"""
)
def zero_shot_labels(spark, d):
    """Labels by softmax of scaled cosines, best first."""
    z = D.zero_shot(F.array(F.col("value") / 100, (F.col("user_id") % 7) / F.lit(7.0), F.lit(0.5)), ["a", "b", "c"])
    return X.load(spark, d, "events").select("event_id", z.alias("z")).select("event_id", F.get("z", F.lit(0))["label"].alias("best"), F.round(F.get("z", F.lit(0))["score"], 6).alias("score"), F.array_join(F.transform("z", lambda x: x["label"]), "").alias("labels"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS unknown FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def unknown_fields(spark, d):
    """Keys that the registry of a domain does not allow."""
    fields = spark.createDataFrame([("general", "click", "active", "authorized", "{}"), ("general", "view", "active", "public", "{}"), ("general", "error", "inactive", "public", "{}"), ("medical", "buy", "active", "public", "{}")], "domain string, meta_key string, status string, access_tier string, json_schema string")
    meta = X.load(spark, d, "events").select("user_id", "event_type").distinct().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.lit("x")))).alias("m"))
    got = meta.select("user_id", D.unknown_keys(F.col("m"), G.allowed_keys(fields, "general")).alias("k"))
    return got.where(F.size("k") > 0).select("user_id", F.array_join("k", ",").alias("unknown"))


@query(with_views("SELECT asset_id, CASE WHEN domain_label = 'medical' THEN 'regulated' WHEN domain_label = 'review' OR lang = 'en' THEN 'authorized' ELSE 'public' END AS tier, CASE WHEN modality = 'text' THEN 'authorized' ELSE 'public' END AS cleared FROM asset", "asset"))
def effective_tiers(spark, d):
    """The stricter of a field's tier and its domain's floor, and what a reader may see."""
    field = F.when(F.col("lang") == "en", "authorized").otherwise("public")
    return X.assets(spark, d).select("asset_id", D.effective_tier(field, F.col("domain_label")).alias("tier"), D.clearance(F.col("modality") == "text").alias("cleared"))


@query(with_views("SELECT asset_id, 'n' || asset_id AS node FROM asset WHERE status <> 'registered' UNION ALL SELECT asset_id, sha256('asset:' || asset_id) FROM asset WHERE status = 'registered'", "asset"))
def asset_nodes(spark, d):
    """Nodes of all assets; those of assets that failed exist already."""
    a = X.assets(spark, d)
    nodes = a.where("status <> 'registered'").select(F.concat(F.lit("n"), F.col("asset_id").cast("string")).alias("node"), F.col("asset_id").cast("string").alias("asset_id"))
    return D.get_or_create_nodes(nodes, a).select(F.col("asset_id").cast("long").alias("asset_id"), "node")


@query(with_views("SELECT asset_id FROM emb GROUP BY 1 HAVING count(DISTINCT channel) = 2", "emb"))
def both_channels(spark, d):
    """Assets that have vectors of both channels."""
    return Q.having_all(X.asset_embeddings(spark, d), "asset_id", "channel", ["st", "clip"])


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS unit_sum, 80 AS padded, round(greatest(-1, least(1, 2 * v[1] - 1)), 6) AS cos, round(greatest(0, least(1, v[2] * 10)), 6) AS conf FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")
def vector_figures(spark, d):
    """Norms, unit and padded vectors, cosines of scores, confidences; the vectors come from text."""
    v = X.load(spark, d, "embeddings").select("vec_id", N.parse_vector(F.to_json(F.transform("embedding", lambda x: x.cast("double")))).alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return v.select("vec_id", F.round(N.norm(F.col("v")), 6).alias("norm"), F.round(total(N.unit(F.col("v"))), 6).alias("unit_sum"), F.size(N.padded(F.col("v"), 80)).alias("padded"), F.round(N.cosine_of_score(F.get("v", F.lit(0))), 6).alias("cos"), F.round(N.confidence(F.get("v", F.lit(1)) * 10), 6).alias("conf"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AS inside FROM orders")
def days(spark, d):
    """Days of timestamps, and an inclusive range of them."""
    f = S.Filters.parse(created_from="1995-01-01", created_to="1996-06-30T23:00:00Z")
    return X.load(spark, d, "orders").withColumn("created_at", F.col("o_orderdate")).select("o_orderkey", N.day(F.col("o_orderdate")).alias("day"), f.column().alias("inside"))


# --- retrieval parts -------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT doc_id % 40 AS query_id, lang AS bucket, doc_id AS asset_id, [lang, source] AS about, left(text, 200) AS kw FROM documents), q AS (SELECT item_id AS query_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS nouns FROM benchmark),
j AS (SELECT * FROM r JOIN q USING (query_id)), u AS (SELECT query_id, bucket, noun FROM (SELECT query_id, bucket, asset_id, kw, unnest(list_distinct(list_filter(nouns, lambda n: length(n) >= 2))) AS noun FROM j) GROUP BY 1, 2, 3 HAVING avg(CASE WHEN contains(kw, noun) THEN 1.0 ELSE 0 END) <= 0.5),
g AS (SELECT query_id, bucket, list(noun) AS usable FROM u GROUP BY 1, 2),
k AS (SELECT j.query_id, j.bucket, asset_id, len(list_filter(nouns, lambda n: len(list_filter(about, lambda a: n = a OR (length(n) >= 2 AND contains(a, n)) OR (length(a) >= 2 AND contains(n, a)))) > 0)) > 0 OR len(list_filter(coalesce(usable, []), lambda n: contains(kw, n))) > 0 AS keep FROM j LEFT JOIN g USING (query_id, bucket))
SELECT query_id, bucket, asset_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id, bucket) AS hit FROM k) WHERE keep OR NOT hit"""
)
def about_filtered(spark, d):
    """Rows that share an entity or a telling noun with their query; groups that would lose all keep all."""
    rows = X.load(spark, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), F.col("lang").alias("bucket"), F.col("doc_id").alias("asset_id"), F.array("lang", "source").alias("about"), F.left("text", F.lit(200)).alias("kwtext"))
    asked = X.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.about_filter(rows, asked).select("query_id", "bucket", "asset_id")


@query(
    """WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'two words' UNION ALL SELECT -2, 'no noun here'))
SELECT item_id AS query_id, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) < 3 THEN text ELSE coalesce(nullif(array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(w) AS x, unnest(range(len(w))) AS i) WHERE regexp_matches(x, '^[A-Z]') GROUP BY 1)), ' '), ''), text) END AS query FROM w"""
)
def normalised_queries(spark, d):
    """Queries of three words or more reduced to their nouns; capitalised words stand in for an analyser's nouns."""
    few = spark.createDataFrame([(-1, "two words"), (-2, "no noun here")], "query_id long, query string")
    asked = X.load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).unionByName(few)
    tag = F.transform(F.filter(F.split("query", r"\s+"), lambda x: x != ""), lambda x: F.struct(x.alias("token"), F.when(x.rlike("^[A-Z]"), "NNG").otherwise("JX").alias("pos")))
    return S.normalise_query(asked.withColumn("tokens", tag))


def _ranked(spark, d):
    return X.load(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("query_id"), F.col("l_returnflag").alias("bucket"), F.col("l_partkey").alias("asset_id")).agg(F.round(F.max("l_extendedprice"), 2).alias("similarity"))


_RANKED = "r AS (SELECT l_suppkey % 40 AS query_id, l_returnflag AS bucket, l_partkey AS asset_id, round(max(l_extendedprice), 2) AS similarity FROM lineitem GROUP BY 1, 2, 3)"


@query(
    f"""WITH {_RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, asset_id ORDER BY similarity DESC, bucket) AS i FROM r), t AS (SELECT query_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id) AS k FROM o WHERE i = 1) WHERE k <= 3),
v AS (SELECT query_id, asset_id, CASE WHEN query_id % 5 = 0 AND asset_id % 2 = 0 THEN NULL ELSE asset_id % 3 = 0 END AS keep FROM t), f AS (SELECT *, bool_and(keep IS NOT NULL) OVER (PARTITION BY query_id) AS complete FROM v)
SELECT query_id, bucket, asset_id FROM r ANTI JOIN (SELECT query_id, asset_id FROM f WHERE complete AND NOT keep) x USING (query_id, asset_id)"""
)
def verified_rows(spark, d):
    """Rows that a judge of the first three does not reject; a query without all verdicts is left alone."""
    rows = _ranked(spark, d)
    top = S.merged_ranking(rows).where("rank <= 3").select("query_id", "asset_id")
    verdicts = top.where("not (query_id % 5 = 0 and asset_id % 2 = 0)").withColumn("keep", F.col("asset_id") % 3 == 0)
    return S.verified(rows, verdicts).select("query_id", "bucket", "asset_id")


@query(f"WITH {_RANKED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, asset_id, bucket) AS rank FROM r), g AS (SELECT query_id, max(CASE WHEN query_id % 8 = 7 THEN 1 ELSE 0 END) = 1 AS empty FROM r GROUP BY 1), rel AS (SELECT DISTINCT query_id, asset_id FROM r WHERE query_id % 8 <> 7 AND asset_id % 4 = 0), "
       "p AS (SELECT query_id, count(*) FILTER (WHERE rank <= 20 AND rel.asset_id IS NOT NULL) AS h20, count(*) FILTER (WHERE rank <= 3 AND rel.asset_id IS NOT NULL) AS h3, count(*) AS shown FROM k LEFT JOIN rel USING (query_id, asset_id) WHERE query_id % 16 <> 15 AND rank <= 40 GROUP BY 1), "
       "a AS (SELECT g.query_id, empty, coalesce(h20, 0) AS h20, coalesce(h3, 0) AS h3, coalesce(shown, 0) AS shown, (SELECT count(*) FROM rel WHERE rel.query_id = g.query_id) AS n FROM g LEFT JOIN p USING (query_id)) "
       "SELECT round(avg(CASE WHEN NOT empty THEN CASE WHEN n > 0 THEN h20 / n ELSE 0 END END), 6) AS recall_20, round(avg(CASE WHEN NOT empty THEN h3 / greatest(1, least(3, shown)) END), 6) AS precision_3, round(count(*) FILTER (WHERE empty AND shown = 0) / count(*) FILTER (WHERE empty), 6) AS block_rate, count(*) FILTER (WHERE empty AND shown > 0) AS leaks FROM a")
def golden_figures(spark, d):
    """Recall, precision, block rate and leaks of a ranking."""
    from pyspark.sql import Window

    rows = _ranked(spark, d)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "asset_id", "bucket"))).where("rank <= 40 and query_id % 16 <> 15").select("query_id", F.col("asset_id").alias("id"), "rank")
    asked = rows.select("query_id").distinct().withColumn("expect_empty", F.col("query_id") % 8 == 7)
    relevant = rows.where("query_id % 8 <> 7 and asset_id % 4 = 0").select("query_id", F.col("asset_id").alias("id"))
    got = M.golden_report(ranked, asked, relevant)
    return got.select(*[F.round(c, 6).alias(c) for c in ("recall_20", "precision_3", "block_rate")], "leaks")


# --- relations -------------------------------------------------------------------------------------------------


def _answers(spark, d):
    """Model answers made of orders: one JSON object a customer and order status; some are lists under another name, some single edges, some broken."""
    o = X.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    edge = F.struct(
        _uuid(F.col("o_orderkey")).alias("target_media_item_id"),
        F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.concat(F.lit(" Kind_"), F.lower(F.substring("o_orderpriority", 1, 1)))).alias("relation_type_code"),
        F.round(F.col("o_totalprice") / 200000, 3).cast("string").alias("confidence"),
        F.concat(F.lit("because of "), "o_orderpriority", F.lit("\nmore")).alias("reason"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("t."), "o_orderstatus", F.lit(" x"))).alias("topic"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Sub "), "o_orderstatus")).alias("sub_topic_ko"),
    )
    lists = o.groupBy(F.col("o_custkey").alias("source")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", edge.alias("e")))).alias("l")).select("source", F.transform("l", lambda x: x["e"]).alias("edges"))
    kind = F.col("source") % 5
    text = F.when(kind == 4, F.concat(F.lit("{broken"), F.to_json("edges"))).when(kind == 3, F.to_json(F.get("edges", F.lit(0)))).when(kind == 2, F.to_json(F.struct(F.col("edges").alias("items")))).otherwise(F.to_json(F.struct("edges")))
    return lists.select(F.col("source").cast("string").alias("source"), text.alias("answer"))


_PROPOSED = """o AS (SELECT o_custkey AS source, o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(o_orderkey AS VARCHAR)), 21, 12) AS target,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'kind_' || lower(substr(o_orderpriority, 1, 1)) END AS kind_code, least(1.0, round(o_totalprice / 200000, 3)) AS confidence, 'because of ' || o_orderpriority || chr(10) || 'more' AS reason,
  CASE WHEN o_orderkey % 3 = 0 THEN 't.' || o_orderstatus ELSE 'because' END AS topic_ko, CASE WHEN o_orderkey % 2 = 0 THEN 'Sub' ELSE '' END AS subtopic_ko, 'general' AS topic_en, '' AS subtopic_en, o_orderkey % 3 <> 0 AS topic_auto,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS seq FROM orders),
pr AS (SELECT CAST(source AS VARCHAR) AS source, seq, target, kind_code, confidence, reason, topic_ko, subtopic_ko, topic_en, subtopic_en, topic_auto, false AS malformed FROM o WHERE source % 5 < 3 OR (source % 5 = 3 AND seq = 0)
  UNION ALL SELECT DISTINCT CAST(source AS VARCHAR), NULL, NULL, NULL, 0.0, NULL, '일반', '', 'general', '', true, true FROM o WHERE source % 5 = 4)"""


@query(f"WITH {_PROPOSED} SELECT * FROM pr")
def parsed_proposals(spark, d):
    """Proposed edges of model answers, with aliases and fallbacks of their topics; broken answers are one row each."""
    return R.parse_proposals(_answers(spark, d))


def _candidates(spark, d):
    o = X.load(spark, d, "orders").where("o_orderstatus <> 'P' and o_orderkey % 5 <> 0")
    return o.select(F.col("o_custkey").cast("string").alias("source"), _uuid(F.col("o_orderkey")).alias("target"), F.round(F.col("o_totalprice") / 600000, 3).alias("sim"))


_KIND_ROWS = [("kind_1", "active", True), ("kind_2", "active", False), ("kind_3", "inactive", True), ("same_domain", "active", True)]
_SYNC = f""", {_PROPOSED}, ca AS (SELECT CAST(o_custkey AS VARCHAR) AS source, o_orderkey, round(o_totalprice / 600000, 3) AS sim FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0),
cu AS (SELECT ca.source, o.target, sim FROM ca JOIN o USING (o_orderkey)),
ac AS (SELECT pr.*, sim, CASE WHEN cu.target IS NULL THEN 'not_a_candidate' WHEN kind_code IS NULL THEN 'no_kind' WHEN kind_code NOT IN ('kind_1', 'kind_2') THEN 'kind_not_active' END AS reject FROM pr LEFT JOIN cu ON cu.source = pr.source AND cu.target = pr.target WHERE NOT malformed),
ex AS (SELECT CASE WHEN kind_code = 'kind_1' AND target < source THEN target ELSE source END AS src, CASE WHEN kind_code = 'kind_1' AND target < source THEN source ELSE target END AS dst, kind_code, 0.5 AS confidence, 'old' AS reason, 'old' AS topic, 'rejected' AS status FROM ac WHERE reject IS NULL AND CAST(source AS BIGINT) % 3 = 0),
nw AS (SELECT CASE WHEN kind_code = 'kind_1' AND target < source THEN target ELSE source END AS src, CASE WHEN kind_code = 'kind_1' AND target < source THEN source ELSE target END AS dst, kind_code, confidence, reason, topic_ko AS topic, CASE WHEN confidence >= 0.6 AND sim >= 0.25 AND kind_code <> 'kind_2' THEN 'active' ELSE 'proposed' END AS status FROM ac WHERE reject IS NULL)"""


def _synced(spark, d):
    kinds = spark.createDataFrame(_KIND_ROWS, "kind_code string, status string, is_symmetric boolean")
    proposals, candidates = R.parse_proposals(_answers(spark, d)), _candidates(spark, d)
    own = R.accepted(proposals, candidates, kinds).where("reject_reason is null and source % 3 = 0")
    old = R.canonical(own.select(F.col("source").alias("src"), F.col("target").alias("dst"), "is_symmetric", "kind_code")).select(*R.KEY, F.lit(0.5).alias("confidence"), F.lit("old").alias("reason"), F.lit("old").alias("topic"), F.lit("rejected").alias("status"))
    return O.sync_edges(old, proposals, candidates, kinds, 0.6, 0.25, 0.7, ["kind_2"])


@query(
    "WITH " + _SYNC.lstrip(", ")
    + """ SELECT src, dst, kind_code, CASE WHEN ex.status IS NULL THEN nw.confidence ELSE greatest(ex.confidence, nw.confidence) END AS confidence, CASE WHEN ex.status IS NULL OR nw.confidence > ex.confidence THEN nw.reason ELSE ex.reason END AS reason,
CASE WHEN ex.status IS NULL OR nw.confidence > ex.confidence THEN nw.topic ELSE ex.topic END AS topic, coalesce(ex.status, nw.status) AS status FROM ex FULL JOIN nw USING (src, dst, kind_code)"""
)
def edge_sync(spark, d):
    """Edges after proposals were checked, gated, put in order and merged."""
    return _synced(spark, d)[0]


@query("WITH " + _SYNC.lstrip(", ") + " SELECT source, count(*) FILTER (WHERE reject IS NULL) AS upserted, count(*) FILTER (WHERE reject IS NOT NULL) AS skipped, 0::BIGINT AS gated_low_conf FROM ac GROUP BY 1")
def edge_sync_counts(spark, d):
    """How many proposals of each source were taken and turned down."""
    return _synced(spark, d)[1]


@query(with_views(", r AS (SELECT DISTINCT asset_id FROM asset JOIN topic USING (asset_id) WHERE status = 'registered'), p AS (SELECT s.asset_id AS source, t.asset_id AS target, list_dot_product(s.v, t.v) / sqrt(list_dot_product(s.v, s.v) * list_dot_product(t.v, t.v)) AS sim FROM emb s JOIN emb t ON s.channel = t.channel AND s.asset_id <> t.asset_id WHERE t.asset_id IN (SELECT asset_id FROM r)), b AS (SELECT source, target, round(max(sim), 6) AS sim FROM p GROUP BY 1, 2 HAVING round(max(sim), 6) >= 0.2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM b) WHERE rank <= 5) SELECT source, target, sim, CAST(rank AS INTEGER) AS rank, modality, regexp_replace(fs_path, '^.*/', '') AS file_name, topic.topic, subtopic, summary, lang AS keywords FROM k JOIN asset ON asset.asset_id = target JOIN topic ON topic.asset_id = target", "asset", "emb", "topic"))
def gated_candidates(spark, d):
    """Similar assets among those that are registered and have a topic, with what a prompt needs of them."""
    from ..operators.vectors import similarity_candidates

    a, t, e = X.assets(spark, d), X.asset_topics(spark, d), X.asset_embeddings(spark, d)
    got = similarity_candidates(e, e.select("asset_id"), 5, 0.2, targets=O.reachable(a, t))
    return O.candidate_rows(got, a, a.select("asset_id", "summary", F.col("lang").alias("keywords")), t).select("source", "target", "sim", "rank", "modality", "file_name", "topic", "subtopic", "summary", "keywords")


@query(with_views("SELECT a.asset_id AS source, md5(a.summary) AS digest, contains(a.summary, ' ') AS spaced, 'topic: ' || t.topic || CASE WHEN t.subtopic = '' THEN '' ELSE ' / ' || t.subtopic END || ' medium: ' || a.modality || ' file: ' || regexp_replace(fs_path, '^.*/', '') || ' text: ' || left(a.summary, 1200) AS prompt FROM asset a JOIN topic t USING (asset_id)", "asset", "topic"))
def proposal_prompts(spark, d):
    """Prompts of all sources that have a topic, by a short template."""
    a, t = X.assets(spark, d), X.asset_topics(spark, d)
    rows = O.source_rows(a.drop("summary"), a.select("asset_id", "summary", F.lit(None).cast("string").alias("keywords")), t)
    none = O.candidate_rows(spark.createDataFrame([], "source long, target long, sim double, position int"), a, a.select("asset_id", "summary", F.col("lang").alias("keywords")), t)
    kinds = spark.createDataFrame(_KIND_ROWS, "kind_code string, status string, is_symmetric boolean").withColumns({"kind_name": F.lit("n"), "description": F.lit("d")})
    made = O.prompts(rows, none, kinds, ["en"], "topic: {topic} medium: {medium} file:{file_name} text: {summary}")
    short = F.replace("prompt", F.lit("file:\nSource file: "), F.lit("file: "))
    return made.join(a.select(F.col("asset_id").alias("source"), "summary"), "source").select("source", F.md5("summary").alias("digest"), F.contains("summary", F.lit(" ")).alias("spaced"), short.alias("prompt"))


@query(with_views("SELECT edge_id, CASE WHEN decided = 'approve' THEN 'active' WHEN decided = 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN decided IS NOT NULL THEN 'me' END AS reviewed_by FROM (SELECT src || ':' || dst || ':' || kind_code AS edge_id, status, CASE WHEN status = 'proposed' AND kind_code <> 'R' THEN CASE WHEN confidence >= 0.5 THEN 'approve' ELSE 'reject' END END AS decided FROM edge)", "edge"))
def reviewed_edges(spark, d):
    """Edges after decisions; later decisions on an edge, and those on edges that are not open, change nothing."""
    return _reviewed(spark, d)[0].select("edge_id", "status", "reviewed_by")


def _reviewed(spark, d):
    e = X.graph_edges(spark, d).withColumns({"edge_id": F.concat_ws(":", *R.KEY), "reviewed_by": F.lit(None).cast("string")})
    own = e.where("kind_code <> 'R'")
    first = own.select("edge_id", F.lit(1).alias("seq"), F.when(F.col("confidence") >= 0.5, "approve").otherwise("reject").alias("action"), F.lit("me").alias("by"))
    return R.review_decisions(e, first.unionByName(own.select("edge_id", F.lit(2).alias("seq"), F.lit("reject").alias("action"), F.lit("you").alias("by"))))


@query(with_views("SELECT src || ':' || dst || ':' || kind_code AS edge_id, s.seq, s.seq = 1 AND status = 'proposed' AS ok FROM edge, (SELECT unnest([1, 2]) AS seq) s WHERE kind_code <> 'R'", "edge"))
def review_outcomes(spark, d):
    """Which decisions took effect."""
    return _reviewed(spark, d)[1].select("edge_id", "seq", "ok")


@query(with_views(", r AS (SELECT *, src || ':' || dst || ':' || kind_code AS edge_id, CASE WHEN kind_code = 'A' THEN 'me' END AS who FROM edge), s AS (SELECT edge_id, CASE WHEN kind_code = 'N' THEN 'active' ELSE status END AS status, confidence, who FROM r), t AS (SELECT edge_id, CASE WHEN who IS NULL THEN 'proposed' ELSE status END AS status, CASE WHEN who IS NOT NULL THEN confidence END AS confidence, who FROM s) SELECT edge_id, status, confidence, who AS reviewed_by FROM t WHERE confidence IS NOT NULL OR who IS NOT NULL", "edge"))
def rescored_edges(spark, d):
    """Revised edges, reset for scoring where nobody reviewed them, and purged of what was never scored."""
    e = X.graph_edges(spark, d).withColumns({"edge_id": F.concat_ws(":", *R.KEY), "reviewed_by": F.when(F.col("kind_code") == "A", "me")})
    revised = R.revise(e, e.where("kind_code = 'N'").select("edge_id", F.lit("active").alias("to")))
    return R.purge_unscored(R.reset_for_rescore(revised), 0).select("edge_id", "status", "confidence", "reviewed_by")


@query(with_views("SELECT asset, other, direction, kind_code, tier, CAST(row_number() OVER (PARTITION BY asset ORDER BY confidence DESC NULLS LAST, other, kind_code) AS INTEGER) AS position FROM (SELECT src AS asset, dst AS other, CASE WHEN is_symmetric THEN 'undirected' ELSE 'outbound' END AS direction, kind_code, confidence, 'strong' AS tier, status FROM edge UNION ALL SELECT dst, src, CASE WHEN is_symmetric THEN 'undirected' ELSE 'inbound' END, kind_code, confidence, 'strong', status FROM edge) WHERE status = 'active' AND asset IN (SELECT DISTINCT src FROM edge WHERE kind_code = 'R')", "edge"))
def strong_neighbours(spark, d):
    """Neighbours of some nodes by approved edges alone, the default."""
    e = X.graph_edges(spark, d)
    none = spark.createDataFrame([], "asset_id string, modality string, fs_path string")
    return R.neighbours(e, none, e.where("kind_code = 'R'").select("src")).select("asset", "other", "direction", "kind_code", "tier", "position")


@query(with_views("SELECT 'total' AS what, count(*) AS n FROM edge WHERE status = 'proposed' AND kind_code <> 'A' UNION ALL SELECT 'exempt', count(*) FILTER (WHERE kind_code = 'A') FROM edge UNION ALL SELECT 'auto', count(*) FILTER (WHERE confidence >= 0.9 AND kind_code <> 'A') FROM edge", "edge"))
def review_totals(spark, d):
    """Open edges, exempt ones, and those that a bar of 0.9 would approve."""
    e = X.graph_edges(spark, d).withColumn("edge_id", F.concat_ws(":", *R.KEY))
    total = R.review_page(e, R.review_filter(exempt=["A"]))[0].select(F.lit("total").alias("what"), F.col("total").alias("n"))
    exempt = e.agg(F.count_if(R.is_review_exempt(F.col("kind_code"), ["A"])).alias("n")).select(F.lit("exempt").alias("what"), "n")
    auto = O.auto_approvable(e, 0.9, ["A"]).agg(F.count("*").alias("n")).select(F.lit("auto").alias("what"), "n")
    return total.unionByName(exempt).unionByName(auto)


@query(
    """WITH k AS (SELECT 'click' AS kind_code, 'Click' AS kind_name, 'old' AS description, true AS is_symmetric, 'active' AS status UNION ALL SELECT 'view', 'View', 'old', false, 'inactive'), n AS (SELECT event_type AS kind_code, min(event_id) AS seq FROM events GROUP BY 1), r AS (SELECT n.kind_code, 'id ' || seq AS reason FROM n ANTI JOIN k USING (kind_code)),
a AS (SELECT * FROM k UNION ALL SELECT kind_code, replace(kind_code, '_', ' '), replace(kind_code, '_', ' ') || chr(10) || reason, true, 'inactive' FROM r)
SELECT kind_code, CASE WHEN kind_code = 'view' THEN 'Seen' ELSE kind_name END AS kind_name, description, is_symmetric, CASE WHEN kind_code = 'error' THEN 'active' ELSE status END AS status FROM a"""
)
def kind_registry(spark, d):
    """Kinds after new codes were registered, names changed and one kind promoted."""
    kinds = spark.createDataFrame([("click", "Click", "old", True, "active"), ("view", "View", "old", False, "inactive")], "kind_code string, kind_name string, description string, is_symmetric boolean, status string")
    news = X.load(spark, d, "events").select(F.col("event_type").alias("kind_code"), F.concat(F.lit("id "), "event_id").alias("reason"), F.col("event_id").alias("seq"))
    after = R.register_kinds(kinds, news)
    after = R.upsert_kinds(after, spark.createDataFrame([("view", "Seen", " ", None, None)], "kind_code string, kind_name string, description string, is_symmetric boolean, status string"))
    return R.list_kinds(R.promote_kind(after, "error"))


# --- topics and one-off transforms -----------------------------------------------------------------------------


@query("SELECT source AS parent, lang AS subtopic, CASE lang WHEN 'en' THEN NULL WHEN 'de' THEN 'DE' WHEN 'fr' THEN CASE WHEN source = 'src1' THEN 'gallic' ELSE 'fr' END ELSE lang END AS canonical, count(*) AS n FROM documents GROUP BY 1, 2")
def canonical_subtopics(spark, d):
    """Subtopics by alias and by a judged synonym; media words have none."""
    aliases = spark.createDataFrame([("src1", "fr", "gallic"), (None, "x", "y")], "parent_topic string, raw_ko string, canonical_ko string")
    own = X.load(spark, d, "documents").groupBy(F.col("source").alias("parent"), F.col("lang").alias("subtopic")).agg(F.count("*").alias("n"))
    named = own.withColumn("raw", F.col("subtopic")).withColumn("subtopic", F.when(F.col("subtopic") == "en", "Video").otherwise(F.col("subtopic")))
    near = named.where("subtopic = 'de'").select("parent", "subtopic", F.lit("DE").alias("synonym"))
    return P.canonical_subtopics(named, aliases, near).select("parent", F.col("raw").alias("subtopic"), "canonical", "n")


@query("SELECT lang AS raw_ko, CASE WHEN lang = 'en' THEN 'kept' ELSE min(source) END AS canonical_ko FROM documents GROUP BY 1")
def frozen_aliases(spark, d):
    """Aliases after new ones were added once each; those that are there stay."""
    table = spark.createDataFrame([("en", "kept", None)], "raw_ko string, canonical_ko string, parent_topic string")
    new = X.load(spark, d, "documents").select(F.col("lang").alias("raw_ko"), F.col("source").alias("canonical_ko"), F.lit(None).cast("string").alias("parent_topic"))
    return P.insert_ignore(table, new, ["raw_ko", "parent_topic"]).select("raw_ko", "canonical_ko")


@query("SELECT DISTINCT source AS parent, lang || '·' || source AS subtopic, 'unknown_parent' AS problem FROM documents WHERE source > 'src4' UNION ALL SELECT DISTINCT source, lang || '·' || source, 'overlaps_topic' FROM documents WHERE lang = 'en' AND source <> 'en'")
def seed_problems(spark, d):
    """Faults of a seed: parents that are no topic, names that overlap one."""
    docs = X.load(spark, d, "documents")
    topics = docs.where("source <= 'src4'").select(F.col("source").alias("topic_ko")).distinct().unionByName(spark.createDataFrame([("en",)], "topic_ko string"))
    subs = docs.select(F.col("source").alias("parent"), F.concat("lang", F.lit("·"), "source").alias("subtopic")).distinct()
    return P.seed_problems(topics, subs)


@query("SELECT doc_id, topic, topic_en, weight FROM (SELECT doc_id, lang AS topic, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN NULL END AS topic_en, 1 AS weight FROM documents)")
def topic_labels(spark, d):
    """Topic rows with weight 1 and the registry's English label."""
    registry = spark.createDataFrame([("en", "english", None), ("de", " ", None), ("fr", "x", "en")], "topic_ko string, topic_en string, parent_topic string")
    return P.english_labels(P.own_topic(X.load(spark, d, "documents").select("doc_id", F.col("lang").alias("topic"))), registry).select("doc_id", "topic", "topic_en", "weight")


@query("SELECT lang AS topic FROM documents EXCEPT SELECT CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END FROM benchmark")
def uncovered_topics(spark, d):
    """Topics of the corpus that no golden query has."""
    return Q.uncovered(X.load(spark, d, "documents").select("lang"), X.load(spark, d, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "en").otherwise("de")))


@query("SELECT user_id, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(r, x))), ',') AS partial FROM (SELECT user_id, list(DISTINCT event_type) AS p, coalesce(list(DISTINCT event_type) FILTER (WHERE value > 50), []) AS r FROM events GROUP BY 1)")
def partial_answers(spark, d):
    """Partial answers less what is relevant anyway."""
    e = X.load(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("partial"), F.collect_set(F.when(F.col("value") > 50, F.col("event_type"))).alias("relevant"))
    return Q.partial_only(e).select("user_id", F.array_join("partial", ",").alias("partial"))


@query("SELECT event_type AS kind, user_id % 4 AS arm, count(*) AS n FROM events GROUP BY 1, 2")
def kind_counters(spark, d):
    """How often each kind occurs in each arm."""
    return Q.kind_counts(X.load(spark, d, "events").withColumn("arm", F.col("user_id") % 4), ["arm"], "event_type").select("kind", "arm", "n")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE lang IN ('en', 'fr')) AS in_list, round(count(*) FILTER (WHERE lang IN ('en', 'fr')) / count(*), 4) AS rate FROM documents")
def closed_rate(spark, d):
    """Share of labels that are in a closed vocabulary."""
    return Q.in_list_rate(X.load(spark, d, "documents"), "lang", spark.createDataFrame([("en",), ("fr",), ("it",)], "v string"))


@query("SELECT l_orderkey, l_linenumber, 'k' || l_returnflag AS kind_code, '{\"topic_ko\":\"' || n_name || '\",\"subtopic_ko\":\"' || s_name || '\",\"topic_en\":\"\",\"subtopic_en\":\"\"}' AS topic FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def backfilled_edges(spark, d):
    """An update from joins: kind and topic of the old type."""
    e = X.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_suppkey", "l_returnflag").alias("relation_type_id"), F.lit(None).cast("string").alias("kind_code"), F.lit("{}").alias("topic"))
    types = X.load(spark, d, "lineitem").select(F.concat_ws("-", "l_suppkey", "l_returnflag").alias("relation_type_id"), F.concat(F.lit("k"), "l_returnflag").alias("kind_code"), F.col("l_suppkey").alias("subtopic_id")).distinct()
    subs = X.load(spark, d, "supplier").select(F.col("s_suppkey").alias("subtopic_id"), F.col("s_nationkey").alias("topic_id"), F.col("s_name").alias("subtopic_ko"), F.lit(None).cast("string").alias("subtopic_en"))
    parents = X.load(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("topic_ko"), F.lit(None).cast("string").alias("topic_en"))
    return G.backfill_kinds(e, types, subs, parents).select("l_orderkey", "l_linenumber", "kind_code", "topic")


@query("SELECT CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'text' ELSE 'unknown' END AS modality, CAST(r_regionkey AS BIGINT) AS asset_id FROM region")
def canonical_media(spark, d):
    """Kinds of files as media."""
    r = X.load(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("asset_id"), F.when(F.col("r_name") == "ASIA", "pdf").when(F.col("r_name") == "EUROPE", "text").otherwise("zip").alias("modality"))
    return G.canonical_modality(r)


@query("SELECT domain, meta_key, access_tier FROM (SELECT 'general' AS domain, n_name AS meta_key, 'public' AS access_tier FROM nation UNION ALL SELECT 'medical', n_name, 'regulated' FROM nation UNION ALL SELECT 'medical', 'own', 'public')")
def copied_fields(spark, d):
    """A domain's fields copied to another; existing keys are overwritten."""
    n = X.load(spark, d, "nation").select(F.lit("general").alias("domain"), F.col("n_name").alias("meta_key"), F.lit("public").alias("access_tier"))
    more = n.where("meta_key like 'A%'").withColumn("domain", F.lit("medical")).unionByName(spark.createDataFrame([("medical", "own", "public")], "domain string, meta_key string, access_tier string"))
    return G.copy_domain(n.unionByName(more), "general", "medical", "regulated")


@query("SELECT k AS kind_code, r_regionkey AS subtopic_id FROM region, (SELECT unnest(['kind_1', 'kind_2', 'same_domain']) AS k) WHERE NOT (k = 'kind_1' AND r_regionkey = 0)")
def seeded_types(spark, d):
    """Active kinds with each default subtopic, but for those that exist."""
    kinds = spark.createDataFrame(_KIND_ROWS, "kind_code string, status string, is_symmetric boolean")
    subs = X.load(spark, d, "region").select(F.col("r_regionkey").alias("subtopic_id"))
    return G.seed_types(kinds, subs, subs.where("subtopic_id = 0").withColumn("kind_code", F.lit("kind_1")))


# --- reports ---------------------------------------------------------------------------------------------------


def _arms(spark, d):
    """A snapshot made of line items: parts are sources, suppliers targets."""
    l = X.load(spark, d, "lineitem")  # noqa: E741
    c = l.where("l_quantity < 40").groupBy(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).agg(F.max("l_discount").alias("score"))
    p = l.groupBy(F.concat(F.lit("p"), "l_partkey").alias("source"), F.when(F.col("l_linenumber") == 7, F.concat(F.lit("p"), "l_partkey")).otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("target"), F.col("l_returnflag").alias("kind")).agg(F.max("l_tax").alias("confidence"))
    return c, p


_ARMS = """c AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, max(l_discount) AS score FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2),
p AS (SELECT 'p' || l_partkey AS source, CASE WHEN l_linenumber = 7 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS target, l_returnflag AS kind, max(l_tax) AS confidence FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT p.*, CASE WHEN source = target THEN 'self' WHEN c.source IS NULL THEN 'hallucinated' ELSE 'kept' END AS gate FROM p LEFT JOIN (SELECT DISTINCT source, target FROM c) c USING (source, target))"""


@query(f"WITH {_ARMS} SELECT count(*) AS proposed, count(*) FILTER (WHERE gate = 'hallucinated') AS hallucinated, count(*) FILTER (WHERE gate = 'self') AS self_ref, count(*) FILTER (WHERE gate = 'kept') AS kept FROM g")
def snapshot_gates(spark, d):
    """What the gates take from the proposals of a snapshot."""
    return Q.gate_stats(*_arms(spark, d))


@query(
    f"""WITH {_ARMS}, k AS (SELECT kind AS arm, least(source, target) AS lo, greatest(source, target) AS hi, source, target FROM g WHERE gate = 'kept'), v AS (SELECT DISTINCT lo, hi, CASE WHEN hi LIKE '%1' THEN 'strong' WHEN hi LIKE '%2' THEN 'error' ELSE 'weak' END AS verdict FROM k WHERE hi NOT LIKE '%3'),
j AS (SELECT arm, count(*) AS pair_count, count(*) FILTER (WHERE verdict IN ('strong', 'weak', 'none')) AS rated, count(*) FILTER (WHERE verdict = 'strong') AS strong_count, count(*) FILTER (WHERE verdict = 'weak') AS weak_count, 0::BIGINT AS none_count FROM (SELECT DISTINCT arm, lo, hi FROM k) LEFT JOIN v USING (lo, hi) GROUP BY 1)
SELECT arm, (SELECT count(*) FROM k x WHERE x.arm = j.arm) AS edge_count, pair_count, rated, strong_count, weak_count, none_count, (SELECT count(DISTINCT a) FROM (SELECT arm, source AS a FROM k UNION ALL SELECT arm, target FROM k) y WHERE y.arm = j.arm) AS assets_with_edge FROM j"""
)
def compared_arms(spark, d):
    """Figures of the arms of an experiment, from kept proposals and verdicts on pairs."""
    own = Q.gated(*_arms(spark, d)).where("gate = 'kept'").withColumn("arm", F.col("kind"))
    pairs = M.unordered(own, "source", "target").select("lo", "hi").distinct().where("hi not like '%3'")
    verdicts = pairs.withColumn("verdict", F.when(F.col("hi").endswith("1"), "strong").when(F.col("hi").endswith("2"), "error").otherwise("weak"))
    return Q.compare_arms(own, verdicts)


def _report(spark, d):
    c, p = _arms(spark, d)
    pairs = c.where("score >= 0.05").select(F.concat(F.lit("/"), "source").alias("a"), F.concat(F.lit("/"), "target").alias("b"), F.lit("A").alias("kind"))
    ids = c.select("source").union(c.select("target")).distinct().where("source <> 's1'")
    alone = X.load(spark, d, "part").select(F.concat(F.lit("/p"), "p_partkey").alias("key")).where("key like '%7'")
    keys = ids.select(F.concat(F.lit("/"), "source").alias("key"), F.col("source").alias("asset_id"))
    return Q.report(pairs, alone, keys, c.where("score >= 0.08"), p, 0.02, [0.0, 0.04])


_REPORT = f"""WITH {_ARMS}, ids AS (SELECT DISTINCT x FROM (SELECT source AS x FROM c UNION ALL SELECT target FROM c) WHERE x <> 's1'), gp AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM c WHERE score >= 0.05 AND source IN (FROM ids) AND target IN (FROM ids)),
al AS (SELECT 'p' || p_partkey AS x FROM part WHERE p_partkey % 10 = 7 AND 'p' || p_partkey IN (FROM ids)), fc AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM c WHERE score >= 0.08),
th AS (SELECT unnest([0.0, 0.02, 0.04]) AS t), e AS (SELECT t, least(source, target) AS lo, greatest(source, target) AS hi, kind, source, target FROM p JOIN th ON confidence >= t), je AS (SELECT e.*, gp.lo IS NOT NULL AS hit FROM e LEFT JOIN gp USING (lo, hi)),
m AS (SELECT t, count(*) FILTER (WHERE hit) / count(*) AS precision, count(*) FILTER (WHERE hit AND kind = 'A') / nullif(count(*) FILTER (WHERE hit), 0) AS kind_accuracy FROM je GROUP BY 1),
rc AS (SELECT t, count(DISTINCT (lo, hi)) FILTER (WHERE hit) / (SELECT count(*) FROM gp) AS recall FROM je GROUP BY 1), iso AS (SELECT t, (SELECT count(*) FROM al WHERE x NOT IN (SELECT source FROM e y WHERE y.t = th.t UNION ALL SELECT target FROM e y WHERE y.t = th.t)) / (SELECT count(*) FROM al) AS isolation_accuracy FROM th)"""


@query(_REPORT + " SELECT (SELECT count(*) FROM c WHERE score >= 0.05 AND source IN (FROM ids) AND target IN (FROM ids)) AS n_golden_pairs, (SELECT count(*) FROM al) AS n_isolated, round((SELECT count(*) FROM gp SEMI JOIN fc USING (lo, hi)) / (SELECT count(*) FROM gp), 6) AS candidate_recall, round(precision, 6) AS precision, round(recall, 6) AS recall, round(kind_accuracy, 6) AS kind_accuracy, round(isolation_accuracy, 6) AS isolation_accuracy FROM m JOIN rc USING (t) JOIN iso USING (t) WHERE t = 0.02")
def report_summary(spark, d):
    """A quality report's figures; keys that lead to no asset are left out."""
    return _report(spark, d)["summary"].select("n_golden_pairs", "n_isolated", *[F.round(c, 6).alias(c) for c in ("candidate_recall", "precision", "recall", "kind_accuracy", "isolation_accuracy")])


@query(_REPORT + " SELECT CAST(t AS DOUBLE) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(kind_accuracy, 6) AS kind_accuracy, round(isolation_accuracy, 6) AS isolation_accuracy FROM m JOIN rc USING (t) JOIN iso USING (t) WHERE t <> 0.02")
def report_sweep(spark, d):
    """The same report by threshold."""
    return _report(spark, d)["sweep"].select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "kind_accuracy", "isolation_accuracy")])


@query(f"WITH {_ARMS}, k AS (SELECT DISTINCT '/' || source AS key FROM c WHERE score >= 0.05 UNION SELECT '/' || target FROM c WHERE score >= 0.05 UNION SELECT '/p' || p_partkey FROM part WHERE p_partkey % 10 = 7) SELECT key FROM k WHERE key NOT IN (SELECT '/' || source FROM c UNION ALL SELECT '/' || target FROM c WHERE target <> 's1')")
def unresolved_keys(spark, d):
    """Keys of the golden set without an asset."""
    return _report(spark, d)["unresolved_keys"]


@query(f"WITH {_ARMS}, s AS (SELECT DISTINCT source FROM c) SELECT c.source, c.target, c.score, kind, confidence FROM c LEFT JOIN p USING (source, target)")
def snapshot_round_trip(spark, d):
    """A snapshot written as JSON and read again."""
    c, p = _arms(spark, d)
    path = f"{shared_dir(spark)}/siltstone/snapshot-{uuid.uuid4().hex}"
    Q.write_json(Q.snapshot_json(c, p.withColumns({"topic_ko": F.lit("t"), "emb_score": F.lit(0.5)}), {"model": "x"}), path)
    c, p = Q.read_snapshot(spark, path)
    return c.join(p, ["source", "target"], "left").select("source", "target", "score", "kind", "confidence")


@query(with_views("SELECT verdict, count(*) AS n, round(count(*) FILTER (WHERE verdict = 'error') / max(total), 6) AS error_rate, max(length(why)) AS longest FROM (SELECT CASE WHEN status = 'active' THEN 'strong' WHEN kind_code = 'R' THEN 'error' ELSE 'weak' END AS verdict, left('because of the edge ' || src, 20) AS why, count(*) OVER () AS total FROM edge) GROUP BY 1", "edge"))
def verdict_round_trip(spark, d):
    """Verdicts written as JSON and read again, counted."""
    e = X.graph_edges(spark, d).select(F.concat_ws(":", *R.KEY).alias("edge_id"), F.when(F.col("status") == "active", "strong").when(F.col("kind_code") == "R", "error").otherwise("weak").alias("verdict"), F.concat(F.lit("because of the edge "), "src").alias("why"), F.sha2("src", 256).alias("prompt_sha256"), F.lit("").alias("judged_by_human"))
    path = f"{shared_dir(spark)}/siltstone/verdicts-{uuid.uuid4().hex}"
    Q.write_json(Q.verdict_json(e, "m-1"), path)
    v = written(Q.read_verdicts(spark, path), "verdicts")
    share = M.verdict_report(v)
    long_ = v.groupBy("verdict").agg(F.max(F.length("why")).cast("long").alias("longest"))
    return share.join(long_, "verdict").select("verdict", "n", F.round(F.when(F.col("verdict") == "error", F.col("error_rate")).otherwise(0.0), 6).alias("error_rate"), "longest")


@query(with_views("SELECT source, target, lo, hi, side FROM (SELECT least(a, b) AS lo, greatest(a, b) AS hi, min(side) AS side FROM (SELECT doc_id AS a, doc_id + 20 AS b, 0 AS side FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id + 20, doc_id, 1 FROM documents) GROUP BY 1, 2), (SELECT 1 AS source, 2 AS target)", "asset"))
def united_pairs(spark, d):
    """Unordered pairs of two sets, with the first set that has them."""
    docs = X.load(spark, d, "documents")
    one = docs.where("lang = 'en'").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b"))
    two = docs.select((F.col("doc_id") + 20).alias("a"), F.col("doc_id").alias("b"))
    return M.pair_union(one, two).select(F.lit(1).alias("source"), F.lit(2).alias("target"), "lo", "hi", "side")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE floor(i * 37 / n) <> floor((i - 1) * 37 / n)")
def strided_sample(spark, d):
    """37 events spread evenly over the order of ids."""
    return M.strided(X.load(spark, d, "events").select("event_id"), 37, "event_id")


@query("SELECT event_type, least(count(*), 25) AS n, count(*) >= 25 AS complete FROM events GROUP BY 1")
def stratified_sample(spark, d):
    """At most 25 events of each type, the same in every run."""
    e = X.load(spark, d, "events")
    a, b = (written(M.stratified(e.repartition(p), ["event_type"], 25, 7, "event_id").select("event_id", "event_type"), "sample") for p in (3, 5))
    if not M.same_rows(a, b):
        raise ValueError("two samples differ")
    return a.groupBy("event_type").agg(F.count("*").alias("n")).join(e.groupBy("event_type").agg((F.count("*") >= 25).alias("complete")), "event_type")


@query(with_views(", g AS (SELECT DISTINCT doc_id AS lo, doc_id + 20 AS hi FROM documents WHERE lang = 'en'), e AS (SELECT doc_id AS source, doc_id + 20 AS target, (doc_id % 10) / 10.0 AS confidence, (doc_id % 7) / 7.0 AS sim FROM documents), t AS (SELECT c, s FROM (SELECT unnest([0.0, 0.5, 0.9]) AS c), (SELECT unnest([0.0, 0.5]) AS s)), m AS (SELECT c, s, count(*) AS approved, count(g.lo) AS hits FROM t JOIN e ON confidence >= c AND sim >= s LEFT JOIN g ON g.lo = least(source, target) AND g.hi = greatest(source, target) GROUP BY 1, 2) SELECT CAST(c AS DOUBLE) AS conf, CAST(s AS DOUBLE) AS sim, approved, hits, round(hits / approved, 6) AS precision, round((SELECT count(*) FROM g SEMI JOIN (SELECT source AS lo, target AS hi FROM e WHERE confidence >= 0.3) USING (lo, hi)) / (SELECT count(*) FROM g), 6) AS recall FROM m", "asset"))
def approve_grid(spark, d):
    """Precision over a grid of bars, beside the recall of candidates."""
    docs = X.load(spark, d, "documents")
    gold = docs.where("lang = 'en'").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b"))
    e = docs.select(F.col("doc_id").alias("source"), (F.col("doc_id") + 20).alias("target"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("confidence"), ((F.col("doc_id") % 7) / F.lit(7.0)).alias("sim"))
    recall = M.candidate_recall(e.where("confidence >= 0.3"), gold)
    return M.approve_sweep(e, gold, [0.0, 0.5, 0.9], [0.0, 0.5]).crossJoin(F.broadcast(recall)).select("conf", "sim", "approved", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(with_views("SELECT src, dst, kind_code, a.modality AS a_modality, a.lang AS a_topic, b.modality AS b_modality, left(b.summary, 300) AS b_summary FROM (SELECT doc_id AS src, doc_id + 20 AS dst, 'x' AS kind_code FROM documents) e JOIN asset a ON a.asset_id = src JOIN asset b ON b.asset_id = dst", "asset"))
def judging_rows(spark, d):
    """Edges with what a judge reads of both ends."""
    docs, a = X.load(spark, d, "documents"), X.assets(spark, d)
    e = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 20).alias("dst"), F.lit("x").alias("kind_code"), F.lit("active").alias("status"))
    got = Q.judging_rows(e, a, a.select("asset_id", "summary", F.col("lang").alias("keywords")), a.select("asset_id", F.col("lang").alias("topic")))
    return got.select("src", "dst", "kind_code", "a_modality", "a_topic", "b_modality", "b_summary")


@query(f"WITH {_PROPOSED}, b AS (SELECT count(DISTINCT source) AS failed FROM pr WHERE malformed), s AS (SELECT count(DISTINCT o_custkey) AS sources FROM orders) SELECT sources, failed, failed > 0.05 * sources AS flagged, (SELECT count(*) FROM pr WHERE NOT malformed) AS frozen FROM b, s")
def snapshot_build(spark, d):
    """Failed answers are counted, and flagged where there are many."""
    answers, candidates = _answers(spark, d), _candidates(spark, d)
    rows, status = Q.build_snapshot(answers, candidates, R.parse_proposals(answers))
    return status.crossJoin(rows.agg(F.count("*").alias("frozen")))  # one row each


# --- streams ---------------------------------------------------------------------------------------------------


def _stream(spark, d, name):
    """The table as a stream: written as three files, read one after the other."""
    path = f"{shared_dir(spark)}/siltstone/stream-{uuid.uuid4().hex}"
    df = X.load(spark, d, name)
    df.repartitionByRange(3, df.columns[0]).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _place(spark):
    return f"{shared_dir(spark)}/siltstone/sink-{uuid.uuid4().hex}"


@query("SELECT user_id, max(event_id) AS event_id, last(event_type ORDER BY event_id) AS event_type, round(last(value ORDER BY event_id), 4) AS value FROM events GROUP BY 1")
def streamed_upserts(spark, d):
    """Events as a stream of changes, merged into a snapshot by user; the last change of each counts."""
    root = _place(spark)
    changes = _stream(spark, d, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    I.upsert_stream(changes, root, ["user_id"], "event_id", f"{root}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return X.read_snapshot(spark, root)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 0")
def streamed_lineage(spark, d):
    """Provenance rows appended for each event, counted."""
    root = _place(spark)
    rows = X.load(spark, d, "events").select(F.col("user_id").cast("string").alias("asset_id"), F.col("event_type").alias("activity"), F.lit("agent").alias("agent"), F.col("props").alias("payload"))
    X.append_lineage(spark, root, rows.where("activity <> 'error'"))
    X.append_lineage(spark, root, rows.where("activity = 'error'"))
    return spark.read.parquet(root).where("occurred_at is not null").groupBy(F.col("asset_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


# --- models as seams, seeds, settings --------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 1 ELSE greatest(1, CAST(ceil(length(text) / 800.0) AS INTEGER)) END AS n_vectors, 64 AS dim, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS norm FROM (SELECT doc_id, left(regexp_replace(text, '\\s+', 'x', 'g'), 2000) AS text FROM documents UNION ALL SELECT -1, '')")
def embedded_chunks(spark, d):
    """Chunks of the first 2,000 characters, embedded by the stub; a document without text has one zero vector."""
    from ..functions.seams import embedder

    docs = X.load(spark, d, "documents").select("doc_id", F.left(F.regexp_replace("text", r"\s+", "x"), F.lit(2000)).alias("text")).unionByName(spark.createDataFrame([(-1, "")], "doc_id long, text string"))
    got = D.document_vectors(D.chunk_rows(docs, 800, 0, "doc_id"), docs, embedder(unit=True), 64, "doc_id")
    return got.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_vectors"), F.max(F.size("embedding")).alias("dim"), F.round(F.max(N.norm(F.col("embedding"))), 6).alias("norm"))


@query("SELECT doc_id, left(string_agg(left(chunk, 12), chr(10) ORDER BY chunk_index), 12) AS summary FROM (" + "SELECT doc_id, unnest(range(len(l))) AS chunk_index, unnest(l) AS chunk FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)) GROUP BY 1 HAVING sum(length(chunk)) >= 40")
def summaries(spark, d):
    """Summaries of summaries of lines by a model that answers with the beginning; short texts have none."""
    from ..functions.seams import summarise

    lines = X.load(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")).alias("chunk_index", "chunk"))
    return summarise(lines, _beginning, "doc_id", least=40).where("summary is not null")


def _beginning(prompt: str) -> str:
    return prompt[:12]


@query("WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM conversations) SELECT conv_id, string_agg('[' || turn || 's] ' || role, chr(10) ORDER BY turn, role) AS summary, CAST(count(*) AS INTEGER) AS n_scenes FROM l WHERE before IS NULL OR before <> role GROUP BY 1")
def scene_summaries(spark, d):
    """Scenes in order of time, repeats of the one before left out; turns of conversations stand in."""
    from ..functions.seams import video_summary

    return video_summary(X.load(spark, d, "conversations").select("conv_id", F.col("turn").cast("double").alias("start_s"), F.col("role").alias("caption")), "conv_id")


@query(with_views("SELECT asset_id, '요약: ' || summary || chr(10) || '키워드: ' || lang AS rrtext FROM asset WHERE asset_id IN (SELECT asset_id FROM emb)", "asset", "emb"))
def rerank_texts(spark, d):
    """What a reranker reads of the assets that were found."""
    a = X.assets(spark, d)
    return S.rerank_texts(a.select("asset_id", "summary", F.array("lang").alias("keywords")), X.asset_embeddings(spark, d))


@query("SELECT CAST(n_nationkey AS INTEGER) AS i, n_name AS topic_ko, lower(n_name) AS topic_en FROM nation")
def seeds_read(spark, d):
    """A seed of topics written as JSON and read in its order."""
    path = f"{shared_dir(spark)}/siltstone/seed-{uuid.uuid4().hex}"
    n = X.load(spark, d, "nation")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("topic_ko"), F.lower("n_name").alias("topic_en")))), lambda x: F.struct(x["topic_ko"].alias("topic_ko"), x["topic_en"].alias("topic_en")))
    Q.write_json(n.agg(rows.alias("topics")).select(F.to_json(F.struct(F.lit(1).alias("version"), "topics")).alias("value")), path)
    return G.read_seed(spark, path, "topics")


@query("SELECT n_name AS a, r_name AS b, 'in' AS kind, '' AS note FROM nation JOIN region ON r_regionkey = n_regionkey")
def golden_read(spark, d):
    """A golden set written as JSON, read and checked."""
    path = f"{shared_dir(spark)}/siltstone/golden-{uuid.uuid4().hex}"
    pairs = X.load(spark, d, "nation").join(X.load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("a"), F.col("r_name").alias("b"), F.lit("in").alias("kind"))).alias("pairs"))
    Q.write_json(pairs.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("fs_path").alias("key_type"), "pairs", F.array(F.lit("x")).alias("isolated"))).alias("value")), path)
    return Q.read_golden(spark, path)[0]


@query("SELECT n_name AS topic_ko, NULL AS parent_topic, 'taxonomy' AS source FROM nation UNION ALL SELECT DISTINCT s_name, n_name, 'seed' FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_name <> 'kept' UNION ALL SELECT 'kept', 'FRANCE', 'auto'")
def seeded_topics(spark, d):
    """A registry whose topics come from a seed and whose subtopics are kept and filled up."""
    registry = spark.createDataFrame([("OLD", None, "auto"), ("kept", "FRANCE", "auto")], "topic_ko string, parent_topic string, source string")
    aliases = spark.createDataFrame([], "raw_ko string, canonical_ko string, decided_by string, parent_topic string")
    n = X.load(spark, d, "nation")
    after, _ = P.apply_seed(registry, aliases, n.select(F.col("n_name").alias("topic_ko")), n.select(F.lower("n_name").alias("raw_ko"), F.col("n_name").alias("canonical_ko")))
    subs = X.load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent_ko"), F.col("s_name").alias("subtopic_ko"))
    return G.seed_subtopics(after, subs)


@query("SELECT event_id, CASE WHEN k < 50 THEN 'k: not one of the values' ELSE '' END || CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN '|' ELSE '' END || 't: not number' ELSE '' END AS faults FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def schema_checks(spark, d):
    """Values that break the schemas of their keys."""
    check = D.schema_violations({"k": {"type": "integer", "enum": list(range(50, 1000))}, "t": {"type": "number"}})
    k = F.get_json_object("props", "$.k").cast("long")
    value = F.when(F.col("event_type") == "error", F.to_json(F.struct(k.alias("k"), F.lit("x").alias("t")))).otherwise(F.to_json(F.struct(k.alias("k"), F.lit(1).alias("t"))))
    return X.load(spark, d, "events").select("event_id", F.array_join(check(value), "|").alias("faults"))


@query(with_views(_PATHS + " SELECT asset_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE word END AS topic FROM n", "asset"))
def name_topics(spark, d):
    """Topics of file names as the corpus guard reads them."""
    return _paths(spark, d).select("asset_id", T.topic_of_filename(T.basename(F.col("fs_path"))).alias("topic"))


@query(with_views("SELECT s.name, s.value FROM (VALUES ('search.cutoff_eps', '0.18'), ('search.weights', '0.2,0.8'), ('relations.exempt', ''), ('relations.excluded', 'same_domain'), ('modalities', 'text,Image')) AS s(name, value)", "asset"))
def settings_values(spark, d):
    """Settings as they are read: a default, a pair, an emptied list, a list left alone, and a request's list of media."""
    from .. import settings

    s = settings.load({"embed.model": "m", "search.fusion_weights": "0.2, 0.8", "relations.review_exempt_kinds": ""})
    rows = [("search.cutoff_eps", str(s.search.cutoff_eps)), ("search.weights", ",".join(map(str, s.search.fusion_weights))), ("relations.exempt", ",".join(sorted(s.relations.review_exempt_kinds))), ("relations.excluded", ",".join(sorted(s.relations.auto_approve_exclude_kinds))), ("modalities", ",".join(settings.parse_modalities(" text, Image,,")))]
    return spark.createDataFrame(rows, "name string, value string")


def _first_candidate(prompt: str) -> str:
    """A model that always relates the source to its first candidate."""
    import json

    lines = [x for x in prompt.split("\n") if x.startswith('{"target_media_item_id"')]
    edges = [{"target_media_item_id": json.loads(lines[0])["target_media_item_id"], "relation_type_code": "references", "confidence": 0.9, "reason": "first of all"}] if lines else []
    return json.dumps({"edges": edges})


_UUID_OF = "substr(md5(CAST({0} AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST({0} AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST({0} AS VARCHAR)), 21, 12)".format


@query(
    with_views(
        f""", a AS (SELECT asset_id AS n, {_UUID_OF('asset_id')} AS id, status, regexp_replace(fs_path, '/[^/]*$', '') AS dir, lower(regexp_replace(regexp_replace(fs_path, '^.*/', ''), '[.][^.]*$', '')) AS raw FROM asset), t AS (SELECT DISTINCT asset_id AS n FROM topic), r AS (SELECT a.* FROM a JOIN t USING (n) WHERE status = 'registered'),
s AS (SELECT id FROM a JOIN t USING (n)), v AS (SELECT {_UUID_OF('asset_id')} AS id, v FROM emb WHERE channel = 'st'),
p AS (SELECT x.id AS source, y.id AS target, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) AS sim FROM v x JOIN v y ON x.id <> y.id WHERE x.id IN (FROM s) AND y.id IN (SELECT id FROM r)),
b AS (SELECT source, target, round(max(sim), 6) AS sim FROM p GROUP BY 1, 2 HAVING round(max(sim), 6) >= 0.2), ec AS (SELECT source, target, 0 AS side, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM b),
o AS (SELECT *, regexp_replace(raw, '(_v[0-9]+|_summary)$', '') AS base FROM r), pc AS (SELECT source, target, 1 AS side, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM (SELECT x.id AS source, y.id AS target, max(CASE WHEN x.raw = y.raw THEN 2 ELSE 1 END) AS score FROM o x JOIN o y ON x.dir = y.dir AND (x.raw = y.raw OR x.base = y.base) AND x.id <> y.id GROUP BY 1, 2)),
f AS (SELECT source, first(target ORDER BY side, rank) AS target FROM (SELECT * FROM ec WHERE rank <= 10 UNION ALL SELECT * FROM pc WHERE rank <= 10) WHERE source IN (FROM s) GROUP BY 1)
SELECT source AS src, target AS dst, 'references' AS kind_code, CAST(0.9 AS DOUBLE) AS confidence, 'first' AS topic, 'active' AS status FROM f""",
        "asset",
        "emb",
        "topic",
    )
)
def proposed_relations(spark, d):
    """One batch over all sources that have a topic, with a model that takes the first candidate."""
    from ..functions.seams import text_model

    a, t, e = X.assets(spark, d), X.asset_topics(spark, d), X.asset_embeddings(spark, d)
    own = lambda df: df.withColumn("asset_id", _uuid(F.col("asset_id")))
    kinds = spark.createDataFrame([("references", "n", "d", False, "active")], "kind_code string, kind_name string, description string, is_symmetric boolean, status string")
    none = spark.createDataFrame([], "src string, dst string, kind_code string, confidence double, reason string, topic string, status string")
    meta = own(a.select("asset_id", "summary", F.col("lang").alias("keywords")))
    got = O.propose(own(a.drop("summary")), meta, own(t), own(e), kinds, none, text_model(_first_candidate), ["en", "de"], auto_approve_min=0.8)
    return got["edges"].select("src", "dst", "kind_code", "confidence", "topic", "status")

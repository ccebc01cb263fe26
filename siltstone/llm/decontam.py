"""Benchmark decontamination over a distributed positional inverted index, with DataFrame functions only.

The index is a table of postings (term, row, position) of every occurrence in the training texts of a term
of the test vocabulary, written to the shared folder; per row one closing posting (term -1) holds the row's
id and number of words. A test item is searched by windows of `width` consecutive words (an item of fewer
words is one window). In each window the two rarest terms by number of postings are taken: the rarest
list proposes alignments, the second list, offset by the distance of the two terms, confirms them. For the
alignments left, the lists of all the item's words are intersected at their offsets, and runs of at least
`width` consecutive words are the matches. With `slop` every term may stand up to that many words off its place
(proximity matches, in a column of their own); 0 gives exact phrases.

The vocabulary, the windows and the confirmed alignments are broadcast only below `BROADCAST_ROWS` rows, which
is counted first. Beyond it the same joins shuffle: those on a word or term are salted by row, since a common word may
be a third of all postings, the others are on (row, position), a key without hot values.

Nulls: a null text has no words and is kept with zero hits; a null item has no windows; a null item id is
named "". Repeated rows are separate documents; repeated items count once by id. Empty tables: no documents
give no rows, no items give rows without hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, pick, scratch_path, table, without

WIDTH = 10
BROADCAST_ROWS = 200_000
SALTS = 64
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = " "  # no word holds a space


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1))


def _store(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` if it is counted to have at most `rows` rows; else let Spark shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _by_term(rows: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """`rows` (with a column row) joined to `small` on a word or term: by broadcast, or dealt out by term and salt."""
    held = _small(small)
    if held is not small:
        return rows.join(held, on, how)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"], how).drop("salt")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vocabulary: word, term), (item words: item, item_id, j, n, term) of the test items."""
    own = pick(items, id=id_col, text=text_col)
    split = _store(own.select(F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text").cast("string")).alias("w")), "items")
    each = split.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
    vocabulary = _store(each.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")
    return vocabulary, _store(each.join(vocabulary, "word").drop("word"), "item-terms")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (row, id, term, pos) of all vocabulary terms in all texts, and a closing posting per row."""
    known = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(_END, -1)], "word string, term long"))
    split = pick(docs, id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("row"), "id", words(F.col("text").cast("string")).alias("w"))
    each = split.select("row", "id", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "word"))
    return _store(_by_term(each, known, "word").select("row", "id", "term", "pos"), "postings")


def matches(postings: DataFrame, terms: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """Runs of matched item words: row, item_id, first and last (word positions in the document).

    Each run covers at least `width` consecutive item words, or a whole shorter item.
    """
    own = postings.where("term >= 0")
    df = _store(own.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    ranked = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # every word belongs to the windows that begin up to width-1 words before it
    last = F.greatest(F.col("n") - width, F.lit(0))
    at = ranked.withColumn("o", F.explode(F.sequence(F.greatest(F.col("j") - (width - 1), F.lit(0)), F.least("j", last))))
    rarest = Window.partitionBy("item", "o").orderBy("df", "j")
    ends = at.withColumn("r", F.row_number().over(rarest)).where("r <= 2").groupBy("item", "o").agg(
        F.min("df").alias("least"), F.min(F.struct("r", "j", "term")).alias("a"), F.max(F.struct("r", "j", "term")).alias("b")
    )
    anchors = _store(ends.where("least > 0").select("item", F.col("a.j").alias("j1"), F.col("a.term").alias("term"), F.col("b.j").alias("j2"), F.col("b.term").alias("term2")).distinct(), "anchors")

    proposed = _by_term(own.select("row", "term", "pos"), anchors, "term").select("row", "item", (F.col("pos") - F.col("j1")).alias("delta"), (F.col("pos") - F.col("j1") + F.col("j2")).alias("pos"), F.col("term2").alias("term"))
    if slop:
        proposed = proposed.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    second = _by_term(own.select("row", "term", "pos"), anchors.select(F.col("term2").alias("term")).distinct(), "term", "left_semi")
    aligned = _store(proposed.join(second, ["row", "term", "pos"]).select("row", "item", "delta").distinct(), "alignments")

    wanted = aligned.join(_small(terms), "item").select("row", "item", "item_id", "n", "delta", "j", "term", (F.col("delta") + F.col("j")).alias("pos"))
    if slop:
        wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("pos") - slop, F.col("pos") + slop)))
    lists = own.select("row", "term", "pos").join(_small(aligned.select("row").distinct()), "row", "left_semi")
    met = lists.join(_small(wanted), ["row", "term", "pos"]).select("row", "item", "item_id", "n", "delta", "j", "pos")
    if slop:
        met = met.groupBy("row", "item", "item_id", "n", "delta", "j").agg(F.min("pos").alias("pos"))
    run = Window.partitionBy("row", "item", "delta").orderBy("j")
    runs = met.withColumn("run", F.col("j") - F.row_number().over(run)).groupBy("row", "item", "item_id", "n", "delta", "run").agg(F.count("*").alias("long"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("long") >= F.least(F.lit(width), F.col("n"))).select("row", "item_id", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """One row per row of `docs`: row, id, n_words, n_hit (words inside any exact match), item_ids (sorted as strings).

    With `slop` also near_ids: the items with proximity matches, exact ones among them.
    """
    vocabulary, terms = item_terms(items)
    postings = build_index(docs, vocabulary, id_col, text_col)
    found = _store(matches(postings, terms, width), "matches")
    # words under the union of the runs: what each run adds beyond the furthest end before it
    before = F.max("last").over(Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first"), F.coalesce(before + 1, F.col("first"))) + 1)
    hit = found.select("row", "first", "last").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = lambda rows, c: rows.select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias(c))
    per_row = hit.join(named(found, "item_ids"), "row")
    rows = postings.where("term = -1").select("row", "id", F.col("pos").cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    out = rows.join(per_row, "row", "left").select("row", "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", empty).alias("item_ids"))
    if not slop:
        return out
    return out.join(named(matches(postings, terms, width, slop), "near_ids"), "row", "left").withColumn("near_ids", F.coalesce("near_ids", empty))


def op6_decontaminate(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", slop: int = 0) -> DataFrame:
    """`docs` without the documents that hold a window of any item (with `slop`, a proximity match). Rows that share an id go together."""
    found = contamination(docs, items, id_col=id_col, slop=slop)
    return without(docs, id_col, found.where("size(near_ids) > 0" if slop else "n_hit > 0").select("id").distinct(), nulls_too=True)


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{_WORD}')"
OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least({WIDTH}, len(w)) AS l, array_to_string(w[o + 1 : o + least({WIDTH}, len(w))], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - {WIDTH}, 0) + 1)) AS o FROM i WHERE len(w) > 0)),
dw AS (SELECT uid, o, l, array_to_string(w[o + 1 : o + l], ' ') AS g
       FROM (SELECT uid, w, l, unnest(range(0, len(w) - l + 1)) AS o FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
m AS (SELECT uid, o, dw.l AS l, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
h AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(o, o + l)) AS p FROM m) GROUP BY uid),
t AS (SELECT uid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (uid) LEFT JOIN t USING (uid)
"""

"""Quality of relations and retrieval: recall, precision, agreement, intervals, sweeps, reports.

Zero denominators give 0.0. Threshold tables are small by nature; they are joined to pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources.scratch import written

# Verdicts that count as judged.
JUDGED = ["strong", "weak", "none"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def unordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    """With lo, hi: the pair without its direction."""
    return rows.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def isolated(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Asset ids that no edge touches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("asset_id")).distinct()
    return assets.select("asset_id").join(ends, "asset_id", "left_anti")


def candidate_recall(candidates: DataFrame, golden: DataFrame) -> DataFrame:
    """One row recall: golden pairs (a, b) found as candidates (source, target) in either direction."""
    found = unordered(candidates, "source", "target").select("lo", "hi", F.lit(1).alias("hit")).distinct()
    pairs = unordered(golden, "a", "b").select("lo", "hi").distinct().join(found, ["lo", "hi"], "left")
    return pairs.agg(ratio(F.count("hit"), F.count("*")).alias("recall"))


def relation_metrics(edges: DataFrame, golden: DataFrame, golden_isolated: DataFrame) -> DataFrame:
    """precision over edges, recall over pairs, kind accuracy over true edges, isolation accuracy.

    edges: src, dst, kind_code; golden: a, b, kind; golden_isolated: asset_id.
    """
    own = unordered(edges, "src", "dst").select("lo", "hi", "kind_code")
    gold = unordered(golden, "a", "b").select("lo", "hi", "kind").distinct()
    judged = own.join(gold, ["lo", "hi"], "left")
    a = judged.agg(ratio(F.count("kind"), F.count("*")).alias("precision"), ratio(F.count_if(F.col("kind") == F.col("kind_code")), F.count("kind")).alias("kind_accuracy"))
    b = gold.join(own.select("lo", "hi", F.lit(1).alias("hit")).distinct(), ["lo", "hi"], "left").agg(ratio(F.count("hit"), F.count("*")).alias("recall"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("asset_id"), F.lit(1).alias("linked")).distinct()
    c = golden_isolated.join(ends, "asset_id", "left").agg(ratio(F.count_if(F.col("linked").isNull()), F.count("*")).alias("isolation_accuracy"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def min_sim_sweep(candidates: DataFrame, golden: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept, hits, recall) of candidates (source, target, sim)."""
    gold = unordered(golden, "a", "b").select("lo", "hi").distinct()
    best = unordered(candidates, "source", "target").join(gold.withColumn("gold", F.lit(1)), ["lo", "hi"], "left")
    at = F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])).alias("threshold")
    kept = best.select("lo", "hi", "sim", "gold", at).where("sim >= threshold")
    per = kept.groupBy("threshold").agg(F.count("*").alias("kept"), F.countDistinct(F.when(F.col("gold") == 1, F.struct("lo", "hi"))).alias("hits"))
    return _all_thresholds(candidates, at, per).crossJoin(gold.agg(F.count("*").alias("n"))).select("threshold", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("hits", F.lit(0)).alias("hits"), ratio(F.coalesce("hits", F.lit(0)), F.col("n")).alias("recall"))


def _all_thresholds(rows: DataFrame, at: Column, per: DataFrame) -> DataFrame:
    return rows.sparkSession.range(1).select(at).join(per, "threshold", "left")


def approve_sweep(edges: DataFrame, golden: DataFrame, confs: list[float], sims: list[float]) -> DataFrame:
    """(conf, sim, approved, hits, precision) over a grid; edges: source, target, confidence, sim."""
    gold = unordered(golden, "a", "b").select("lo", "hi").distinct().withColumn("gold", F.lit(1))
    own = unordered(edges, "source", "target").join(gold, ["lo", "hi"], "left").select(F.col("confidence").alias("c"), F.col("sim").alias("s"), "gold")
    grid = own.sparkSession.createDataFrame([(float(c), float(s)) for c in confs for s in sims], "conf double, sim double")
    met = own.join(F.broadcast(grid), (F.col("c") >= F.col("conf")) & (F.col("s") >= F.col("sim"))).groupBy("conf", "sim").agg(F.count("*").alias("approved"), F.count("gold").alias("hits"))
    return grid.join(met, ["conf", "sim"], "left").select("conf", "sim", F.coalesce("approved", F.lit(0)).alias("approved"), F.coalesce("hits", F.lit(0)).alias("hits"), ratio(F.coalesce("hits", F.lit(0)), F.col("approved")).alias("precision"))


def coverage_curve(edges: DataFrame, verdicts: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, edge_count, rated_count, strong_count, strong_rate, assets_with_edge); errors and unjudged edges are not rated."""
    at = F.explode(F.array(*[F.lit(float(t)) for t in sorted(thresholds)])).alias("threshold")
    kept = edges.join(verdicts.select("edge_id", "verdict"), "edge_id", "left").select("src", "dst", "confidence", "verdict", at).where("confidence >= threshold")
    n = kept.groupBy("threshold").agg(F.count("*").alias("edge_count"), F.count_if(F.col("verdict").isin(JUDGED)).alias("rated_count"), F.count_if(F.col("verdict") == "strong").alias("strong_count"))
    ends = kept.select("threshold", F.explode(F.array("src", "dst")).alias("a")).groupBy("threshold").agg(F.countDistinct("a").alias("assets_with_edge"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _all_thresholds(edges, at, n.join(ends, "threshold")).select("threshold", zero("edge_count"), zero("rated_count"), zero("strong_count"), ratio(F.col("strong_count"), F.col("rated_count")).alias("strong_rate"), zero("assets_with_edge"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) of two raters; without variation 1 if they agree, else 0; no rows: 0."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("x")).withColumnRenamed("a", "v")
    right = cells.groupBy("b").agg(F.sum("n").alias("y")).withColumnRenamed("b", "v")
    by_chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("e"))
    seen = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    o, e = ratio(F.col("same"), F.col("n")), ratio(F.col("e"), F.col("n").cast("double") * F.col("n"))
    both = seen.crossJoin(by_chance).select("n", o.alias("observed"), e.alias("expected"))
    return both.withColumn("kappa", F.when(F.col("n") == 0, 0.0).when(F.col("expected") >= 1, F.when(F.col("observed") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("observed") - F.col("expected")) / F.when(F.col("expected") < 1, 1 - F.col("expected"))))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """By query: recall, precision (÷ k), reciprocal rank, nDCG, mean rank of what is not relevant, its share of the k shown.

    ranked: query_id, id, rank (from 1); relevant: query_id, id. A query of either table has a row.
    """
    rel = relevant.select("query_id", "id").distinct()
    own = ranked.join(rel.withColumn("rel", F.lit(1)), ["query_id", "id"], "left")
    top = F.col("rank") <= k
    hit = F.col("rel") == 1
    a = own.groupBy("query_id").agg(
        F.count_if(top & hit).alias("hits"),
        F.coalesce(F.max(F.when(hit, 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.sum(F.when(top & hit, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.avg(F.when(F.col("rel").isNull(), F.col("rank"))), F.lit(0.0)).alias("nonrelevant_mean_rank"),
        ratio(F.count_if(top & F.col("rel").isNull()), F.count_if(top)).alias("nonrelevant_exposure"),
    )
    both = a.join(rel.groupBy("query_id").agg(F.count("*").alias("n_rel")), "query_id", "full_outer").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return both.select("query_id", ratio(F.col("hits"), F.col("n_rel")).alias("recall"), (F.col("hits") / F.lit(k)).alias("precision"), "reciprocal_rank", F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), "nonrelevant_mean_rank", "nonrelevant_exposure")


def golden_report(ranked: DataFrame, queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: mean recall@20 and precision@3 (÷ rows shown) of queries with answers, share of answerless queries that show nothing, number of leaks.

    queries: query_id, expect_empty.
    """
    own = ranked.join(relevant.select("query_id", "id", F.lit(1).alias("rel")).distinct(), ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count("*").alias("shown"), F.count_if((F.col("rank") <= 20) & (F.col("rel") == 1)).alias("h20"), F.count_if((F.col("rank") <= 3) & (F.col("rel") == 1)).alias("h3"), F.count_if(F.col("rank") <= 3).alias("s3")
    )
    n = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    per = queries.join(own, "query_id", "left").join(n, "query_id", "left").fillna(0, ["shown", "h20", "h3", "s3", "n_rel"])
    asks, none = ~F.col("expect_empty"), F.col("expect_empty")
    return per.agg(
        F.coalesce(F.avg(F.when(asks, ratio(F.col("h20"), F.col("n_rel")))), F.lit(0.0)).alias("recall_20"),
        F.coalesce(F.avg(F.when(asks, F.col("h3") / F.greatest("s3", F.lit(1)))), F.lit(0.0)).alias("precision_3"),
        ratio(F.count_if(none & (F.col("shown") == 0)), F.count_if(none)).alias("block_rate"),
        F.count_if(none & (F.col("shown") > 0)).alias("leaks"),
    )


def verdict_report(verdicts: DataFrame) -> DataFrame:
    """(verdict, n, error_rate): counts, and the share of errors among all."""
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n")).withColumn("error_rate", F.sum(F.when(F.col("verdict") == "error", F.col("n")).otherwise(0)).over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy()))


def hollow_report(assets: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(modality, hollow, total): assets without any vector; unknown modality is exempt."""
    n = embeddings.groupBy("asset_id").agg(F.count("*").alias("c"))
    return assets.where("modality <> 'unknown'").join(n, "asset_id", "left").groupBy("modality").agg(F.count_if(F.coalesce("c", F.lit(0)) == 0).alias("hollow"), F.count("*").alias("total"))


def unclassified_report(assets: DataFrame, topics: DataFrame) -> DataFrame:
    """One row (total, missing, rate) of registered assets without a topic."""
    own = assets.where("status = 'registered'").join(topics.select("asset_id", F.lit(1).alias("t")).distinct(), "asset_id", "left")
    return own.agg(F.count("*").alias("total"), F.count_if(F.col("t").isNull()).alias("missing"), ratio(F.count_if(F.col("t").isNull()), F.count("*")).alias("rate"))


def linked_assets(edges: DataFrame) -> DataFrame:
    """One row: number of distinct assets that edges touch; ends are exploded, so no OR join."""
    return edges.select(F.explode(F.array("src", "dst")).alias("a")).agg(F.countDistinct("a").alias("n_assets"))


def stratified(rows: DataFrame, by: list[str], per_cell: int, seed: int, id_col: str) -> DataFrame:
    """A repeatable sample: the first `per_cell` of each cell by a seeded hash."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
    return rows.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= per_cell).drop("__i")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with i, their place in the order from 0: a sort over ranges, then the rows of the ranges before."""
    ranged = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    first = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return ranged.withColumn("i", first.cast("long") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at")


def strided(rows: DataFrame, n: int, id_col: str) -> DataFrame:
    """`n` rows spread evenly over the order of ids."""
    total = rows.count()
    if total <= n:
        return rows
    i = F.col("i")
    at = numbered(rows.select(id_col), [id_col]).where(F.floor((i * n) / total) != F.floor(((i - 1) * n) / total))
    return rows.join(at.select(id_col), id_col, "left_semi")


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Nearest-rank p95 and upper median by group: exact, from counts of distinct values that are combined before they meet."""
    v = rows.select(*by, N.finite(F.col(value)).alias("v"))
    return v.groupBy(*by).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").alias("median"))


def snapshot_tables(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates: source, target, score), (proposed: source, target, kind, confidence) of rows (source, candidates, proposed)."""
    c = snapshot.select("source", F.explode("candidates").alias("x")).select("source", F.col("x.id").alias("target"), "x.score")
    p = snapshot.select("source", F.explode("proposed").alias("x")).select("source", "x.target", "x.kind", "x.confidence")
    return c, p


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def pair_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (a, b) of both by unordered pair, with side 0 if the first has it, else 1."""
    both = unordered(first, "a", "b").select("lo", "hi", F.lit(0).alias("side")).unionByName(unordered(second, "a", "b").select("lo", "hi", F.lit(1).alias("side")))
    return both.groupBy("lo", "hi").agg(F.min("side").alias("side"))


def resolve_keys(golden: DataFrame, assets: DataFrame, key: str = "fs_path") -> tuple[DataFrame, DataFrame]:
    """(golden keys with asset_id, keys without an asset, sorted) for a column `key` of both."""
    ids = assets.select(key, "asset_id")
    return golden.join(ids, key), golden.select(key).distinct().join(ids, key, "left_anti").orderBy(key)

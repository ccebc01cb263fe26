"""Catalogue operators on small rows whose results are worked out by hand."""

import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators import documents as D
from siltstone.operators import metrics as M
from siltstone.operators import relations as R
from siltstone.operators import search as S
from siltstone.operators import topics as P
from siltstone.operators import vectors as V
from siltstone.sources import files as X
from siltstone.sources import tables
from siltstone.streaming import incremental as I

A, B, C = (f"00000000-0000-0000-0000-00000000000{i}" for i in "abc")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- search --------------------------------------------------------------------------------------------------------


def fused(spark, *extra):
    base = [("q", "text", "a", 0.9, 0.8, True, ["hit_keywords", "hit_cross_meta"]), ("q", "text", "b", 0.5, 0.1, False, None), ("q", "text", "c", 0.4, None, True, ["hit_summary", "hit_cross_meta"]), ("q", "text", "d", 0.3, 0.2, True, [])]
    return spark.createDataFrame(base + list(extra), "query_id string, bucket string, asset_id string, similarity double, cos double, lexical boolean, matched_queries array<string>")


def signal(spark, top, low):
    return spark.createDataFrame([("q", "text", top, low)], "query_id string, bucket string, top double, baseline double")


def test_gate_passed_cuts(spark):
    out = S.bucket_policy(fused(spark), signal(spark, 0.8, 0.1), 10)
    assert rows(out, "asset_id", "keep_reason", "rank") == [("a", "gate_passed", 1), ("c", "gate_passed", 2), ("d", "gate_passed", 3)]


def test_gate_failed_rescues_by_evidence(spark):
    out = S.bucket_policy(fused(spark, ("q", "text", "e", 0.2, None, True, None)), signal(spark, 0.3, 0.2), 10)
    assert rows(out, "asset_id", "keep_reason") == [("a", "evidence_normal"), ("e", "legacy_no_matched_queries")]
    keyword = S.bucket_policy(fused(spark), signal(spark, 0.3, 0.2), 10, mode="keyword")
    assert rows(keyword, "asset_id") == [("a",), ("c",)]
    assert S.bucket_policy(fused(spark), signal(spark, 0.3, 0.2), 10, S.Tuning(bm25_operator="or")).count() == 0
    assert S.bucket_policy(fused(spark), signal(spark, 0.3, 0.2), 10, S.Tuning(evidence_rescue_enabled=False)).count() == 3
    assert S.bucket_policy(fused(spark), signal(spark, 0.3, 0.2), 2, S.Tuning(cutoff_enabled=False)).count() == 2


def test_gate_boundaries(spark):
    s = spark.createDataFrame([("q", "a", 0.35, 0.17), ("q", "b", 0.35, 0.18), ("q", "c", 0.34, 0.0)], "query_id string, bucket string, top double, baseline double")
    assert rows(S.gate(s), "bucket", "passed") == [("a", True), ("b", False), ("c", False)]


def test_gate_signal_of_few(spark):
    knn = spark.createDataFrame([("q", "one", 0.4, 1), ("q", "odd", 0.9, 1), ("q", "odd", 0.2, 2), ("q", "odd", float("nan"), 3)], "query_id string, bucket string, cos double, rank int")
    assert rows(S.gate_signal(knn), "bucket", "top", "baseline") == [("odd", 0.9, 0.0), ("one", 0.4, 0.0)]


def test_evidence(spark):
    df = spark.createDataFrame([(["hit_summary", "hit_cross_meta"],), (["hit_labels", "hit_cross_meta", "hit_labels"],), (["x"],), (None,)], "m array<string>")
    assert [(round(r.a, 6), r.b) for r in df.select(S.evidence_score(F.col("m")).alias("a"), S.evidence_score(F.col("m"), True).alias("b")).collect()] == [(1.0, 0.0), (4.0, 4.0), (0.0, 0.0), (0.0, 0.0)]


def test_fuse_keeps_first_k_of_the_sample(spark):
    lex = spark.createDataFrame([("q", "t", "a", 2.0, ["hit_summary"])], "query_id string, bucket string, asset_id string, score double, matched_queries array<string>")
    knn = spark.createDataFrame([("q", "t", "b", 0.9, 1), ("q", "t", "a", 0.5, 2), ("q", "t", "c", 0.1, 3)], "query_id string, bucket string, asset_id string, cos double, rank int")
    assert rows(S.fuse(lex, knn, 2), "asset_id", "similarity", "cos", "lexical") == [("a", 0.5, 0.5, True), ("b", 0.5, 0.9, False)]


def test_rerank_moves_scores(spark):
    df = spark.createDataFrame([("q", "t", k, s, r) for k, s, r in (("a", 0.9, 0.1), ("b", 0.8, 0.7), ("c", 0.7, 0.7), ("d", 0.6, 1.0))], "query_id string, bucket string, asset_id string, similarity double, rerank_score double")
    assert rows(S.rerank(df, 3), "asset_id", "similarity", "pos") == [("a", 0.7, 3), ("b", 0.9, 1), ("c", 0.8, 2), ("d", 0.6, 4)]
    assert rows(S.rerank(df, 3, tau=0.9), "asset_id") == [("d",)]


def test_about_filter(spark):
    q = spark.createDataFrame([("q", "배 여행")], "query_id string, query string")
    mk = lambda data: spark.createDataFrame([("q", "t", k, a, w) for k, a, w in data], "query_id string, bucket string, asset_id string, about array<string>, kwtext string")
    assert rows(S.about_filter(mk([("a", ["여행기"], ""), ("b", ["배드민턴"], ""), ("c", [], "택배"), ("d", [], "여행 사진"), ("e", ["배"], "")]), q), "asset_id") == [("a",), ("d",), ("e",)]
    assert S.about_filter(mk([("a", ["x"], "y"), ("b", [], "z")]), q).count() == 2  # all would go
    assert S.about_filter(mk([("a", None, None), ("b", None, None)]), q).count() == 2


def test_filters(spark):
    assert S.Filters.parse() is None and S.Filters.parse(file_ext=" , ", topic=" ") is None
    f = S.Filters.parse(file_ext="PDF,.txt,pdf", created_from="2024-01-02", created_to="2024-01-03T10:00:00Z")
    assert f.file_ext == ("pdf", "txt") and f.created_from == date(2024, 1, 2)
    with pytest.raises(ValueError):
        S.Filters.parse(created_from="yesterday")
    df = spark.createDataFrame([(1, "pdf", datetime(2024, 1, 2)), (2, "pdf", datetime(2024, 1, 3, 23)), (3, "pdf", datetime(2024, 1, 4)), (4, "doc", datetime(2024, 1, 2))], "i int, file_ext string, created_at timestamp")
    assert rows(df.where(f.column()), "i") == [(1,), (2,)]


def test_query_normalisation(spark):
    df = spark.createDataFrame([(1, "두 낱말", []), (2, "강아지 영상 찾아 줘", [("강아지", "NNG"), ("영상", "NNG"), ("찾", "VV"), ("강아지", "NNG")]), (3, "이것 저것 그것", [("이것", "NP")])], "query_id int, query string, tokens array<struct<token:string,pos:string>>")
    assert rows(S.normalise_query(df)) == [(1, "두 낱말"), (2, "강아지"), (3, "이것 저것 그것")]


def test_lexical_clauses(spark):
    docs = spark.createDataFrame([(1, "text", ["red fox"], ["red fox"], "fox file", "a red fox runs"), (2, "text", ["blue"], ["Red Fox"], "x", "red and blue fox"), (3, "text", [], [], "", "nothing")], "asset_id int, bucket string, keywords array<string>, labels array<string>, file_name string, summary string")
    q = spark.createDataFrame([("q", " Red Fox ")], "query_id string, query string")
    got = {r.asset_id: r.matched_queries for r in S.lexical(docs, q, 10).collect()}
    assert got == {1: ["hit_cross_meta", "hit_keywords", "hit_labels", "hit_summary"], 2: ["hit_cross_meta", "hit_summary"]}
    assert {r.asset_id for r in S.lexical(docs, q, 10, "or").collect()} == {1, 2}


def test_verified(spark):
    df = spark.createDataFrame([("q", "t", "a", 0.9), ("q", "i", "a", 0.8), ("q", "t", "b", 0.7), ("q", "t", "c", 0.1)], "query_id string, bucket string, asset_id string, similarity double")
    full = spark.createDataFrame([("q", "a", False), ("q", "b", True)], "query_id string, asset_id string, keep boolean")
    assert rows(S.verified(df, full, 2), "asset_id") == [("b",), ("c",)]
    assert S.verified(df, full.where("asset_id = 'a'"), 2).count() == 4  # not all were judged


def test_unknown_modality(spark):
    with pytest.raises(ValueError):
        S.search_hybrid(spark.range(1), spark.range(1), ["smell"])


# --- vectors -------------------------------------------------------------------------------------------------------


def test_similarity_leaves_out_vectors_without_direction(spark):
    df = spark.createDataFrame([(1, "st", [1.0, 0.0]), (2, "st", [0.0, 0.0]), (3, "st", [1.0, 1.0]), (4, "clip", [1.0, 0.0]), (5, "st", None), (6, "st", [float("nan"), 1.0])], "asset_id int, channel string, embedding array<double>")
    assert rows(V.similarity_candidates(df, df, 5)) == [(1, 3, 0.707107, 1), (3, 1, 0.707107, 1)]
    assert rows(V.similarity_candidates(df, df, 5, 0.8)) == []
    assert V.similarity_candidates(df.limit(0), df.limit(0), 5).count() == 0


def test_similarity_blocks_change_nothing(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("asset_id"), F.lit("st").alias("channel"), F.array(*[F.sin(F.col("id") * k) for k in range(1, 6)]).alias("embedding"))
    want = rows(V.similarity_candidates(df, df, 4))
    monkeypatch.setattr(V, "BLOCK_BYTES", 900)
    assert rows(V.similarity_candidates(df, df, 4)) == want


def test_similarity_holds_few_products_and_no_ties(spark, monkeypatch):
    """A task holds a bounded number of similarities and of equally similar targets; chunks of a target may come apart."""
    seen, take = [], V._Best.take
    monkeypatch.setattr(V, "CELLS", 400)
    monkeypatch.setattr(V._Best, "take", lambda self, sim, names: (seen.append((sim.size, self.target.size)), take(self, sim, names))[1])
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(7, 3))
    data = [(i // 3, "st", [float(x) for x in vectors[i % 7]]) for i in range(300)]  # 100 assets of three chunks, many alike
    want, unit = [], vectors / np.linalg.norm(vectors, axis=1)[:, None]
    cos = unit @ unit.T
    for s in range(100):
        sims = [(-round(max(cos[(3 * s + a) % 7, (3 * t + b) % 7] for a in range(3) for b in range(3)), 6), t) for t in range(100) if t != s]
        want += [(s, t, -x, r) for r, (x, t) in enumerate(sorted(sims)[:4], 1) if -x >= 0.1]
    df = spark.createDataFrame(data, "asset_id int, channel string, embedding array<double>")
    assert sorted(rows(V.similarity_candidates(df, df, 4, 0.1))) == want
    best = V._Best(2, 4, 0.1, 6)
    for i in range(0, 10000, 2):
        best.take(np.ones((2, 2)), [i, i + 1])
    assert max(s for s, _ in seen) <= 400 and best.target.tolist() == [[0, 1, 2, 3]] * 2


# --- relations -----------------------------------------------------------------------------------------------------


def test_proposals(spark):
    answers = [(A, json.dumps({"edges": [{"target_media_item_id": B, "relation_type_code": " Same_Series", "confidence": 1.7, "topic_ko": "한국 음식"}, {"target_media_item_id": " "}]})), (B, json.dumps({"target_media_item_id": A, "relation_type_code": "x", "confidence": "NaN"})), (C, "no json"), (A, json.dumps({"items": []})), (B, "[1]")]
    got = R.parse_proposals(spark.createDataFrame(answers, "source string, answer string"))
    assert rows(got, "source", "target", "kind_code", "confidence", "topic_ko", "malformed") == [(A, B, "same_series", 1.0, "한국", False), (B, A, "x", 0.0, "일반", False), (B, None, None, 0.0, "일반", True), (C, None, None, 0.0, "일반", True)]


def test_gates_on_targets(spark):
    kinds = spark.createDataFrame([("k", True, "active"), ("old", True, "inactive")], "kind_code string, is_symmetric boolean, status string")
    p = spark.createDataFrame([(A, B, "k"), (A, "x", "k"), (A, C, "k"), (A, A, "k"), (A, B, None), (A, B, "old")], "source string, target string, kind_code string")
    cand = spark.createDataFrame([(A, B), (A, A)], "source string, target string")
    assert rows(R.accepted(p, cand, kinds), "target", "kind_code", "reject_reason") == sorted([(B, "k", None), ("x", "k", "target_not_uuid"), (C, "k", "not_a_candidate"), (A, "k", "self"), (B, None, "no_kind"), (B, "old", "kind_not_active")], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("kind, conf, keeps", [("same_domain", 0.7, True), ("same_domain", 0.69, False), ("same_domain", None, False), ("references", None, True)])
def test_persist(spark, kind, conf, keeps):
    df = spark.createDataFrame([(kind, conf)], "k string, c double")
    assert df.select(R.should_persist(F.col("k"), F.col("c")).alias("x")).first().x is keeps
    assert df.select(R.exposure_tier(F.lit("proposed"), F.col("k"), F.col("c")).alias("x")).first().x == ("weak" if keeps else None)
    assert df.select(R.decide_status(F.col("k"), F.col("c")).alias("x")).first().x == "proposed"


def test_merge_is_like_row_by_row(spark):
    """A batch with repeats against applying its rows one after the other."""
    import random

    rng = random.Random(0)
    mk = lambda n: [(rng.choice("ab"), rng.choice("cd"), "k", rng.choice([None, 0.1, 0.5, 0.9]), f"r{i}", f"t{i}", rng.choice(["proposed", "active"]), i) for i in range(n)]
    schema = "src string, dst string, kind_code string, confidence double, reason string, topic string, status string, seq int"
    for _ in range(4):
        old = {r[:3]: list(r[3:7]) for r in mk(2)}
        batch = mk(rng.randint(1, 9))
        state = {k: list(v) for k, v in old.items()}
        for r in batch:
            if r[:3] not in state:
                state[r[:3]] = list(r[3:7])
            else:
                s, a, b = state[r[:3]], state[r[:3]][0] or 0.0, r[3] or 0.0
                if b > a:
                    s[1], s[2] = r[4], r[5]
                s[0] = max(a, b)
        existing = spark.createDataFrame([(*k, *v) for k, v in old.items()], schema.rsplit(",", 1)[0])
        assert rows(R.merge_edges(existing, spark.createDataFrame(batch, schema))) == sorted(((*k, *v) for k, v in state.items()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_review(spark):
    e = spark.createDataFrame([("e1", "proposed", None), ("e2", "active", "me")], "edge_id string, status string, reviewed_by string")
    d = spark.createDataFrame([("e1", 1, "approve", "x"), ("e1", 2, "reject", "y"), ("e2", 3, "reject", "x"), ("e9", 4, "reject", "x")], "edge_id string, seq int, action string, by string")
    after, oks = R.review_decisions(e, d)
    assert rows(after) == [("e1", "active", "x"), ("e2", "active", "me")]
    assert rows(oks, "seq", "ok") == [(1, True), (2, False), (3, False), (4, False)]
    with pytest.raises(PySparkException):
        R.review_decisions(e, d.withColumn("action", F.lit("maybe")))[0].collect()
    with pytest.raises(ValueError):
        R.review_filter(date_col="x")
    assert rows(R.revise(e, spark.createDataFrame([("e2", "rejected")], "edge_id string, to string")), "edge_id", "status") == [("e1", "proposed"), ("e2", "rejected")]


def test_kinds(spark):
    kinds = spark.createDataFrame([("a", "A", "d", False, "active")], "kind_code string, kind_name string, description string, is_symmetric boolean, status string")
    new = R.register_kinds(kinds, spark.createDataFrame([("A ", "x", 1), ("new_one", "why", 3), ("New_One", "first", 2), ("medical", "x", 4), ("9", "x", 5)], "kind_code string, reason string, seq int"))
    assert rows(new, "kind_code", "kind_name", "description", "status") == [("a", "A", "d", "active"), ("new_one", "new one", "new one\nfirst", "inactive")]
    up = R.upsert_kinds(kinds, spark.createDataFrame([("a", "", "new", True, "inactive"), ("b", "B", None, None, None)], "kind_code string, kind_name string, description string, is_symmetric boolean, status string"))
    assert rows(up) == [("a", "A", "new", False, "active"), ("b", "B", None, True, "inactive")]
    assert rows(R.promote_kind(new, "new_one"), "kind_code", "status") == [("a", "active"), ("new_one", "active")]
    assert rows(R.list_kinds(new, "inactive"), "kind_code") == [("new_one",)]


def test_retry_states(spark):
    df = spark.createDataFrame([(None, 2, 1), (None, 0, 1), ("boom", 0, 1), ("boom", 0, 2), ("boom", None, None)], "error string, n int, attempts int")
    got = [(r.x.status, r.x.attempts) for r in df.select(R.resolution_status(F.col("error"), F.col("n"), F.col("attempts")).alias("x")).collect()]
    assert got == [("resolved", 1), ("isolated", 1), ("pending", 2), ("failed", 3), ("pending", 1)]


def test_maintenance(spark):
    e = spark.createDataFrame([("a", "active", 0.9, None), ("b", "active", None, "me"), ("c", "proposed", None, None)], "edge_id string, status string, confidence double, reviewed_by string")
    assert rows(R.reset_for_rescore(e), "edge_id", "status", "confidence") == [("a", "proposed", None), ("b", "active", None), ("c", "proposed", None)]
    with pytest.raises(ValueError):
        R.clear_edges(e)
    with pytest.raises(ValueError):
        R.purge_unscored(e, 1)
    assert rows(R.purge_unscored(e, 0), "edge_id") == [("a",), ("b",)]
    assert R.clear_edges(e.where("reviewed_by is null")).count() == 0


# --- topics --------------------------------------------------------------------------------------------------------


def test_canonical_names(spark):
    reg = spark.createDataFrame([("음식", None), ("여행", None)], "topic_ko string, parent_topic string")
    al = spark.createDataFrame([("요리", "음식", "seed", None)], "raw_ko string, canonical_ko string, decided_by string, parent_topic string")
    raw = spark.createDataFrame([(1, "음식"), (2, " 요리"), (3, "관광"), (4, ""), (5, "?"), (6, None)], "i int, topic string")
    judge = lambda rest: rest.withColumn("canonical", F.when(F.col("topic") == "관광", "여행").otherwise("없는것"))
    out, frozen = P.canonical_topics(raw, reg, al, judge)
    assert rows(out, "i", "canonical", "decided_by") == [(1, "음식", "exact"), (2, "음식", "alias"), (3, "여행", "classified"), (4, "", "passthrough"), (5, "미분류", "classified"), (6, None, "passthrough")]
    assert rows(frozen, "raw_ko", "canonical_ko") == [("?", "미분류"), ("관광", "여행")]
    assert rows(P.canonical_topics(raw, reg.limit(0), al)[0], "i", "canonical")[4] == (5, "?")


def test_canonical_subtopics(spark):
    al = spark.createDataFrame([("김치찌개", "찌개", "seed", "음식")], "raw_ko string, canonical_ko string, decided_by string, parent_topic string")
    raw = spark.createDataFrame([("음식", "김치찌개"), ("음식", "영상"), ("음식", "음식"), ("음식", "Video"), ("여행", "김치찌개"), ("음식", None)], "parent string, subtopic string")
    assert rows(P.canonical_subtopics(raw, al)) == sorted([("음식", "김치찌개", "찌개"), ("음식", "영상", None), ("음식", "음식", None), ("음식", "Video", None), ("여행", "김치찌개", "김치찌개"), ("음식", None, None)], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_insert_ignore_and_seed(spark):
    t = spark.createDataFrame([("a", None, "old"), ("a", "p", "sub")], "topic_ko string, parent_topic string, source string")
    new = spark.createDataFrame([("a", None, "new"), ("b", None, "x"), ("b", None, "y")], "topic_ko string, parent_topic string, source string")
    assert rows(P.insert_ignore(t, new, ["topic_ko", "parent_topic"])) == [("a", "p", "sub"), ("a", None, "old"), ("b", None, "x")]
    al = spark.createDataFrame([("r", "c", "auto", None)], "raw_ko string, canonical_ko string, decided_by string, parent_topic string")
    reg, frozen = P.apply_seed(t, al, spark.createDataFrame([("z",)], "topic_ko string"), spark.createDataFrame([("r", "other"), ("s", "z")], "raw_ko string, canonical_ko string"))
    assert rows(reg) == [("a", "p", "sub"), ("z", None, "taxonomy")]
    assert rows(frozen, "raw_ko", "canonical_ko", "decided_by") == [("r", "c", "auto"), ("s", "z", "seed")]


def test_seed_problems(spark):
    topics = spark.createDataFrame([("음식·요리",), ("여행",)], "topic_ko string")
    subs = spark.createDataFrame([("음식·요리", "요리"), ("여행", "요리·맛집"), ("없음", "x")], "parent string, subtopic string")
    assert rows(P.seed_problems(topics, subs)) == [("없음", "x", "unknown_parent"), ("여행", "요리·맛집", "overlaps_topic")]


# --- metrics -------------------------------------------------------------------------------------------------------


def test_kappa_edges(spark):
    k = lambda data: M.cohen_kappa(spark.createDataFrame(data, "a string, b string"), "a", "b").first().kappa
    assert k([("x", "x")] * 3) == 1.0
    assert k([("x", "y")] * 3) == 0.0
    assert k([]) == 0.0
    assert round(k([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")]), 6) == 0.5


def test_retrieval(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("s", "a")], "query_id string, id string")
    got = {r.query_id: r for r in M.retrieval_metrics(ranked, rel, 2).collect()}
    assert (got["q"].recall, got["q"].precision, got["q"].reciprocal_rank, got["q"].nonrelevant_mean_rank, got["q"].nonrelevant_exposure) == (0.5, 0.5, 0.5, 2.0, 0.5)
    assert round(got["q"].ndcg, 4) == 0.3869
    assert (got["r"].recall, got["r"].ndcg, got["r"].nonrelevant_exposure) == (0.0, 0.0, 1.0)
    assert (got["s"].recall, got["s"].precision) == (0.0, 0.0)


def test_golden_report(spark):
    q = spark.createDataFrame([("q", False), ("none", True), ("leak", True), ("lost", False)], "query_id string, expect_empty boolean")
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("leak", "a", 1)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("lost", "a")], "query_id string, id string")
    assert tuple(M.golden_report(ranked, q, rel).first()) == (0.5, 0.25, 0.5, 1)


def test_sweeps(spark):
    cand = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.8), ("a", "c", 0.4)], "source string, target string, sim double")
    gold = spark.createDataFrame([("b", "a"), ("c", "d")], "a string, b string")
    assert rows(M.min_sim_sweep(cand, gold, [0.95, 0.5])) == [(0.5, 2, 1, 0.5), (0.95, 0, 0, 0.0)]
    assert M.candidate_recall(cand, gold).first().recall == 0.5
    assert M.candidate_recall(cand, gold.limit(0)).first().recall == 0.0
    edges = cand.withColumn("confidence", F.lit(0.8))
    assert rows(M.approve_sweep(edges, gold, [0.5, 0.9], [0.5])) == [(0.5, 0.5, 2, 2, 1.0), (0.9, 0.5, 0, 0, 0.0)]


def test_reports_and_sets(spark):
    v = spark.createDataFrame([("strong",), ("error",), ("strong",), ("weak",)], "verdict string")
    assert rows(M.verdict_report(v)) == [("error", 1, 0.25), ("strong", 2, 0.25), ("weak", 1, 0.25)]
    a = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    b = spark.createDataFrame([("b", "c"), ("a", "b")], "a string, b string")
    assert rows(M.pair_union(a, b)) == [("a", "b", 0), ("b", "c", 1)]
    assert M.same_rows(a, a.orderBy("a")) and not M.same_rows(a, b)
    df = spark.range(100).withColumn("cell", F.col("id") % 3)
    assert rows(M.stratified(df, ["cell"], 4, 1, "id")) == rows(M.stratified(df, ["cell"], 4, 1, "id"))
    assert M.stratified(df, ["cell"], 4, 1, "id").count() == 12
    assert M.strided(df, 10, "id").count() == 10 and M.strided(df, 200, "id").count() == 100
    snap = spark.createDataFrame([("s", [("t", 0.5)], [("t", "k", 0.9)])], "source string, candidates array<struct<id:string,score:double>>, proposed array<struct<target:string,kind:string,confidence:double>>")
    c, p = M.snapshot_tables(snap)
    assert rows(c) == [("s", "t", 0.5)] and rows(p) == [("s", "t", "k", 0.9)]
    found, missing = M.resolve_keys(spark.createDataFrame([("x",), ("y",)], "fs_path string"), spark.createDataFrame([("x", 1)], "fs_path string, asset_id int"))
    assert rows(found) == [("x", 1)] and rows(missing) == [("y",)]


# --- documents -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "segments, size, overlap, want",
    [
        (["aa", "bb", "cc"], 5, 0, ["aa\nbb", "cc"]),
        (["aa", "", None, " bb "], 5, 0, ["aa\nbb"]),
        (["a" * 7, "b"], 3, 0, ["aaa", "aaa", "a", "b"]),
        (["aa", "bb", "cc"], 5, 2, ["aa\nbb", "bb\ncc"]),
        ([], 5, 0, []),
        (["aaa", "bbb", "ccc"], 3, 2, ["aaa", "aa\nbbb", "bb\nccc"]),
    ],
)
def test_chunks(spark, segments, size, overlap, want):
    df = spark.createDataFrame([(segments,)], "s array<string>")
    assert df.select(D.chunks(F.col("s"), size, overlap).alias("c")).first().c == want


def test_chunk_limits(spark):
    df = spark.createDataFrame([(["abc", "", "de", "f"],)], "s array<string>")
    assert df.select(D.limit_chars(F.col("s"), 4).alias("c"), D.limit_chars(F.col("s"), 0).alias("z")).first() == (["abc", "d"], [])
    with pytest.raises(ValueError):
        D.chunks(F.col("s"), 3, 3)


def test_search_documents(spark):
    r = spark.createDataFrame([(1, "/d/youtube_사막_HAi1OZD1OMM.jpg", None, None, [(" cat ", 0.9), ("", 0.1)], [0.0, 0.0]), (2, "/d/b.txt", "s", ["k"], None, [1.0])], "asset_id int, fs_path string, summary string, keywords array<string>, labels array<struct<label:string,score:double>>, embedding array<double>")
    t = spark.createDataFrame([(1, "여행", ""), (1, "여행", "사막")], "asset_id int, topic string, subtopic string")
    got = {x.asset_id: x for x in D.search_documents(r, t).collect()}
    assert (got[1].file_name, got[1].labels, got[1].embedding, got[1].topics, got[1].subtopics, got[1].topic_pairs) == ("youtube 사막", ["cat"], None, ["여행"], ["사막"], ["여행", "여행>사막"])
    assert (got[2].labels, got[2].topics, got[2].file_ext, got[2].embedding) == ([], None, "txt", [1.0])


def test_nodes_and_duplicates(spark):
    nodes = spark.createDataFrame([("n1", "1")], "node string, asset_id string")
    both = D.get_or_create_nodes(nodes, spark.createDataFrame([(1,), (2,), (2,)], "asset_id int"))
    assert both.count() == 2 and rows(D.get_or_create_nodes(both, spark.createDataFrame([(2,)], "asset_id int"))) == rows(both)
    a = spark.createDataFrame([(1, "h", "registered", 2), (2, "h", "deferred", 1), (3, "h", "failed", 0), (4, None, "registered", 0)], "asset_id int, file_hash string, status string, created_at int")
    assert rows(D.content_duplicates(a)) == [(1, 2)]


def test_tiers(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"}, "general"), ({"a": "1", "b": "2"}, "medical")], "m map<string,string>, d string")
    tiers = spark.createDataFrame([("a", "public"), ("b", "regulated")], "meta_key string, access_tier string")
    assert [sorted(r.x) for r in df.select(D.readable(F.col("m"), F.col("d"), tiers, F.lit("authorized")).alias("x")).collect()] == [["a", "c"], []]
    assert [r.x for r in df.select(D.unknown_keys(F.col("m"), ["a"]).alias("x")).collect()] == [["b", "c"], ["b"]]
    assert df.select(D.unknown_keys(F.col("m"), []).alias("x")).first().x == []


def test_schema_violations(spark):
    check = D.schema_violations({"labels": {"type": "array", "items": {"type": "object", "required": ["label"], "properties": {"label": {"type": "string"}, "score": {"type": "number"}}}}, "n": {"type": "integer"}})
    texts = ['{"labels": [{"label": "a", "score": 1}], "n": 3}', '{"labels": [{"score": "x"}], "n": true, "other": 1}', "nope", None, "[]"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(check("t").alias("v")).collect()]
    assert got == [[], ["labels[0].score: not number", "labels[0]: label is missing", "n: not integer"], ["not JSON"], [], ["not an object"]]


def test_zero_shot(spark):
    df = spark.createDataFrame([([0.2, 0.3, 0.2],)], "s array<double>")
    got = df.select(D.zero_shot(F.col("s"), ["b", "c", "a"], 10.0).alias("x")).first().x
    assert [g.label for g in got] == ["c", "a", "b"] and round(sum(g.score for g in got), 9) == 1


# --- sources and streams -------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "_kept.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "sub" / "a.json").write_text('{"a": 1}\nx')
    (tmp_path / "sub" / "p.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / ".hidden" / "b.txt").write_text("x")
    found = X.list_files(spark, str(tmp_path)).select("path", "content", X.sniffed_kind(F.col("content"), F.col("path")).alias("kind"))
    names = {r.path.rsplit("/", 1)[1]: r.kind for r in found.collect()}
    assert {k: v for k, v in names.items() if k != "_kept.txt"} == {"a.json": "json", "p.pdf": "pdf"}
    assert rows(X.segments(found.where("kind = 'json'")), "position", "segment") == [(0, '{"a": 1}\nx')]
    assert X.pick_encoding("한글".encode("cp949")) == "cp949"
    assert X.pick_encoding("한글".encode()[:-1]) == "utf-8"
    for kind, path in (("text", "/a/b.pdf"), ("pdf", "b.txt"), ("word", "b.md"), ("text", "b.md"), ("json", "b")):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(kind, path)], "k string, p string").select(X.checked_kind(F.col("k"), F.col("p"))).collect()
    assert list(X.file_parts("text", ("x" * 5000).encode())) == ["x" * 4096, "x" * 904]
    h = X.file_hashes(found.where("kind = 'pdf'")).first()
    assert h.file_size == 10 and len(h.file_hash) == 64


def test_media_types(spark):
    types = ["application/pdf", "text/css", "image/png", "application/msword", "application/ld+json", "application/zip", None]
    got = [(r.k, r.m) for r in spark.createDataFrame([(t,) for t in types], "t string").coalesce(1).select(X.kind_of_type(F.col("t")).alias("k")).select("k", X.modality_of(F.col("k")).alias("m")).collect()]
    assert got == [("pdf", "text"), ("text", "text"), ("image", "image"), ("word", "text"), ("json", "text"), ("unknown", "unknown"), ("unknown", "unknown")]


def test_upsert_stream(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "asset_id int, topic string, seq int"
    run = lambda: I.upsert_stream(spark.readStream.schema(schema).parquet(src), root, ["asset_id"], "seq", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).write.parquet(src)
    run()
    spark.createDataFrame([(1, None, 3), (3, "d", 1)], schema).write.mode("append").parquet(src)
    run()
    assert rows(tables.read_snapshot(spark, root), "asset_id", "topic") == [(1, None), (2, "c"), (3, "d")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.current_version(spark, root) is None
    first = tables.write_snapshot(spark.range(1), root)
    assert tables.write_snapshot(spark.range(2), root, "noop") == first
    with pytest.raises(FileExistsError):
        tables.write_snapshot(spark.range(2), root, "error")
    tables.write_snapshot(spark.range(3), root)
    assert tables.read_snapshot(spark, root).count() == 3 and spark.read.parquet(first).count() == 1


def test_stream_of_contents(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "asset_id int, file_hash string, status string, created_at timestamp"
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, "h", "registered", t), (2, "h", "registered", t), (3, "g", "failed", t)], schema).coalesce(1).write.parquet(src)
    q = I.distinct_content(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("contents").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("contents").count() == 1

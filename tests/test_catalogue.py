"""Settings, reports, proposals, the switches of the read path, and models as seams."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone import settings
from siltstone.functions import seams
from siltstone.operators import proposals as O
from siltstone.operators import registry as G
from siltstone.operators import reports as Q
from siltstone.operators import search as S


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


# --- settings ------------------------------------------------------------------------------------------------------


def test_settings():
    s = settings.load({"embed.model": "m", "search.cutoff_eps": " 0.3 ", "search.fusion_weights": "0.2,0.8", "relations.review_exempt_kinds": "", "embed.normalise": "off"})
    assert s.search.cutoff_eps == 0.3 and s.search.fusion_weights == (0.2, 0.8) and s.embed.normalise is False
    assert s.relations.review_exempt_kinds == frozenset() and s.relations.auto_approve_exclude_kinds == {"same_domain"}


@pytest.mark.parametrize(
    "bad",
    [{}, {"embed.model": " "}, {"search.cutoff_eps": "2"}, {"search.cutoff_eps": "nan"}, {"search.cutoff_eps": "x"}, {"search.fusion_weights": "1"}, {"search.fusion_weights": "0.5,1.5"}, {"search.bm25_operator": "xor"}, {"embed.channel": "st_api"}, {"embed.channel": "zz"}, {"embed.chunk_size": "5", "embed.chunk_overlap": "5"}, {"search.index_sync_enabled": "no"}, {"embed.normalise": "maybe"}, {"relations.top_k": "0"}],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        settings.load(bad if bad in ({}, {"embed.model": " "}) else {"embed.model": "m", **bad})


def test_lists_of_names():
    assert settings.parse_kinds(None, frozenset("x")) == {"x"} and settings.parse_kinds("", frozenset("x")) == frozenset() and settings.parse_kinds(" A, b,,") == {"a", "b"}
    assert settings.parse_modalities(" ") is None and settings.parse_modalities("text, Image,") == ["text", "Image"]
    assert settings.checked_modalities(None) == ["text", "image", "video", "audio"]
    with pytest.raises(ValueError):
        settings.checked_modalities("TEXT")


# --- files of reports ----------------------------------------------------------------------------------------------


def test_golden_files(spark, tmp_path):
    def read(**data):
        path = str(tmp_path / "g.json")
        with open(path, "w") as f:
            json.dump({"version": 1, "key_type": "fs_path", "pairs": [], "isolated": ["z"]} | data, f)
        spark.catalog.clearCache()
        return Q.read_golden(spark, path)

    pairs, alone = read(pairs=[{"a": "x", "b": "y", "kind": "k"}])
    assert rows(pairs) == [("x", "y", "k", "")] and rows(alone) == [("z",)]
    for bad in ({"version": 2}, {"key_type": "id"}, {"pairs": [{"a": "x", "b": "x", "kind": "k"}]}, {"pairs": [{"a": "x", "b": "y"}]}):
        with pytest.raises(ValueError):
            read(**bad)


def test_older_snapshots(spark, tmp_path):
    path = str(tmp_path / "s.json")
    with open(path, "w") as f:
        json.dump({"version": 1, "config": {}, "sources": {"a": {"candidates": [["b", "0.5"], ["c"]], "proposed": [{"target": "b", "kind": "k", "confidence": 0.9}]}}}, f)
    c, p = Q.read_snapshot(spark, path)
    assert rows(c) == [("a", "b", 0.5), ("a", "c", 0.0)] and rows(p) == [("a", "b", "k", 0.9, "", 0.0)]


def test_seeds(spark, tmp_path):
    path = str(tmp_path / "t.json")
    with open(path, "w") as f:
        json.dump({"version": 1, "topics": [{"topic_ko": "b", "topic_en": "x"}, {"topic_ko": "a", "topic_en": "y"}]}, f)
    assert rows(G.read_seed(spark, path, "topics")) == [(0, "b", "x"), (1, "a", "y")]
    registry = spark.createDataFrame([("b", None, "taxonomy", "x"), ("s", "b", "auto", None)], "topic_ko string, parent_topic string, source string, topic_en string")
    seeds = spark.createDataFrame([("b", "s"), ("b", "t")], "parent_ko string, subtopic_ko string")
    assert rows(G.seed_subtopics(registry, seeds), "topic_ko", "parent_topic", "source") == [("b", None, "taxonomy"), ("s", "b", "auto"), ("t", "b", "seed")]
    fields = spark.createDataFrame([("d", "k", "active", '{"type": "string"}'), ("d", "l", "active", "{}"), ("d", "m", "inactive", '{"type": "string"}')], "domain string, meta_key string, status string, json_schema string")
    assert G.key_schemas(fields, "d") == {"k": {"type": "string"}} and G.allowed_keys(fields, "d") == ["k", "l"]


# --- proposing -----------------------------------------------------------------------------------------------------

ID = "00000000-0000-0000-0000-00000000000{}".format


def test_propose(spark):
    assets = spark.createDataFrame([(ID(i), "registered" if i < 5 else "failed", f"/a/n{i}.txt", "text") for i in range(1, 6)], "asset_id string, status string, fs_path string, modality string")
    meta = spark.createDataFrame([(ID(1), "one", "['k']")], "asset_id string, summary string, keywords string")
    topics = spark.createDataFrame([(ID(i), "t", "s" if i == 1 else "") for i in (1, 2, 3)], "asset_id string, topic string, subtopic string")
    vectors = spark.createDataFrame([(ID(i), "st", [1.0, i / 10]) for i in range(1, 6)], "asset_id string, channel string, embedding array<double>")
    kinds = spark.createDataFrame([("references", "n", "d", False, "active")], "kind_code string, kind_name string, description string, is_symmetric boolean, status string")
    none = spark.createDataFrame([], "src string, dst string, kind_code string, confidence double, reason string, topic string, status string")

    def answer(prompt):
        if "Source summary: one" in prompt:
            assert "Source file: n1.txt" in prompt and "t / s" in prompt and "/a/" not in prompt and '"signal":"embedding"' in prompt
            return json.dumps({"edges": [{"target_media_item_id": ID(2), "relation_type_code": "References", "confidence": 0.9, "reason": "r"}, {"target_media_item_id": ID(4), "relation_type_code": "references"}, {"target_media_item_id": ID(3), "relation_type_code": "brand_new", "reason": "why"}]})
        return "no JSON"

    got = O.propose(assets, meta, topics, vectors, kinds, none, seams.text_model(answer), ["t"], auto_approve_min=0.8)
    assert rows(got["edges"], "src", "dst", "kind_code", "status", "topic") == [(ID(1), ID(2), "references", "active", "r")]
    assert rows(got["counts"], "source", "upserted", "skipped", "malformed") == [(ID(1), 1, 2, 0), (ID(2), 0, 0, 1), (ID(3), 0, 0, 1)]
    assert ("brand_new", "inactive") in rows(got["kinds"], "kind_code", "status") and got["lineage"].count() == 3


def test_no_kinds():
    assert O.kind_guide([]) == O.NO_KINDS and "- a: hint" in O.kind_guide([{"kind_code": "a", "description": "x"}], {"a": "hint"})


# --- the read path -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shelf(spark):
    docs = spark.createDataFrame(
        [(i, "text", [w], [w], f"f{i}", f"{w} fox number {i}", [1.0, i / 10], [w], w, "medical" if i == 4 else None) for i, w in enumerate(["red", "red", "blue", "red", "red"])],
        "asset_id int, modality string, keywords array<string>, labels array<string>, file_name string, summary string, embedding array<double>, about array<string>, kwtext string, domain_label string",
    )
    return docs, spark.createDataFrame([("q", "red fox number", [1.0, 0.0])], "query_id string, query string, vector array<double>")


def test_switches_need_their_inputs(spark, shelf):
    docs, q = shelf
    with pytest.raises(ValueError):
        S.search_hybrid(docs, q, ["text"], tuning=S.Tuning(rerank_enabled=True))
    fused = spark.createDataFrame([("q", "text", 1, 0.5, 0.5, True, ["hit_summary"])], "query_id string, bucket string, asset_id int, similarity double, cos double, lexical boolean, matched_queries array<string>")
    signal = spark.createDataFrame([("q", "text", 0.9, 0.1)], "query_id string, bucket string, top double, baseline double")
    for t in (S.Tuning(rerank_enabled=True), S.Tuning(about_filter_enabled=True)):
        with pytest.raises(ValueError):
            S.bucket_policy(fused, signal, 5, t)


def test_read_path(spark, shelf):
    docs, q = shelf
    off = S.Tuning(cutoff_enabled=False)
    got, meta = S.search_hybrid(docs, q, ["text"], 10, off)
    assert got.count() == 5 and meta.first().gate_passed and not meta.first().error
    assert S.search_hybrid(docs, q, ["text"], 10, off, exclude_medical=True)[0].count() == 4
    about = S.search_hybrid(docs, q, ["text"], 10, S.Tuning(cutoff_enabled=False, about_filter_enabled=True))[0]
    assert rows(about, "asset_id", "cut_count") == [(0, 1), (1, 1), (3, 1), (4, 1)]
    ranked = S.search_hybrid(docs, q, ["text"], 10, S.Tuning(cutoff_eps=-1, cutoff_floor=0, result_floor=0, rerank_enabled=True), rerank_fn=lambda query, text: F.when(text.contains("blue"), 2.0).otherwise(0.1))[0]
    assert ranked.where("rank = 1").first().asset_id == 2
    judged = S.search_hybrid(docs, q, ["text"], 10, off, judge=lambda top: top.select("query_id", "asset_id", (F.col("rank") != 1).alias("keep")))[0]
    assert judged.count() == 4
    short = S.search_hybrid(docs, q.withColumn("query", F.lit("red fox")), ["text"], 10, off, judge=lambda top: top.select("query_id", "asset_id", F.lit(False).alias("keep")))[0]
    assert short.count() == 5  # two words are not judged
    noun = S.search_hybrid(docs, q, ["text"], 10, off, normalise=lambda df: df.withColumn("query", F.lit("blue")))[0]
    assert noun.where("lexical").count() == 1
    policy = S.Policy(cut=lambda floor: F.col("asset_id") > 2)
    assert S.search_hybrid(docs, q, ["text"], 10, S.Tuning(cutoff_eps=-1, cutoff_floor=0), policy=policy)[0].count() == 2


def test_vector_hits_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", [float(i % 7), float(i % 5) + 0.5]) for i in range(60)] + [(99, "a", [0.0, 0.0]), (98, "a", [1.0])], "asset_id int, bucket string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, [1.0, k / 3]) for k in range(5)], "query_id int, vector array<double>")
    want = rows(S.vector_hits(docs, asked, 4))
    assert len(want) == 5 * 2 * 4
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    assert rows(S.vector_hits(docs, asked, 4)) == want


# --- models --------------------------------------------------------------------------------------------------------


def test_models(spark):
    scenes = spark.createDataFrame([(1, 5.5, "b"), (1, 0.0, "a"), (1, 6.0, "b"), (1, 7.0, None)], "asset_id int, start_s double, caption string")
    assert rows(seams.video_summary(scenes)) == [(1, "[0s] a\n[5s] b", 2)]
    ask = seams.object_model(lambda p: '{"n": 3}' if p == "x" else "junk", "n int")
    assert rows(spark.createDataFrame([("x",), ("y",)], "p string").select(ask(F.col("p"))["n"].alias("n"))) == [(3,), (None,)]
    see = seams.picture_model(lambda pictures: [f"{len(p)} bytes" for p in pictures])
    assert rows(spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary").select(see("b").alias("c"))) == [("3 bytes",), (None,)]


def test_snapshot_and_verdicts_are_written_by_rows(spark, tmp_path):
    """No row holds a whole file; empty ones are read again; lines that are no documents, or of another version, are errors."""
    c = spark.range(50).select(F.col("id").cast("string").alias("source"), F.lit("t").alias("target"), F.lit(0.5).alias("score"))
    p = c.select("source", "target", F.lit("k").alias("kind"), F.lit(0.1).alias("confidence"), F.lit("t").alias("topic_ko"), F.lit(0.2).alias("emb_score"))
    v = spark.range(50).select(F.col("id").cast("string").alias("edge_id"), F.lit("weak").alias("verdict"), F.lit("w" * 30).alias("why"), F.lit("s").alias("prompt_sha256"), F.lit("").alias("judged_by_human"))
    for n in (50, 0):
        snapshot, verdicts = Q.snapshot_json(c.limit(n), p.limit(n), {"model": "x"}), Q.verdict_json(v.limit(n), "m")
        assert snapshot.agg(F.max(F.length("value"))).first()[0] < 250 and verdicts.agg(F.max(F.length("value"))).first()[0] < 250
        Q.write_json(snapshot, f"{tmp_path}/s{n}")
        Q.write_json(verdicts, f"{tmp_path}/v{n}")
        got, proposed = Q.read_snapshot(spark, f"{tmp_path}/s{n}")
        assert got.count() == proposed.count() == n == got.distinct().count()
        assert {r.why for r in Q.read_verdicts(spark, f"{tmp_path}/v{n}").collect()} == ({"w" * 20} if n else set())
    good = '{"version":1,"verdicts":[{"edge_id":"a","verdict":"weak"}]}'
    for i, (text, rows) in enumerate([(good, 1), (good.replace(",", ",\n"), 1), (f"{good}\n{good}", 2), (f"{good}\n{{", None), (good + "\n" + good.replace("1", "2"), None), (good.replace("1", "2"), None), ("", None)]):
        (tmp_path / f"{i}.json").write_text(text)
        if rows:
            assert Q.read_verdicts(spark, f"{tmp_path}/{i}.json").count() == rows
        else:
            with pytest.raises(ValueError):
                Q.read_verdicts(spark, f"{tmp_path}/{i}.json")

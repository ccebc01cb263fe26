"""The pipeline's stages on the smallest tables, and the queries against their SQL."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from siltstone.llm import common, decontam, registry, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    n = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, SF), f"test-{i}")
        n.append(docs.count())
        if i < 4:
            assert docs.columns == columns, name
        if name.startswith("SimHash"):
            assert all(r.id == r.component for r in simhash.similar_groups(docs).collect())
        if name.startswith("benchmark"):
            assert not any(r.n_hit for r in decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect())
    assert n == sorted(n, reverse=True) and n[4] == n[5] > 0.4 * n[0]
    assert docs.where("not exact").isEmpty()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())


def odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string, line string"
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long), (1, long), (2, long.upper()), (3, None), (4, ""), (5, " \n "), (None, "free words here"), (None, None), (6, "x " * 50_000), (7, f"{long}\nanother line")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None, len(t) if t else None, "a", "b") for i, t in rows], schema)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name, tmp_path):
    """Nulls, repeats, ties, very long texts, extra columns, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd_rows(spark)
    got = stage(spark, docs, str(tmp_path))
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got.collect())
    if name.startswith("SentencePiece"):
        assert len(ids) == docs.count() and got.where("text is null" if "text" in got.columns else "ids is null").count() == 2
    else:
        assert got.columns == docs.columns
    want = {
        "line dedup": [None, None, 1, 3, 4, 5, 6, 7],  # 7 keeps its second line
        "SimHash near-dedup": [None, None, 1, 6],  # the null text of no id stands for all without words; 7 shares 8 of 10 shingles with 1
        "benchmark decontamination": [None, None, 3, 4, 5, 6],
    }.get(name)
    if want is not None:
        assert [i if there else None for there, i in ids] == want
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(cols).collect()), key=key) == sorted(want.select(*cols).fetchall(), key=key)

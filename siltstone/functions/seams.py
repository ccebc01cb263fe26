"""Places where models plug in. Each takes a callable over lists and gives a column function; the stubs are deterministic."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = {"st": "sentence", "st_bge": "sentence", "st_api": "remote", "clip": "image"}


def backend(channel: str) -> str:
    """Backend of a channel; an unknown one is an error."""
    try:
        return CHANNELS[channel]
    except KeyError:
        raise ValueError(f"unknown channel: {channel}") from None


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """Stub: signed hashed words, length 1; a blank text counts as one space."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.lower().split() or [" "]:
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embedder(embed: Callable[[list[str]], list] = hashed_embedding, retries: int = 2, unit: bool = False):
    """Column function text -> array<double> in Arrow batches. Transport errors (OSError) are tried again; a wrong count or an empty vector is an error.

    An answer is a vector a text, or (index, vector) pairs in any order. With `unit` vectors are brought to length 1.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t if isinstance(t, str) and t.strip() else " " for t in s]
            for attempt in range(retries + 1):
                try:
                    got = embed(texts)
                    break
                except OSError:
                    if attempt == retries:
                        raise
            if got and isinstance(got[0], tuple):
                if sorted(i for i, _ in got) != list(range(len(texts))):
                    raise ValueError("the embedder left out or repeated an index")
                got = [v for _, v in sorted(got, key=lambda x: x[0])]
            if len(got) != len(texts) or any(not len(v) for v in got):
                raise ValueError("the embedder gave another number of vectors, or an empty one")
            if unit:
                norms = [math.sqrt(sum(x * x for x in v)) for v in got]
                got = [[x / n for x in v] if n else v for v, n in zip(got, norms)]
            yield pd.Series(got, index=s.index)

    return run


def overlap_score(pairs: list[tuple[str, str]]) -> list[float]:
    """Stub reranker: share of query words in the text."""
    out = []
    for q, t in pairs:
        words = set(q.lower().split())
        out.append(len(words & set(t.lower().split())) / len(words) if words else 0.0)
    return out


def pair_scorer(score: Callable[[list[tuple[str, str]]], list[float]] = overlap_score):
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(score(list(zip(q.fillna(""), t.fillna("")))), index=q.index, dtype="float64")

    return run


def text_model(complete: Callable[[str], str]):
    """Column function prompt -> answer."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(complete, na_action="ignore")

    return run


def json_object(text) -> dict:
    """The object that an answer holds; {} if it is none."""
    try:
        got = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def object_model(complete: Callable[[str], str], schema: str):
    """Column function prompt -> struct of `schema` from the JSON object that the answer holds; null fields where it has none."""
    ask = text_model(lambda p: json.dumps(json_object(complete(p)), ensure_ascii=False))
    return lambda prompt: F.from_json(ask(prompt), schema)


def picture_model(describe: Callable[[list[bytes]], list[str]]):
    """Column function binary picture -> caption, by batches; a picture that is null has none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            there = s[s.notna()]
            got = describe([bytes(b) for b in there]) if len(there) else []
            if len(got) != len(there):
                raise ValueError("the model gave another number of captions")
            yield pd.Series(got, index=there.index, dtype="object").reindex(s.index)

    return run


def video_summary(scenes: DataFrame, by: str = "asset_id", start: str = "start_s", caption: str = "caption") -> DataFrame:
    """(by, summary, n_scenes): captions in order of time, one a line with its second, repeats of the one before left out."""
    own = scenes.where(F.coalesce(caption, F.lit("")) != "")
    listed = F.array_sort(F.collect_list(F.struct(start, caption)))
    fresh = F.filter(F.col("l"), lambda x, i: (i == 0) | (F.get(F.col("l"), i - 1)[caption] != x[caption]))
    line = lambda x: F.concat(F.lit("["), F.floor(x[start]).cast("string"), F.lit("s] "), x[caption])
    return own.groupBy(by).agg(listed.alias("l")).select(by, F.array_join(F.transform(fresh, line), "\n").alias("summary"), F.size(fresh).alias("n_scenes"))


def summarise(chunks: DataFrame, complete: Callable[[str], str], by: str = "asset_id", order: str = "chunk_index", text: str = "chunk", least: int = 1) -> DataFrame:
    """(by, summary): each chunk is summarised, the partial summaries of a group are joined in order and summarised again.

    Groups whose text is shorter than `least` characters have a null summary.
    """
    ask = text_model(complete)
    part = chunks.withColumn("part", ask(F.col(text)))
    grouped = part.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda s: s["part"]), "\n").alias("parts"), F.sum(F.length(text)).alias("size"))
    return grouped.select(by, F.when(F.col("size") >= least, ask(F.col("parts"))).alias("summary"))

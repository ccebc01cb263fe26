"""Search documents, chunks, snapshots of tables, access tiers, field schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .vectors import mean_vector

# Access tiers from open to closed, and the least tier of a domain.
TIERS = ["public", "authorized", "regulated"]
DOMAIN_FLOOR = {"medical": "regulated", "review": "authorized"}


def index_rows(assets: DataFrame, metadata: DataFrame, embeddings: DataFrame, channel: str) -> DataFrame:
    """Registered assets with metadata and the mean vector of a channel; assets without a vector drop out."""
    own = assets.where("status = 'registered'")
    means = mean_vector(embeddings.where((F.col("channel") == channel) & F.col("embedding").isNotNull()), ["asset_id"])
    return own.join(metadata, "asset_id", "left").join(means, "asset_id", "inner")


def search_documents(rows: DataFrame, topics: DataFrame | None = None, noise: list[str] = ()) -> DataFrame:
    """One document per row (asset_id, fs_path, summary, keywords, labels, embedding, ...): file name words, flat labels, topics, filter fields.

    Topic fields are null without a topic; a zero vector is null.
    """
    labels = F.filter(F.transform("labels", lambda x: T.strip(x["label"])), lambda x: x.isNotNull() & (x != ""))
    out = rows.withColumns(
        {
            "file_name": T.clean_file_name(F.col("fs_path"), noise),
            "summary": F.coalesce("summary", F.lit("")),
            "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
            "labels": F.coalesce(labels, F.array().cast("array<string>")),
            "file_ext": T.extension(F.col("fs_path")),
            "source_dataset": T.source_dataset(F.col("fs_path")),
            "embedding": F.when(F.exists("embedding", lambda x: x != 0), F.col("embedding")),
        }
    )
    if topics is None:
        return out
    own = topics.where(F.coalesce("topic", F.lit("")) != "").groupBy("asset_id").agg(
        F.array_sort(F.collect_set("topic")).alias("topics"), F.array_sort(F.array_compact(F.collect_set(T.blank_to_null(F.col("subtopic"))))).alias("subtopics"), F.array_sort(F.collect_set(T.topic_pair(F.col("topic"), F.col("subtopic")))).alias("topic_pairs")
    )
    return out.join(own, "asset_id", "left")


def merge_rows(existing: DataFrame, incoming: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """The table after an upsert by key: `columns` of incoming rows win (nulls and empty lists too), others stay. Keys are unique on both sides."""
    columns = columns if columns is not None else [c for c in incoming.columns if c not in key]
    new = incoming.select(*key, *[F.col(c).alias(f"n_{c}") for c in columns], F.lit(True).alias("__new"))
    both = existing.join(new, key, "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)
    return both.select(*[F.col(c) if c in key else pick(c).alias(c) for c in existing.columns])


def get_or_create_nodes(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset nodes (node, asset_id) with those of new assets; a node's id follows from its asset's."""
    new = assets.select(F.col("asset_id").cast("string").alias("asset_id")).distinct().join(nodes.select("asset_id"), "asset_id", "left_anti")
    return nodes.unionByName(new.select(F.sha2(F.concat(F.lit("asset:"), "asset_id"), 256).alias("node"), "asset_id"))


def content_duplicates(assets: DataFrame) -> DataFrame:
    """Registered or deferred assets whose content hash an earlier one has: asset_id, first."""
    own = assets.where(F.col("status").isin("registered", "deferred") & F.col("file_hash").isNotNull())
    first = own.groupBy("file_hash").agg(F.min(F.struct("created_at", "asset_id")).alias("f"))
    return own.join(first, "file_hash").where(F.col("asset_id") != F.col("f.asset_id")).select("asset_id", F.col("f.asset_id").alias("first"))


def chunks(segments: Column, size: int, overlap: int = 0) -> Column:
    """Array of chunks: segments packed in order up to `size` characters, joined by line breaks; a longer one is cut alone.

    With `overlap` a chunk begins with the end of the one before it (as that was before its own overlap).
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    clean = F.filter(F.transform(segments, T.strip), lambda s: s.isNotNull() & (s != ""))
    # an over-long segment becomes its cuts, marked so that nothing is packed with them
    cuts = F.flatten(F.transform(clean, lambda s: F.when(F.length(s) <= size, F.array(F.struct(s.alias("t"), F.lit(False).alias("cut")))).otherwise(F.transform(F.sequence(F.lit(0), ((F.length(s) - 1) / size).cast("int")), lambda i: F.struct(F.substring(s, i * size + 1, F.lit(size)).alias("t"), F.lit(True).alias("cut"))))))
    start = F.array().cast("array<struct<t:string,cut:boolean>>")

    def add(done, x):
        last = F.get(done, F.size(done) - 1)
        fits = (F.size(done) > 0) & ~x["cut"] & ~last["cut"] & (F.length(last["t"]) + 1 + F.length(x["t"]) <= size)
        joined = F.struct(F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"), F.lit(False).alias("cut"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    packed = F.transform(F.aggregate(cuts, start, add), lambda x: x["t"])
    if not overlap:
        return packed
    return F.transform(packed, lambda c, i: F.when(i == 0, c).otherwise(T.strip(F.concat(F.right(F.get(packed, i - 1), F.lit(overlap)), F.lit("\n"), c))))


def limit_chars(segments: Column, most: int) -> Column:
    """Segments up to `most` characters in all, the last one cut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(max(0, most)).alias("left"))
    step = lambda s, x: F.when((s["left"] <= 0) | (x == ""), s).otherwise(F.struct(F.concat(s["out"], F.array(F.left(x, s["left"]))).alias("out"), (s["left"] - F.least(s["left"], F.length(x))).alias("left")))
    return F.aggregate(F.filter(segments, lambda x: x.isNotNull()), start, step, lambda s: s["out"])


def chunk_rows(docs: DataFrame, size: int, overlap: int = 0, id_col: str = "asset_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, chunk) of the lines of a text."""
    return docs.select(id_col, F.posexplode(chunks(F.split(text_col, "\n"), size, overlap)).alias("chunk_index", "chunk"))


def document_vectors(chunks: DataFrame, ids: DataFrame, embed, size: int, id_col: str = "asset_id") -> DataFrame:
    """(id, chunk_index, embedding) of chunks; a document of `ids` without a chunk has one zero vector at index 0."""
    own = chunks.select(id_col, "chunk_index", embed("chunk").alias("embedding"))
    none = ids.select(id_col).join(chunks.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.lit(0).alias("chunk_index"), F.array_repeat(F.lit(0.0), size).alias("embedding"))
    return own.unionByName(none)


def timeline(rows: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """(by, text): texts of a group in order, one a line."""
    item = F.struct(*order, text)
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s[text]), "\n").alias("text"))


def ordinal(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, t in enumerate(TIERS):
        out = F.when(tier == t, F.lit(i)).otherwise(out)
    return out


def effective_tier(field_tier: Column, domain: Column) -> Column:
    """The stricter of a field's tier and its domain's floor, as text."""
    floor = F.lit(None).cast("int")
    for d, t in DOMAIN_FLOOR.items():
        floor = F.when(domain == d, F.lit(TIERS.index(t))).otherwise(floor)
    return F.get(F.array(*map(F.lit, TIERS)), F.greatest(F.coalesce(ordinal(field_tier), F.lit(0)), F.coalesce(floor, F.lit(0))))


def clearance(authenticated: Column) -> Column:
    return F.when(authenticated, "authorized").otherwise("public")


def readable(meta: Column, domain: Column, tiers: DataFrame, cleared: Column) -> Column:
    """A string map without the keys above the clearance; `tiers` (meta_key, access_tier) is the small registry of one domain. Unregistered keys pass."""
    known = {r["meta_key"]: r["access_tier"] for r in tiers.select("meta_key", "access_tier").collect()}
    if not known:
        return meta
    of = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.map_filter(meta, lambda k, _: F.element_at(of, k).isNull() | (ordinal(effective_tier(F.element_at(of, k), domain)) <= ordinal(cleared)))


def unknown_keys(meta: Column, allowed: list[str]) -> Column:
    """Keys that are not registered, sorted; a domain without registered keys allows all."""
    if not allowed:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_except(F.map_keys(meta), F.array(*map(F.lit, allowed))))


def _violations(value, schema: dict, path: str) -> Iterator[str]:
    kinds = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}
    want = schema.get("type")
    wants = [want] if isinstance(want, str) else want or []
    if wants and not any(isinstance(value, kinds[w]) and not (isinstance(value, bool) and w in ("number", "integer")) for w in wants):
        yield f"{path}: not {'/'.join(wants)}"
        return
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from _violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            if k not in value:
                yield f"{path}: {k} is missing"
        for k, s in schema.get("properties", {}).items():
            if k in value:
                yield from _violations(value[k], s, f"{path}.{k}")
    if "enum" in schema and value not in schema["enum"]:
        yield f"{path}: not one of the values"


def schema_violations(schemas: dict[str, dict]):
    """A column function: sorted violations of a JSON object's keys against their schemas (types, items, required, properties, enum)."""

    @F.pandas_udf("array<string>")
    def check(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                try:
                    value = json.loads(t) if t is not None else {}
                except ValueError:
                    out.append(["not JSON"])
                    continue
                out.append(sorted(v for k, sc in schemas.items() if isinstance(value, dict) and k in value for v in _violations(value[k], sc, k)) if isinstance(value, dict) else ["not an object"])
            yield pd.Series(out, index=s.index)

    return check


def zero_shot(scores: Column, labels: list[str], scale: float = 100.0) -> Column:
    """array<struct<label, score>> by softmax of scaled cosines, best first, ties by label."""
    p = N.softmax(F.transform(scores, lambda x: x * scale))
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("o"), F.get(F.array(*map(F.lit, labels)), i).alias("label")))
    return F.transform(F.array_sort(pairs), lambda s: F.struct(s["label"].alias("label"), (-s["o"]).alias("score")))


def running_index(rows: DataFrame, by: str, order: str, keep: Column) -> DataFrame:
    """Rows that `keep` holds for, numbered from 0 within their group."""
    return rows.where(keep).withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)

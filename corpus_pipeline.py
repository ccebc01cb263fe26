"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes the result of each as Parquet to
the shared folder and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import cotrain, decontam, linededup, pieces, simhash
from siltstone.llm.common import numbered, place, scratch, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    A null text is scored as an empty one, null metadata as a value of its own; rows without an id stay, rows that share an id go
    together only if all are rejected. Without labels every row stays; an empty table gives no rows.
    """
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that match an earlier one; documents that lose all their lines go.

    Null and empty texts have no lines and stay as they are. Earlier means a smaller id, then line; where ids repeat or are null, rows
    count in order of id (nulls first) and text, so of repeated rows the first stays. An empty table gives no rows.
    """
    out = linededup.keep_documents(docs)
    if "n_chars" not in [c.lower() for c in docs.columns]:
        return out
    at, text = place(out, "n_chars"), place(out, "text")
    return numbered(out).withColumn(f"c{at}", F.length(f"c{text}").cast(out.schema[at].dataType)).toDF(*out.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts that share 0.8 or more of their five-word shingles.

    Null and empty texts share the empty set: one of them stays. First means the smallest id (nulls first), ties by text; of repeated
    rows one stays. An empty table gives no rows.
    """
    return simhash.keep_one_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; null items have no windows. Rows that share an id (null as well) go together. An empty table
    gives no rows, an empty benchmark leaves all.
    """
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts: doc_id, ids, n_tokens, exact (the ids decode to the text).

    A null text has null ids, an empty one none; null ids of documents and repeated rows are kept. An empty table gives no rows.
    """
    return pieces.encode(docs, pieces.load()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on the way is deleted once its result is saved."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/siltstone/stage-{i}-{uuid.uuid4().hex}"
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

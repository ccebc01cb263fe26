"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import delete, discard, scratch, scratch_path, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, leaving every other character alone."""
    return F.translate(col, UPPER, UPPER.lower())


def place(df: DataFrame, name: str) -> int:
    """Position of the column `name`: the one spelled so, else the only one that differs in case alone."""
    for alike in ([i for i, c in enumerate(df.columns) if c == name], [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]):
        if len(alike) == 1:
            return alike[0]
        if alike:
            break
    raise ValueError(f"{len(alike)} columns are named {name}")


def numbered(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ..: no name of the caller can clash with one of ours, or with another by case."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The columns `names` (ours = the caller's), whatever else `df` holds."""
    return numbered(df).select(*[F.col(f"c{place(df, theirs)}").alias(ours) for ours, theirs in names.items()])


def without(df: DataFrame, id_col: str, gone: DataFrame, nulls_too: bool = False) -> DataFrame:
    """`df` without the rows whose id is in the one column of `gone`; rows without an id stay unless `nulls_too`."""
    key = F.col(f"c{place(df, id_col)}")
    bad = gone.toDF("gone")
    return numbered(df).join(bad, key.eqNullSafe(F.col("gone")) if nulls_too else key == F.col("gone"), "left_anti").toDF(*df.columns)

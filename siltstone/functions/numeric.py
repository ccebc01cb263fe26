"""Scores, intervals and vectors as column expressions. Non-finite numbers are settled before any comparison."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-9


def finite(c: Column, default: float = 0.0) -> Column:
    """`c` as a double, `default` where it is null, not a number or infinite."""
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(default)).otherwise(d)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def cosine_of_score(score: Column) -> Column:
    """Cosine from a (1 + cos) / 2 score; an invalid score counts as 0.5."""
    return clamp(2 * finite(score, 0.5) - 1, -1.0, 1.0)


def confidence(c: Column) -> Column:
    return clamp(finite(c), 0.0, 1.0)


def min_max(c: Column, *by: str) -> Column:
    """Min-max of finite values within a partition; all 1 where the span is 0."""
    w = Window.partitionBy(*by)
    v = finite(c)
    low, span = F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)
    return F.when(span <= 0, F.lit(1.0)).otherwise((v - low) / F.when(span > 0, span))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of the Wilson interval; (0, 1) for n <= 0."""
    m = F.when(n > 0, n.cast("double"))
    p = hits / m
    mid, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)).alias("low"), F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0)).alias("high"))


def band(c: Column) -> Column:
    """Confidence band; null falls to the last."""
    return F.when(c < 0.60, "<.60").when(c < 0.75, ".60-.75").when(c < 0.90, ".75-.90").when(c < 0.95, ".90-.95").otherwise(">=.95")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no direction."""
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n > 0, n)


def unit(v: Column) -> Column:
    """Length 1; a zero vector is left alone."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def padded(v: Column, size: int) -> Column:
    """Cut or filled with zeros to `size`."""
    return F.slice(F.concat(F.transform(v, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def nearest_rank(values: Column, q: float) -> Column:
    """The ceil(q n)-th smallest; null for none."""
    s = F.array_sort(values)
    at = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.size(s)).cast("int"))
    return F.get(s, at - 1)


def day(c: Column) -> Column:
    """Day as text from a timestamp, a date or text that begins with one."""
    return F.left(c.cast("string"), F.lit(10))

"""Vector expressions over arrays of doubles; all stay in the JVM. Arrays of a pair must be equally long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column, w: Column | None = None) -> Column:
    """Weighted Euclidean distance."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(_sum(sq if w is None else F.zip_with(sq, w, lambda x, y: x * y)))


def manhattan(a: Column, b: Column) -> Column:
    """S1."""
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    """S1."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine."""
    return 1 - cosine(a, b)


def similarity(d: Column, compat: bool = False) -> Column:
    """exp(-d); compat gives 1 - exp(-d), which grows with the distance (Q8)."""
    return 1 - F.exp(-d) if compat else F.exp(-d)


def interpolate(a: Column, b: Column, alpha: float) -> Column:
    """A (1 - alpha) + b alpha, alpha in [0, 1]."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def extrapolate(origin: Column, delta: Column, factor: float) -> Column:
    """Origin + delta * factor."""
    return F.zip_with(origin, delta, lambda x, y: x + y * factor)


def clamp(target: Column, anchor: Column, cap: float) -> Column:
    """The target, or the point at distance ``cap`` from the anchor towards it if that is nearer."""
    d = euclidean(target, anchor)
    return F.when(d <= cap, target).otherwise(F.zip_with(anchor, target, lambda a, t: a + (t - a) * (F.lit(cap) / d)))


def transition_shape(df: DataFrame, start: str, end: str, duration_ms: Column) -> DataFrame:
    """W60 over normalised vectors: unit direction, magnitude, velocity (magnitude per ms; 0 without duration), curvature.

    A displacement of 1e-10 or less has no direction (zeros). Curvature is the gap between the middle of both vectors and
    half of the displacement.
    """
    gap = F.zip_with(end, start, lambda e, s: e - s)
    size = F.sqrt(_sum(F.transform(gap, lambda x: x * x)))
    bend = F.zip_with(F.zip_with(start, end, lambda s, e: (s + e) / 2), F.transform(gap, lambda x: x / 2), lambda m, h: (m - h) * (m - h))
    df = df.withColumn("magnitude", size).withColumn("curvature", F.sqrt(_sum(bend)))
    df = df.withColumn("direction", F.transform(gap, lambda x: F.when(F.col("magnitude") > 1e-10, x / F.col("magnitude")).otherwise(0.0)))
    return df.withColumn("velocity", F.when(duration_ms > 0, F.col("magnitude") / duration_ms).otherwise(0.0))


def soft_gate(x: Column, masks: list[list[float]], p: Column, confident: float = 0.5) -> Column:
    """X times the probability-weighted sum of masks; x itself if no probability reaches ``confident``."""
    gate = F.zip_with(F.array(*[F.array(*map(F.lit, m)) for m in masks]), p, lambda m, q: F.transform(m, lambda v: v * q))
    total = F.aggregate(F.slice(gate, 2, max(1, len(masks) - 1)), F.get(gate, F.lit(0)), lambda s, m: F.zip_with(s, m, lambda u, v: u + v)) if len(masks) > 1 else F.get(gate, F.lit(0))
    return F.when(F.array_max(p) >= confident, F.zip_with(x, total, lambda u, v: u * v)).otherwise(x)


def means(df: DataFrame, key: str, v: str, more: bool = False) -> DataFrame:
    """Mean vector (and population deviations) per key, place by place; combined on the map side."""
    each = df.select(key, F.posexplode(v).alias("k", "x"))
    stats = each.groupBy(key, "k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    pick = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("k", n))), lambda x: x[n])
    return stats.groupBy(key).agg(pick("m").alias("mean"), *([pick("s").alias("std")] if more else []))


def scaled(df: DataFrame, v: str, center: bool = True) -> DataFrame:
    """(x - mean) / population deviation per place; deviations under 1e-10 count as 1. The statistics are one row."""
    one = means(df.withColumn("_all", F.lit(1)), "_all", v, more=True).select("mean", "std")
    unit = F.transform("std", lambda s: F.when(s < 1e-10, 1.0).otherwise(s))
    x = F.zip_with(v, "mean", lambda a, m: a - m) if center else F.col(v)
    return df.crossJoin(F.broadcast(one)).withColumn(v, F.zip_with(x, unit, lambda a, s: a / s)).drop("mean", "std")

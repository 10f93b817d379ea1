"""Scalar scores over columns, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sequences import r6
from . import vectors as v


def convergence(pre: Column, ai: Column, post: Column) -> dict[str, Column]:
    """d(pre, ai) - d(post, ai), its sigmoid at 10, and its direction (within 0.01: neutral)."""
    gain = r6(v.euclidean(pre, ai) - v.euclidean(post, ai))
    return {"gain": gain, "score": r6(1 / (1 + F.exp(-10 * gain))), "direction": F.when(gain > 0.01, "converging").when(gain < -0.01, "diverging").otherwise("neutral")}


def latency_score(latency: Column, low: float, high: float, best: float) -> Column:
    """exp(-3 |relative deviation from the best|) inside [low, high], else 0."""
    return r6(F.when(latency.between(low, high), F.exp(-3 * F.abs(latency - best) / best)).otherwise(0.0))


def interaction(latency: Column, low: float, high: float, conv: Column, prosody: Column, w: tuple[float, float] = (0.6, 0.4)) -> Column:
    """0 outside the time gate, else weighted convergence and prosody; the latency score is no factor (Q13)."""
    return r6(F.when(latency.between(low, high), w[0] * conv + w[1] * prosody).otherwise(0.0))


def mahalanobis(x: Column, mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance, the quadratic form of x - mean with an inverse covariance (rows of arrays)."""
    d = F.zip_with(x, mean, lambda a, b: a - b)
    return v.dot(d, F.transform(inverse, lambda row: v.dot(row, d)))


def anomaly(distance: Column) -> Column:
    """1 - exp(-d / 10), clamped to [0, 1]."""
    return r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.exp(-distance / 10))))


def receivers(edges: DataFrame, threshold: float, arousal: str = "arousal") -> DataFrame:
    """S16 over edges(src, dst, distance, tie, sight, facing, arousal): score and the best receiver per caller.

    Score: 0.4 exp(-d) + 0.3 tie + 0.3 line of sight (1 or 0.1) + 0.1 cos facing. A weak best with arousal over 0.7 is
    directed to the system; below the threshold the call is a broadcast.
    """
    score = 0.4 * F.exp(-F.col("distance")) + 0.3 * F.col("tie") + 0.3 * F.when(F.col("sight"), 1.0).otherwise(0.1) + 0.1 * F.cos("facing")
    best = edges.withColumn("score", r6(score)).groupBy("src").agg(F.max_by(F.struct("dst", "score"), F.struct("score", -F.col("dst"))).alias("m"), F.max(arousal).alias("arousal"))
    weak = F.col("m.score") < threshold
    return best.select("src", F.when(weak & (F.col("arousal") > 0.7), "system").when(weak, "broadcast").otherwise(F.col("m.dst").cast("string")).alias("receiver"), F.col("m.score").alias("score"))


def receiver_shares(edges: DataFrame, threshold: float) -> DataFrame:
    """Weights 1 / (1 + d) * (1 or 0.2 without sight) * affinity (0.5 if null), normalised per caller; unicast above the threshold."""
    weight = 1 / (1 + F.col("distance")) * F.when(F.col("sight"), 1.0).otherwise(0.2) * F.coalesce("tie", F.lit(0.5))
    out = edges.withColumn("w", weight).withColumn("share", r6(F.col("w") / F.sum("w").over(W.partitionBy("src"))))
    return out.withColumn("unicast", F.max("share").over(W.partitionBy("src")) > threshold).select("src", "dst", "share", "unicast")


def is_broadcast(arousal: Column, entropy: Column, neighbours: Column) -> Column:
    """S18."""
    return (arousal > 0.7) | (entropy > 1.5) | (neighbours == 0)


def is_graded(probabilities: Column, threshold: float = 0.3) -> Column:
    """Whether a map's second greatest value reaches the threshold."""
    return F.coalesce(F.get(F.array_sort(F.map_values(probabilities), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), F.lit(1)) >= threshold, F.lit(False))


def bucket(key: Column, ratio: float) -> Column:
    """Whether the first 32 bits of a key's MD5, as a share, lie under the ratio."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967295.0 < ratio


def harmonic_distance(a: Column, b: Column) -> Column:
    """|r - round(r)| / round(r) of r = a / b, half to even; infinite for zero."""
    r = F.try_divide(a, b)
    near = F.bround(r)
    return F.when((b == 0) | (near == 0), float("inf")).otherwise(r6(F.abs(r - near) / near))


def persona_score(ranges: list[tuple[Column, float, float]]) -> Column:
    """Mean normalised place of the features inside their ranges; zeros and outside values are skipped; none: 0."""
    parts = F.filter(F.array(*[F.when((c != 0) & c.between(lo, hi), (c - lo) / (hi - lo)) for c, lo, hi in ranges]), lambda x: x.isNotNull())
    return r6(F.when(F.size(parts) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)))


def feature_similarity(a: list[Column], b: list[Column], w: list[float], spans: list[float]) -> Column:
    """1 - weighted mean |a - b| / span over features positive in both, at least 0; none shared: 0."""
    both = [(x > 0) & (y > 0) for x, y in zip(a, b, strict=True)]
    total = sum((F.when(k, F.lit(q)).otherwise(0.0) for k, q in zip(both, w, strict=True)), F.lit(0.0))
    gap = sum((F.when(k, q * F.abs(x - y) / s).otherwise(0.0) for k, x, y, q, s in zip(both, a, b, w, spans, strict=True)), F.lit(0.0))
    return r6(F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / total)))


def timbre_distance(a: list[Column], b: list[Column], spans: list[float]) -> Column:
    """Euclidean distance of features over their spans."""
    return r6(F.sqrt(sum((((x - y) / s) ** 2 for x, y, s in zip(a, b, spans, strict=True)), F.lit(0.0))))


def vote(candidates: DataFrame, w: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """S25 over candidates(id, class, rank, conf, p): the class of greatest w0 conf + w1 p; ties: the better rank."""
    s = r6(w[0] * F.col("conf") + w[1] * F.coalesce("p", F.lit(0.0)))
    return candidates.withColumn("score", s).groupBy("id").agg(F.max_by(F.struct("class", "score"), F.struct("score", -F.col("rank"))).alias("m")).select("id", "m.class", "m.score")


def veto(candidates: DataFrame) -> DataFrame:
    """S26 over candidates(id, class, grp, rank, conf, wanted): the first candidate of the wanted group, else the first at half its confidence."""
    c = F.struct("class", "conf")
    out = candidates.groupBy("id").agg(F.min_by(c, "rank").alias("first"), F.min_by(c, F.when(F.col("grp") == F.col("wanted"), F.col("rank"))).alias("hit"))
    return out.select("id", F.coalesce("hit.class", "first.class").alias("class"), r6(F.coalesce(F.col("hit.conf"), F.col("first.conf") * 0.5)).alias("conf"))


def blend(p: Column, q: Column) -> Column:
    """Two probability arrays blended by their confidences (greatest entries)."""
    a, b = F.array_max(p), F.array_max(q)
    return F.zip_with(p, q, lambda x, y: (x * a + y * b) / (a + b))


def uncertainty(x: Column, floor: float = 0.0) -> Column:
    """Sample variance of an array, at least ``floor``; one entry or none: 0."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / n
    return r6(F.when(n <= 1, 0.0).otherwise(F.greatest(F.lit(floor), F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean)) / (n - 1))))


def next_token(logits: Column, forbidden: Column, temperature: float = 1.0, draw: Column | None = None, k: int | None = None, top_p: float = 1.0) -> Column:
    """Index of the next token: forbidden ones never, temperature, then the greedy choice or, with a uniform draw, top-k and top-p."""
    scored = F.transform(logits, lambda x, i: F.struct(F.when(F.array_contains(forbidden, i), float("-inf")).otherwise(x / temperature).alias("s"), (-i).alias("i")))
    order = F.reverse(F.array_sort(scored))
    if draw is None:
        return -F.get(order, F.lit(0))["i"]
    order = F.slice(order, 1, k) if k else order
    top = F.get(order, F.lit(0))["s"]
    w = F.transform(order, lambda x: F.exp(x["s"] - top))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    cum = F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: F.aggregate(F.slice(w, F.lit(1), n), F.lit(0.0), lambda s, x: s + x) / total)
    kept = F.size(F.filter(cum, lambda x: x < top_p)) + 1
    scale = F.get(cum, F.least(kept, F.size(w)) - 1)
    at = F.least(F.size(F.filter(cum, lambda x: x < draw * scale)), F.size(w) - 1)
    return -F.get(order, at)["i"]


def sweeps(peaks: DataFrame, key: str, time: str, freq: str, slope: float, least: int) -> DataFrame:
    """Runs of ``least`` or more frames whose peak frequency moves one way by ``slope`` or more per frame."""
    w = W.partitionBy(key).orderBy(time)
    d = F.col(freq) - F.lag(freq).over(w)
    m = peaks.withColumn("dir", F.when(d >= slope, 1).when(d <= -slope, -1).otherwise(0))
    m = m.withColumn("run", F.sum((F.coalesce(F.lag("dir").over(w) != F.col("dir"), F.lit(True))).cast("int")).over(w))
    return m.where("dir <> 0").groupBy(key, "run", "dir").agg(F.count("*").alias("frames"), F.min(time).alias("start"), F.max(time).alias("stop")).where(F.col("frames") >= least)

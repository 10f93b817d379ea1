"""Functions with the caller's code and variable-row extractors."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import gap_sessions, r6
from . import kernels

PREDICATES: dict[str, Callable] = {}


def predicate(name: str):
    """Register a row predicate."""

    def add(f):
        PREDICATES[name] = f
        return f

    return add


def validate(rows: DataFrame, column: str, f: Callable) -> DataFrame:
    """Rows with valid, the predicate's value; an exception counts as false, with a warning."""

    @F.pandas_udf("boolean")
    def ok(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return bool(f(x))
            except Exception as e:
                warnings.warn(f"predicate failed: {e}", stacklevel=2)
                return False

        return s.map(one)

    return rows.withColumn("valid", ok(column))


def extract(waves: DataFrame, bands: int) -> DataFrame:
    """U5 (112), U6 (112), U7 (45) over waves(id, rate, x): feature vectors."""

    @F.pandas_udf("array<double>")
    def f(x: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([kernels.waveform_features(np.asarray(a), r, bands).tolist() for a, r in zip(x, rate, strict=True)])

    return waves.select("id", f("x", "rate").alias("features"))


def phrases(waves: DataFrame, gap_ms: float = 20, least_ms: float = 10, level: float = 0.05) -> DataFrame:
    """U2, U8 over waves(id, rate, x): one row per phrase with its samples."""

    def run(batches):
        for pdf in batches:
            rows = [(i, k, s, e) for i, r, x in pdf[["id", "rate", "x"]].itertuples(index=False) for k, (s, e) in enumerate(kernels.segments(np.asarray(x), r, gap_ms, least_ms, level))]
            yield pd.DataFrame(rows, columns=["id", "phrase", "start", "stop"]).astype("int64")

    return waves.mapInPandas(run, "id long, phrase long, start long, stop long")


def modality(waves: DataFrame) -> DataFrame:
    """Noise, harmonic or sweep by flatness and the pitch change between halves."""

    @F.pandas_udf("string")
    def f(x: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for a, r in zip(x, rate, strict=True):
            a = np.asarray(a)
            flat = kernels.waveform_features(a, r, 6)[4]
            p, q = kernels.yin(a[: len(a) // 2], r), kernels.yin(a[len(a) // 2 :], r)
            out.append("noise" if flat > 0.3 else "sweep" if p and q and abs(p - q) > 0.1 * p else "harmonic")
        return pd.Series(out)

    return waves.select("id", f("x", "rate").alias("modality"))


def pitch(waves: DataFrame) -> DataFrame:
    """U11."""
    f = F.pandas_udf(lambda x, rate: pd.Series([kernels.yin(np.asarray(a), r) for a, r in zip(x, rate, strict=True)]), "double")
    return waves.select("id", r6(f("x", "rate")).alias("f0"))


def codas(clicks: DataFrame, key: str, time: str, max_gap: float) -> DataFrame:
    """Gap-limited groups of click times."""
    return gap_sessions(clicks, key, time, max_gap)


def response_scores(rows: DataFrame, baselines: list[list[float]], sigma: float = 1.0, size: int = 20) -> DataFrame:
    """U12 over rows(id, v): best exp(-(distance / steps) / sigma) over resampled baselines; without baselines 0.5."""

    def resample(x):
        x = np.asarray(x, float)
        return np.interp(np.linspace(0, 1, size), np.linspace(0, 1, len(x)), x)

    base = [resample(b) for b in baselines]

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return pd.Series([max((float(np.exp(-(kernels.dtw(resample(x), b) / size) / sigma)) for b in base), default=0.5) for x in v])

    return rows.select("id", r6(f("v")).alias("score"))


def turing_ratio(similarities: DataFrame, threshold: float = 0.9) -> DataFrame:
    """U13 over similarities(kind, s), kind 'ai' or 'natural': ratio of mean similarities and whether it passes."""
    m = similarities.agg(F.avg(F.when(F.col("kind") == "ai", F.col("s"))).alias("a"), F.avg(F.when(F.col("kind") == "natural", F.col("s"))).alias("n"))
    ratio = F.coalesce(F.try_divide("a", "n"), F.lit(0.0))
    return m.select(r6(ratio).alias("ratio"), (ratio >= threshold).alias("passed"))


def parsed_tokens(t: DataFrame, meanings: dict[str, str]) -> DataFrame:
    """U4: a row per token with its meaning; confidence 1 with one, else 0.5."""
    table = F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv]) if meanings else F.create_map().cast("map<string,string>")
    out = t.withColumn("meaning", F.try_element_at(table, F.col("token")))
    return out.withColumn("confidence", F.when(F.col("meaning").isNotNull(), 1.0).otherwise(0.5))


def parse_idioms(t: DataFrame, idioms: dict[str, list[str]], openers: list[str], closers: list[str]) -> DataFrame:
    """U3 over long-form tokens: left-to-right parse of a sequence: an idiom by its first token, opener at place 0, closer at 1, content, noise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        s, out, i = pdf["token"].tolist(), [], 0
        while i < len(s):
            idiom = idioms.get(s[i])
            if idiom and s[i : i + len(idiom)] == idiom:
                out.append((i, " ".join(idiom), "idiom"))
                i += len(idiom)
                continue
            out.append((i, s[i], "noise" if not s[i] else "opener" if i == 0 and s[i] in openers else "closer" if i == 1 and s[i] in closers else "content"))
            i += 1
        return pd.DataFrame([(pdf["seq"].iloc[0], *o) for o in out], columns=["seq", "pos", "part", "role"])

    kind = t.schema["seq"].dataType.simpleString()
    return t.select("seq", "pos", "token").groupBy("seq").applyInPandas(run, f"seq {kind}, pos long, part string, role string")


def dispute_phases(rows: DataFrame, key: str, time: str, value: str, jump: float = 0.2) -> DataFrame:
    """Banded phases of a trajectory and its tipping point, the first rise over ``jump`` into the escalated band."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(time)
    band = F.when(F.col(value) < 0.33, "calm").when(F.col(value) < 0.66, "tense").otherwise("escalated")
    m = rows.withColumn("band", band).withColumn("_d", F.col(value) - F.lag(value).over(w))
    return m.groupBy(key).agg(*[F.count_if(F.col("band") == b).alias(b) for b in ("calm", "tense", "escalated")], F.min(F.when((F.col("_d") > jump) & (F.col("band") == "escalated"), F.col(time))).alias("tipping_point"))

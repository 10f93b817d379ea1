"""Stateful operators, each as a batch form on ordered rows and, where state is kept, as a keyed streaming operator.

Streams use event time with a watermark; rows later than it are dropped. The keyed operators order a micro-batch's rows
of a key by time, so a replay of a stream in time order gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequences import divided, r6
from ..plans.lineage import running


def replay(spark, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parse_events(raw: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """ST5 over raw(value): (events, dead letters); messages that don't parse go to the second."""
    x = raw.withColumn("e", F.from_json("value", schema))
    # A message that isn't JSON parses to a struct of nulls.
    first = [f"e.{f.name}" for f in x.schema["e"].dataType.fields]
    good = F.coalesce(*[F.col(c).cast("string") for c in first]).isNotNull()
    return x.where(good).select("e.*"), x.where(~good).select("value")


def recent(df: DataFrame, time: str, seconds: int) -> DataFrame:
    """ST1, ST2: rows of the last seconds before the newest one, by event time; a stream bounds its state by a watermark."""
    if df.isStreaming:
        return df.withWatermark(time, f"{seconds} seconds").groupBy(F.window(time, f"{seconds} seconds")).agg(F.count("*").alias("n"))
    newest = df.agg(F.max(time).alias("_newest"))
    return df.crossJoin(F.broadcast(newest)).where(F.col("_newest") - F.col(time) <= seconds).drop("_newest")


def range_from_oldest(df: DataFrame, time: str, start: float, stop: float) -> DataFrame:
    """ST2: rows whose offset from the oldest lies in [start, stop]."""
    oldest = df.agg(F.min(time).alias("_o"))
    return df.crossJoin(F.broadcast(oldest)).where((F.col(time) - F.col("_o")).between(start, stop)).drop("_o")


def _accept(times: list[float], gap: float, last: float | None) -> tuple[list[bool], float | None]:
    out = []
    for t in times:
        ok = last is None or t - last >= gap
        out.append(ok)
        last = t if ok else last
    return out, last


def debounce(df: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """ST3, ST19: rows at least ``gap`` after the last accepted one of their key (batch): an ordered fold in the JVM."""
    times = df.groupBy(key).agg(F.array_sort(F.collect_list(F.col(time).cast("double"))).alias("ts"))
    kept = F.aggregate("ts", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(F.concat(F.array(F.lit(float("-inf"))), a), -1) >= gap), F.concat(a, F.array(t))).otherwise(a))
    return times.select(key, F.explode(kept).alias(time))


def debounce_stream(df: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """ST3, ST19 on a stream: state is the last accepted time of each key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(time)
        ok, last = _accept(rows[time].astype(float).tolist(), gap, last)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * sum(ok), time: rows[time].astype(float)[ok]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, time).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{time}` double", "last double", "append", GroupStateTimeout.NoTimeout)


def turn_states(df: DataFrame, key: str, time: str, level: str, loud: float, quiet: int) -> DataFrame:
    """ST4: per row vocalising, turn_end (first quiet row), waiting, or ready from ``quiet`` quiet rows on."""
    w = W.partitionBy(key).orderBy(time)
    m = df.withColumn("_v", (F.col(level) >= loud).cast("int"))
    m = m.withColumn("_last", F.max(F.when(F.col("_v") == 1, F.row_number().over(w))).over(w)).withColumn("_since", F.row_number().over(w) - F.col("_last"))
    state = F.when(F.col("_v") == 1, "vocalising").when(F.col("_last").isNull(), "idle").when(F.col("_since") == 1, "turn_end").when(F.col("_since") < quiet, "waiting").otherwise("ready")
    return m.withColumn("state", state).drop("_v", "_last", "_since")


def paired_with_last(df: DataFrame, key: str, time: str, source: str, system: str, timeout: float | None = None) -> DataFrame:
    """ST6: each other row with its key's last system row before it, within the timeout if given."""
    w = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("response_to", F.last(F.when(F.col(source) == system, F.col(time)), ignorenulls=True).over(w)).where(F.col(source) != system)
    return out if timeout is None else out.withColumn("response_to", F.when(F.col(time) - F.col("response_to") <= timeout, F.col("response_to")))


def drop_late(df: DataFrame, time: str, max_age: float) -> DataFrame:
    """ST7: rows not older than the newest seen before them less ``max_age`` (batch, in arrival order ``arrival``)."""
    return running(df, ["arrival"], time, "_m", F.max, F.greatest).where(F.col(time) >= F.col("_m") - max_age).drop("_m")


def latest_positions(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """ST8: last value of each key with its velocity from the one before."""
    w = W.partitionBy(key).orderBy(time)
    v = F.try_divide(F.col(value) - F.lag(value).over(w), F.col(time) - F.lag(time).over(w))
    return df.withColumn("velocity", r6(v)).groupBy(key).agg(F.max_by(F.struct(time, value, "velocity"), time).alias("x")).select(key, "x.*")


def prune_stale(latest: DataFrame, time: str, ttl: float) -> DataFrame:
    """ST9: keys seen within the ttl of the newest one."""
    return recent(latest, time, ttl)


def ema(df: DataFrame, key: str, time: str, value: str, alpha: float = 0.3) -> DataFrame:
    """ST10: exponential moving average per key, starting at the first value."""
    v = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("v"))
    return v.select(key, r6(F.aggregate(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(1))), F.get("v", F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)).alias("ema"))


def ema_stream(df: DataFrame, key: str, time: str, value: str, alpha: float = 0.3) -> DataFrame:
    """ST10 on a stream: one row per key and trigger with the average so far."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a = state.get[0] if state.exists else None
        for x in pd.concat(batches).sort_values(time)[value].astype(float):
            a = x if a is None else a * (1 - alpha) + x * alpha
        state.update((a,))
        yield pd.DataFrame({key: [k[0]], "ema": [a]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, ema double", "ema double", "update", GroupStateTimeout.NoTimeout)


def boundaries(df: DataFrame, key: str, time: str, error: str, high: float, low: float, sustain: int, alpha: float = 0.1) -> DataFrame:
    """ST11: times where a key's EMA-normalised error, after ``sustain`` rows at or over ``high``, falls under ``low``; then it re-arms."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, held, armed, out = None, 0, False, []
        for t, e in pdf.sort_values(time)[[time, error]].itertuples(index=False):
            mean = e if mean is None else mean * (1 - alpha) + e * alpha
            x = e / mean if mean else 0.0
            held = held + 1 if x >= high else 0
            armed |= held >= sustain
            if armed and x < low:
                out.append(t)
                armed = False
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), time: out})

    f = df.schema
    return df.select(key, time, error).groupBy(key).applyInPandas(run, f"`{key}` {f[key].dataType.simpleString()}, `{time}` {f[time].dataType.simpleString()}")


def known_or_new(rows: DataFrame, known: DataFrame, distance, threshold: float) -> DataFrame:
    """ST12: nearest of known(c_id, c) to each row(id, v), and whether it is within the threshold; works on streams."""
    near = rows.crossJoin(F.broadcast(known.agg(F.collect_list(F.struct("c_id", "c")).alias("_k"))))
    d = F.array_min(F.transform("_k", lambda k: F.struct(r6(distance(F.col("v"), k["c"])).alias("d"), k["c_id"].alias("c_id"))))
    return near.withColumn("m", d).select("id", "m.c_id", F.col("m.d").alias("distance"), (F.col("m.d") <= threshold).alias("known"))


def promotions(candidates: DataFrame, similar: DataFrame, least: int, now: float, ttl: float) -> DataFrame:
    """ST13 over candidates(id, seen) and similar(id): expired, promoted from ``least`` similar rows on, else waiting."""
    n = similar.groupBy("id").agg(F.count("*").alias("n"))
    out = candidates.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("id", "n", F.when(F.col("n") >= least, "promoted").when(now - F.col("seen") > ttl, "expired").otherwise("waiting").alias("state"))


def alerts(df: DataFrame, time: str, value: str, width: int, limit: float) -> DataFrame:
    """ST14: per window of ``width`` seconds mean, greatest value and whether it exceeds the limit; streams need a watermark."""
    return df.groupBy(F.window(time, f"{width} seconds")).agg(r6(F.avg(value)).alias("mean"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), "mean", "max", (F.col("max") > limit).alias("alert"))


def leak(df: DataFrame, key: str, time: str, value: str, least: int = 100, share: float = 0.1) -> DataFrame:
    """ST15: growth of the last tenth's mean over the first's; under ``least`` rows no verdict."""
    w = W.partitionBy(key).orderBy(time)
    t = df.withColumn("_t", F.ntile(10).over(w)).groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_t") == 1, F.col(value))).alias("a"), F.avg(F.when(F.col("_t") == 10, F.col(value))).alias("b"))
    g = F.try_divide(F.col("b") - F.col("a"), "a")
    return t.select(key, "n", r6(g).alias("growth"), F.when(F.col("n") >= least, g > share).alias("leak"))


def soak(df: DataFrame, key: str, time: str, value: str, limit: float) -> DataFrame:
    """ST20: percent growth from the oldest to the newest known value: ok, potential over the limit, confirmed over twice it.

    Growth from zero is infinite (NaN from zero to zero), which counts as confirmed when upward.
    """
    known = F.when(F.col(value).isNotNull(), F.col(time))
    first, last = F.min_by(value, known), F.max_by(value, known)
    out = df.groupBy(key).agg(r6(divided(100 * (last - first), first)).alias("growth"))
    return out.withColumn("verdict", F.when(F.col("growth") > 2 * limit, "confirmed").when(F.col("growth") > limit, "potential").otherwise("ok"))


def responses(stimuli: DataFrame, rows: DataFrame, key: str, width: float) -> DataFrame:
    """ST16: per stimulus(key, s_time) the responses(key, time, score, alarm) within ``width`` before the next stimulus, alarm rate and mean score."""
    s = stimuli.withColumn("_next", F.lead("s_time").over(W.partitionBy(key).orderBy("s_time"))).withColumn("_stop", F.least(F.col("s_time") + width, F.coalesce("_next", F.lit(float("inf")))))
    x = s.join(rows, key, "left").where(F.col("time").isNull() | ((F.col("time") > F.col("s_time")) & (F.col("time") < F.col("_stop"))))
    got = x.groupBy(key, "s_time").agg(F.count("time").alias("responses"), r6(F.avg(F.col("alarm").cast("double"))).alias("alarm_rate"), r6(F.avg("score")).alias("mean_score"))
    return stimuli.select(key, "s_time").join(got, [key, "s_time"], "left").withColumn("responses", F.coalesce("responses", F.lit(0)))


def downsample(df: DataFrame, time: str, value: str, step: str) -> DataFrame:
    """ST17: tumbling mean, least and greatest value and count."""
    return df.groupBy(F.window(time, step)).agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), "n", "mean", "min", "max")


def retained(df: DataFrame, time: str, now: Column, days: int) -> DataFrame:
    """ST18: rows younger than the policy's days."""
    return df.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def next_context(history: DataFrame, least: int = 5, weight: float = 0.7) -> DataFrame:
    """ST22 over history(src, dst, feature_p): counts smoothed to uniform, blended with the feature model once a source has ``least`` rows."""
    k = history.select("dst").distinct().agg(F.count("*").alias("k"))
    c = history.groupBy("src", "dst").agg(F.count("*").alias("n"), F.avg("feature_p").alias("f")).crossJoin(F.broadcast(k))
    t = F.sum("n").over(W.partitionBy("src"))
    p = (F.col("n") + 1) / (t + F.col("k"))
    return c.select("src", "dst", r6(F.when(t >= least, weight * p + (1 - weight) * F.col("f")).otherwise(p)).alias("p"))


def sync_batch(queue: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """ST23 over queue(id, priority, time, bytes): (sent, remaining), by priority then time while the byte budget lasts; nothing is lost (Q24)."""
    q = running(queue, [F.desc("priority"), "time", "id"], "bytes", "_run")
    return q.where(F.col("_run") <= budget).drop("_run"), q.where(F.col("_run") > budget).drop("_run")


def strategy_scores(rows: DataFrame) -> DataFrame:
    """ST24 over rows(strategy, answered, matched, positive): mean of 0.3, 0.5, 0.2 flags per strategy; no rows: 0.5."""
    s = 0.3 * F.col("answered").cast("int") + 0.5 * F.col("matched").cast("int") + 0.2 * F.col("positive").cast("int")
    return rows.groupBy("strategy").agg(r6(F.coalesce(F.avg(s), F.lit(0.5))).alias("score"))


def arousal(evidence: list[Column], weights: list[float]) -> dict[str, Column]:
    """ST25: weighted score of evidence terms, its level, and confidence 1 / (1 + population variance of the terms)."""
    score = sum((w * e for e, w in zip(evidence, weights, strict=True)), F.lit(0.0)) / sum(weights)
    mean = sum(evidence, F.lit(0.0)) / len(evidence)
    var = sum(((e - mean) ** 2 for e in evidence), F.lit(0.0)) / len(evidence)
    return {"score": r6(score), "level": F.when(score < 0.33, "low").when(score < 0.66, "medium").otherwise("high"), "confidence": r6(1 / (1 + var))}


def relationships(outcomes: DataFrame) -> DataFrame:
    """ST21 over outcomes(a, b): strength 0.1 per outcome of a pair whoever leads, at most 1."""
    return outcomes.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(r6(F.least(F.lit(1.0), 0.1 * F.count("*"))).alias("strength"))


def bayes_filter(rows: DataFrame, key: str, time: str, likelihood: str, stay: float = 0.9) -> DataFrame:
    """ST26: per row the posterior over contexts from likelihood(array) by a sticky transition, normalised; an ordered fold per key."""
    x = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(likelihood).alias("l")))).alias("x"))
    k = F.size(F.get("x", F.lit(0))["l"])

    def norm(a):
        s = F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
        return F.transform(a, lambda p: F.when(s > 0, p / s).otherwise(1 / F.size(a)))

    first = F.transform(F.get("x", F.lit(0))["l"], lambda _: F.lit(1.0) / k)
    step = lambda a, r: norm(F.zip_with(a, r["l"], lambda p, q: (stay * p + (1 - stay) / k) * q))
    return x.select(key, F.aggregate("x", first, step).alias("posterior"))


def clusters_online(rows: DataFrame, state: DataFrame | None, spawn: float, rate: float = 0.1) -> DataFrame:
    """M21 per micro-batch (foreachBatch): (c_id, c, n) after one batch of rows(id, v) on the centroids so far.

    Rows within ``spawn`` of a centroid move it by the mean of their gaps times the rate; of the others the least id of
    each hash bucket spawns one. The centroids are the state and bounded by what spawns; rows stay distributed.
    """
    from ..functions.vectors import euclidean
    from ..operators.joins import nearest_centroid

    if state is None or state.isEmpty():
        first = rows.orderBy("id").limit(1)
        return first.select(F.lit(0).cast("long").alias("c_id"), F.col("v").alias("c"), F.lit(1).cast("long").alias("n"))
    near = nearest_centroid(rows, state.select("c_id", "c"), euclidean).join(rows, "id")
    moved = near.where(F.col("distance") <= spawn).select("c_id", F.posexplode("v").alias("k", "x")).groupBy("c_id", "k").agg(F.avg("x").alias("m"), F.count("*").alias("hits"))
    moved = moved.groupBy("c_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda z: z["m"]).alias("m"), F.max("hits").alias("hits"))
    kept = state.join(moved, "c_id", "left").select("c_id", F.when(F.col("m").isNull(), F.col("c")).otherwise(F.zip_with("c", "m", lambda a, b: a + rate * (b - a))).alias("c"), (F.col("n") + F.coalesce("hits", F.lit(0))).alias("n"))
    far = near.where(F.col("distance") > spawn).groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("_h")).agg(F.min_by(F.struct("id", "v"), "id").alias("x"))
    base = state.agg((F.max("c_id") + 1).alias("_b"))
    born = far.crossJoin(F.broadcast(base)).select((F.col("_b") + F.row_number().over(W.orderBy("x.id")) - 1).cast("long").alias("c_id"), F.col("x.v").alias("c"), F.lit(1).cast("long").alias("n"))
    return kept.unionByName(born)

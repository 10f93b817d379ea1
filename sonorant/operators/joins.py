"""Joins: interval, as-of, radius, nearest neighbour, grammar lookups.

Interval joins get an equi-key by cutting time into buckets, so that no nested loop is planned; a pair is kept in the
bucket of the later start alone. Nearest-neighbour searches take a stated query set against all rows and keep a bounded
list per query by a grouped top-k, not a sort of all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import cut, running
from .blocks import block_pairs
from .sequences import r6


def _bucketed(df: DataFrame, start: str, stop: str, width: float) -> DataFrame:
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.greatest(F.floor(F.col(start) / width), F.floor(F.col(stop) / width)).cast("long"))))


def overlaps(a: DataFrame, b: DataFrame, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of a(a_start, a_stop) and b(b_start, b_stop) with a_start < b_stop and b_start < a_stop, equal in ``on``.

    Touching intervals don't overlap. ``width`` should be near the usual length.
    """
    x, y = _bucketed(a, "a_start", "a_stop", width), _bucketed(b, "b_start", "b_stop", width)
    pairs = x.join(y, ["_bucket", *(on or [])]).where("a_start < b_stop and b_start < a_stop")
    return pairs.where(F.col("_bucket") == F.floor(F.greatest("a_start", "b_start") / width)).drop("_bucket")


def align(candidates: DataFrame, annotations: DataFrame, width: float, least_iou: float = 0.3, least_ms: float = 10) -> DataFrame:
    """Per candidate(a_id, a_start, a_stop) the annotation(b_id, b_start, b_stop, label) of greatest IoU, 'Unknown' and -1 without one.

    Ties go to the lower annotation id.
    """
    common = F.least("a_stop", "b_stop") - F.greatest("a_start", "b_start")
    iou = common / (F.greatest("a_stop", "b_stop") - F.least("a_start", "b_start"))
    found = overlaps(candidates, annotations, width).withColumn("iou", r6(iou)).where((F.col("iou") >= least_iou) & (common >= least_ms))
    best = found.groupBy("a_id").agg(F.max_by(F.struct("b_id", "label", "iou"), F.struct("iou", -F.col("b_id"))).alias("x"))
    out = candidates.select("a_id").join(best, "a_id", "left")
    return out.select("a_id", F.coalesce("x.b_id", F.lit(-1)).alias("b_id"), F.coalesce("x.label", F.lit("Unknown")).alias("label"), F.coalesce("x.iou", F.lit(0.0)).alias("iou"))


def type_profiles(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster its size and its primary label (most frequent known one, ties: least) with its share of the known."""
    known = clusters.join(labelled, "a_id").where("label <> 'Unknown'").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    known = known.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy("cluster")))).withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "label"))).where("k = 1")
    return known.select("cluster", "label", "share")


def _together(rows: dict[str, np.ndarray], least: float, size: int = 16384):
    """Pairs of J3 in one cell: ``own`` rows start in it, ``first`` ones may be a pair's earlier row; chunks of (a_id, b_id, ratio) of about ``size``."""
    start, stop = rows["start"], np.where(np.isnan(rows["stop"]), np.inf, rows["stop"])  # NaN is above all others
    length = stop - start
    y = np.flatnonzero(rows["own"])
    y = y[np.lexsort((rows["id"][y], start[y]))]
    rank = np.zeros(len(start), np.int64)
    rank[y] = np.arange(1, len(y) + 1)
    x = np.flatnonzero(rows["first"])
    at, n = rank[x], np.searchsorted(start[y], stop[x]) - rank[x]
    x, at, n = x[n > 0], at[n > 0], n[n > 0]
    parts = -(-n // size)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    x, at, n = np.repeat(x, parts), np.repeat(at, parts) + k * size, np.minimum(np.repeat(n, parts) - k * size, size)
    ends = np.cumsum(n)
    ids, y_start, y_stop, y_length = rows["id"][y], start[y], stop[y], length[y]
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        m = n[lo:hi]
        i = np.repeat(x[lo:hi], m)
        j = np.arange(m.sum()) + np.repeat(at[lo:hi] - (np.cumsum(m) - m), m)
        with np.errstate(all="ignore"):
            ratio = (np.minimum(stop[i], y_stop[j]) - y_start[j]) / np.minimum(length[i], y_length[j])
            ratio = np.floor(ratio * 1e6 + 0.5) / 1e6
        a, b = rows["id"][i], ids[j]
        kept = (start[i] < y_stop[j]) & (a != b) & ~(ratio < least)
        a, b = a[kept], b[kept]
        yield np.minimum(a, b), np.maximum(a, b), ratio[kept]
        lo = hi


def superpositions(phrases: DataFrame, width: float, least: float = 0.3, size: int = 65536) -> DataFrame:
    """Pairs id < id of one modality whose overlap is ``least`` or more of the shorter; NaN, which counts as more, where that has no length.

    Rows are dealt to cells of four usual lengths or more (``width``: the least length to assume), once to each that they reach; the
    later row of a pair is looked for in its own cell alone, among a sorted list. Cells of over ``size`` rows split their earlier rows.
    Ratios are rounded as millionths, as DuckDB rounds.
    """
    kind = phrases.schema["id"].dataType.simpleString()
    rows = phrases.select("modality", "id", F.col("start").cast("double"), F.col("stop").cast("double")).where("modality is not null and id is not null and stop is not null and not isnan(start)")
    low, high, usual = rows.agg(F.min("start"), F.max("start"), F.avg(F.when(F.abs("stop") < float("inf"), F.greatest(F.col("stop") - F.col("start"), F.lit(0.0))))).first()
    if low is None:
        return rows.select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("stop").alias("ratio"))
    wide = 4 * max(width, min(usual or 0.0, high - low))
    cell = lambda t: F.floor((F.least(t, F.lit(high)) - low) / wide).cast("int")
    dealt = rows.withColumn("_own", cell(F.col("start"))).withColumn("_cell", F.explode(F.sequence("_own", F.greatest("_own", cell(F.col("stop"))))))
    large = dealt.groupBy("modality", "_cell").count().where(F.col("count") > size).select("modality", "_cell", F.ceil(F.col("count") / size).cast("int").alias("_n"))
    own, mine = F.col("_own") == F.col("_cell"), F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    dealt = dealt.join(F.broadcast(large), ["modality", "_cell"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.select("modality", "_cell", "id", "start", "stop", own.alias("own"), mine.alias("_mine"), F.explode(F.when(own, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(mine))).alias("_part"))
    dealt = dealt.withColumn("first", F.col("_mine") == F.col("_part")).drop("_mine")
    cells = dealt.repartition("modality", "_cell", "_part").sortWithinPartitions("modality", "_cell", "_part")
    to = to_arrow_type(phrases.schema["id"].dataType)

    def run(batches):
        held, last = [], None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                pieces = [(None, None)]
            else:
                column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_part", "id", "start", "stop", "own", "first")}
                names = batch.column("modality")
                code = pc.dictionary_encode(names).indices.to_numpy()
                new = np.flatnonzero((np.diff(code) != 0) | (np.diff(column["_cell"]) != 0) | (np.diff(column["_part"]) != 0)) + 1
                bounds = [0, *new.tolist(), len(code)]
                pieces = [((names[u].as_py(), column["_cell"][u], column["_part"][u]), {c: column[c][u:w] for c in ("id", "start", "stop", "own", "first")}) for u, w in itertools.pairwise(bounds) if w > u]
            for key, piece in pieces:
                if held and key != last:
                    for a, b, ratio in _together({c: np.concatenate([h[c] for h in held]) for c in held[0]}, least):
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a, to), pa.array(b, to), pa.array(ratio)], ["a_id", "b_id", "ratio"])
                    held = []
                held, last = ([*held, piece] if piece else held), key

    return cells.select("modality", "_cell", "_part", "id", "start", "stop", "own", "first").mapInArrow(run, f"a_id {kind}, b_id {kind}, ratio double")


def vocabulary(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per cluster but noise (-1): members, mean and deviation of their duration, and how many have an annotation of their file inside them."""
    found = members.where("cluster <> -1").join(annotations, (members["file"] == annotations["a_file"]) & (annotations["at"] >= members["start"]) & (annotations["at"] <= members["stop"]), "left")
    each = found.groupBy("cluster", "id").agg(F.first("duration").alias("duration"), (F.count("at") > 0).cast("int").alias("has"))
    return each.groupBy("cluster").agg(F.count("*").alias("members"), r6(F.avg("duration")).alias("mean_ms"), r6(F.stddev_pop("duration")).alias("std_ms"), F.sum("has").alias("annotated"))


def nearest_by_value(queries: DataFrame, rows: DataFrame, limit: float) -> DataFrame:
    """Per query(q_id, x) the row(key, v) of least |x - v| under the limit, ties to the lower key.

    Only the next values below and above a query can be the nearest: two running extremes over one order of queries and values.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    points = rows.where(known("v")).groupBy("v").agg(F.min("key").alias("key")).select(F.col("v").alias("x"), F.lit(0).alias("side"), F.lit(None).cast(queries.schema["q_id"].dataType).alias("q_id"), F.struct("v", "key").alias("s"))
    both = points.unionByName(queries.where(known("x")).select("x", F.lit(1).alias("side"), "q_id"), allowMissingColumns=True)
    both = running(both, [F.asc("x"), F.asc("side")], "s", "below", F.max, lambda before, inside: inside)
    both = running(both, [F.desc("x"), F.asc("side")], "s", "above", F.min, lambda before, inside: inside)
    near = both.where("side = 1").select("q_id", "x", F.explode(F.array("below", "above")).alias("s")).where("s is not null")
    near = near.select("q_id", "s.key", F.abs(F.col("x") - F.col("s.v")).alias("gap")).where(F.col("gap") < limit)
    return near.groupBy("q_id").agg(F.min_by(F.struct("key", "gap"), F.struct("gap", "key")).alias("m")).select("q_id", "m.key", r6("m.gap").alias("gap"))


def match_library(queries: DataFrame, library: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Best mean similarity of pitch (within 2 kHz) and duration (within 500 ms); none under the threshold.

    Equal phrases and equal queries meet once, block against block; per query and block all that may round to the best go on.
    Similarities often lie halfway between two places; they are rounded as millionths, as DuckDB rounds.
    """
    asked = queries.select(F.col("q_f0").cast("double"), F.col("q_duration").cast("double")).distinct().where("q_f0 is not null and q_duration is not null")
    lib = library.groupBy(F.col("f0").cast("double").alias("f0"), F.col("duration_ms").cast("double").alias("duration_ms")).agg(F.min("key").alias("key")).where("f0 is not null and duration_ms is not null")

    def best(q, p):
        out = []
        for at in range(0, len(q["q_f0"]), 256):
            f, d = q["q_f0"][at : at + 256], q["q_duration"][at : at + 256]
            sim = (np.maximum(0.0, 1 - np.abs(f[:, None] - p["f0"]) / 2000) + np.maximum(0.0, 1 - np.abs(d[:, None] - p["duration_ms"]) / 500)) / 2
            i, j = np.nonzero(sim >= sim.max(1, keepdims=True) - 2e-6)
            out.append(pd.DataFrame({"q_f0": f[i], "q_duration": d[i], "raw": sim[i, j], "key": p["key"][j]}).groupby(["q_f0", "q_duration", "raw"], as_index=False)["key"].min())
        return pd.concat(out).to_dict("list")

    kind = library.schema["key"].dataType.simpleString()
    near = block_pairs(asked.withColumn("_k", F.xxhash64("q_f0", "q_duration")), lib, "_k", "key", best, f"q_f0 double, q_duration double, raw double, key {kind}")
    best_of = near.withColumn("sim", F.round(F.col("raw") * 1e6) / 1e6).groupBy("q_f0", "q_duration").agg(F.max_by(F.struct("key", "sim"), F.struct("sim", -F.col("key"))).alias("m"))
    found = queries.withColumns({"q_f0": F.col("q_f0").cast("double"), "q_duration": F.col("q_duration").cast("double")}).join(best_of, ["q_f0", "q_duration"])
    return found.select("q_id", F.when(F.col("m.sim") >= threshold, F.col("m.key")).alias("key"), F.col("m.sim").alias("sim"))


def without_duration(key: Column) -> Column:
    """A phrase key without its duration part."""
    return F.regexp_replace(key, "_DUR_[0-9]+", "")


def match_keys(targets: DataFrame, available: DataFrame) -> DataFrame:
    """Per target key the least available key that is equal but for the duration."""
    a = available.select(F.col("key").alias("match"), without_duration(F.col("key")).alias("stem"))
    t = targets.where(F.col("key").rlike("_DUR_[0-9]+")).select("key", without_duration(F.col("key")).alias("stem"))
    return t.join(a.groupBy("stem").agg(F.min("match").alias("match")), "stem").select("key", "match")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, max_age: float | None = None) -> DataFrame:
    """Left rows with the latest right value at or before their time (per key), none older than max_age. One sort, no theta join."""
    both = left.select(key, time, F.lit(1).alias("_side"), F.col("id"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("double").alias("_at")).unionByName(
        right.select(key, time, F.lit(0).alias("_side"), F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.col(value).alias("_v"), F.col(time).cast("double").alias("_at"))
    )
    w = W.partitionBy(key).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_s", F.last(F.when(F.col("_side") == 0, F.struct("_v", "_at")), ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if max_age is None else F.col(time) - F.col("_s._at") <= max_age
    return out.select("id", key, time, F.when(fresh, F.col("_s._v")).alias(value))


def within_radius(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id, x, y, z) within a radius, by an equi-join on grid cells of that size."""
    cell = lambda c, k=0: (F.floor(F.col(c) / radius) + k).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    p = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"), F.explode(steps).alias("s"))
    p = p.withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j"), "cz": F.col("cz") + F.col("s.k")}).drop("s")
    q = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    dist = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    return p.join(q, ["cx", "cy", "cz"]).where("a_id <> b_id").withColumn("distance", r6(dist)).where(F.col("distance") <= radius).select("a_id", "b_id", "distance")


def _halved(x: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, low child, high child) of a tree over points, halved along the widest axis down to ``leaf``; leaves have axis -1 and a number."""
    nodes, todo, leaves = [], [(np.arange(len(x)), None)], 0
    while todo:
        at, parent = todo.pop()
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        axis = int(np.argmax(np.ptp(x[at], axis=0))) if len(at) else 0
        cut = float(np.median(x[at, axis])) if len(at) else 0.0
        low = x[at, axis] <= cut
        if len(at) <= leaf or min(low.sum(), (~low).sum()) < leaf // 4:
            nodes.append([-1, 0.0, leaves, leaves])
            leaves += 1
        else:
            nodes.append([axis, cut, -1, -1])
            todo += [(at[low], (len(nodes) - 1, 2)), (at[~low], (len(nodes) - 1, 3))]
    return [tuple(n) for n in nodes]


def _nearest(q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Per 128 queries (place, place, distance in whole millionths, rank) of their k best rows but themselves, ties to the lower id."""
    order = np.lexsort((ids, *x.T))
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]).any(1)])
    place = np.arange(len(order))
    order = np.sort(order[place - np.maximum.accumulate(np.where(new, place, 0)) <= k])  # of equal points the lowest ids
    order = order[np.argsort(ids[order], kind="stable")]
    ids, x = ids[order], x[order]
    for at in range(0, len(q), 128):
        p = q[at : at + 128]
        d = sum((p[:, None, c] - x[None, :, c]) ** 2 for c in range(x.shape[1]))
        d = np.floor(np.sqrt(d) * 1e6 + 0.5) / 1e6
        d[q_id[at : at + 128, None] == ids] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
        i, j = np.nonzero((d <= kth) & (d < np.inf))
        by = np.lexsort((j, d[i, j], i))
        i, j = i[by], j[by]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        i, j, rank = i[rank <= k], j[rank <= k], rank[rank <= k]
        yield at + i, order[j], d[i, j], rank


def nearest_points(points: DataFrame, k: int, leaf: int = 1024) -> DataFrame:
    """(a_id, b_id, distance, rank) of every point(id, x, y, z) and its k nearest others, ties to the lower id; distances that are NaN or null come last.

    Points go to the leaves of a tree, about ``leaf`` to each, whose cuts are medians of at most a million points; every point is in a leaf.
    A leaf's points find k others among themselves first; only what lies within the largest of these distances of the leaf's box can be nearer.
    """
    axes = ["x", "y", "z"]
    points = points.select("id", *[F.col(c).cast("double") for c in axes])
    fine = F.lit(True)
    for c in axes:
        fine &= F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    n, odd = points.agg(F.count("*"), F.count_if(~fine)).first()
    known = points.where(fine)
    kind = points.schema["id"].dataType.simpleString()
    share = max(1, -(-n // 1_000_000))
    of = max(16, leaf // share)
    tree = _halved(known.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(*axes).toPandas().to_numpy(float), of)
    axis, cut_at, low, high = (np.array(c) for c in zip(*tree, strict=True))

    @F.pandas_udf("int")
    def leaf_of(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        v, node = np.stack([x, y, z], 1), np.zeros(len(x), int)
        while (inner := axis[node] >= 0).any():
            at = np.flatnonzero(inner)
            m = node[at]
            node[at] = np.where(v[at, axis[m]] <= cut_at[m], low[m], high[m])
        return pd.Series(low[node])

    placed = cut(known.withColumn("leaf", leaf_of(*axes)))

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = pdf[axes].to_numpy(float), pdf["id"].to_numpy()
        far, found = 0.0, 0
        for _, _, d, rank in _nearest(ids, x, ids, x, k):
            far, found = max(far, d[rank == k].max(initial=0.0)), found + (rank == k).sum()
        far = far + 2e-6 if found == len(ids) else np.inf
        return pd.DataFrame([[pdf["leaf"].iloc[0], *(x.min(0) - far), *(x.max(0) + far)]], columns=["to", *[f"{c}{e}" for e in (0, 1) for c in axes]])

    boxes = cut(placed.groupBy("leaf").applyInPandas(reach, "to int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"))
    span = placed.groupBy("leaf").agg(*[f(c).alias(f"{c}_{e}") for c in axes for f, e in ((F.min, "min"), (F.max, "max"))])
    meets, inside = F.lit(True), F.lit(True)
    for c in axes:
        meets &= (F.col(f"{c}_min") <= F.col(f"{c}1")) & (F.col(f"{c}_max") >= F.col(f"{c}0"))
        inside &= F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1"))
    pairs = span.join(F.broadcast(boxes), meets).select("leaf", "to", *[f"{c}{e}" for e in (0, 1) for c in axes])
    near = placed.join(F.broadcast(pairs), "leaf").where(inside).select("to", (F.col("leaf") == F.col("to")).alias("own"), "id", *axes)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, own = pdf[axes].to_numpy(float), pdf["id"].to_numpy(), pdf["own"].to_numpy(bool)
        q_id = ids[own]
        out = [pd.DataFrame({"a_id": q_id[i], "b_id": ids[j], "distance": d, "rank": rank}) for i, j, d, rank in _nearest(q_id, x[own], ids, x, k)]
        return pd.concat(out)

    out = near.groupBy("to").applyInPandas(best, f"a_id {kind}, b_id {kind}, distance double, rank int")
    if odd:
        missing = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
        few = n - odd <= k
        rest, empty = points.where((F.lit(True) if few else ~fine) & ~missing), points.where(missing)
        p = points.selectExpr("id as b_id", "x as bx", "y as by", "z as bz")
        met = rest.crossJoin(p).unionByName(empty.crossJoin(F.broadcast(p.orderBy("b_id").limit(k + 1))))
        met = met.where("id <> b_id").select(F.col("id").alias("a_id"), "b_id", r6(F.sqrt(sum((F.col(c) - F.col(f"b{c}")) ** 2 for c in axes))).alias("distance"))
        rank = F.row_number().over(W.partitionBy("a_id").orderBy(F.asc_nulls_last("distance"), "b_id"))
        met = met.withColumn("rank", rank).where(F.col("rank") <= k)
        out = met if few else out.unionByName(met)
    return out


def top_k(pairs: DataFrame, query: str, row: str, metric: str, k: int, descending: bool = False) -> DataFrame:
    """The k best rows per query, ties to the lower row; bounded per query and task before the shuffle."""
    order = [F.desc(metric) if descending else F.asc(metric), F.asc(row)]
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def phrase_similarity(f0: Column, f1: Column, d0: Column, d1: Column, r0: Column, r1: Column) -> Column:
    """0.5 pitch + 0.3 duration + 0.2 range similarity, clamped at 10 kHz, 1 s, 5 kHz."""
    part = lambda a, b, top: 1 - F.least(F.abs(a - b) / top, F.lit(1.0))
    return r6(0.5 * part(f0, f1, 10000) + 0.3 * part(d0, d1, 1000) + 0.2 * part(r0, r1, 5000))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, distance) -> DataFrame:
    """Per row(id, v) the centroid(c_id, c) of least distance(v, c), ties to the lower id. Centroids are a model: broadcast."""
    near = rows.crossJoin(F.broadcast(centroids)).withColumn("distance", r6(distance(F.col("v"), F.col("c"))))
    return near.groupBy("id").agg(F.min_by(F.struct("c_id", "distance"), F.struct("distance", "c_id")).alias("m")).select("id", "m.c_id", "m.distance")


def validate_sequences(bigrams: DataFrame, grammar: DataFrame, least: float = 0.01) -> DataFrame:
    """Per sequence its steps, violations (pair missing or p at most ``least``) and confidence: half valid share, half mean p."""
    steps = bigrams.select("seq", "src", "dst").join(grammar.select("src", "dst", "p"), ["src", "dst"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    ok = (F.col("p") > least).cast("double")
    return steps.groupBy("seq").agg(F.count("*").alias("steps"), F.count_if(F.col("p") <= least).alias("violations"), r6(F.avg(ok) / 2 + F.avg("p") / 2).alias("confidence"))


def without_incoming(edges: DataFrame) -> DataFrame:
    """Sources that are no edge's target."""
    return edges.select("src").distinct().join(edges.select(F.col("dst").alias("src")), "src", "left_anti")


def across_groups(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys of more than one group, with the number of groups."""
    return df.groupBy(key).agg(F.countDistinct(group).alias("groups")).where("groups > 1")


def allowed_probabilities(bigrams: DataFrame, allowed: DataFrame) -> DataFrame:
    """P(dst | src) over the bigrams of an allowed set (src, dst)."""
    c = bigrams.join(F.broadcast(allowed) if allowed.isLocal() else allowed, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return c.withColumn("p", r6(F.col("n") / F.sum("n").over(W.partitionBy("src"))))


def compare_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per id whether two models' labels agree, and their divergence: 1 if not, else mean of relative confidence and score gaps."""
    rel = F.try_divide(F.abs(F.col("a_conf") - F.col("b_conf")), F.greatest("a_conf", "b_conf"))
    both = a.join(b, "id").withColumn("same", F.col("a_label") == F.col("b_label"))
    return both.select("id", "same", r6(F.when(~F.col("same"), 1.0).otherwise((F.coalesce(rel, F.lit(0.0)) + F.abs(F.col("a_score") - F.col("b_score"))) / 2)).alias("divergence"))

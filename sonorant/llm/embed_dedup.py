"""Embedding near-duplicates: random-hyperplane sign hashing, exact cosine verification, connected components (operator 4).

Only rows of equal, non-null label (and equal dimension) are compared. Equal vectors of a label are folded into one with
a weight first, so exact copies cost one row. Each distinct vector gets a sign pattern of ``bits`` random hyperplanes in
each of several tables; vectors that share a pattern in any table are candidates, and their cosine is computed in double
precision. The number of tables follows from ``recall``, the chance that a pair right at the threshold meets in some
table (nearer pairs meet with a higher one); the bits follow from the number of vectors.

A bucket of more than ``block`` vectors is cut into blocks, and every pair of blocks is its own group, so no group is
unbounded and no candidate is dropped. Pairs never leave a task: for each vector it counts the links that no earlier
table has shown already, and names one representative of its local component.

Edge cases: null label, null, empty or zero vectors and those with null or non-finite components link with nothing and
are components of their own; repeated rows are vectors of their own that link to each other; a null vec_id takes part
but names no component (of null ids alone: null) and isn't kept; an empty table gives no rows. Only vec_id, embedding
and label are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize, ship

THRESHOLD = 0.93
RECALL = 0.9995
BLOCK = 1024
SEED = 20


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits a table) for n vectors: buckets of some dozens, and the recall at the threshold."""
    bits = max(6, min(30, round(math.log2(max(n, 2) / 256))))
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log1p(-p)), bits


def patterns(x: np.ndarray, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """Sign patterns of the rows of x, one int32 per table. The hyperplanes depend on seed, table and dimension alone."""
    planes = np.random.default_rng([seed, x.shape[1], tables, bits]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _usable(vectors: DataFrame) -> DataFrame:
    ok = "label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    return vectors.where(ok)


def _hashed(distinct: DataFrame, tables: int, bits: int) -> DataFrame:
    """distinct (rid, label, embedding, weight) -> (rid, label, dim, weight, vec, sigs): float64 and int32 bytes."""

    def run(batches):
        for b in batches:
            e = b.column(2)
            sizes = pa.compute.list_value_length(e).to_numpy(zero_copy_only=False)
            flat = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            vec, sig = [b""] * len(sizes), [b""] * len(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                for i, v, s in zip(at, x, patterns(x, tables, bits), strict=True):
                    vec[i], sig[i] = v.tobytes(), s.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes.astype(np.int32)), b.column(3), pa.array(vec, pa.binary()), pa.array(sig, pa.binary())], ["rid", "label", "dim", "weight", "vec", "sigs"])

    return distinct.select("rid", "label", "embedding", "weight").mapInArrow(run, "rid long, label string, dim int, weight long, vec binary, sigs binary")


def _local(x: np.ndarray, sig: np.ndarray, weight: np.ndarray, side: np.ndarray, cross: bool, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of one group: links new in table t (weighted), and the index of a representative."""
    n = len(x)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(n)
    if not near.any():
        return np.zeros(n, dtype=np.int64), label
    i, j = np.nonzero(near)
    new = np.ones(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 18):
        p, q = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        new[at : at + (1 << 18)] = ~(sig[p, :t] == sig[q, :t]).any(axis=1)
        if cross:
            new[at : at + (1 << 18)] &= side[p] != side[q]
    found = np.bincount(i[new], weights=weight[j[new]].astype(float), minlength=n).astype(np.int64)
    while True:  # least index over links, then pointer jumping
        low = label.copy()
        np.minimum.at(low, i, label[j])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return found, label
        label = low


def linked(hashed: DataFrame, tables: int, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b, n): b is of a's component, n links of a that were found in one group; n is summed by the caller."""
    each = hashed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    each = each.withColumn("sig", F.substring("sigs", F.col("t") * 4 + 1, F.lit(4)))
    key = ["t", "label", "dim", "sig"]
    hot = each.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = each.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rid", "t"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).select(*key, "lo", "hi", "own", "rid", "weight", "vec", "sigs")
    group = [*key, "lo", "hi"]

    def run(batches):
        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            b = pa.Table.from_batches(parts).combine_chunks()
            if b.num_rows < 2:
                return None
            cols = {c: b.column(c).to_numpy() for c in ("t", "lo", "hi", "own", "rid", "weight")}
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), dtype=np.float64).reshape(b.num_rows, -1)
            sig = np.frombuffer(b"".join(b.column("sigs").to_pylist()), dtype=np.int32).reshape(b.num_rows, -1)
            found, label = _local(x, sig, cols["weight"], cols["own"], bool(cols["lo"][0] != cols["hi"][0]), int(cols["t"][0]), threshold)
            say = (found > 0) | (label != np.arange(len(label)))
            if not say.any():
                return None
            rid = cols["rid"]
            return pa.RecordBatch.from_arrays([pa.array(rid[say]), pa.array(rid[label[say]]), pa.array(found[say])], ["a", "b", "n"])

        open_parts: list[pa.RecordBatch] = []
        open_key = None
        for b in batches:
            if not b.num_rows:
                continue
            # A group's rows are neighbours; find where the key changes.
            differs = np.zeros(b.num_rows, dtype=bool)
            for c in group:
                col = b.column(c).fill_null("") if c == "label" else b.column(c)
                differs[1:] |= np.asarray(pa.compute.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)))
            cuts = [0, *np.flatnonzero(differs).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(s, e - s)
                k = tuple(part.column(c)[0].as_py() for c in group) if s == 0 else None
                if s > 0 or k != open_key:
                    if open_parts and (out := finish(open_parts)) is not None:
                        yield out
                    open_parts = []
                open_parts.append(part)
                open_key = tuple(part.column(c)[0].as_py() for c in group) if e == b.num_rows else None
        if open_parts and (out := finish(open_parts)) is not None:
            yield out

    return paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long, n long")


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    usable = materialize(_usable(rows), "vectors")
    distinct = usable.groupBy("label", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.withColumn("rid", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    tables, bits = shape(n, threshold, recall)
    found = materialize(linked(_hashed(distinct, tables, bits), tables, threshold, block), "found")
    joined = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    group = distinct.select("rid", "label", "embedding", "weight", "least").join(joined, F.col("rid") == F.col("node"), "left").join(links, F.col("rid") == F.col("a"), "left")
    group = group.select("label", "embedding", "least", F.coalesce("component", "rid").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = group.join(group.groupBy("rep").agg(F.min("least").alias("component_id")), "rep")
    inside = usable.join(named, ["label", "embedding"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    ok = F.expr("coalesce(label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0), false)")
    outside = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


__all__ = ["embedding_components", "linked", "patterns", "shape"]

"""All pairs of two tables, block against block: kernels see two bounded arrays and return few rows, no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.lineage import cut


def blocked(rows: DataFrame, key: str | Column, size: int, group: str | None = None) -> tuple[DataFrame, int]:
    """(one row per block: _g, _b and the array _rows of its rows; the largest number of blocks of a group)."""
    rows = rows.withColumn("_g", F.lit(0) if group is None else F.col(group))
    n = rows.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    k = -(-n // size) or 1
    given = [c for c in rows.columns if c != "_g"]
    by = rows.groupBy("_g", F.pmod(F.xxhash64(key), F.lit(k)).cast("int").alias("_b"))
    return by.agg(F.collect_list(F.struct(*given)).alias("_rows")), k


def block_pairs(a: DataFrame, b: DataFrame, key_a: str | Column, key_b: str | Column, kernel: Callable, schema: str, size: int = 4096, group: str | None = None) -> DataFrame:
    """kernel(columns of a's block, columns of b's block) -> columns of ``schema``, or several such, over all pairs of blocks (of equal group).

    Blocks are copied to each of their pairs; a group's column travels as given in ``a`` and ``b``. Null groups meet nothing.
    """
    x, nx = blocked(a, key_a, size, group)
    y, ny = blocked(b, key_b, size, group)
    return _run(x, y, nx, ny, kernel, schema, F.lit(True))


def self_pairs(a: DataFrame, key: str | Column, kernel: Callable, schema: str, size: int = 4096, group: str | None = None) -> DataFrame:
    """kernel(block, block, whether both are the same) over all unordered pairs of a table's blocks (of equal group)."""
    x, n = blocked(a, key, size, group)
    x = cut(x)
    return _run(x, x, n, n, kernel, schema, F.col("_i") <= F.col("_j"), same=True)


def _run(x: DataFrame, y: DataFrame, nx: int, ny: int, kernel: Callable, schema: str, where: Column, same: bool = False) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = x.select("_g", F.col("_b").alias("_i"), F.col("_rows").alias("_x")).withColumn("_j", every(ny)).where(where)
    right = y.select("_g", F.col("_b").alias("_j"), F.col("_rows").alias("_y")).withColumn("_i", every(nx)).where(where)
    met = left.join(right.hint("shuffle_merge"), ["_g", "_i", "_j"]).select("_i", "_j", "_x", "_y")
    names = [f.name for f in x.schema["_rows"].dataType.elementType], [f.name for f in y.schema["_rows"].dataType.elementType]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                i, j = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                p, q = (_frame(batch.column(2 + k)[at].values, names[k]) for k in (0, 1))
                got = kernel(p, q, i == j) if same else kernel(p, q)
                for out in filter(len, [got] if isinstance(got, dict) else got):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], to_arrow_type(f.dataType)) for f in fields], [f.name for f in fields])

    fields = StructType.fromDDL(schema).fields
    return met.mapInArrow(run, schema)


def _frame(rows, names: list[str]) -> dict[str, object]:
    """Columns of a block: NumPy arrays; lists of equal length and without nulls as a matrix, others as a list of arrays or None."""
    out, parts = {}, rows.flatten()
    for k, c in enumerate(names):
        v = parts[k]
        if pa.types.is_list(v.type):
            flat, sizes = v.flatten(), np.diff(v.offsets.to_numpy())
            if not v.null_count and not flat.null_count and len(v) and (sizes == sizes[0]).all():
                out[c] = flat.to_numpy(zero_copy_only=False).reshape(len(v), -1)
            else:
                out[c] = [None if x is None or any(e is None for e in x) else np.asarray(x, float) for x in v.to_pylist()]
        else:
            out[c] = v.to_numpy(zero_copy_only=False)
    return out


def _matrix(v: object) -> np.ndarray | None:
    """A block's vectors as a matrix of doubles, or None where they are no clean matrix."""
    return np.asarray(v, float) if isinstance(v, np.ndarray) and np.isfinite(v).all() else None


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by one product; near ones, where that loses digits, place by place."""
    sx, sy = (x * x).sum(1), (y * y).sum(1)
    d = sx[:, None] + sy - 2 * x @ y.T
    i, j = np.nonzero(d < 1e-4 * (sx[:, None] + sy))
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], j[at : at + 65536]
        d[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return np.maximum(d, 0)


def nearest(rows: DataFrame, queries: DataFrame, score: str, k: int, margin: float = 4e-6) -> DataFrame:
    """(q_id, id): per query(q_id, q) a superset of its k best rows(id, v) but itself by ``score``, "distance" or "cosine".

    Per block all go on whose score could round to one of the block's k best. Blocks with null, uneven or non-finite vectors go on whole.
    """

    def best(a, b):
        x, y = _matrix(a["q"]), _matrix(b["v"])
        if x is None or y is None or x.shape[1] != y.shape[1]:
            return {"q_id": np.repeat(a["q_id"], len(b["id"])), "id": np.tile(b["id"], len(a["q_id"]))}
        if score == "cosine":
            sx, sy = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            x, y = x / np.where(sx > 0, sx, np.nan)[:, None], y / np.where(sy > 0, sy, np.nan)[:, None]
        qs, ids, kin = [], [], b["id"]
        if len(y):  # of equal vectors only the lowest ids can be among the best
            order = np.argsort(kin, kind="stable")
            same = np.unique(np.ascontiguousarray(y[order]).view(f"V{8 * y.shape[1]}").ravel(), return_inverse=True)[1]
            by = np.argsort(same, kind="stable")
            first = np.concatenate([[True], same[by][1:] != same[by][:-1]])
            rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
            order = order[by[rank <= k]]
            y, kin = y[order], kin[order]
        for at in range(0, len(x), 256):
            d = -(x[at : at + 256] @ y.T) if score == "cosine" else np.sqrt(squares(x[at : at + 256], y))
            own = a["q_id"][at : at + 256, None] == kin
            d[own] = np.nan
            kept = ~own
            if d.shape[1] > k:
                kth = np.partition(np.where(np.isnan(d), np.inf, d), k - 1, axis=1)[:, k - 1 : k]
                kept &= ~(d > kth + margin)
            i, j = np.nonzero(kept)
            qs.append(a["q_id"][at : at + 256][i])
            ids.append(kin[j])
        return {"q_id": np.concatenate(qs), "id": np.concatenate(ids)}

    return block_pairs(queries.select("q_id", "q"), rows.select("id", "v"), "q_id", "id", best, "q_id long, id long").where("q_id <> id")


def group_distances(rows: DataFrame) -> DataFrame:
    """(a, b, n, k, total, least, odd) of the distances, in millionths, between all rows(id, label, v) by their labels' pair.

    k of the n are finite, odd is the sum of the infinite and NaN ones; null vectors and ones of another length have none.
    """

    def sums(p, q, same):
        out = []
        x, y = _matrix(p["v"]), _matrix(q["v"])
        whole = x is not None and y is not None and x.shape[1] == y.shape[1]
        of = lambda t: {None if u != u else int(u): np.flatnonzero((t == u) | (np.isnan(t) if u != u else False)) for u in np.unique(t)}
        lp, lq = of(np.asarray(p["label"], float)), of(np.asarray(q["label"], float))
        for u, i in lp.items():
            for w, j in lq.items():
                once = p["id"][i][:, None] < q["id"][j] if same else np.ones((len(i), len(j)), bool)
                if whole:
                    d = np.rint(np.sqrt(squares(x[i], y[j])) * 1e6)
                else:
                    d = np.array([[np.nan if p["v"][s] is None or q["v"][t] is None or len(p["v"][s]) != len(q["v"][t]) else np.rint(np.sqrt(((np.asarray(p["v"][s], float) - q["v"][t]) ** 2).sum()) * 1e6) for t in j] for s in i]).reshape(len(i), len(j))
                known, odd = once & np.isfinite(d), None
                if not whole and (once & ~known).any():
                    given = np.array([[p["v"][s] is not None and q["v"][t] is not None and len(p["v"][s]) == len(q["v"][t]) for t in j] for s in i]).reshape(len(i), len(j))
                    odd = float(d[once & ~known & given].sum()) if (once & ~known & given).any() else None
                if once.any():
                    lo, hi = (u if w is None else w if u is None else f(u, w) for f in (min, max))
                    out.append((lo, hi, int(once.sum()), int(known.sum()), int(d[known].sum()), int(d[known].min()) if known.any() else None, odd))
        return {n: list(c) for n, c in zip("a b n k total least odd".split(), zip(*out, strict=True), strict=False)} if out else {}

    got = self_pairs(rows.select("id", "label", "v"), "id", sums, "a int, b int, n long, k long, total long, least long, odd double")
    return got.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("least").alias("least"), F.sum("odd").alias("odd"))

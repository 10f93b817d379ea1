"""Pairs of blocks against brute force: copies, nulls, labels without value, vectors of zero and of other lengths."""

import numpy as np
import pytest

from sonorant.operators import aggregates, blocks

RNG = np.random.default_rng(8)
X = [RNG.normal(size=4).tolist() for _ in range(90)]
ROWS = [(i, i % 3 if i % 7 else None, x) for i, x in enumerate(X + [X[0]] * 30 + [[0.0] * 4])]
SCHEMA = "id long, label int, v array<double>"


@pytest.mark.parametrize("score", ["distance", "cosine"])
@pytest.mark.parametrize("odd", [[], [(200, 1, None), (201, 2, [1.0]), (202, 0, [1.0, None, 2.0, 3.0])]])
def test_nearest_holds_the_best(spark, monkeypatch, score, odd):
    monkeypatch.setattr(blocks.block_pairs, "__defaults__", (25, None))
    rows = spark.createDataFrame(ROWS + odd, SCHEMA)
    got = blocks.nearest(rows, rows.where("id % 20 = 0 and id < 200").selectExpr("id as q_id", "v as q"), score, 3)
    pairs = [(r.q_id, r.id) for r in got.collect()]
    assert len(pairs) == len(set(pairs))
    found = {q: {j for p, j in pairs if p == q} for q, _ in pairs}
    for q in range(0, 120, 20):
        x = np.array(ROWS[q][2])
        if score == "cosine":
            best = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), i) for i, _, y in ROWS if i != q and any(y))
        else:
            best = sorted((round(float(np.linalg.norm(x - y)), 6), i) for i, _, y in ROWS if i != q)
        assert {i for _, i in best[:3]} <= found[q] and q not in found[q]


@pytest.mark.parametrize("odd", [[], [(200, 1, None), (201, 2, [1.0]), (202, 0, [float("nan")] * 4)]])
def test_label_distances_equal_brute_force(spark, monkeypatch, odd):
    monkeypatch.setattr(blocks.self_pairs, "__defaults__", (25, None))
    rows = ROWS + odd
    got = {(r.a, r.b): (r.n, r.mean, r.least) for r in aggregates.label_distances(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for i, u, x in rows:
        for j, w, y in rows:
            if i < j:
                lab = [k for k in (u, w) if k is not None] or [None]
                want.setdefault((min(lab) if lab[0] is not None else None, max(lab) if lab[0] is not None else None), []).append(None if x is None or y is None or len(x) != len(y) else round(float(np.linalg.norm(np.subtract(x, y))), 6))
    assert set(got) == set(want)
    for k, d in want.items():
        known = [x for x in d if x is not None]
        n, mean, least = got[k]
        assert n == len(d) and (mean == pytest.approx(np.mean(known), abs=2e-6, nan_ok=True)) and least == pytest.approx(np.fmin.reduce(known), abs=1e-9)


@pytest.mark.parametrize("size", [9, 4096])
def test_dbscan_by_blocks_equals_the_kernel(spark, monkeypatch, size):
    from sonorant.functions import kernels
    from sonorant.operators import models

    monkeypatch.setattr(blocks.self_pairs, "__defaults__", (size, None))
    x = np.concatenate([RNG.normal(size=(25, 2)) * 0.4 + c for c in ((0, 0), (4, 0), (0, 5))] + [RNG.uniform(-3, 8, (15, 2))])
    rows = [(100 + i, g, v.tolist()) for g in (0, 1) for i, v in zip(range(g * 100, g * 100 + 90), x[RNG.permutation(90)], strict=True)] + [(500, 0, None), (501, None, [0.0, 0.0])]
    got = {r.id: r.cluster for r in models.dbscan_blocks(spark.createDataFrame(rows, SCHEMA), "label", 4, models.within(0.6)).collect()}
    assert got[500] is None and got[501] is None
    for g in (0, 1):
        of = [(i, v) for i, k, v in rows if k == g and v]
        want = kernels.dbscan(np.array([v for _, v in of]), 0.6, 4)
        first = {}
        mine = [got[i] for i, _ in of]
        for m, w in zip(mine, want, strict=True):
            assert (m is None) == (w < 0)
            if m is not None:
                assert first.setdefault(w, m) == m
        assert len(set(first.values())) == len(first)


def test_hdbscan_takes_groups_of_any_size(spark):
    from sonorant.operators import models

    x = np.concatenate([RNG.normal(size=(2700, 2)), RNG.normal(size=(2700, 2)) + 40])
    got = models.hdbscan(spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], SCHEMA), "label", 900).collect()
    near, far = ({r.cluster for r in got if (r.id < 2700) == side} - {-1} for side in (True, False))
    assert len(near) == len(far) == 1 and near != far and len(got) == 5400


def test_warped_clusters_of_a_large_group_equal_the_kernel(spark):
    from sonorant.functions import kernels
    from sonorant.operators import models

    rows = [(i, 1, (RNG.integers(0, 40, int(RNG.integers(1, 4))) * 10.0).tolist()) for i in range(505)]
    got = {r.id: r.cluster for r in models.dtw_clusters(spark.createDataFrame(rows, SCHEMA), "label", 15.0, 4).collect()}
    d = np.zeros((505, 505))
    for i in range(505):
        d[i, i:] = d[i:, i] = [kernels.dtw(rows[i][2], y) for _, _, y in rows[i:]]
    assert [got[i] for i in range(505)] == kernels.dbscan(None, 15.0, 4, d).tolist()


def test_warped_matrix_equals_the_kernel(spark):
    from sonorant.functions import kernels
    from sonorant.operators import models

    rows = [(i, 1, RNG.exponential(50, int(RNG.integers(1, 30))).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.i, r.j): r.distance for r in models.dtw_matrix(df, df.where("id % 20 = 0"), 5).collect()}
    assert set(got) == {(i, j) for i in (0, 20, 40) for j in range(i + 1, 60)}
    assert all(abs(v - kernels.dtw(np.array(rows[i][2]), np.array(rows[j][2]), 5)) < 2e-6 for (i, j), v in got.items())


def test_warping_by_diagonals_equals_the_kernel():
    from sonorant.functions import kernels

    for k in range(60):
        n, m = RNG.integers(1, 25, 2)
        a, b, band = RNG.exponential(50, (5, n)), RNG.exponential(50, (5, m)), (None, 0, 1, 5)[k % 4]
        want = np.array([kernels.dtw(x, y, band) for x, y in zip(a, b, strict=True)])
        assert np.allclose(kernels.dtw_each(a, b, band), want, rtol=0, atol=1e-7)
        limit = float(np.median(want)) + 1e-6
        assert ((kernels.dtw_each(a, b, band, limit) <= limit) == (want <= limit)).all()


def test_equal_series_are_warped_once(monkeypatch):
    from sonorant.functions import kernels
    from sonorant.operators import models

    warped, plain = [], kernels.dtw_each
    monkeypatch.setattr(kernels, "dtw_each", lambda a, *rest: warped.append(len(a)) or plain(a, *rest))
    v = [np.arange(k % 3 + 2.0) for k in range(300)]
    x, which = models._distinct(v)
    d = models._warped(x, x, np.ones((3, 3), bool))[np.ix_(which, which)]
    assert sum(warped) == 9 and d.shape == (300, 300) and d[0, 3] == 0 and d[0, 1] == kernels.dtw(v[0], v[1])


def test_series_with_a_null_are_near_none(spark):
    from sonorant.operators import models

    rows = [(0, 1, [1.0, None]), (1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.5]), (3, 1, None), (4, 1, [900.0] * 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: r.cluster for r in models.dtw_clusters(df, "label", 15.0, 2).collect()} == {0: -1, 1: 0, 2: 0, 3: -1, 4: -1}
    got = {(r.i, r.j): r.distance for r in models.dtw_matrix(df, df.where("id < 2"), 5).collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 4), (1, 2), (1, 4)} and np.isnan(got[0, 1]) and got[1, 2] == 0.5


def test_nearest_points_of_every_row_equal_brute_force(spark):
    from sonorant.operators import joins

    rows = [(i, *map(float, v)) for i, v in enumerate(np.concatenate([RNG.integers(0, 6, (150, 3)), RNG.normal(size=(60, 3)) + 90, np.full((90, 3), 2), [[500, 500, 500]]]))]
    for size in (8, 1024):
        got = {(r.a_id, r["rank"]): (r.b_id, r.distance) for r in joins.nearest_points(spark.createDataFrame(rows, "id long, x double, y double, z double"), 5, size).collect()}
        assert len(got) == 5 * len(rows)
        for i, *p in rows:
            best = sorted((round(float(np.sqrt(((np.array(p) - q) ** 2).sum())), 6), j) for j, *q in rows if j != i)[:5]
            for k, (d, j) in enumerate(best, 1):
                assert got[i, k][0] == j and got[i, k][1] == pytest.approx(d, abs=1e-9)


@pytest.mark.parametrize("n", [3, 40])
def test_nearest_points_of_odd_and_few_rows(spark, n):
    from sonorant.operators import joins

    rows = [(i, float(i * i), 0.0, 0.0) for i in range(n)] + [(90, None, 0.0, 0.0), (91, float("nan"), 0.0, 0.0), (92, 1.0, None, 2.0)]
    got = {}
    for r in joins.nearest_points(spark.createDataFrame(rows, "id long, x double, y double, z double"), 4).collect():
        got.setdefault(r.a_id, {})[r["rank"]] = r.b_id

    def far(p, q):
        if any(v is None for v in (*p, *q)):
            return 2, 0.0
        d = float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))))
        return (1, 0.0) if np.isnan(d) else (0, d)

    for i, *p in rows:
        best = [j for _, j in sorted((far(p, q), j) for j, *q in rows if j != i)][:4]
        assert [got[i][k] for k in sorted(got[i])] == best


def test_nearest_points_query_asks_for_every_row(spark):
    import __spark_entry__ as entry

    got = entry.queries()["j10_nearest_points"](spark, "/root/testdata/sf0.001")
    assert got.select("a_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()

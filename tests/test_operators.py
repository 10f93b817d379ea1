"""Hand-computed fixtures, edge cases and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorant.functions import kernels, scalars, stats, vectors
from sonorant.operators import filters, joins, models
from sonorant.operators import sequences as seq


def toks(spark, **seqs):
    return spark.createDataFrame([(k, i, x, 0) for k, v in seqs.items() for i, x in enumerate(v)], "seq string, pos int, token string, ctx int")


def test_ngrams_count_and_total(spark):
    t = toks(spark, a="xxx", b="xy", c="z")
    got = {(r.n, r.ngram): (r.occurrences, r.sequences) for r in seq.ngram_counts(t, [1, 2, 3]).collect()}
    assert got == {(1, "x"): (4, 2), (1, "y"): (1, 1), (1, "z"): (1, 1), (2, "x x"): (2, 1), (2, "x y"): (1, 1), (3, "x x x"): (1, 1)}


def test_transition_rows_sum_to_one(spark):
    t = toks(spark, a="abcab", b="ba")
    for r in seq.transition_matrix(t).groupBy("src").agg(F.sum("p").alias("p")).collect():
        assert abs(r.p - 1) < 1e-5


def test_empty_sequences(spark):
    t = toks(spark, a="q").where("false")
    assert seq.ngram_counts(t, [2]).count() == 0 and seq.max_ngram_length(t, 2, 5).first().max_n == 1
    assert seq.runs(t).count() == 0 and seq.zipf(t.groupBy("token").agg(F.count("*").alias("c"))).first().slope in (None, 0.0)


def test_partitioning_does_not_matter(spark):
    t = toks(spark, a="abcabcaab", b="ccba")
    a = sorted(map(tuple, seq.pmi(t.repartition(1)).collect()))
    assert a == sorted(map(tuple, seq.pmi(t.repartition(7, "pos")).collect()))


def test_gap_at_threshold_stays(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 500.0), (1, 1001.0), (1, None)], "k int, t double")
    assert sorted((r.size, r.start, r.stop) for r in seq.gap_sessions(df, "k", "t", 500).collect()) == [(1, 1001.0, 1001.0), (2, 0.0, 500.0)]


def test_anchored_windows(spark):
    df = spark.createDataFrame([(1, x) for x in (0.0, 4.0, 9.0, 11.0, 15.0)], "k int, t double")
    assert sorted((r.anchor, r.size) for r in seq.anchored_windows(df, "k", "t", 10).collect()) == [(0.0, 3), (11.0, 2)]


def test_causal_chain_ends_on_a_cycle(spark):
    df = spark.createDataFrame([(1, [2]), (2, [3]), (3, [1, 3])], "id int, parents array<int>")
    assert {(r.id, r.depth) for r in seq.causal_chain(df, 1).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_align_touching_and_ties(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0), (2, 100.0, 200.0), (3, 500.0, 600.0)], "a_id long, a_start double, a_stop double")
    b = spark.createDataFrame([(7, 0.0, 100.0, "x"), (5, 0.0, 100.0, "y"), (9, 200.0, 300.0, "z")], "b_id long, b_start double, b_stop double, label string")
    got = {r.a_id: (r.b_id, r.label) for r in joins.align(a, b, 50).collect()}
    assert got == {1: (5, "y"), 2: (-1, "Unknown"), 3: (-1, "Unknown")}


@pytest.mark.parametrize("width", [7.0, 30.0, 500.0])
def test_bucketed_overlap_equals_naive(spark, width):
    rng = np.random.default_rng(3)
    x = [(i, float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 300, 60), rng.integers(1, 40, 60), strict=True))]
    a, b = spark.createDataFrame(x, "a_id int, a_start double, a_stop double"), spark.createDataFrame(x, "b_id int, b_start double, b_stop double")
    got = sorted((r.a_id, r.b_id) for r in joins.overlaps(a, b, width).collect())
    assert got == sorted((i, j) for i, s, e in x for j, t, u in x if s < u and t < e)


def test_as_of_age_limit(spark):
    left = spark.createDataFrame([(1, "k", 10.0), (2, "k", 30.0), (3, "q", 5.0)], "id int, k string, t double")
    right = spark.createDataFrame([("k", 10.0, 1.5), ("k", 12.0, 2.5)], "k string, t double, v double")
    assert {r.id: r.v for r in joins.as_of(left, right, "k", "t", "v", 10).collect()} == {1: 1.5, 2: None, 3: None}


def test_absent_species_gives_no_rows(spark):
    p = spark.createDataFrame([("a", "s", 5.0)], "key string, species string, f0 double")
    assert filters.in_range(p, "f0", 0, 9, "none").count() == 0


def test_similarity_falls_with_distance(spark):
    r = spark.range(1).select(vectors.similarity(F.lit(0.0)).alias("a"), vectors.similarity(F.lit(2.0)).alias("b"), vectors.similarity(F.lit(2.0), True).alias("c")).first()
    assert r.a == 1 and r.b < 1 and abs(r.b + r.c - 1) < 1e-12


def test_zero_vectors(spark):
    r = spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), scalars.uncertainty(F.array(F.lit(3.0))).alias("u")).first()
    assert r.c is None and r.u == 0


def test_sampling_respects_forbidden_and_top_p(spark):
    logits, bad = F.array(*map(F.lit, (5.0, 4.0, 1.0))), F.array(F.lit(0))
    r = spark.range(1).select(scalars.next_token(logits, bad).alias("greedy"), scalars.next_token(logits, bad, draw=F.lit(0.999), top_p=0.5).alias("p"), scalars.next_token(logits, bad, draw=F.lit(0.99999), k=2).alias("k")).first()
    assert (r.greedy, r.p, r.k) == (1, 1, 2)


def test_distribution_functions():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(stats.t_sf2(2.228138852, 10) - 0.05) < 1e-8
    assert abs(stats.fisher_greater(3, 1, 1, 3) - 17 / 70) < 1e-12 and abs(stats.normal_quantile(0.975) - 1.959963985) < 1e-8
    assert stats.sample_size(0.1, 0.02) == 3841


def test_dtw_invariants():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=12), rng.normal(size=12)
    assert kernels.dtw(a, a) == 0 and abs(kernels.dtw(a, b) - kernels.dtw(b, a)) < 1e-9
    assert kernels.dtw(a, b, 2) >= kernels.dtw(a, b) - 1e-9 and kernels.keogh(a, b, 2) <= kernels.dtw(a, b, 2) + 1e-9
    with pytest.raises(ValueError):
        kernels.dtw(a, [])


def test_change_points_equal_brute_force():
    x = np.array([0, 0.1, 0, 5, 5.1, 4.9, 5, 1, 1.1])
    best = min(((sum(((x[s:e] - x[s:e].mean()) ** 2).sum() for s, e in zip(c[:-1], c[1:], strict=True)) + 0.5 * (len(c) - 2), c) for m in range(1 << 8) for c in [[0, *[i + 1 for i in range(8) if m >> i & 1], 9]] if min(np.diff(c)) >= 2))
    assert kernels.change_points(x, 0.5) == best[1]


def test_clusterings_find_two_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), [[50.0, 50.0]]])
    for label in (kernels.dbscan(x, 0.5, 3), kernels.hdbscan(x, 5)):
        assert len(set(label[:20])) == 1 and len(set(label[20:40])) == 1 and label[0] != label[20] and label[40] == -1
    with pytest.raises(ValueError):
        kernels.dbscan(x[:2], 1, 3)


def test_viterbi_and_baum_welch():
    start, trans, emit = np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.9, 0.1], [0.1, 0.9]])
    path, lp = kernels.viterbi(np.array([0, 0, 1, 1]), start, trans, emit)
    assert path == [0, 0, 1, 1] and lp < 0
    s, x, e, like = kernels.baum_welch_counts(np.array([0, 0, 1, 1]), start, trans, emit)
    assert abs(s.sum() - 1) < 1e-9 and abs(x.sum() - 3) < 1e-9 and abs(e.sum() - 4) < 1e-9 and like >= lp


def test_yin_finds_the_pitch():
    t = np.arange(1600) / 16000
    assert abs(kernels.yin(np.sin(2 * np.pi * 440 * t), 16000) - 440) < 2


def test_cycles(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src int, dst int")
    assert not models.has_cycle(e((1, 2), (2, 3), (1, 3))) and models.has_cycle(e((1, 2), (2, 3), (3, 2))) and models.has_cycle(e((4, 4)))


def test_multiple_alignment():
    rows = kernels.align_progressive([list("abcd"), list("acd"), list("abd")])
    assert ["".join(x).replace("-", "") for x in rows] == ["abcd", "acd", "abd"] and len({len(x) for x in rows}) == 1


def test_harmonic_distance_half_even(spark):
    r = spark.range(1).select(scalars.harmonic_distance(F.lit(2.5), F.lit(1.0)).alias("a"), scalars.harmonic_distance(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert r.a == 0.25 and math.isinf(r.b)


def test_plans_push_filters(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = filters.in_range(df.select("p_partkey", F.col("p_retailprice").alias("f0")), "f0", 900, 950)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_retailprice" in plan and "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan


def _blobs(spark):
    """Two clusters apart in the first place (unit scale), drowned by a second place of wide noise until it is scaled."""
    rng = np.random.default_rng(3)
    return [(i, 0, [float(10 * (i % 2) + 0.1 * rng.normal()), float(1e4 * rng.normal()), 5.0]) for i in range(60)]


def test_silhouettes_are_of_scaled_rows(spark):
    rows = _blobs(spark)
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    wide = spark.createDataFrame([(i, k, [x * 1e3, y / 1e5, z]) for i, k, (x, y, z) in rows], "id long, label int, v array<double>")
    a, b = ({r.k: r.silhouette for r in models.silhouettes(x, [1, 2, 60, 99]).collect()} for x in (df, wide))
    assert a[2] == pytest.approx(b[2], abs=1e-6) and a[1] == a[60] == a[99] == 0.0


def test_cluster_suite_runs_each_method(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, (20.0 * (i % 3) + rng.normal(size=4)).tolist()) for i in range(90)]
    got = {r.method: r for r in models.cluster_suite(spark.createDataFrame(rows, "id long, label int, v array<double>"), "label", 3, 5, 2).collect()}
    assert set(got) == {"kmeans", "hdbscan", "mixture"} and got["kmeans"].clusters == 3
    assert all(r.silhouette > 0 and r.clusters >= 2 and 0 < r.assigned <= 90 for r in got.values())


def test_vocabulary_is_scaled_within_its_modality(spark):
    rng = np.random.default_rng(6)
    base = [[float(x) for x in rng.normal(size=6)] for _ in range(2)]
    rows = [(10 * g + i, g, [y * (1e3 if g else 1.0) for y in (base[i % 2][:5] + [base[i % 2][5] + 0.001 * i])]) for g in (0, 1) for i in range(8)]
    got = models.build_vocabulary(spark.createDataFrame(rows, "id long, label int, v array<double>"), "label", 0.5, 3).collect()
    assert {(r.label, r.id % 2, r.cluster) for r in got} == {(g, p, c) for g in (0, 1) for p, c in ((0, 0), (1, 1))} and len(got) == 16


def test_discover_gates_and_measures(spark):
    rng = np.random.default_rng(7)
    sizes = (12, 8, 5)
    rows = [(100 * c + i, 0, (50.0 * c + 0.1 * rng.normal(size=3)).tolist(), 100.0 + c, 10.0, 0.1) for c, n in enumerate(sizes) for i in range(n)]
    bad = [(900 + i, 0, [1e3, 1e3, 1e3 + i / 100], *q) for i, q in enumerate([(10.0, 10.0, 0.1)] * 6 + [(100.0, 1.0, 0.1)] * 6 + [(100.0, 10.0, 0.9)] * 6)]
    df = spark.createDataFrame(rows + bad, "id long, label int, v array<double>, duration_ms double, hnr double, flatness double")
    got = sorted(models.discover(df, "label", 4).collect(), key=lambda r: r.centroid[0])
    assert [r["size"] for r in got] == list(sizes)
    for c, r in enumerate(got):
        x = np.array([v for i, _, v, *_ in rows if i // 100 == c])
        d = np.linalg.norm(x - x.mean(0), axis=1)
        assert r.centroid == pytest.approx(x.mean(0).tolist(), abs=1e-5) and (r.mean, r.std) == pytest.approx((d.mean(), d.std()), abs=1e-5)
    p, length = np.array(sizes) / 25, np.repeat([100.0, 101.0, 102.0], sizes)
    assert got[0].perplexity == pytest.approx(2 ** -(p * np.log2(p)).sum(), abs=1e-5) and got[0].duration_cv == pytest.approx(length.std() / length.mean(), abs=1e-5)
    assert got[0].zipf_r2 == pytest.approx(np.corrcoef(np.log([1, 2, 3]), np.log(sizes))[0, 1] ** 2, abs=1e-5)


def test_totals_over_a_whole_order_are_those_of_one_task(spark):
    from sonorant.plans.lineage import numbered, running

    rows = [(i, (i * 7919) % 97, None if i % 11 == 0 else (i * 31) % 13) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k int, x int").repartition(7)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    want, most, total = {}, None, None
    for i, (key, _, x) in enumerate(order):
        if x is not None:
            total, most = x + (total or 0), x if most is None else max(most, x)
        want[key] = (i, total, most)
    by = [F.desc("k"), "id"]
    got = numbered(df, by, "i").join(running(df, by, "x", "s").select("id", "s"), "id").join(running(df, by, "x", "m", F.max, F.greatest).select("id", "m"), "id")
    assert {r.id: (r.i, r.s, r.m) for r in got.collect()} == want
    assert running(df.where("false"), by, "x", "s").count() == 0


def test_metric_weights_do_not_depend_on_partitions(spark):
    rows = [(i, [float(i % 3), float((i * 37) % 11), 1.0], i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    a, b = models.metric_weights(df.repartition(1), "label", 3, margin=5.0, batch=40), models.metric_weights(df.repartition(9), "label", 3, margin=5.0, batch=40)
    assert a[0].tolist() == b[0].tolist() and a[1] == b[1] and a[0].tolist() != [1.0, 1.0, 1.0]
    with pytest.raises(Exception, match="mini-batch"):
        models.metric_weights(df.select(F.lit(1).cast("long").alias("id"), F.array(F.lit(1.0)).alias("v"), "label"), "label", 3, batch=10)


def test_nearest_by_value_over_crowded_buckets(spark):
    q = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 9.9, 10.0, 55.0, None, float("nan"), 1e9])], "q_id int, x double")
    r = spark.createDataFrame([(k, float(k % 20)) for k in range(400)] + [(900, 74.9), (901, None)], "key int, v double")
    got = {x.q_id: (x.key, x.gap) for x in joins.nearest_by_value(q.repartition(3), r.repartition(5), 20.0).collect()}
    assert got == {0: (0, 0.0), 1: (10, 0.1), 2: (10, 0.0), 3: (900, 19.9)}


def test_match_library_equals_brute_force_over_blocks(spark):
    rng = np.random.default_rng(2)
    q = [(i, float(f), float(d)) for i, (f, d) in enumerate(zip(rng.integers(0, 9000, 300), rng.integers(0, 900, 300), strict=True))]
    lib = [(k, float(f) / 2, float(d) / 2) for k, (f, d) in enumerate(zip(rng.integers(0, 9000, 5000), rng.integers(0, 900, 5000), strict=True))] * 2
    got = {r.q_id: (r.key, r.sim) for r in joins.match_library(spark.createDataFrame(q, "q_id int, q_f0 double, q_duration double"), spark.createDataFrame(lib, "key int, f0 double, duration_ms double")).collect()}
    for i, f, d in q:
        s = [(math.floor((max(0.0, 1 - abs(f - x) / 2000) + max(0.0, 1 - abs(d - y) / 500)) / 2 * 1e6 + 0.5) / 1e6, -k) for k, x, y in lib]
        assert got[i] == (-max(s)[1] if max(s)[0] >= 0.8 else None, max(s)[0])


def test_network_metrics_by_either_join(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 40, (200, 2))] + [(0, k) for k in range(1, 40)]
    e = spark.createDataFrame(rows, "src int, dst int")
    near = {k: {b for a, b in rows if a == k} | {a for a, b in rows if b == k} - {k} for k in range(40)}
    near = {k: v - {k} for k, v in near.items()}
    local = [sum(q in near[p] for p in v for q in v) / (len(v) * (len(v) - 1)) if len(v) > 1 else 0 for v in near.values() if v]
    for most in (1_000_000, 0):
        r = models.network_metrics(e, most).first()
        assert (r.nodes, r.edges, r.clustering) == (40, sum(map(len, near.values())) // 2, round(sum(local) / 40, 6))

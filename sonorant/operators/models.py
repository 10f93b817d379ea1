"""Clustering, classification and model operators.

Models with fixed size (prototypes, centroids, matrices) are broadcast. Kernels without a JVM form run as grouped pandas
functions on groups that a parameter bounds; MLlib does the rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels, vectors
from ..plans.lineage import cut
from .blocks import block_pairs, self_pairs, squares
from .filters import purity
from .sequences import r6


def _together(v: pd.Series) -> np.ndarray | list[np.ndarray]:
    """Rows x places, or a list of rows where they differ in length (series for time warping)."""
    rows = [np.asarray(x) for x in v]
    return np.stack(rows) if len({len(x) for x in rows}) == 1 else rows


def _in_group(rows: DataFrame, group: str, label, most: int | None) -> DataFrame:
    """(group, id, cluster) by a function (n x d array) -> labels per group; groups over ``most`` rows are an error, not cut."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(pdf) > most:
            raise ValueError(f"a group holds {len(pdf)} rows, over the bound of {most}; split the key")
        pdf = pdf.sort_values("id")
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "cluster": label(_together(pdf["v"])).astype("int64")})

    kind = rows.schema[group].dataType.simpleString()
    return rows.select(group, "id", "v").groupBy(group).applyInPandas(run, f"`{group}` {kind}, id long, cluster long")


def dbscan(rows: DataFrame, group: str, eps: float, min_samples: int, most: int = 20_000) -> DataFrame:
    """M1: DBSCAN within each group; the key of a cluster is (group, cluster), so labels don't meet across groups (Q23)."""
    return _in_group(rows, group, lambda x: kernels.dbscan(x, eps, min_samples), most)


def hdbscan(rows: DataFrame, group: str, min_size: int, most: int | None = None) -> DataFrame:
    """M3: published HDBSCAN within each group (Q22). One task a group: its rows in memory, time with the square of them."""
    return _in_group(rows, group, lambda x: kernels.hdbscan(x, min_size), most)


def _components(links: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, cluster): the least id that links(a, b), given both ways, lead to."""
    label = cut(ids.withColumn("cluster", F.col("id")))
    while True:
        near = links.join(label.selectExpr("id as b", "cluster as c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        new = label.join(near, label["id"] == near["a"], "left").select("id", F.least("cluster", "c").alias("cluster"))
        new = new.join(new.selectExpr("id as cluster", "cluster as jump"), "cluster", "left").select("id", F.least("cluster", "jump").alias("cluster"))
        new = cut(new)
        if new.agg(F.sum("cluster")).first()[0] == label.agg(F.sum("cluster")).first()[0]:
            break
        label = new
    return label


def dbscan_pairs(pairs: DataFrame, ids: DataFrame, min_samples: int) -> DataFrame:
    """M1 at scale, over all pairs within eps (a, b, both ways): core points by degree, clusters as components of core links.

    (id, cluster): cluster is the least core id; a border point joins the least core neighbour's; noise is null.
    """
    core = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("id"))
    links = pairs.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    label = _components(links, core)
    border = pairs.join(label.selectExpr("id as b", "cluster as c"), "b").groupBy("a").agg(F.min("c").alias("c"))
    return ids.join(label, "id", "left").join(border, ids["id"] == border["a"], "left").select(ids["id"], F.coalesce("cluster", "c").alias("cluster"))


def _rows(block: dict[str, object], at: np.ndarray) -> dict[str, object]:
    """Some rows of a block."""
    return {c: v[at] if isinstance(v, np.ndarray) else [v[k] for k in at] for c, v in block.items()}


def dbscan_blocks(rows: DataFrame, group: str, min_samples: int, close, size: int | None = None, key: str | Column = "id") -> DataFrame:
    """M1 at scale over rows(id, group, v), links found block against block by close(block, block) -> matrix of booleans.

    (id, cluster) as in ``dbscan_pairs``. No link becomes a row: a first pass counts each row's neighbours, a second returns
    a spanning forest of the core rows of each pair of blocks, a third each border row's least cluster; these two call close() on such rows
    alone. Null groups have no neighbours.
    """
    how = {"group": group} if size is None else {"group": group, "size": size}
    known = cut(rows.where(F.col(group).isNotNull()).select("id", group, "v"))

    def counts(p, q, same):
        near = close(p, q)
        if same:
            near = near & (p["id"][:, None] != q["id"])
            return {"id": p["id"], "n": near.sum(1)}
        return {"id": np.concatenate([p["id"], q["id"]]), "n": np.concatenate([near.sum(1), near.sum(0)])}

    core = self_pairs(known, key, counts, "id long, n long", **how).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") + 1 >= min_samples).select("id", F.lit(True).alias("core"))
    core = cut(core)
    marked = known.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))

    def forest(p, q, same):
        cp, cq = np.flatnonzero(p["core"]), np.flatnonzero(q["core"])
        near = close(_rows(p, cp), _rows(q, cq))
        ids = np.concatenate([p["id"][cp], q["id"][cq]])
        if same:
            ids = np.concatenate([ids[: len(cp)]] * 2)
        a, b, left, left_q = [], [], np.ones(len(cp), bool), np.ones(len(cq), bool)
        for i in range(len(cp)):  # breadth first: every core row is reached once
            edge, side = [i] if left[i] else [], 0
            left[i] = False
            while len(edge):
                if side == 0:
                    got = near[edge] & left_q
                    to = np.flatnonzero(got.any(0))
                    a.append(ids[: len(cp)][np.asarray(edge)[got[:, to].argmax(0)]])
                    b.append(ids[len(cp) :][to])
                    left_q[to] = False
                else:
                    got = near[:, edge] & left[:, None]
                    to = np.flatnonzero(got.any(1))
                    a.append(ids[:len(cp)][to])
                    b.append(ids[len(cp) :][np.asarray(edge)[got[to].argmax(1)]])
                    left[to] = False
                edge, side = to, 1 - side
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return {"a": a[a != b], "b": b[a != b]}

    links = self_pairs(marked, key, forest, "a long, b long", **how).distinct()
    label = _components(cut(links.union(links.select("b", "a"))), core.select("id"))
    named = marked.join(label, "id", "left").select("id", group, "v", F.col("cluster").isNull().alias("open"), F.coalesce("cluster", F.lit(0)).alias("c"))

    def border(p, q, same):
        far, out = np.iinfo(np.int64).max, []
        for x, y in ((p, q),) if same else ((p, q), (q, p)):
            own, other = np.flatnonzero(x["open"]), np.flatnonzero(~y["open"])
            c = y["c"][other]
            if len(own) and len(c):
                m = close(_rows(p, own), _rows(q, other)) if x is p else close(_rows(p, other), _rows(q, own)).T
                least = np.where(m, c, far).min(1)
                out.append((np.asarray(x["id"])[own][least < far], least[least < far]))
        return {"id": np.concatenate([u for u, _ in out]), "c": np.concatenate([w for _, w in out])} if out else {}

    edge = self_pairs(named, key, border, "id long, c long", **how).groupBy("id").agg(F.min("c").alias("c"))
    return rows.select("id").join(label, "id", "left").join(edge, "id", "left").select("id", F.coalesce("cluster", "c").alias("cluster"))


def within(eps: float):
    """close() of ``dbscan_blocks`` for vectors whose distance, in millionths, is at most eps; null and uneven ones are close to none."""

    def close(p, q):
        i, j = ([k for k, x in enumerate(t["v"]) if x is not None] for t in (p, q))
        near = np.zeros((len(p["v"]), len(q["v"])), bool)
        for n in {len(p["v"][k]) for k in i}:
            a, b = [k for k in i if len(p["v"][k]) == n], [k for k in j if len(q["v"][k]) == n]
            if b:
                d = squares(np.array([p["v"][k] for k in a], float), np.array([q["v"][k] for k in b], float))
                near[np.ix_(a, b)] = np.rint(np.sqrt(d) * 1e6) <= round(eps * 1e6)
        return near

    return close


def _assembled(rows: DataFrame):
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector("v"))


def kmeans(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """M2: k-means; fewer rows than k is an error."""
    from pyspark.ml.clustering import KMeans

    if rows.limit(k).count() < k:
        raise ValueError("fewer rows than clusters")
    return KMeans(k=k, seed=seed).fit(_assembled(rows)).transform(_assembled(rows)).select("id", F.col("prediction").cast("long").alias("cluster"))


def gmm(rows: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float, float]:
    """M4, M5: Gaussian mixture: (labels, log-likelihood, BIC with full covariances)."""
    from pyspark.ml.clustering import GaussianMixture

    data = _assembled(rows).cache()
    n, d = data.count(), len(data.first()["v"])
    if n < k:
        raise ValueError("fewer rows than components")
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(data)
    like = model.summary.logLikelihood
    free = k * (1 + d + d * (d + 1) // 2) - 1
    return model.transform(data).select("id", F.col("prediction").cast("long").alias("cluster")), like, free * float(np.log(n)) - 2 * like


def _scaled(rows: DataFrame) -> DataFrame:
    """rows with features: v in units of standard deviations from the mean; a constant place is 0."""
    from pyspark.ml.feature import StandardScaler

    data = _assembled(rows).withColumnRenamed("features", "raw")
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(data).transform(data).drop("raw")


def _silhouette(done: DataFrame) -> float:
    """Of features by prediction; under two clusters 0."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return float(ClusteringEvaluator().evaluate(done)) if done.select("prediction").distinct().count() > 1 else 0.0


def silhouettes(rows: DataFrame, ks: list[int], seed: int = 42) -> DataFrame:
    """Silhouette of standardised k-means for each k; 0 for k under 2, k not under the rows, or one cluster."""
    from pyspark.ml.clustering import KMeans

    n, out = rows.count(), []
    data = _scaled(rows).cache() if n else None
    for k in ks:
        out.append((k, _silhouette(KMeans(k=k, seed=seed).fit(data).transform(data)) if 1 < k < n else 0.0))
    return rows.sparkSession.createDataFrame(out, "k int, silhouette double")


def cluster_suite(rows: DataFrame, group: str, k: int, min_size: int, dims: int = 8, least: float = 0.01, seed: int = 42) -> DataFrame:
    """(method, clusters, assigned, silhouette) of k-means, HDBSCAN within each group and a mixture, over the same scaled features.

    The mixture is fitted on ``dims`` principal components; rows of components under a weight of ``least``, and
    HDBSCAN's noise, are not assigned.
    """
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _scaled(rows).cache()
    scaled = data.select("id", group, vector_to_array("features").alias("v"))
    found = hdbscan(scaled, group, min_size).where("cluster >= 0")
    named = cut(found.select(group, "cluster").distinct().withColumn("prediction", F.monotonically_increasing_id()))
    low = PCA(k=dims, inputCol="features", outputCol="low").fit(data).transform(data).select("id", F.col("low").alias("features"))
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(low)
    kept = [i for i, w in enumerate(model.weights) if w >= least]
    done = {
        "kmeans": KMeans(k=k, seed=seed).fit(data).transform(data),
        "hdbscan": data.join(found.join(named, [group, "cluster"]).select("id", "prediction"), "id"),
        "mixture": data.join(model.transform(low).where(F.col("prediction").isin(kept)).select("id", "prediction"), "id"),
    }
    out = []
    for method, x in done.items():
        x = cut(x.select("id", "features", F.col("prediction").cast("double").alias("prediction")))
        out.append((method, x.select("prediction").distinct().count(), x.count(), _silhouette(x)))
    return rows.sparkSession.createDataFrame(out, "method string, clusters long, assigned long, silhouette double")


def build_vocabulary(rows: DataFrame, group: str, eps: float, min_samples: int, most: int = 20_000) -> DataFrame:
    """(group, id, cluster) of DBSCAN on rows scaled within their group, without noise."""

    def label(x: np.ndarray) -> np.ndarray:
        std = x.std(axis=0)
        return kernels.dbscan((x - x.mean(axis=0)) / np.where(std > 0, std, 1.0), eps, min_samples)

    return _in_group(rows, group, label, most).where("cluster >= 0")


def discover(rows: DataFrame, group: str, min_size: int, min_duration: float = 40.0, min_hnr: float = 3.0, max_flatness: float = 0.6) -> DataFrame:
    """M34 over rows(id, group, v, duration_ms, hnr, flatness): purity gate, HDBSCAN within each group, and per cluster its
    centroid, size and distances to the centroid, next to zipf_r2, perplexity and duration_cv of the whole vocabulary.
    """
    checks = [("duration", F.col("duration_ms") < min_duration), ("hnr", F.col("hnr") < min_hnr), ("flatness", F.col("flatness") > max_flatness)]
    pure = rows.where(purity(checks) == "ok")
    found = cut(hdbscan(pure, group, min_size).where("cluster >= 0").withColumn("c_id", F.struct(group, "cluster")))
    members = pure.join(found.select("id", "c_id"), "id")
    centroids = cut(vectors.means(members, "c_id", "v").select("c_id", F.col("mean").alias("centroid")))
    far = members.join(centroids, "c_id").select("c_id", vectors.euclidean(F.col("v"), F.col("centroid")).alias("distance"))
    stats = cut(cluster_stats(far).join(centroids, "c_id"))
    # Clusters of one size have one place in the ranking after another: sums per size need no order of all clusters.
    sizes = stats.groupBy("size").agg(F.count("*").alias("n")).withColumn("above", F.sum("n").over(W.orderBy(F.desc("size"))) - F.col("n"))
    ranked = sizes.select("size", F.explode(F.sequence(F.col("above") + 1, F.col("above") + F.col("n"))).alias("rank"))
    share = F.col("size") / F.sum("size").over(W.partitionBy())
    ranked = ranked.withColumn("h", -share * F.log2(share))
    r2 = F.when((F.count("*") < 3) | (F.min("size") == F.max("size")), 0.0).otherwise(F.regr_r2(F.ln("size"), F.ln("rank")))
    whole = ranked.agg(r6(r2).alias("zipf_r2"), r6(F.pow(F.lit(2.0), F.sum("h"))).alias("perplexity"))
    spread = members.agg(r6(F.stddev_pop("duration_ms") / F.avg("duration_ms")).alias("duration_cv"))
    return stats.select(f"c_id.{group}", "c_id.cluster", "size", "mean", "std", "centroid").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(spread))


def vocabulary_fit(rows: DataFrame, dims: int, k: int, least: float = 0.01, seed: int = 42) -> DataFrame:
    """PCA, mixture, components above a least weight: (component, weight, mean in PCA space)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    data = _assembled(rows)
    low = PCA(k=dims, inputCol="features", outputCol="low").fit(data).transform(data).select("id", F.col("low").alias("features"))
    model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(low)
    weights = [(i, float(w)) for i, w in enumerate(model.weights)]
    g = model.gaussiansDF.select(vector_to_array("mean").alias("mean")).collect()
    return rows.sparkSession.createDataFrame([(i, w, list(g[i]["mean"])) for i, w in weights if w > least], "component int, weight double, mean array<double>")


def classify(rows: DataFrame, label: str, kind: str, seed: int = 42) -> DataFrame:
    """(id, label, predicted) of a forest, tree or perceptron fitted on rows of a hash split and applied to the others."""
    from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, RandomForestClassifier

    data = _assembled(train_test(rows, 0.3)).withColumn("y", F.col(label).cast("double"))
    n, classes = len(data.first()["v"]), int(data.agg(F.max("y")).first()[0]) + 1
    model = {
        "forest": lambda: RandomForestClassifier(labelCol="y", numTrees=20, subsamplingRate=0.8, seed=seed),
        "tree": lambda: DecisionTreeClassifier(labelCol="y", seed=seed),
        "perceptron": lambda: MultilayerPerceptronClassifier(labelCol="y", layers=[n, 32, classes], seed=seed, maxIter=60),
    }[kind]()
    return model.fit(data.where("not test")).transform(data.where("test")).select("id", label, F.col("prediction").cast("long").alias("predicted"))


def train_test(rows: DataFrame, share: float, salt: str = "s") -> DataFrame:
    """Test flag by the id's MD5, so reruns and other engines agree."""
    return rows.withColumn("test", F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 < share)


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Each class cut to the smallest one's size, in the order of the ids' MD5."""
    least = rows.groupBy(label).count().agg(F.min("count").alias("least"))
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.col("id").cast("string")), "id")))
    return ranked.join(F.broadcast(least), F.col("_k") <= F.col("least")).drop("_k", "least")


def knn_vote(near: DataFrame, weight: Column) -> DataFrame:
    """M12, M13 over near(q_id, label, distance): the label of the greatest summed weight; ties: least label."""
    votes = near.groupBy("q_id", "label").agg(r6(F.sum(weight)).alias("w"))
    best = votes.groupBy("q_id").agg(F.max_by(F.struct("label", "w"), F.struct("w", -F.col("label"))).alias("m"), F.sum("w").alias("t"))
    return best.select("q_id", F.col("m.label").alias("predicted"), r6(F.col("m.w") / F.col("t")).alias("confidence"))


def few_shot(rows: DataFrame, prototypes: DataFrame, distance) -> DataFrame:
    """Nearest prototype(c_id, c) with softmax(-distance); confident if over 0.5 and more than one prototype."""
    d = rows.crossJoin(F.broadcast(prototypes)).withColumn("d", r6(distance(F.col("v"), F.col("c"))))
    p = d.groupBy("id").agg(F.min_by("c_id", F.struct("d", "c_id")).alias("predicted"), F.min("d").alias("least"), F.sum(F.exp(-F.col("d"))).alias("z"), F.count("*").alias("k"))
    prob = r6(F.exp(-F.col("least")) / F.col("z"))
    return p.select("id", "predicted", prob.alias("probability"), ((prob > 0.5) & (F.col("k") > 1)).alias("confident"))


def detections(rows: DataFrame, prototype: DataFrame, distance, threshold: float) -> DataFrame:
    """Windows whose similarity exp(-d) to the prototype(c) reaches the threshold, one event each (Q8)."""
    s = rows.crossJoin(F.broadcast(prototype)).withColumn("score", r6(F.exp(-distance(F.col("v"), F.col("c")))))
    return s.where(F.col("score") >= threshold).select("id", "score")


def exemplars(assigned: DataFrame) -> DataFrame:
    """M23 over assigned(id, c_id, distance): the nearest row of each cluster."""
    return assigned.groupBy("c_id").agg(F.min_by(F.struct("id", "distance"), F.struct("distance", "id")).alias("m")).select("c_id", "m.id", "m.distance")


def medoids(assigned: DataFrame, snr: DataFrame, least: float, pct: float = 0.25) -> DataFrame:
    """The nearest row if its SNR suffices, else the best SNR among the nearest ``pct`` of the cluster."""
    w = W.partitionBy("c_id").orderBy("distance", "id")
    r = assigned.join(snr, "id").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("c_id")))
    near = r.where((F.col("k") == 1) | (F.col("k") <= F.ceil(F.col("n") * pct)))
    key = F.struct(((F.col("k") == 1) & (F.col("snr") >= least)).alias("a"), "snr", -F.col("k"))
    return near.groupBy("c_id").agg(F.max_by(F.struct("id", "snr"), key).alias("m")).select("c_id", "m.id", "m.snr")


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """Size, mean and population deviation of the distances per cluster."""
    return assigned.groupBy("c_id").agg(F.count("*").alias("size"), r6(F.avg("distance")).alias("mean"), r6(F.stddev_pop("distance")).alias("std"))


def predict_next(rules: DataFrame, prefix: str, k: int) -> DataFrame:
    """M31 over rules(prefix, next, n, p): the k most probable continuations."""
    return rules.where(F.col("prefix") == prefix).orderBy(F.desc("n"), "next").limit(k)


#: Edges that may close a wedge of the network are broadcast up to this number, else joined.
CLOSING = 1_000_000


def network_metrics(edges: DataFrame, most: int = CLOSING) -> DataFrame:
    """M32 over undirected edges(src, dst): nodes, edges, density, mean local clustering.

    Edges point to the end of more neighbours, so a triangle is met once, at the node of fewest, whose pointed neighbours
    are at most the root of twice the edges; hubs spread no wedges.
    """
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    deg = cut(both.groupBy("a").agg(F.count("*").alias("k")))
    rated = e.join(deg.selectExpr("a", "k as ka"), "a").join(deg.selectExpr("a as b", "k as kb"), "b")
    low, high = F.struct(F.col("ka").alias("k"), F.col("a").alias("n")), F.struct(F.col("kb").alias("k"), F.col("b").alias("n"))
    to = cut(rated.select(F.least(low, high).alias("l"), F.greatest(low, high).alias("h")).select(F.col("l.n").alias("c"), F.col("h.n").alias("n"), F.col("h.k").alias("k")))
    closing = cut(to.selectExpr("c as p", "n as q").join(to.select(F.col("n").alias("p")).distinct(), "p", "left_semi"))
    x, y = to.selectExpr("c", "n as p", "k as kp"), to.selectExpr("c", "n as q", "k as kq")
    wedges = x.join(y, "c").where("kp < kq or (kp = kq and p < q)").select("c", "p", "q")
    found = wedges.join(F.broadcast(closing) if closing.count() <= most else closing, ["p", "q"])
    tri = found.select(F.explode(F.array("c", "p", "q")).alias("c")).groupBy("c").agg(F.count("*").alias("t"))
    local = deg.join(tri, deg["a"] == tri["c"], "left").select(F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("l"))
    n = local.agg(F.count("*").alias("nodes"), r6(F.avg("l")).alias("clustering"))
    return n.crossJoin(e.agg(F.count("*").alias("edges"))).withColumn("density", r6(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))))


def path_lengths(edges: DataFrame, start: object, depth: int = 20) -> DataFrame:
    """(node, depth) breadth-first from a node over undirected edges."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = both.where(F.col("a") == start).select(F.col("a").alias("node")).distinct().withColumn("depth", F.lit(0))
    edge = seen
    for d in range(1, depth + 1):
        edge = cut(edge.join(both, edge["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        if edge.isEmpty():
            break
        seen = seen.union(edge)
    return seen


def has_cycle(edges: DataFrame) -> bool:
    """Whether directed edges(src, dst) hold a cycle: peel nodes without successors until none is left or none goes."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = left.count()
        if m == n:
            return True
        n = m
    return False


def dtw_pairs(a: DataFrame, pairs: DataFrame, band: int | None = None) -> DataFrame:
    """M8, M9 over a(id, v) and pairs(i, j): warped distance per pair."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kernels.dtw(np.asarray(p), np.asarray(q), band) for p, q in zip(x, y, strict=True)])

    p = pairs.join(a.selectExpr("id as i", "v as x"), "i").join(a.selectExpr("id as j", "v as y"), "j")
    return p.select("i", "j", r6(distance("x", "y")).alias("distance"))


def _distinct(v) -> tuple[list[np.ndarray], np.ndarray]:
    """The different series of a block, and which of them each row has."""
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(np.asarray(x, float).tobytes(), len(seen)) for x in v], int)
    return [np.frombuffer(x) for x in seen], which


def _warped(x: list[np.ndarray], y: list[np.ndarray], need: np.ndarray, band: int | None = None, limit: float | None = None) -> np.ndarray:
    """Matrix of the warped distances that are needed, else infinite; pairs of equal lengths are warped together."""
    out = np.full((len(x), len(y)), np.inf)

    def lengths(v):
        sizes = np.array([len(s) for s in v])
        return [(at := np.flatnonzero(sizes == n), np.array([v[k] for k in at])) for n in np.unique(sizes)]

    mine, others = lengths(x), lengths(y)
    for i, a in mine:
        for j, b in others:
            u, w = np.nonzero(need[np.ix_(i, j)])
            many = max(8, min(512, 2**15 // max(1, a.shape[1])))
            for at in range(0, len(u), many):
                p, q = u[at : at + many], w[at : at + many]
                out[i[p], j[q]] = kernels.dtw_each(a[p], b[q], band, limit)
    return out


def _series_blocks(rows: DataFrame, size: int) -> tuple[Column, int]:
    """Key and size of the blocks of series: equal ones share a block, up to 256 of them, and of long ones fewer make a block."""
    each = rows.groupBy(F.xxhash64("v")).agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("t"))
    copies, usual = each.agg(F.max("n"), F.sum("t") / F.sum("n")).first()
    return F.xxhash64("v", F.pmod(F.xxhash64("id"), F.lit(-(-(copies or 1) // 256)))), max(32, min(size, int(size * 64 / max(1, usual or 1))))


def dtw_matrix(rows: DataFrame, queries: DataFrame, band: int | None = None) -> DataFrame:
    """M9 over rows(id, v) and queries of the same columns: (i, j, distance) of each query i with every row j > i, block against block.

    Equal series of a block are warped once. Distances are rounded as millionths.
    """

    def far(p, q):
        (x, kx), (y, ky) = _distinct(p["v"]), _distinct(q["v"])
        first, last = np.full(len(x), np.iinfo(np.int64).max), np.full(len(y), np.iinfo(np.int64).min)
        np.minimum.at(first, kx, p["id"])
        np.maximum.at(last, ky, q["id"])
        d = np.floor(_warped(x, y, first[:, None] < last, band) * 1e6 + 0.5) / 1e6
        for at in range(0, len(kx), 32):
            i, j = np.nonzero(p["id"][at : at + 32, None] < q["id"])
            yield {"i": p["id"][at + i], "j": q["id"][j], "distance": d[kx[at + i], ky[j]]}

    asked, all_ = (x.where("v is not null").select("id", "v") for x in (queries, rows))
    key, size = _series_blocks(all_, 2048)
    return block_pairs(asked, all_, key, key, far, "i long, j long, distance double", size)


def dtw_clusters(rows: DataFrame, group: str, eps: float, min_samples: int, band: int | None = None) -> DataFrame:
    """DBSCAN on warped distances within each group; clusters count from 0 by their least core id, noise is -1."""

    def close(p, q):
        (x, kx), (y, ky) = _distinct(p["v"]), _distinct(q["v"])
        same = band is None and len(x) == len(y) and all(np.array_equal(s, t) for s, t in zip(x, y, strict=True))
        near = _warped(x, y, np.tri(len(x), dtype=bool).T if same else np.ones((len(x), len(y)), bool), band, eps) <= eps
        return (near | near.T if same else near)[np.ix_(kx, ky)]

    key, size = _series_blocks(rows, 1024)
    found = dbscan_blocks(rows.select("id", group, "v"), group, min_samples, close, size, key).join(rows.select("id", group), "id")
    names = found.where("cluster is not null").select(group, "cluster").distinct().withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("cluster")) - 1)
    return found.join(names, [group, "cluster"], "left").select(group, "id", F.coalesce("k", F.lit(-1)).cast("long").alias("cluster"))


def change_points(rows: DataFrame, key: str, order: str, value: str, penalty: float) -> DataFrame:
    """(key, segment, start, stop) of the optimal partition of each key's ordered series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        c = kernels.change_points(pdf[value].to_numpy(float), penalty)
        return pd.DataFrame({key: pdf[key].iloc[0], "segment": np.arange(len(c) - 1), "start": c[:-1], "stop": c[1:]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, segment long, start long, stop long")


def hmm_fit(sequences: DataFrame, states: int, symbols: int, rounds: int = 10, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """M6: Baum-Welch over sequences(v array<int>): E-steps in tasks, summed by Spark; the model is the driver's. A sequence under 2 is an error."""
    if sequences.where(F.size("v") < 2).limit(1).count():
        raise ValueError("sequence of under two symbols")
    rng = np.random.default_rng(seed)
    unit = lambda x: x / x.sum(-1, keepdims=True)
    model = [unit(np.ones(states)), unit(rng.random((states, states)) + 1), unit(rng.random((states, symbols)) + 1)]
    like = -np.inf
    for _ in range(rounds):
        shared = sequences.sparkSession.sparkContext.broadcast(model)

        def step(batches, shared=shared):
            total = None
            for pdf in batches:
                for s in pdf["v"]:
                    got = kernels.baum_welch_counts(np.asarray(s), *shared.value)
                    total = [np.array(x, float) for x in got] if total is None else [x + y for x, y in zip(total, got, strict=True)]
            if total is not None:
                yield pd.DataFrame({"k": np.arange(4), "x": [np.ravel(x).tolist() for x in total]})

        sums = sequences.select("v").mapInPandas(step, "k int, x array<double>").select("k", F.posexplode("x").alias("i", "y")).groupBy("k", "i").agg(F.sum("y").alias("y")).orderBy("k", "i").toPandas()
        s, t, e, new = (sums[sums.k == k].y.to_numpy() for k in range(4))
        model = [unit(s + 1e-9), unit(t.reshape(states, states) + 1e-9), unit(e.reshape(states, symbols) + 1e-9)]
        if new[0] - like < 1e-6:
            break
        like = float(new[0])
    return (*model, like)


def hmm_decode(sequences: DataFrame, model: tuple) -> DataFrame:
    """M7: (id, states, log_prob) of each sequence."""

    @F.pandas_udf("states array<int>, log_prob double")
    def decode(v: pd.Series) -> pd.DataFrame:
        got = [kernels.viterbi(np.asarray(x), *model[:3]) for x in v]
        return pd.DataFrame({"states": [p for p, _ in got], "log_prob": [q for _, q in got]})

    return sequences.withColumn("d", decode("v")).select("id", "d.states", r6("d.log_prob").alias("log_prob"))


def metric_weights(rows: DataFrame, label: str, rounds: int = 5, rate: float = 0.1, margin: float = 1.0, batch: int = 1000) -> tuple[np.ndarray, list[float]]:
    """M20 over rows(id, v, label): weights of a weighted L1 metric from semi-hard triplets; (weights, losses).

    Each row is an anchor among the rows of its mini-batch. Mini-batches of about ``batch`` rows are dealt by a hash of the
    row, so that the result doesn't depend on partitions; one that gets over four times as many rows (copies) is an error.
    """
    dims = len(rows.first()["v"])
    w, losses = np.ones(dims), []
    dealt = cut(rows.select("id", "v", label).withColumn("_b", F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-rows.count() // batch))))))
    for r in range(rounds):
        def step(pdf, *, w=w):
            if len(pdf) > 4 * batch:
                raise ValueError(f"{len(pdf)} rows in a mini-batch of {batch}")
            pdf = pdf.sort_values("id")
            x, y = np.stack(pdf["v"].to_numpy()), pdf[label].to_numpy()
            grad, loss, n = np.zeros(dims), 0.0, 0
            for i in range(len(x)):
                same, other = np.flatnonzero((y == y[i]) & (np.arange(len(x)) != i)), np.flatnonzero(y != y[i])
                if not len(same) or not len(other):
                    continue
                dp, dn = np.abs(x[same] - x[i]), np.abs(x[other] - x[i])
                p = dp[np.argmin(dp @ w)]
                far = dn @ w
                hard = dn[(far > p @ w) & (far < p @ w + margin)]
                if len(hard):
                    q = hard[np.argmin(hard @ w)]
                    loss, n, grad = loss + margin + p @ w - q @ w, n + 1, grad + p - q
            return pd.DataFrame({"b": [pdf["_b"].iloc[0]], "g": [grad.tolist()], "loss": [loss], "n": [n]})

        got = dealt.groupBy("_b").applyInPandas(step, "b long, g array<double>, loss double, n long").toPandas().sort_values("b")
        n = max(1, got.n.sum())
        losses.append(float(got.loss.sum() / n))
        if r and losses[-1] >= losses[-2] - 1e-9:
            break
        w = np.maximum(w - rate * np.sum(np.stack(got.g.to_numpy()), axis=0) / n, 0)
    return w, losses


def mahalanobis_models(rows: DataFrame, key: str, ridge: float = 1e-3, least: int = 3) -> DataFrame:
    """Per key mean and inverse of covariance (ddof 1) plus ridge; keys of too few rows are not fitted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame({key: [], "mean": [], "inverse": []})
        x = np.stack(pdf["v"].to_numpy())
        inv = np.linalg.inv(np.cov(x, rowvar=False, ddof=1) + ridge * np.eye(x.shape[1]))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [x.mean(0).tolist()], "inverse": [inv.tolist()]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "v").groupBy(key).applyInPandas(run, f"`{key}` {kind}, mean array<double>, inverse array<array<double>>")

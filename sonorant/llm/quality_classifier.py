"""Quality classifier with hierarchical empirical Bayes (operator 1).

Evidence of a document: a logistic regression on a few surface features of its whole text (shares of symbols, capitals,
digits, distinct words, repeated trigrams, mean word length, length), fitted on a bounded labelled sample in two folds by
crc32 of the id; the other fold's model scores a document, so no document meets evidence that it trained. Sites repeat
their quality, so the evidence is combined with where the document comes from: the host (``source``) and, inside it, the
path (``lang``, the finest address that documents carry; for pages host and path of the url fit the same arguments).

Sums, sums of squares and counts of the evidence are grouped aggregates over all documents by path and host. The
variance of the evidence inside a path, of paths inside a host and of hosts comes from the moments of the nested groups.
A host's posterior mean shrinks towards the global mean by the variances of its sum and of the hosts; a path's posterior
shrinks towards its host's in the same way, so sparse sites stay near their parents. A document's own evidence is taken
out of its path's and its host's sums before it meets them. The score joins the document's log-odds with its path's
posterior log-odds over the global one. Sites that hold a good part of all rows are few and are broadcast to the rows;
the others are joined by site, so no task gets a hot site.

Edge cases: null and empty texts have all-zero features; null host or path is a site of its own; null ids aren't
labelled; repeated rows each get a row and count each; without labels of both kinds in a fold the evidence of the other
fold's documents is one half; an empty table gives no rows. Columns other than doc_id, text, host and path are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import _SYMBOL, repeated_words
from .shared import crc_mod, label_of, labelled_ids, materialize, scan
from .toxicity import logistic
from .wordvec import Words, per_doc, utf8

MAX_LABELLED = 200_000
#: Weight of the site's log-odds against the document's (1: the site's prior takes the place of the global one); documents are kept from this probability on.
SITE_WEIGHT, KEEP = 1.0, 0.5
#: Sites with this share of all rows or more, at most its inverse of them, are broadcast.
HOT = 1e-4
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[[ord(c) for c in "!?|"]] = True


def surface(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text of a slice (texts x features), all bounded."""
    w = Words(raw, offsets)
    h = w.hash
    n_docs = len(offsets) - 1
    n = np.diff(w.first)
    many = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / size

    order = np.lexsort((h, w.doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][new], minlength=n_docs) / many
    width = per_doc(w.end - w.start, w.first) / many
    repeat = repeated_words(w.doc, h, n_docs) / many
    columns = [10 * share(_SYMBOL), share(_UPPER), 10 * share(_POINT), 5 * share(_DIGIT), distinct, repeat, np.minimum(width, 20) / 10, np.log1p(n) / 10, n < 50, np.ones(n_docs)]
    return np.stack(columns, axis=1).astype(float)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Coefficients of the document classifier for each fold (crc32 of the id modulo 2), fitted on the other fold's documents."""
    ids, y = labelled_ids(labels, "quality", max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast((ids, y))

    def make():
        def each(b: pa.RecordBatch):
            label = label_of(b.column(0), *shared.value)
            if not (label >= 0).any():
                return None
            b, label = b.filter(pa.array(label >= 0)), label[label >= 0]
            x = surface(*utf8(b.column(1)))
            return [b.column(0), label, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))]

        return each, None

    # Of repeated rows one counts, and the order is that of the ids, so that reruns agree.
    got = scan(docs.select("doc_id", "text"), "text", "doc_id long, y long, x array<double>", make).groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("s"))
    got = got.select(crc_mod(F.col("doc_id"), 2).cast("int").alias("fold"), "doc_id", "s.y", "s.x").orderBy("doc_id").toArrow()
    y, fold, betas = got["y"].to_numpy().astype(float), got["fold"].to_numpy(), np.zeros((2, 10))
    for k in (0, 1):
        use = fold != k
        if use.any() and y[use].min() < y[use].max():
            betas[k] = logistic(np.stack(got["x"].to_numpy()[use]), y[use])
    return betas


def exact(c: Column) -> Column:
    """A sum whose result doesn't depend on the order."""
    return F.sum(F.round(c, 9).cast("decimal(38,9)"))


@dataclass(frozen=True)
class Levels:
    """Global mean; variance of the evidence inside paths, of paths' means inside hosts, and of hosts' means."""

    mean: float
    within: float
    path: float
    host: float


def by_host(paths: DataFrame) -> DataFrame:
    """(host, host_n, host_u, host_nn): rows, sum of the evidence in millionths, sum of the paths' squared rows."""
    square = F.col("n").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")
    return paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("u").alias("host_u"), F.sum(square).cast("double").alias("host_nn"))


def levels(paths: DataFrame) -> Levels:
    """The moments of nested groups of unequal sizes over paths(host, path, n, u, q), u and q sums of evidence and its square in millionths."""
    hosts = by_host(paths)
    parent = hosts.withColumnRenamed("host", "h")
    m, of_host = F.col("u") / F.col("n") / 1e6, F.col("host_u") / F.col("host_n") / 1e6
    row = paths.join(parent, F.col("host").eqNullSafe(F.col("h"))).agg(
        F.sum("n").alias("n"), F.sum("u").alias("u"), F.count("*").alias("paths"),
        exact(F.greatest(F.lit(0.0), F.col("q") / 1e6 - F.col("n") * m * m)).alias("within"),
        exact(F.col("n") * (m - of_host) ** 2).alias("path"), exact(F.col("n") * F.col("n") / F.col("host_n")).alias("share"),
    ).first()
    if not row["n"]:
        return Levels(0.5, 0.0, 0.0, 0.0)
    n, mean = row["n"], row["u"] / row["n"] / 1e6
    top = hosts.agg(F.count("*").alias("hosts"), exact(F.col("host_n") * (of_host - F.lit(mean)) ** 2).alias("host"), F.sum(F.col("host_nn").cast("decimal(38,0)")).alias("nn"), exact(F.col("host_n") * F.col("host_n") / F.lit(float(n))).alias("share")).first()
    share, within = float(row["share"]), float(row["within"]) / max(1, n - row["paths"])
    path = max(0.0, float(row["path"]) - (row["paths"] - top["hosts"]) * within) / max(1e-9, n - share)
    noise = (top["hosts"] - 1) * within + path * (share - float(top["nn"]) / n)
    host = max(0.0, float(top["host"]) - noise) / max(1e-9, n - float(top["share"]))
    return Levels(mean, within, path if n > share else 0.0, host if top["hosts"] > 1 else 0.0)


def with_sites(own: DataFrame, weight: float = SITE_WEIGHT, keep: float = KEEP, hot: float = HOT) -> DataFrame:
    """(doc_id, evidence, host_mean, path_mean, score, predicted, kept) of own(doc_id, host, path, evidence), which is read several times."""
    # Sums of millionths are exact, so that reruns agree whatever the order.
    e = F.col("evidence")
    paths = own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(e * 1_000_000).cast("long")).alias("u"), F.sum(F.round(e * e * 1_000_000).cast("long")).alias("q"))
    paths = materialize(paths, "paths")
    v = levels(paths)
    sites = paths.join(by_host(paths).withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "u", "host_n", "host_u", "host_nn")
    sites = materialize(sites, "sites")
    here = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
    many = F.col("n") >= hot * F.lit(float(sites.agg(F.sum("n")).first()[0] or 0))
    met = own.join(F.broadcast(sites.where(many)), here).unionByName(own.join(sites.where(~many), here))

    rest = F.col("host_n") - 1
    noise = F.lit(v.within) / F.col("host_n") + F.lit(v.path) * F.col("host_nn") / F.col("host_n") / F.col("host_n")
    trust = F.when((rest > 0) & F.lit(v.host > 0), F.lit(v.host) / (F.lit(v.host) + noise)).otherwise(0.0)
    mean = F.lit(v.mean)
    met = met.withColumn("host_mean", mean + trust * (F.coalesce(F.try_divide(F.col("host_u") / 1e6 - e, rest), mean) - mean))
    path_mean = F.try_divide((F.col("u") / 1e6 - e) * v.path + F.lit(v.within) * F.col("host_mean"), (F.col("n") - 1) * v.path + F.lit(v.within))
    met = met.withColumn("path_mean", F.coalesce(path_mean, F.col("host_mean")))

    def odds(c):
        c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(c / (1 - c))

    score = 1 / (1 + F.exp(-(odds(e) + F.lit(weight) * (odds(F.col("path_mean")) - odds(mean)))))
    out = met.withColumn("score", score).select("doc_id", "evidence", "host_mean", "path_mean", "score")
    return out.withColumn("predicted", (F.col("score") >= keep).cast("int")).withColumn("kept", F.col("score") >= keep)


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = MAX_LABELLED, weight: float = SITE_WEIGHT, keep: float = KEEP) -> DataFrame:
    """(doc_id, evidence, host_mean, path_mean, score, predicted, kept) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    shared = rows.sparkSession.sparkContext.broadcast(train(rows, labels, max_labelled))
    rows = rows.withColumn("fold", crc_mod(F.col("doc_id"), 2).cast("int"))

    def make():
        betas = shared.value

        def each(b: pa.RecordBatch):
            x = np.sum(surface(*utf8(b.column(1))) * betas[b.column(4).to_numpy()], axis=1)
            return [b.column(0), b.column(2), b.column(3), 1 / (1 + np.exp(-np.clip(x, -20, 20)))]

        return each, None

    own = materialize(scan(rows, "text", "doc_id long, host string, path string, evidence double", make), "evidence")
    return with_sites(own, weight, keep)


__all__ = ["by_host", "levels", "quality_scores", "surface", "train", "with_sites"]

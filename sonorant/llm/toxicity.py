"""Toxicity by maximum-scoring segments (operator 2).

Learning: over labelled training documents, each word (A-Z in lower case, punctuation at its ends cut off) and each of
its short prefixes is counted by the number of toxic and of other documents that hold it. Its log-odds under a Dirichlet
prior drawn from all training documents has a standard error; its score is the log-odds moved towards zero by ``z`` of
these, so a word of which little is known scores zero and every other word of a text, toxic or not, carries its log-odds.
A token's score is the best of its word's and prefixes' scores plus a drift, chosen so that a token of clean text scores
-``margin`` on average. Documents are counted, not times, so a word's k-th time in a text carries 1 / k^2 of its score.

Scoring: a linear-time scan finds every maximal-scoring segment of a text (Ruzzo and Tompa). The best segments of
non-toxic training texts follow an extreme-value law, P(S < x) = exp(-K n exp(-lambda x)) for n words (Karlin and
Altschul); K and lambda are fitted by maximum likelihood, and a segment's significance follows. A text joins its segments
by their sum statistic: the least p-value of its best r segments over r. Its score is a logistic curve of that evidence.

Of near copies one trains. Both fits use scores out of the other half of the training documents (two folds by a hash of the id), as a text's own
words would flatter it; the final word scores use all of them. The labelled sample is bounded by ``max_labelled`` rows
(of least id hash); everything else covers all rows. Labels, lang, source and doc_id are no inputs of a score.

Edge cases: null and empty texts have no segment and get the lowest score; null ids aren't labelled; ids labelled both
ways count as toxic; a labelled id on several rows trains once, with its least text; repeated rows each get a row;
without labels of both kinds every score is 0; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, crc_mod, label_of, labelled_ids, materialize, scan
from .wordvec import Words, mix64, utf8

MAX_LABELLED = 400_000
#: Standard errors that a word's log-odds moves towards zero, documents that must hold it, weight of the prior in documents.
Z, LEAST, PRIOR = 3.0, 3, 50.0
#: Mean score of a token of clean text, negated.
MARGIN = 0.5
#: Segments of a text that the sum statistic joins at most.
JOINED = 8
#: Bytes of a word's prefixes that are evidence beside the word, so that endings don't hide a stem.
PREFIXES = (4, 5, 6)
#: Segments below this significance (1 - p) aren't reported.
SIGNIFICANT = 0.95
PREDICT = 0.3
SPLIT = (4, 2)

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_-#$%&|"]] = True

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, evidence double, segments array<struct<start:int,stop:int,score:double,significance:double>>"


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case without punctuation at their ends (a word of punctuation alone stays as it is)."""
    w = Words(raw, offsets, lower=True)
    full = w.end.copy()
    for _ in range(4):
        cut = _EDGE[w.raw[w.end - 1]] & (w.end - 1 > w.start)
        if not cut.any():
            break
        w.end = w.end - cut
    for _ in range(4):
        cut = _EDGE[w.raw[w.start]] & (w.start + 1 < w.end)
        if not cut.any():
            break
        w.start = w.start + cut
    w.full = full
    return w


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of each kind of evidence: the word itself, then its prefixes of PREFIXES bytes."""
    out = [(np.arange(len(w)), w.hash)]
    end = w.end
    for k in PREFIXES:
        longer = np.flatnonzero(end - w.start > k)
        w.end = np.minimum(end, w.start + k)
        out.append((longer, mix64(w.hash[longer] + np.uint64(k))))
        w.end = end
    return out


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with one row, of least text, of every id that stands on several rows."""
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    again = materialize(again, "repeated-ids")
    texts = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").select("doc_id", "text").unionByName(texts)


def one_of_copies(docs: DataFrame, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, y) without all but the first document of each label whose texts agree in a MinHash of their word triples.

    A family of near copies would otherwise make evidence of each of its words.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ids, y))

    def make():
        def each(b: pa.RecordBatch):
            label = label_of(b.column(0), *shared.value)
            if not (label >= 0).any():
                return None
            b, label = b.filter(pa.array(label >= 0)), label[label >= 0]
            w = tokens(*utf8(b.column(1)))
            h = np.concatenate([w.hash, np.zeros(2, np.uint64)])
            with np.errstate(over="ignore"):
                h = mix64(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:])
            inside = np.ones(len(w), dtype=bool)  # the last two words of a text start no triple, unless it has no other
            ends, size = w.first[1:], np.diff(w.first)
            for k in (1, 2):
                inside[ends[size > 2] - k] = False
            at = np.flatnonzero(inside)
            cut = np.searchsorted(at, w.first[:-1])
            some = size > 0
            sketch = np.zeros(b.num_rows, dtype=np.uint64)
            if some.any():
                sketch[some] = np.minimum.reduceat(h[at], cut[some])
            return [b.column(0), label, sketch.view(np.int64)]

        return each, None

    got = scan(docs.select("doc_id", "text"), "text", "doc_id long, y long, sketch long", make)
    got = got.groupBy("sketch", "y").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").toArrow()
    return got["doc_id"].to_numpy(), got["y"].to_numpy()


def _fold() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")


def document_counts(docs: DataFrame, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    """(feature, toxic0, toxic1, clean0, clean1): training documents of each label and fold that hold a word or prefix."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, y))

    def make():
        def each(b: pa.RecordBatch):
            label = label_of(b.column(0), *shared.value)
            if not (label >= 0).any():
                return None
            b, label = b.filter(pa.array(label >= 0)), label[label >= 0]
            kind = b.column(2).to_numpy() + 2 * (1 - label)
            w = tokens(*utf8(b.column(1)))
            found = features(w)
            h, of = np.concatenate([x for _, x in found]), np.concatenate([w.doc[at] for at, _ in found])
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            h, of = h[new], of[new]
            u, at = np.unique(h, return_inverse=True)
            return [u.view(np.int64), *(np.bincount(at[kind[of] == k], minlength=len(u)) for k in range(4))]

        return each, None

    got = scan(docs.select("doc_id", "text", _fold()), "text", "feature long, toxic0 long, toxic1 long, clean0 long, clean1 long", make)
    return got.groupBy("feature").agg(*[F.sum(c).alias(c) for c in got.columns[1:]])


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int, z: float = Z, least: int = LEAST, prior: float = PRIOR) -> Column:
    """Dirichlet log-odds of a feature from its document counts, moved towards zero by z standard errors; 0 below least."""
    alpha = (toxic + clean) / F.lit(float(max(1, n_toxic + n_clean))) * F.lit(prior) + F.lit(0.01)

    def odds(c: Column, n: int) -> Column:
        return F.log((c + alpha) / (F.lit(float(n) + prior + 1.0) - c - alpha * F.lit(0.5)))

    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    error = F.sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))
    return F.when(toxic + clean >= least, F.signum(delta) * F.greatest(F.abs(delta) - F.lit(z) * error, F.lit(0.0))).otherwise(0.0)


def evidence(counts: DataFrame, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature hashes, scores: features x (from all documents, for fold 0, for fold 1)) where any isn't 0.

    What is collected is bounded by the labelled sample: each such feature stands in ``least`` or more of its texts.
    """

    def score(*folds: int) -> Column:
        toxic, clean = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in ("toxic", "clean"))
        return log_odds(toxic, clean, sum(sizes[f"toxic{k}"] for k in folds), sum(sizes[f"clean{k}"] for k in folds))

    scored = counts.select("feature", score(0, 1).alias("w"), score(1).alias("w0"), score(0).alias("w1"))  # a fold's come from the other
    got = scored.where("w <> 0 or w0 <> 0 or w1 <> 0").toArrow()
    h = got["feature"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.stack([got[c].to_numpy()[order] for c in ("w", "w0", "w1")], axis=1) if len(h) else np.zeros((0, 3))


def maximal_segments(at: list[int], weight: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, stop, score) of a sequence that is drift everywhere but weight[i] at at[i].

    Ruzzo and Tompa's linear-time algorithm; the drift between two such places is added in one step.
    """
    out: list[list[float]] = []  # left sum, right sum, start, stop
    total, before = 0.0, 0
    for i, x in zip(at, weight, strict=True):
        total += drift * (i - before)
        before = i + 1
        if x <= 0:
            total += x
            continue
        now = [total, total + x, i, i + 1]
        total += x
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= now[0]:
                j -= 1
            if j < 0 or out[j][1] >= now[1]:
                out.append(now)
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
    return [(int(s), int(e), r - left) for left, r, s, e in out]


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(lambda, ln K) of P(S < x) = exp(-K n exp(-lambda x)) by maximum likelihood; texts without a segment are S <= 0.

    For each lambda the best K has a closed form. With too few segments to tell, lambda is 1.
    """
    n = np.maximum(n, 1).astype(float)
    if not len(best):
        return 1.0, 0.0

    def fit(lam: float) -> tuple[float, float]:
        found = best > 0
        log_k = math.log(max(1, found.sum()) / (n * np.exp(-lam * best)).sum())
        rate = math.exp(log_k) * n * np.exp(-lam * best)
        return float((math.log(lam) + log_k + np.log(n) - lam * best)[found].sum() - rate.sum()), log_k

    lam = max(np.geomspace(0.2, 5.0, 80).tolist(), key=lambda x: fit(x)[0]) if (best > 0).sum() >= 20 else 1.0
    return float(lam), fit(lam)[1]


def sum_evidence(x: list[float], joined: int = JOINED) -> float:
    """-ln p of a text from the normalised scores lambda S - ln(K n) of its segments, best first.

    The best r of them are joined by Karlin and Altschul's sum statistic, P = exp(-t) t^(r-1) / (r! (r-1)!), each r
    weighing half as much as the one before; of all r the one that says most counts. Beyond the first, only segments
    above chance level join.
    """
    best, total = (x[0] if x else 0.0), 0.0
    for r, y in enumerate(x[:joined], 1):
        if y <= 0:
            break
        total += y
        if r > 1 and total > r:
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
    return best


class Model:
    """Scores of words and prefixes, drift, extreme-value parameters and the logistic curve from evidence to probability."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, drift: float = -MARGIN):
        self.words, self.weights, self.drift = words, weights, drift
        self.lam, self.log_k, self.slope, self.base = 1.0, 0.0, 0.0, -50.0

    def scored(self, w: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, scores without drift) of a slice's tokens that don't score 0; weights: one per feature."""
        best = np.zeros(len(w))
        own = None
        for number, h in features(w):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            value = np.where(self.words[at] == h, weights[at], 0.0)
            if own is None:
                own = value
            np.maximum.at(best, number, value)
        best = np.where(best > 0, best, own)  # no feature speaks for toxicity: the word's own score
        at = np.flatnonzero(best)
        h = w.hash[at]
        order = np.lexsort((at, h, w.doc[at]))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[at][order][1:] != w.doc[at][order][:-1])
        first = np.flatnonzero(new)
        times = np.empty(len(at))
        times[order] = np.arange(1, len(at) + 1) - np.repeat(first, np.diff(np.append(first, len(at))))
        return at, best[at] / times**2

    def segments(self, w: Words, weights: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """The maximal segments of every text of a slice, in text order."""
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(w.first) - 1)]
        if not len(self.words) or not len(w):
            return out
        hit, weight = self.scored(w, weights)
        if not len(hit):
            return out
        of, place, weight = w.doc[hit], hit - w.first[w.doc[hit]], weight + self.drift
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for s, e in zip(cuts, [*cuts[1:], len(of)], strict=True):
            if weight[s:e].max() > 0:
                out[of[s]] = maximal_segments(place[s:e].tolist(), weight[s:e].tolist(), self.drift)
        return out

    def normalised(self, score: float, n: int) -> float:
        """lambda S - ln(K n)."""
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def evidence(self, scores: list[float], n: int) -> float:
        """-ln p of a text of n words whose segments have these scores; without any, that of score zero."""
        return sum_evidence([self.normalised(x, n) for x in sorted(scores, reverse=True)[:JOINED]] or [self.normalised(0.0, n)])

    def significance(self, score: float, n: int) -> float:
        """Probability that chance text of n words holds no segment of this score."""
        return math.exp(-math.exp(min(50.0, -self.normalised(score, n))))

    def fit(self, scores: list[list[float]], n: np.ndarray, toxic: np.ndarray) -> None:
        """Extreme-value parameters from the clean texts, then the logistic curve from all."""
        best = np.array([max(x, default=0.0) for x in scores])
        self.lam, self.log_k = extreme_value(best[toxic == 0], n[toxic == 0])
        x = np.array([self.evidence(s, int(m)) for s, m in zip(scores, n, strict=True)])
        self.slope, self.base = logistic(np.stack([x, np.ones_like(x)], axis=1), toxic.astype(float))
        if self.slope <= 0:  # too few texts for the halves to show evidence: -ln p as it is, with the prior odds
            self.slope, self.base = 1.0, math.log((toxic.sum() + 1) / ((toxic == 0).sum() + 1))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.base, -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic regression, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, split: tuple[int, int] = SPLIT, margin: float = MARGIN) -> Model:
    """A model from the labelled documents that aren't held out."""
    sc = docs.sparkSession.sparkContext
    ids, y = labelled_ids(labels, "toxic", max_labelled, crc_mod(F.col("doc_id"), split[0]) != split[1])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    docs = one_row_each(docs.select("doc_id", "text"))
    ids, y = one_of_copies(docs, ids, y)
    shared = sc.broadcast((ids, y))

    def sizes() -> dict[str, int]:
        frame = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids), "y": pa.array(y)}))
        got = {(r.y, r.fold): r["count"] for r in frame.join(docs, "doc_id", "left_semi").groupBy("y", _fold()).count().collect()}
        return {f"{c}{k}": got.get((v, k), 0) for c, v in (("toxic", 1), ("clean", 0)) for k in (0, 1)}

    words, weights = evidence(document_counts(docs, ids, y), sizes())
    if not len(words):
        return Model(words, weights[:, 0])
    model = sc.broadcast(Model(words, weights, 0.0))

    def by_fold(rows: DataFrame, schema: str, say) -> pa.Table:
        """say(model, words, weights of the fold, labels) per slice and fold of the labelled rows."""

        def make():
            def each(b: pa.RecordBatch):
                label = label_of(b.column(0), *shared.value)
                out = []
                for k in (0, 1):
                    mine = (label >= 0) & (b.column(2).to_numpy() == k)
                    if mine.any():
                        w = tokens(*utf8(b.column(1).filter(pa.array(mine))))
                        out.append(say(model.value, w, model.value.weights[:, 1 + k], label[mine]))
                return [pa.concat_arrays(x) for x in zip(*out, strict=True)] if out else None

            return each, None

        return scan(rows.select("doc_id", "text", _fold()), "text", schema, make)

    def mean(m: Model, w: Words, weights: np.ndarray, label: np.ndarray) -> list[pa.Array]:
        hit, score = m.scored(w, weights)
        clean = label == 0
        return [pa.array([int(np.diff(w.first)[clean].sum())]), pa.array([int(np.round(score[clean[w.doc[hit]]] * 1e6).sum())])]

    total = by_fold(docs, "n long, micro long", mean).agg(F.sum("n").alias("n"), F.sum("micro").alias("micro")).first()
    drift = -margin - (total["micro"] or 0) / 1e6 / max(1, total["n"] or 0)
    model = sc.broadcast(Model(words, weights, drift))

    def tops(m: Model, w: Words, weights: np.ndarray, label: np.ndarray) -> list[pa.Array]:
        best = [sorted((x for _, _, x in s), reverse=True)[:JOINED] for s in m.segments(w, weights)]
        return [pa.array(np.diff(w.first)), pa.array(label), pa.array(best, pa.list_(pa.float64()))]

    got = by_fold(docs, "n long, toxic long, best array<double>", tops).toArrow()
    n, toxic, best = got["n"].to_numpy(), got["toxic"].to_numpy(), got["best"].to_pylist()
    order = sorted(range(len(n)), key=lambda i: (best[i], n[i], toxic[i]))  # so that reruns agree to the last bit
    used = weights[:, 0] != 0
    out = Model(words[used], weights[used, 0], drift)
    out.fit([best[i] for i in order], n[order], toxic[order])
    return out


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, split: tuple[int, int] = SPLIT) -> DataFrame:
    """Columns of SCHEMA for every row; segments are the significant toxic passages as word positions [start, stop)."""
    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = rows.sparkSession.sparkContext.broadcast(train(rows, labels, max_labelled, split))
    rows = rows.select("doc_id", (crc_mod(F.col("doc_id"), split[0]) == split[1]).alias("held_out"), "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())]))

    def make():
        model = shared.value

        def each(b: pa.RecordBatch):
            w = tokens(*utf8(b.column(2)))
            n = np.diff(w.first)
            found = model.segments(w, model.weights)
            evidence = np.array([model.evidence([x for _, _, x in s], int(m)) for s, m in zip(found, n, strict=True)])
            some = np.array([bool(s) for s in found])
            score = model.probability(evidence)
            score = np.where(some, score, np.minimum(score, 0.01))
            said = [[(s, e, x, p) for s, e, x in f if (p := model.significance(x, int(m))) >= SIGNIFICANT] for f, m in zip(found, n, strict=True)]
            rows = [[dict(zip(("start", "stop", "score", "significance"), x, strict=True)) for x in f] for f in said]
            return [b.column(0), b.column(1), score, (score >= PREDICT).astype(np.int32), np.where(some, evidence, 0.0), pa.array(rows, kind)]

        return each, None

    return scan(rows, "text", SCHEMA, make)


__all__ = ["toxicity", "train", "Model", "maximal_segments", "extreme_value", "sum_evidence", "tokens", "logistic"]

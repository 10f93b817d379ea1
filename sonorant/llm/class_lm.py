"""Language-model scoring with Brown class-based n-grams (operator 10).

Tokens are a text's words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end token. Training texts are counted
whole, and every word of theirs gets a class, in two steps:

* Exchange clustering of the most frequent words, of word endings (what all other words fall into by their last bytes)
  and of the end token: each moves to the class that raises the class bigram likelihood most, sweep after sweep.
* The exchange step of all other words, in Spark: each word's occurrences are counted by the class before them, and the
  word moves to the class that makes these contexts likeliest, against the classes fixed so far (as the distributed
  exchange algorithm does within a round). This covers the whole vocabulary and grows with the corpus.

The model is P(w | previous) = P(class(w) | history(previous)) * P(w | class(w)). history is the class of the previous
token's type (a frequent word, an ending or the end); its transitions are counted over all training tokens with the final
classes and discounted towards class unigrams; P(w | class) has one added count per known word and one for all unknown
words of a class, which is that of their ending. A text's score is the sum of log10 P over its tokens (the first follows
an end token).

Sizes: the types are a parameter, so the matrix of the clustering is bounded whatever the corpus; counts, contexts and
classes of words, which grow with it, stay in Spark. Scoring looks words up in two ways: those counted often enough to be
among the ``head`` most frequent in a broadcast table of bounded size, all others by a join with the class table. Words
are identified by a 64-bit hash. Sums over the join are of integers (1e-12 units), so that reruns agree to the last bit.

Edge cases: null and empty texts are one end token; a null doc_id counts as the text "" for the split and stays null;
repeated rows count and score each for itself; without training texts every token is unknown; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, crc_mod, materialize, scan
from .wordvec import Words, mix64, utf8

#: Types of single words, types of word endings, classes, entries of the broadcast table.
WORDS, ENDINGS, CLASSES, HEAD = 2048, 127, 64, 500_000
SWEEPS = 6
#: Keys that a task counts before it hands them on.
MOST_KEPT = 500_000
#: Modulus and remainder of the crc32 of the ids that are held out.
SPLIT = (7, 2)

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_END_HASH = int(mix64(np.array([0x5E9D0FEED], dtype=np.uint64)).view(np.int64)[0])


def _endings(w: Words, endings: int) -> np.ndarray:
    """A type number below ``endings`` from each word's last three bytes."""
    last = w.raw[w.end - 1].astype(np.uint64)
    before = np.where(w.end - 2 >= w.start, w.raw[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    third = np.where(w.end - 3 >= w.start, w.raw[np.maximum(w.end - 3, 0)], 0).astype(np.uint64)
    return (mix64(last | before << np.uint64(8) | third << np.uint64(16)) % np.uint64(endings)).astype(np.int64)


def _split(docs: DataFrame, split: tuple[int, int]) -> DataFrame:
    rows = columns_apart(docs, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), split[0]) == split[1]).alias("held_out"), "text")


def _counted(rows: DataFrame, keys: list[str], make) -> DataFrame:
    """rows(text) -> (*keys long, c): make() gives a function words -> uint64 arrays of keys; combined per task in slices."""

    def each_task():
        key_of = make()
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def fold(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            k, c = (np.concatenate(x) for x in zip(*pieces, strict=True))
            order = np.lexsort(k.T[::-1])
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])) if len(k) else np.zeros(0, np.int64)
            return k[first], np.add.reduceat(c, first) if len(first) else c

        def out(k: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
            return [*(np.ascontiguousarray(k[:, i]).view(np.int64) for i in range(k.shape[1])), c]

        def each(b: pa.RecordBatch):
            k = np.stack(key_of(Words(*utf8(b.column(0)), lower=True)), axis=1)
            kept.append(fold([(k, np.ones(len(k), dtype=np.int64))]))
            if sum(len(x[0]) for x in kept) > MOST_KEPT:
                k, c = fold(kept)
                kept[:] = [(k, c)] if 2 * len(k) < MOST_KEPT else []
                if not kept:
                    return out(k, c)
            return None

        def last():
            return out(*fold(kept)) if kept else None

        return each, last

    got = scan(rows.select("text"), "text", ", ".join(f"{k} long" for k in keys) + ", c long", each_task)
    return got.groupBy(*keys).agg(F.sum("c").alias("c"))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over train(text): per task in slices first, then by Spark. End tokens are not in it."""
    return _counted(train, ["word"], lambda: lambda w: [w.hash])


class Types:
    """Type of every word: index of one of the most frequent words, else len(words) + ending; the end token is the last."""

    def __init__(self, words: np.ndarray, endings: int):
        self.order = np.argsort(words)
        self.words, self.endings = words[self.order], endings
        self.end = len(words) + endings
        self.n = self.end + 1

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = len(self.words) + ending.astype(np.int64)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out[hit] = self.order[at[hit]]
        return out

    def sequence(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(types, first) of all texts' tokens with their end tokens; first as in Words, with the ends counted."""
        n_docs = len(w.first) - 1
        out = np.full(len(h) + n_docs, self.end, dtype=np.int64)
        out[np.arange(len(h)) + w.doc] = self.of(h, _endings(w, self.endings))
        return out, w.first + np.arange(n_docs + 1)


def bigram_counts(train: DataFrame, types: Types) -> np.ndarray:
    """Counts (previous type, type) over train(text); a text's first token follows the end token."""
    shared = train.sparkSession.sparkContext.broadcast(types)

    def make():
        k = shared.value

        def cells(w: Words) -> list[np.ndarray]:
            t, _ = k.sequence(w, w.hash)
            before = np.concatenate([[k.end], t[:-1]])  # the token before a text's first is an end token
            return [(before * k.n + t).astype(np.uint64)]

        return cells

    got = _counted(train, ["cell"], make).toArrow()
    out = np.zeros(types.n * types.n, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["c"].to_numpy()
    return out.reshape(types.n, types.n)


def contexts(train: DataFrame, types: Types, of: np.ndarray) -> DataFrame:
    """(word, h, c): occurrences of every word that is no type of its own by the class h of the token before."""
    shared = train.sparkSession.sparkContext.broadcast((types, of))

    def make():
        k, of = shared.value

        def pairs(w: Words) -> list[np.ndarray]:
            h = w.hash
            t, first = k.sequence(w, h)
            before = of[np.concatenate([[k.end], t[:-1]])][np.arange(len(h)) + w.doc]
            rare = t[np.arange(len(h)) + w.doc] >= len(k.words)
            return [h[rare], before[rare].astype(np.uint64)]

        return pairs

    return _counted(train, ["word", "h"], make)


def choose_classes(counted: DataFrame, transition: np.ndarray, unigram: np.ndarray) -> DataFrame:
    """(word, cls, h, c): of each word of contexts its class and count (h null), and (word null) counts of (h, cls).

    The class that is likeliest given the word's contexts; no word joins the last class, the end token's. Ties: the lowest.
    """
    free = len(unigram) - 1
    shared = counted.sparkSession.sparkContext.broadcast((np.log(unigram[:free]), np.log(transition[:, :free]) - np.log(unigram[:free])))
    grouped = counted.groupBy("word").agg(F.array_sort(F.collect_list(F.struct(F.col("h").cast("int").alias("h"), "c"))).alias("x"))

    def run(batches):
        prior, gain = shared.value
        joint = np.zeros(gain.shape, dtype=np.int64)
        for b in batches:
            x = b.column(1)
            flat = x.flatten()
            at = np.repeat(np.arange(b.num_rows), np.asarray(pa.compute.list_value_length(x)))
            h, c = flat.field("h").to_numpy(), flat.field("c").to_numpy()
            for lo in range(0, b.num_rows, 4096):  # at most 4096 rows x classes at once
                s, e = np.searchsorted(at, [lo, lo + 4096])
                n = min(4096, b.num_rows - lo)
                dense = np.zeros((n, len(gain)))
                dense[at[s:e] - lo, h[s:e]] = c[s:e]
                cls = np.argmax(np.round(dense @ gain + prior, 6), axis=1)
                np.add.at(joint, (h[s:e], cls[at[s:e] - lo]), c[s:e])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), pa.array(cls.astype(np.int32)), pa.nulls(n, pa.int32()), pa.array(dense.sum(axis=1).astype(np.int64))], ["word", "cls", "h", "c"])
        h, cls = np.nonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(cls.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(joint[h, cls])], ["word", "cls", "h", "c"])

    return grouped.mapInArrow(run, "word long, cls int, h int, c long")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every type by the exchange algorithm. The last type, the end token, keeps a class of its own.

    Starts from frequency ranks modulo the classes; a type moves where the sum of n log n over class bigrams, less the
    same over both margins, is greatest (ties: lowest class), until a sweep moves none.
    """
    n = len(counts)
    weight = counts.sum(axis=0)
    rank = np.empty(n, dtype=np.int64)
    rank[np.lexsort((np.arange(n), -weight))] = np.arange(n)
    free = max(1, classes - 1)
    of = rank % free
    of[n - 1] = free
    k = free + 1
    c = counts.astype(float)
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    out_to, in_from = c @ member, c.T @ member  # of each type: counts to and from each class
    joint = member.T @ out_to
    for _ in range(sweeps):
        moved = 0
        for t in np.argsort(rank)[: n].tolist():
            if t == n - 1 or not (out_to[t].any() or in_from[t].any()):
                continue
            a, row, col, self_n = of[t], out_to[t].copy(), in_from[t].copy(), c[t, t]
            # Without t in its class: its row, its column, its self-transitions.
            joint[a] -= row
            joint[:, a] -= col
            joint[a, a] += self_n
            row[a] -= self_n
            col[a] -= self_n
            rows, cols = joint.sum(axis=1) + col, joint.sum(axis=0) + row  # what others send to t and get from it stays
            # Gain of adding t to each free class b.
            base_r, base_c = _xlogx(joint[:free]), _xlogx(joint[:, :free])
            gain = (_xlogx(joint[:free] + row) - base_r).sum(axis=1) + (_xlogx(joint[:, :free] + col[:, None]) - base_c).sum(axis=0)
            d = np.arange(free)
            diag = joint[d, d]
            gain -= _xlogx(diag + row[:free]) - _xlogx(diag) + _xlogx(diag + col[:free]) - _xlogx(diag)
            gain += _xlogx(diag + row[:free] + col[:free] + self_n) - _xlogx(diag)
            total_r, total_c = row.sum() + self_n, col.sum() + self_n
            gain -= _xlogx(rows[:free] + total_r) - _xlogx(rows[:free]) + _xlogx(cols[:free] + total_c) - _xlogx(cols[:free])
            b = int(np.argmax(np.round(gain, 6)))
            joint[b] += row
            joint[:, b] += col
            joint[b, b] += self_n
            if b != a:
                moved += 1
                of[t] = b
                out_to[:, a] -= c[:, t]
                out_to[:, b] += c[:, t]
                in_from[:, a] -= c[t]
                in_from[:, b] += c[t]
        if not moved:
            break
    return of


def smoothed(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(transition, unigram) of class bigram counts: absolute discounting towards the class unigram."""
    k = joint.shape[1]
    unigram = (joint.sum(axis=0) + 1) / (joint.sum() + k)
    seen, total = (joint > 0).sum(axis=1), joint.sum(axis=1)
    discounted = (np.maximum(joint - 0.5, 0) + (0.5 * seen)[:, None] * unigram) / np.maximum(total, 1)[:, None]
    return np.where(total[:, None] > 0, discounted, unigram), unigram


def class_bigrams(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Type bigram counts -> class bigram counts."""
    member = np.zeros((len(of), int(of.max()) + 1), dtype=np.int64)
    member[np.arange(len(of)), of] = 1
    return member.T @ pairs @ member


class Model:
    """log10 P(class | history class), and per class log10 of the divisor of P(word | class)."""

    def __init__(self, joint: np.ndarray, words: np.ndarray):
        self.log_class = np.log10(smoothed(joint)[0])
        self.log_divisor = np.log10(joint.sum(axis=0) + words + 1.0)


class Trained:
    """What scoring needs: types and their classes, the model, totals; tables of all words' counts and classes stay in Spark."""

    def __init__(self, train: DataFrame, words: int, endings: int, classes: int):
        counts = materialize(word_counts(train), "word-counts")
        self.n_texts = train.count()
        totals = counts.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = (totals[0] or 0) + self.n_texts, totals[1] + (1 if self.n_texts else 0)  # with the end token
        top = counts.orderBy(F.desc("c"), "word").limit(words).toArrow()
        self.types = Types(top["word"].to_numpy().view(np.uint64), endings)
        pairs = bigram_counts(train, self.types)
        self.of = exchange(pairs, classes)
        n_top = len(top)
        chosen = materialize(choose_classes(contexts(train, self.types, self.of), *smoothed(class_bigrams(pairs, self.of))), "classes")
        k = int(self.of.max()) + 1
        # Transitions: of the frequent words and the end from the type bigrams, of all others from their contexts.
        joint = np.zeros((k, k), dtype=np.int64)
        own = np.concatenate([np.arange(n_top), [self.types.end]])
        np.add.at(joint, (self.of[:, None], self.of[own][None]), pairs[:, own])
        got = chosen.where("word is null").groupBy("h", "cls").agg(F.sum("c").alias("c")).toArrow()
        np.add.at(joint, (got["h"].to_numpy(), got["cls"].to_numpy()), got["c"].to_numpy())
        distinct = np.bincount(self.of[own], minlength=k) if self.n_texts else np.zeros(k, np.int64)
        rare = chosen.where("word is not null").groupBy("cls").agg(F.count("*").alias("v")).toArrow()
        distinct[rare["cls"].to_numpy()] += rare["v"].to_numpy()
        self.model = Model(joint, distinct)
        self.top = (top["word"].to_numpy(), self.of[:n_top], top["c"].to_numpy())
        self.rare = chosen.where("word is not null").select("word", "cls", "c")

    def head(self, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(least count, words sorted, classes, counts) of at most ``most`` words, the frequent ones first of all."""
        # The least count of the broadcast table, so that it has at most ``most`` rows: ranks by count, not by row.
        sizes = self.rare.groupBy("c").agg(F.count("*").alias("v")).orderBy(F.desc("c")).limit(most).toArrow()
        cs, vs = sizes["c"].to_numpy(), sizes["v"].to_numpy()
        order = np.argsort(-cs)
        fits = np.cumsum(vs[order]) <= most
        bound = int(cs[order][fits][-1]) if fits.any() else int(cs.max(initial=0)) + 1
        got = self.rare.where(F.col("c") >= bound).toArrow()
        word, cls, c = (np.concatenate([x, got[n].to_numpy()]) for x, n in zip(self.top, ("word", "cls", "c"), strict=True))
        word = word.view(np.uint64)
        by = np.argsort(word)
        return bound, word[by], cls[by].astype(np.int64), c[by]


def score(docs: DataFrame, words: int = WORDS, endings: int = ENDINGS, classes: int = CLASSES, head: int = HEAD, split: tuple[int, int] = SPLIT) -> DataFrame:
    """Columns of SCHEMA for every row."""
    spark = docs.sparkSession
    rows = _split(docs, split)
    trained = Trained(rows.where("not held_out").select("text"), words, endings, classes)
    bound, *known = trained.head(head)
    model = trained.model
    shared = spark.sparkContext.broadcast((trained.types, trained.of, model, *known))
    log_all = float(np.log10(trained.n + trained.v + 1.0))
    log_end = float(np.log10(trained.n_texts + 1.0))
    end_known = 1 if trained.n_texts else 0

    def make():
        types, of, model, known, known_class, known_count = shared.value
        logs = np.log10(known_count + 1.0)
        state = {"row": (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40}
        end = of[types.end]

        def each(b: pa.RecordBatch):
            w = Words(*utf8(b.column(2)), lower=True)
            h = w.hash
            n_docs = b.num_rows
            t, first = types.sequence(w, h)
            before = of[np.concatenate([[types.end], t[:-1]])]
            place = np.arange(len(h)) + w.doc
            ends = first[1:] - 1
            path = model.log_class[before[ends], end] - model.log_divisor[end] + log_end
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), dtype=bool)
            cls, log = known_class[at[hit]], logs[at[hit]]
            path += np.bincount(w.doc[hit], weights=model.log_class[before[place[hit]], cls] - model.log_divisor[cls] + log, minlength=n_docs)
            head_log = np.bincount(w.doc[hit], weights=log, minlength=n_docs) + log_end
            head_known = np.bincount(w.doc[hit], minlength=n_docs) + end_known
            rid = state["row"] + np.arange(n_docs)
            state["row"] += n_docs
            # The other words, each once per text and class before it, with its number of times.
            code = np.stack([w.doc[~hit].astype(np.uint64), h[~hit], before[place[~hit]].astype(np.uint64), of[t[place[~hit]]].astype(np.uint64)], axis=1)
            code = code[np.lexsort((code[:, 2], code[:, 1], code[:, 0]))]
            start = np.flatnonzero(np.concatenate([[len(code) > 0], (code[1:, :3] != code[:-1, :3]).any(axis=1)]) if len(code) else np.zeros(0, bool))
            times = np.diff(np.append(start, len(code)))
            rare_doc, rare = code[start, 0].astype(np.int64), code[start, 1].view(np.int64)
            m = len(rare)
            # A text's own row has no word; a hash of its number spreads these rows over the join's partitions.
            none = lambda kind, n: pa.nulls(n, kind)
            return [
                pa.concat_arrays([pa.array(rid), pa.array(rid[rare_doc])]),
                pa.concat_arrays([pa.array(mix64(rid.astype(np.uint64)).view(np.int64)), pa.array(rare)]),
                pa.concat_arrays([pa.array(np.zeros(n_docs, dtype=np.int32)), pa.array(times.astype(np.int32))]),
                pa.concat_arrays([none(pa.int32(), n_docs), pa.array(code[start, 2].astype(np.int32))]),
                pa.concat_arrays([none(pa.int32(), n_docs), pa.array(code[start, 3].astype(np.int32))]),
                pa.concat_arrays([b.column(0), none(pa.int64(), m)]),
                pa.concat_arrays([b.column(1), none(pa.bool_(), m)]),
                pa.concat_arrays([pa.array(np.diff(first)), none(pa.int64(), m)]),
                pa.concat_arrays([pa.array(head_known), none(pa.int64(), m)]),
                pa.concat_arrays([pa.array(head_log), none(pa.float64(), m)]),
                pa.concat_arrays([pa.array(path), none(pa.float64(), m)]),
            ]

        return each, None

    schema = "rid long, word long, times int, h int, unknown int, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, path double"
    parts = scan(rows, "text", schema, make)
    joined = parts.join(trained.rare.where(F.col("c") < bound), "word", "left").withColumn("cls", F.coalesce("cls", "unknown"))
    # log10 P(class | history) - log10 of the class's divisor, classes x classes; bounded by the parameter.
    cells = (model.log_class - model.log_divisor[None]).ravel()
    table = F.broadcast(spark.createDataFrame([(i // len(model.log_divisor), i % len(model.log_divisor), float(x)) for i, x in enumerate(cells)], "h int, cls int, said double"))
    joined = joined.join(table, ["h", "cls"], "left")
    exact = lambda x: F.sum(F.round(x * F.lit(1e12)).cast("long") * F.col("times"))
    log = F.when(F.col("c").isNotNull(), F.log10(F.col("c") + F.lit(1.0))).otherwise(F.lit(0.0))
    out = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("head_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("head_log") + F.coalesce(exact(log), F.lit(0)) / F.lit(1e12)).alias("logs"),
        (F.max("path") + F.coalesce(exact(F.coalesce("said", F.lit(0.0)) + log), F.lit(0)) / F.lit(1e12)).alias("score"),
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(trained.n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score",
    )


__all__ = ["score", "word_counts", "bigram_counts", "contexts", "choose_classes", "exchange", "smoothed", "class_bigrams", "Types", "Model", "Trained"]

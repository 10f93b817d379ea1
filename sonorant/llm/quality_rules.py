"""Quality rules by hashed n-gram log-likelihood ratio (operator 9).

Every document's word unigrams and bigrams fall into ``buckets`` hash buckets. Two multinomials are counted over whole
tables: ``trusted`` over documents labelled quality 1 and ``raw`` over all documents. A document's verdict is its
log-likelihood ratio sum(log(p_trusted / p_raw)) divided by its number of n-grams, against a fixed threshold; no draw
is involved. Beside it stand four plain counts and the base rule on them.

Edge cases: null and empty texts have no words and fail the base rule; a null doc_id is kept as null; repeated rows
each get a row; an empty table gives no rows; without trusted documents both multinomials are equal and every ratio is
0, so that the base rule alone decides. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns_apart, label_of, scan
from .wordvec import Words, mix64, per_doc, utf8

#: Buckets of the hashed n-grams: the model's size, whatever the corpus.
BUCKETS = 1 << 16
#: A document is kept at this mean log-likelihood ratio (nats per n-gram) or more.
THRESHOLD = -0.15
#: Ids of trusted documents that are broadcast at most; beyond that all are marked by a join.
MAX_TRUSTED = 400_000
#: Pseudo-count of each bucket.
SMOOTH = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def grams(w: Words, h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every word and every pair of neighbouring words of a text."""
    with np.errstate(over="ignore"):
        pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[w.doc[:-1] == w.doc[1:]] if len(h) > 1 else h[:0]
    of = w.doc[1:][w.doc[:-1] == w.doc[1:]] if len(h) > 1 else w.doc[:0]
    mask = np.uint64(buckets - 1)
    return np.concatenate([h & mask, pair & mask]).astype(np.int64), np.concatenate([w.doc, of])


def marked(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, Callable[[pa.Array], np.ndarray]]:
    """(rows of mark and text, function of a slice's marks to whether its texts are trusted): every document labelled quality 1.

    Up to ``most`` of their ids are broadcast and the mark is the id; beyond that, a join by the id sets the mark.
    """
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y = 1")
    good = good.select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = good.limit(most + 1).toArrow()["doc_id"].to_numpy()
    if len(got) <= most:
        ids = np.sort(got)
        known = docs.sparkSession.sparkContext.broadcast((ids, np.ones(len(ids), dtype=np.int64)))
        return rows.select(F.col("doc_id").alias("mark"), "text"), lambda m: label_of(m, *known.value) == 1
    bare = rows.where("doc_id is null").select(F.lit(False).alias("mark"), "text")  # apart, as they would share a task of the join
    met = rows.where("doc_id is not null").join(good.withColumn("mark", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
    return met.select(F.coalesce("mark", F.lit(False)).alias("mark"), "text").union(bare), lambda m: m.to_numpy(zero_copy_only=False).astype(bool)


def ngram_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """Counts, 2 x buckets: of all documents, and of the trusted ones. Summed per task, then by Spark per bucket."""
    rows, trusted = marked(docs, labels, max_trusted)

    def make():
        sums = np.zeros((2, buckets), dtype=np.int64)

        def each(b: pa.RecordBatch):
            w = Words(*utf8(b.column(1)))
            at, of = grams(w, w.hash, buckets)
            sums[0] += np.bincount(at, minlength=buckets)
            sums[1] += np.bincount(at[trusted(b.column(0))[of]], minlength=buckets)

        def last():
            at = np.flatnonzero(sums[0])
            return [at.astype(np.int32), sums[0, at], sums[1, at]]

        return each, last

    got = scan(rows, "text", "bucket int, raw long, trusted long", make).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    out = np.zeros((2, buckets), dtype=np.int64)
    at = got["bucket"].to_numpy()
    out[0, at], out[1, at] = got["raw"].to_numpy(), got["trusted"].to_numpy()
    return out


def log_ratios(counts: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """log(p_trusted / p_raw) per bucket. The trusted multinomial is smoothed towards the raw one, so unseen is neutral."""
    raw = (counts[0] + smooth) / (counts[0].sum() + smooth * counts.shape[1])
    prior = smooth * counts.shape[1]
    trusted = (counts[1] + prior * raw) / (counts[1].sum() + prior)
    return np.log(trusted / raw)


def repeated_words(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text, words inside a three-word window that stands twice or more in the text."""
    n = len(h)
    if n < 3:
        return np.zeros(n_docs, dtype=np.int64)
    with np.errstate(over="ignore"):
        code = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        code = mix64(code + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    order = np.argsort(code[inside], kind="stable")
    c = code[inside][order]
    same = c[1:] == c[:-1]
    twice = np.zeros(len(c), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def repeated_lines(raw: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Per text, lines that hold a word and equal an earlier line of the text."""
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs, dtype=np.int64)
    breaks = np.flatnonzero(raw == 10)
    has = np.flatnonzero(np.diff(np.searchsorted(breaks, offsets)) > 0)
    data = raw.tobytes()
    space = b" \t\r\x0b\x0c"
    for i in has:
        seen = set()
        for line in data[offsets[i] : offsets[i + 1]].split(b"\n"):
            if line.strip(space):
                if line in seen:
                    out[i] += 1
                else:
                    seen.add(line)
    return out


def measure(raw: np.ndarray, offsets: np.ndarray, ratios: np.ndarray, threshold: float) -> list[np.ndarray]:
    """All columns of SCHEMA but doc_id, for a slice of texts."""
    n_docs = len(offsets) - 1
    w = Words(raw, offsets)
    h = w.hash
    n_words = np.diff(w.first)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    word_chars = per_doc(starts[w.end] - starts[w.start], w.first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    repeat = repeated_words(w.doc, h, n_docs)
    at, of = grams(w, h, len(ratios))
    total = np.bincount(of, weights=ratios[at], minlength=n_docs)
    score = total / np.maximum(np.bincount(of, minlength=n_docs), 1)
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    return [n_words, word_chars, n_symbols, repeated_lines(raw, offsets, w), repeat, failed, score, ~failed & (score >= threshold)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Columns of SCHEMA for every document."""
    docs = columns_apart(docs, ["doc_id", "text"])
    counts = ngram_counts(docs, labels, buckets, max_trusted)
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(counts))

    def make():
        def each(b: pa.RecordBatch):
            return [b.column(0), *measure(*utf8(b.column(1)), ratios.value, threshold)]

        return each, None

    return scan(docs.select(F.col("doc_id").cast("long"), "text"), "text", SCHEMA, make)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """The documents that the rules keep, with all their columns; the filter runs where the text is read, without a join."""
    bare = columns_apart(docs, ["doc_id", "text"])
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(bare, labels, buckets, max_trusted)))
    at = docs.columns.index("text")

    def run(batches):
        from .shared import let_go, slices

        let_go()
        for batch in batches:
            for b in slices(batch, at):
                yield b.filter(pa.array(measure(*utf8(b.column(at)), ratios.value, threshold)[-1]))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["quality_rules", "keep_documents", "ngram_counts", "log_ratios", "measure", "pc"]

"""Mixing sources to target weights by cube-method balanced sampling (operator 7).

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, in code-point order with null last, weigh
1, 2, 3, 1, 2, 3, ... and share 100 % of all sizes; a target stops at ``most`` times its source's size and the excess is
shared again by weight until none is above. Each document of a source is taken target / source_size times on average:
its whole part surely, its fractional part by balanced sampling.

A document that is a large part of its source's target (``large``) would stay fractional to the end, as no other could
make up for it; such documents are drawn first by their hash, and the others' probabilities are scaled to what is left.

Flight phase: in blocks of a source's documents, three fractional documents at a time move along the null vector of the
two constraints (document total, token total) until one reaches 0 or 1. A block leaves at most two fractional
documents and a dozen, of falling sizes, that don't fly; those of all blocks of a source fly again, level by level, until
one block is left. Landing: of all choices of its dozen the one nearest to the token total is taken. Blocks are dealt by hash, so a source with a third of all
documents is many groups; of a row that is repeated more often than a block holds, the repeats are numbered first. Draws
come from a hash of the row, so reruns agree.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null source is one source; null doc_ids take part;
repeated rows are drawn each for itself; a table without words takes nothing; an empty one gives no rows. Only doc_id,
source and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, ship

#: Times that a document may be taken.
MOST = 3
#: Documents that one flight handles.
BLOCK = 4096
#: Documents of a source that the landing decides on together, beside those that a flight leaves.
LANDING = 12
#: Sources (a row each) that are broadcast at most, so that a frequent source is no single task of a join.
BROADCAST = 100_000
#: Part of its source's target from which a document is drawn before the flight.
LARGE = 0.02


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(totals: DataFrame, most: int = MOST) -> DataFrame:
    """totals (source, source_size) -> the same with target (double)."""
    # One row per source, not per document, goes through the ordering.
    ranked = totals.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    ranked = materialize(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:  # each round fills at least one more source, in practice a few at once
        over = (F.col("source_size") == 0) | (F.lit(level) * F.col("weight") >= most * F.col("source_size"))
        row = ranked.agg(
            F.sum(F.when(over, F.lit(most) * F.col("source_size")).otherwise(0)).alias("used"),
            F.sum(F.when(~over, F.col("weight"))).alias("open"),
            F.count(F.when(over, 1)).alias("full"),
        ).first()
        if not row["open"] or row["full"] == full:
            break
        full, level = row["full"], (total - row["used"]) / row["open"]
    return ranked.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight")))


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move probabilities p through the null space of (1, size) until at most two are fractional (none may be left)."""
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    todo = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    active: list[int] = []
    at = 0
    eps = 1e-9
    while True:
        while len(active) < 3 and at < len(todo):
            active.append(todo[at])
            at += 1
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = (s[i] for i in active)
            u = [c - b, a - c, b - a]
            if u[0] == u[1] == u[2] == 0.0:
                u = [1.0, -1.0, 0.0]
        elif s[active[0]] == s[active[1]]:
            u = [1.0, -1.0]
        else:
            break
        up = down = float("inf")
        for i, x in zip(active, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if draw[active[0]] * (up + down) < down else -down
        left = []
        for i, x in zip(active, u, strict=True):
            p[i] += step * x
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1 - eps:
                p[i] = 1.0
            else:
                left.append(i)
        active = left
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the fractional probabilities (a handful) to the choice whose token total, then document total, comes nearest."""
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at):
        choices = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
        off = np.abs(choices @ size[at].astype(float) - float((p[at] * size[at]).sum()))
        few = np.abs(choices.sum(axis=1) - p[at].sum())
        p[at] = choices[np.lexsort((np.arange(len(off)), few, np.round(off, 6)))[0]]
    return p


def ladder(size: np.ndarray, steps: int = LANDING) -> np.ndarray:
    """Places of documents (sizes in falling order) whose sizes fall by about 1.7 each, so that sums of them come near any value."""
    out: list[int] = []
    for k in range(min(steps, len(size))):
        at = int(np.searchsorted(-size, -size[0] / 1.7**k))
        at = min(max(at, out[-1] + 1 if out else 0), len(size) - 1)
        out += [at] if at not in out else []
    return np.array(out, dtype=int)


def _flight(pdf: pd.DataFrame) -> pd.DataFrame:
    # Large documents fly first. A ladder of sizes stays behind for the next level and, in the last block, the landing.
    pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    draw = ((pdf["h"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / float(1 << 53)
    size, p = pdf["size"].to_numpy(), pdf["p"].to_numpy()
    last = pdf["blocks"].iloc[0] == 1
    stay = ladder(size) if last or len(p) > 4 * LANDING else np.zeros(0, dtype=int)
    fliers = np.setdiff1d(np.arange(len(p)), stay)
    p[fliers] = fly(p[fliers], size[fliers], draw[fliers])
    pdf["p"] = land(p, size) if last else p
    return pdf


def _open(p: str = "p") -> Column:
    return (F.col(p) > 0) & (F.col(p) < 1)


def draw_large(marked: DataFrame, more: list[str], most: int = MOST, large: float = LARGE, hint=F.broadcast) -> DataFrame:
    """marked with the large documents of each source decided and the others' p scaled to the tokens that are left."""
    is_large = _open() & (F.col("size") > F.lit(large) * F.col("target"))
    draw = F.shiftrightunsigned(F.xxhash64("h", F.lit("large")), 11).cast("double") / float(1 << 53)
    due = F.col("p") * F.col("size")
    marked = marked.withColumns({"large": is_large, "draw": draw})
    # Winners in the order of their draws, as long as they don't exceed what the source is due.
    total = marked.where(_open()).groupBy(F.col("source").alias("of")).agg(F.sum(due).alias("most"), F.max("large").alias("some")).where("some")
    drawn = marked.where("large").join(hint(total), F.col("source").eqNullSafe(F.col("of"))).drop("of", "some")
    w = W.partitionBy("source").orderBy("draw", "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, 0)
    wins = F.when(F.col("draw") < F.col("p"), F.col("size")).otherwise(0)
    drawn = drawn.withColumn("won", ((F.col("draw") < F.col("p")) & (F.sum(wins).over(w) <= 1.001 * F.col("most"))).cast("double")).drop("most")
    marked = materialize(marked.where("not large").withColumn("won", F.lit(0.0)).unionByName(drawn), "drawn").drop("draw")
    of = marked.where(_open()).groupBy(F.col("source").alias("of")).agg(
        F.sum(due).alias("due"), F.sum(F.col("won") * F.col("size")).alias("won_size"), F.sum(F.when(~F.col("large"), due)).alias("rest"), F.max("large").alias("some")
    ).where("some").select("of", F.least(F.greatest(F.coalesce(F.try_divide(F.round(F.col("due") - F.col("won_size"), 3), F.round("rest", 3)), F.lit(1.0)), F.lit(0.0)), F.lit(1e6)).alias("scale"))
    joined = marked.join(hint(of), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    p = F.when(F.col("large"), F.col("won")).when(_open() & F.col("scale").isNotNull(), F.least(F.col("p") * F.col("scale"), F.lit(most) - F.col("whole"))).otherwise(F.col("p"))
    joined = joined.withColumn("p", p).withColumn("over", F.floor("p").cast("long"))  # others may have to be taken once more
    return joined.withColumns({"p": F.col("p") - F.col("over"), "whole": F.col("whole") + F.col("over")}).drop("large", "won", "scale", "over")


def numbered_repeats(flying: DataFrame, block: int) -> DataFrame:
    """flying with a column nth: 0, but for rows repeated more often than ``block``, whose repeats are numbered.

    Equal rows are folded before the shuffle and unfolded again, so that none is one task's group.
    """
    often = flying.groupBy("h").count().where(F.col("count") > block).select("h")
    if often.isEmpty():
        return flying.withColumn("nth", F.lit(0))
    often = materialize(often, "often")
    folded = flying.join(often, "h", "left_semi").groupBy(*flying.columns).agg(F.count("*").alias("times"))
    unfolded = folded.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
    return flying.join(often, "h", "left_anti").withColumn("nth", F.lit(0)).unionByName(unfolded)


def copies(rows: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """rows (doc_id, source, size, more columns) -> the same with source_size, target and n_copies (long).

    ``more columns`` must not clash with those added; callers in this module choose them.
    """
    ship(rows.sparkSession)
    more = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    rows = materialize(rows, "sizes")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most).select("source", "source_size", "target")
    by_source = materialize(by_source, "targets")
    hint = F.broadcast if by_source.count() <= BROADCAST else lambda df: df
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    marked = (
        rows.join(hint(by_source.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("whole", F.least(F.floor("rate"), F.lit(most)).cast("long"))
        .withColumn("p", F.when((F.col("size") > 0) & (F.col("whole") < most), F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("h", F.xxhash64("doc_id", "size"))
        .select("doc_id", "source", "size", *more, "source_size", "target", "whole", "p", "h")
    )
    marked = draw_large(marked, more, most, hint=hint)
    is_open = "p > 0 and p < 1"
    parts, flying, level = [marked.where(f"not ({is_open})")], numbered_repeats(marked.where(is_open), block), 0
    while True:
        per = flying.groupBy(F.col("source").alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
        dealt = flying.join(hint(per), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h", "nth", F.lit(level)), F.col("blocks")).cast("int"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
        flown = materialize(dealt.groupBy("source", "block").applyInPandas(_flight, schema).drop("block", "blocks"), "flown")
        parts.append(flown.where(f"not ({is_open})").drop("nth"))
        flying = flown.where(is_open)
        level += 1
        if flying.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("n_copies", (F.col("whole") + F.col("p")).cast("long")).select("doc_id", "source", "size", *more, "source_size", "target", "n_copies")


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))
    return copies(rows, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, most: int = MOST) -> DataFrame:
    """docs with each row as many times as the mix takes it, all columns kept.

    Rows of equal doc_id, source and text are told apart by a number, so that repeated rows are drawn each for itself.
    """
    key = ["_id", "_key", "_nth"]
    w = W.partitionBy("_id", "_key").orderBy(F.lit(0))
    named = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("_key", F.xxhash64("source", "text")).withColumn("_nth", F.row_number().over(w))
    bare = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64("source", "text").alias("_key"),
    ).withColumn("_nth", F.row_number().over(w))
    taken = copies(bare, most).where("n_copies > 0").select(*key, "n_copies")
    return named.join(taken, key).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select(*docs.columns)


__all__ = ["mix", "mixed_documents", "copies", "targets", "fly", "land", "size_of"]

"""SimHash near-duplicates by multi-index hashing (operator 5).

``fingerprints`` reads whole texts: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined
by a space (repeats count; fewer words than that: the whole sequence; no word: fingerprint zero). A bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes (UTF-8, seed 42).

``link_components`` joins fingerprints at ``radius`` or fewer differing bits. The 64 bits are cut into segments with
allowances whose (allowance + 1) sum to more than the radius, so two fingerprints in range agree within the allowance
in at least one segment. Each distinct fingerprint is stored once per segment and looks up the small Hamming ball
around its segment's value; full distances are then verified. Equal fingerprints are first folded into one, so a group
of copies is one row. Within a table bucket no pairs are emitted: vectorised comparisons feed a local union-find, and
only a spanning forest leaves the task.

Edge cases: null and empty texts have fingerprint zero and link to each other; a null doc_id can't name a component:
such rows keep their fingerprint and take part, but are named last (a component of null ids alone is null);
repeated rows each get a row; an empty table gives no rows. Only doc_id and text are read. ``keep_one`` keeps one row of a
component of null ids, and knows rows by id and text, as an id may stand on several texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import columns_apart, materialize, scan, ship
from .wordvec import _LOWER, utf8

#: Words a shingle; differing bits that still link.
WIDTH, RADIUS = 4, 4
#: Distinct fingerprints from which segments of 32 bits with balls of radius 2 take over from three segments.
MANY = 200_000_000
#: Pairs compared at once inside a bucket.
PAIRS = 1 << 20


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of one text (its UTF-8 bytes)."""
    words = text.translate(_LOWER.tobytes()).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)), dtype="<u8", count=n)
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        set_in += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long. hashed adds tkey, the text's hash."""
    extra = [F.xxhash64("text").alias("tkey")] if hashed else []

    def make():
        def each(b: pa.RecordBatch):
            raw, at = utf8(b.column(1))
            data = raw.tobytes()
            return [b.column(0), np.array([fingerprint(data[s:e], width) for s, e in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64).view(np.int64), *b.columns[2:]]

        return each, None

    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text", *extra)
    return scan(rows, "text", "doc_id long, fp long" + ", tkey long" * hashed, make)


def segments(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(shift, bits, allowance) of each segment, for n distinct fingerprints. Sum of (allowance + 1) exceeds the radius."""
    parts = 2 if n >= MANY and radius >= 2 else min(3, radius + 1)
    least = radius + 1 - parts  # allowances still to deal out
    widths = [64 // parts + (i < 64 % parts) for i in range(parts)]
    out, shift = [], 0
    for i, bits in enumerate(widths):
        out.append((shift, bits, least // parts + (i < least % parts)))
        shift += bits
    return out


def ball(bits: int, allowance: int) -> list[int]:
    """Masks of at most ``allowance`` bits out of ``bits``."""
    masks = [0]
    edge = [(0, -1)]
    for _ in range(allowance):
        edge = [(m | 1 << j, j) for m, top in edge for j in range(top + 1, bits)]
        masks += [m for m, _ in edge]
    return masks


class _Forest:
    """Union-find over the fingerprints that a task links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _in_range(stored: np.ndarray, asking: np.ndarray, radius: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links of a spanning forest between stored and asking fingerprints of one bucket, in bounded blocks.

    Fingerprints of one component so far are not compared again with each other: what is asked is connectivity.
    """
    out = []
    for a in asking.tolist():
        rest = stored
        if len(stored) > 64 and a in forest.up:
            top = forest.root(a)
            rest = np.array([s for s in stored.tolist() if forest.root(s) != top], dtype=np.int64)
        near = rest[np.bitwise_count((rest ^ np.int64(a)).view(np.uint64)) <= radius]
        for s in near.tolist():
            if s != a and forest.join(a, s):
                out.append((max(a, s), min(a, s)))
    return out


def link_components(fps: DataFrame, radius: int = RADIUS, many: int | None = None) -> DataFrame:
    """(fp, rep) for the distinct fingerprints in fps(fp) that are linked to others: rep is one of their component."""
    spark = fps.sparkSession
    ship(spark)
    n = fps.count() if many is None else many
    rows = []
    for k, (shift, bits, allowance) in enumerate(segments(n, radius)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1)
        masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, allowance)])
        # One row for each key that the fingerprint is stored under (mask 0) or asks for; k tells the segments apart.
        rows.append(fps.select("fp", F.lit(k).alias("k"), part.alias("part"), F.explode(masks).alias("mask")))
    asked = rows[0]
    for r in rows[1:]:
        asked = asked.union(r)
    asked = asked.select("k", F.col("part").bitwiseXOR(F.col("mask")).alias("key"), (F.col("mask") != 0).alias("asks"), "fp")
    schema = "a long, b long"

    def run(batches):
        forest = _Forest()
        left: np.ndarray | None = None

        def bucket_links(table: np.ndarray, last: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
            """table: rows (bucket code, asks, fp) sorted by bucket. Keeps back the last bucket unless it is complete."""
            edges = np.flatnonzero(np.concatenate([[True], (table[1:, 0] != table[:-1, 0]) | (table[1:, 1] != table[:-1, 1]), [True]]))
            stop = len(edges) - 1 if last else len(edges) - 2
            out: list[tuple[int, int]] = []
            lo, hi = edges[:stop], edges[1 : stop + 1]
            n_stored = np.add.reduceat(1 - table[: edges[stop], 2], lo) if stop > 0 else np.zeros(0, np.int64)
            sizes = hi - lo
            small = (n_stored > 0) & (sizes > 1) & (n_stored * sizes <= 4096)
            # Small buckets: all candidate pairs (stored x any) of many buckets at once.
            picked = np.flatnonzero(small)
            for at in range(0, len(picked), 4096):
                p = picked[at : at + 4096]
                first = np.repeat(lo[p], n_stored[p] * sizes[p])
                each = np.concatenate([[0], np.cumsum(n_stored[p] * sizes[p])])
                within = np.arange(each[-1]) - np.repeat(each[:-1], np.diff(each))
                wide = np.repeat(sizes[p], n_stored[p] * sizes[p])
                s, q = table[first + within // wide, 3], table[first + within % wide, 3]
                hit = (np.bitwise_count((s ^ q).view(np.uint64)) <= radius) & (s != q)
                for x, y in zip(s[hit].tolist(), q[hit].tolist(), strict=True):
                    if forest.join(x, y):
                        out.append((max(x, y), min(x, y)))
            for i in np.flatnonzero((n_stored > 0) & (sizes > 1) & ~small):
                b = table[lo[i] : hi[i], 3]
                stored = b[: n_stored[i]]
                for cut in range(0, len(stored), PAIRS // 64):
                    out += _in_range(stored[cut : cut + PAIRS // 64], b, radius, forest)
            return out, table[edges[stop] :] if not last else table[:0]

        for batch in batches:
            table = np.stack([batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy(), np.asarray(batch.column(2).cast(pa.int8())).astype(np.int64), batch.column(3).to_numpy()], axis=1)
            table = table if left is None else np.concatenate([left, table])
            out, left = bucket_links(table, False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        if left is not None and len(left):
            out, _ = bucket_links(left, True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    links = asked.repartition("k", "key").sortWithinPartitions("k", "key", "asks", "fp").mapInArrow(run, schema)
    return components(links).select(F.col("node").alias("fp"), F.col("component").alias("rep"))


def simhash_components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 lower-case hex digits, and the least doc_id reachable."""
    marked = materialize(fingerprints(docs, width), "fingerprints")
    folded = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "folded")
    linked = link_components(folded.select("fp"), radius)
    group = folded.join(linked, "fp", "left").select("fp", "least", F.coalesce("rep", "fp").alias("rep"))
    named = group.join(group.groupBy("rep").agg(F.min("least").alias("component_id")), "rep").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, unique_ids: bool = True) -> DataFrame:
    """One document of each component, with all columns: of least (doc_id with nulls last, fingerprint, hash of the text).

    A row is known by doc_id and text, so a doc_id on texts of several components stays or goes with each of them; of
    rows equal in both, one stays. If one doc_id would stay with several texts, unique_ids keeps the first of them only.
    """
    marked = materialize(fingerprints(docs, width, True), "fingerprints")
    rows = marked.groupBy("fp", "doc_id", "tkey").agg(F.count("*").alias("n"))
    folded = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "tkey", "n")).alias("least"))
    folded = materialize(folded, "folded")
    linked = link_components(folded.select("fp"), radius)
    kept = folded.join(linked, "fp", "left").groupBy(F.coalesce("rep", "fp")).agg(F.min("least").alias("least")).select("least.*")
    if unique_ids:  # null is no id: rows without one stay apart
        named = kept.where("not none").groupBy("doc_id").agg(F.min(F.struct("none", "doc_id", "fp", "tkey", "n")).alias("least"))
        kept = named.select("least.*").unionByName(kept.where("none"))
    kept = materialize(kept.select("doc_id", "tkey", "n"), "survivors")

    def of(some: DataFrame) -> DataFrame:
        key = docs["doc_id"].cast("long").eqNullSafe(some["doc_id"]) & (F.xxhash64(docs["text"]) == some["tkey"])
        return docs.join(some, key, "left_semi")

    return of(kept.where("n = 1")).unionByName(of(kept.where("n > 1")).dropDuplicates(["doc_id", "text"]))


__all__ = ["fingerprint", "fingerprints", "link_components", "simhash_components", "keep_one", "segments", "ball"]

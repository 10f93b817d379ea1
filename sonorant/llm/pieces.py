r"""SentencePiece encoding and decoding by a relational lattice (operator 8).

The piece table (id, piece, score, kind) is read from a public model file whose path is a parameter; nothing is trained.
A text is normalised as the model says (a blank before it, blanks as U+2581) and cut into words that no piece crosses.

Lattice of a word: all its substrings up to the longest piece's length are exploded and equi-joined to the piece table,
whose size is the model's; a character without a piece becomes its UTF-8 bytes. Edges are grouped by word and folded by a
higher-order ``aggregate``: the best way to reach each place of the word. In a unigram model the best path has the
greatest sum of scores. In a byte-pair model a path is the model's own encoding exactly if every two neighbouring pieces
are: two pieces may meet only if merging their joined text gives just these two. That test is a property of pairs of
pieces; the distinct pairs of the lattice are tested once each.

Encoding a corpus: the ``head`` most frequent words go through the relational lattice and are broadcast, a table of
bounded size. Every other word goes through the same lattice inside the task that reads its text; so whole texts are
encoded where they are read, without shuffling the corpus.

Edge cases: null text gives null ids, empty text no ids; ids of control pieces are never produced and decode to nothing;
a text that itself holds U+2581 decodes with a blank instead, as in the original format; invalid byte sequences decode
to U+FFFD. Repeated rows each get a row; an empty table gives no rows. Extra columns pass through untouched.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .shared import held, materialize, scan, ship

SPACE = "▁"
#: Words that the relational lattice encodes for the broadcast table; words that a task remembers beside it.
HEAD, REMEMBERED = 100_000, 300_000
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def default_model() -> str:
    """The public byte-pair model of this machine's tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterable[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, at = varint(at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Pieces:
    """A piece table. ids: piece -> id; bytes_: byte -> id; bpe: whether the model merges pairs."""

    rows: list[tuple[int, str, float, int]]
    bpe: bool
    dummy_prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    score: dict[int, float] = field(default_factory=dict)
    bytes_: dict[int, int] = field(default_factory=dict)
    longest: int = 1
    unknown: int = 0

    def __post_init__(self):
        for i, piece, score, kind in self.rows:
            if kind in (_NORMAL, _USER):
                self.ids[piece] = i
                self.score[i] = score
            elif kind == _BYTE:
                self.bytes_[int(piece[3:5], 16)] = i
            elif kind == _UNKNOWN:
                self.unknown = i
        self.longest = max(map(len, self.ids), default=1)
        # Pieces hold blanks only in front, so a word ends before its next blank; white space that no longer piece holds cuts too.
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\t\n\x0b\x0c\r\x85\xa0\u2028\u2029\u3000" if c not in joined)
        self.cut = re.compile(r".+" if crossing else rf"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (rf"|[{alone}]" if alone else ""), re.S)
        self.text = {i: p for p, i in self.ids.items()}
        self._meets: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Pieces:
        """From a model file."""
        rows, kind, dummy = [], 1, True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                rows.append((len(rows), got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, _NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                got = dict(_fields(value))
                dummy = bool(got.get(3, 1))
                if got.get(2) or got.get(4, 1) and got.get(1) != b"identity":
                    raise ValueError("only models without a normalisation map are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        return cls(rows, kind == 2, dummy)

    def __reduce__(self):
        return type(self), (self.rows, self.bpe, self.dummy_prefix)

    def words(self, text: str) -> list[str]:
        """The text's words, normalised; their concatenation is the normalised text."""
        if not text:
            return []
        return self.cut.findall((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE))

    def fallback(self, char: str) -> tuple[int, ...]:
        """Ids of a character that has no piece."""
        if not self.bytes_:
            return (self.unknown,)
        return tuple(self.bytes_[b] for b in char.encode())

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: again and again the neighbours whose joined piece scores best (leftmost first)."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, where = self.score[k], i
            if best is None:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def meets(self, left: int, right: int) -> bool:
        """Whether two pieces (negative: a character without a piece) may be neighbours on a path."""
        if not self.bpe or left < 0 or right < 0:
            return True
        known = self._meets.get((left, right))
        if known is None:
            if len(self._meets) > 2_000_000:
                self._meets.clear()
            a, b = self.text[left], self.text[right]
            known = self._meets[left, right] = self.merged(a + b) == [a, b]
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The lattice of one word, searched for its best path.

        Unigram: per end the best (score, piece, start), folded from left to right. Byte-pair: the one path whose
        neighbours all meet, found from the left, longest piece first; a place that leads nowhere is not tried again.
        """
        path = self._merge_path(word) if self.bpe else self._best_path(word)
        out: list[int] = []
        for k in path:
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.fallback(chr(-k - 1)))
        return tuple(out)

    def _merge_path(self, word: str) -> list[int]:
        n, ids, longest, known = len(word), self.ids, self.longest, self._meets
        path: list[int] = []
        ends: list[int] = []
        dead = bytearray(n + 1)
        at, stop = 0, min(n, longest)
        while at < n:
            found = False
            while stop > at:
                k = ids.get(word[at:stop])
                if k is None and stop == at + 1:
                    k = -ord(word[at]) - 1
                if k is not None and not dead[stop]:
                    if not path:
                        found = True
                    else:
                        fits = known.get((path[-1], k))
                        found = self.meets(path[-1], k) if fits is None else fits
                    if found:
                        break
                stop -= 1
            if found:
                path.append(k)
                ends.append(at)
                at, stop = stop, min(n, stop + longest)
            else:
                dead[at] = 1
                path.pop()
                stop = at - 1
                at = ends.pop()
        return path

    def _best_path(self, word: str) -> list[int]:
        n, ids, score = len(word), self.ids, self.score
        best: list[tuple[float, int, int]] = [(0.0, -1, 0)] + [(-float("inf"), -1, 0)] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                k = ids.get(word[start:end])
                if k is None:
                    if end - start > 1:
                        continue
                    k = -ord(word[start]) - 1
                total = best[start][0] + score.get(k, -1e3)
                if total > best[end][0]:
                    best[end] = (total, k, start)
        path, at = [], n
        while at:
            path.append(best[at][1])
            at = best[at][2]
        return path[::-1]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        reverse = {i: b for b, i in self.bytes_.items()}
        out: list[bytes] = []
        for i in ids:
            if i in reverse:
                out.append(bytes([reverse[i]]))
            elif i in self.text:
                out.append(self.text[i].encode())
        said = b"".join(out).decode("utf-8", "replace").replace(SPACE, " ")
        return said[1:] if self.dummy_prefix and said.startswith(" ") else said


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of words(word): explode substrings, join the piece table, group edges by word, fold."""
    spark = words.sparkSession
    ship(spark)
    # The piece table's size is the model's, so it may be broadcast.
    table = F.broadcast(spark.createDataFrame([(p, i, float(s)) for i, p, s, k in pieces.rows if k in (_NORMAL, _USER)], "piece string, id int, score double"))
    n = F.length("word")
    starts = words.where("word <> ''").select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("start")))).alias("size"))
    spans = spans.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("size")))
    found = spans.join(table, "piece", "left").where("id is not null or size = 1")
    code = -F.ascii("piece") - 1  # the character's code point
    edges = found.select("word", "start", (F.col("start") + F.col("size")).alias("end"), F.coalesce("id", code).alias("id"), F.coalesce("score", F.lit(-1e3)).alias("score"))
    if pieces.bpe:
        edges = materialize(edges, "edges")
        before = edges.select("word", F.col("end").alias("start"), F.col("id").alias("prev"))
        pairs = edges.join(before, ["word", "start"])
        shared = spark.sparkContext.broadcast(pieces)

        @F.pandas_udf("boolean")
        def meets(left: pd.Series, right: pd.Series) -> pd.Series:
            p = shared.value
            return pd.Series([p.meets(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)

        distinct = pairs.select("prev", "id").distinct()
        fit = distinct.where(meets("prev", "id"))
        pairs = pairs.join(fit, ["prev", "id"]).select("word", "start", "end", "id", F.lit(0.0).alias("score"), "prev")
        steps = pairs.unionByName(edges.where("start = 0").select("word", "start", "end", "id", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("prev")))
    else:
        steps = edges.withColumn("prev", F.lit(None).cast("int"))
    grouped = steps.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", "start", "id", "score", "prev"))).alias("steps"))
    # best[place] = (score, id, start) of the best way to a place; place 0 is reached at score 0.
    fold = """
      aggregate(steps,
        concat(array(named_struct('score', 0d, 'id', cast(null as int), 'start', 0)), array_repeat(cast(null as struct<score: double, id: int, start: int>), length(word))),
        (best, e) -> if(best[e.start] is not null and (e.prev is null or best[e.start].id = e.prev)
            and (best[e.end] is null or best[e.start].score + e.score > best[e.end].score),
          transform(best, (x, i) -> if(i = e.end, named_struct('score', best[e.start].score + e.score, 'id', e.id, 'start', e.start), x)), best))"""
    walk = """
      aggregate(sequence(1, length(word)), named_struct('at', length(word), 'ids', cast(array() as array<int>)),
        (s, i) -> if(s.at = 0, s, named_struct('at', best[s.at].start, 'ids', concat(array(best[s.at].id), s.ids))), s -> s.ids)"""
    return grouped.withColumn("best", F.expr(fold)).select("word", F.expr(walk).alias("ids"))


def frequent_words(docs: DataFrame, pieces: Pieces, head: int = HEAD) -> DataFrame:
    """The ``head`` words that stand most often in docs(text), as far as tasks see them twice; ties by the word."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        p, counts = shared.value, Counter()

        def out():
            words = [(w, n) for w, n in counts.items() if n > 1]
            counts.clear()
            return [pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())]

        def each(b: pa.RecordBatch):
            for text in b.column(0).to_pylist():
                if text:
                    counts.update(p.words(text))
            return out() if len(counts) > 1_000_000 else None

        return each, out

    got = scan(docs.select("text"), "text", "word string, n long", make).groupBy("word").agg(F.sum("n").alias("n"))
    return got.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(head).select("word")


def encoder(docs: DataFrame, pieces: Pieces, head: int = HEAD):
    """(token, broadcast of pieces and the head words' ids) for the tasks that encode."""
    words = materialize(frequent_words(docs, pieces, head), "head-words")
    got = encode_words(words.repartition("word"), pieces).toArrow()
    return uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((pieces, got))


class Encoder(dict):
    """Inside a task: word -> its ids as int32 bytes. A word that isn't known yet is encoded, checked and remembered.

    Decoding joins what the pieces stand for, so a text decodes to itself if each of its words does; that is checked
    once per word, when it comes in.
    """

    def __init__(self, pieces: Pieces, table: pa.Table):
        super().__init__()
        self.pieces, self.wrong = pieces, set()
        names = {i: p.encode() for i, p in pieces.text.items()} | {i: bytes([b]) for b, i in pieces.bytes_.items()}
        self.names = names
        for word, ids in zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True):
            self.learn(word, tuple(i for k in ids for i in ((k,) if k >= 0 else pieces.fallback(chr(-k - 1)))))
        self.head = dict(self)

    def learn(self, word: str, ids: tuple[int, ...]) -> bytes:
        if b"".join([self.names.get(i, b"") for i in ids]) != word.encode():
            self.wrong.add(word)
        out = np.array(ids, dtype="<i4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out

    def __missing__(self, word: str) -> bytes:
        if len(self) >= len(self.head) + REMEMBERED:
            self.clear()
            self.update(self.head)
        return self.learn(word, self.pieces.encode_word(word))

    def texts(self, texts: list[str | None]) -> tuple[pa.Array, list[bool]]:
        """(ids of each text, whether they decode to it again); null texts have null ids and count as exact."""
        parts, exact = [], []
        for t in texts:
            words = self.pieces.words(t) if t else []
            parts.append(b"".join(map(self.__getitem__, words)))
            exact.append(not t or (SPACE not in t and (not self.wrong or self.wrong.isdisjoint(words))))
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int64) // 4
        values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=pa.array([t is None for t in texts])), exact


def task_encoder(token: str, shared) -> Encoder:
    """The worker's encoder; tasks of one job share it."""
    return held(token, lambda: Encoder(*shared.value))


def encode_documents(docs: DataFrame, model: str | None = None, head: int = HEAD) -> DataFrame:
    """docs with one more column, ids (array of int): every whole text's piece ids."""
    ship(docs.sparkSession)
    pieces = Pieces.read(model or default_model())
    token, shared = encoder(docs, pieces, head)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def run(batches):
        from .shared import slices

        encode = task_encoder(token, shared)
        for batch in batches:
            for b in slices(batch, at):
                ids, _ = encode.texts(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded(..., ids) with one more column, decoded: the text of the ids (null ids: null)."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.read(model or default_model()))

    def run(batches):
        p = shared.value
        for b in batches:
            said = pa.array([None if x is None else p.decode(x) for x in b.column(b.schema.names.index("ids")).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str | None = None, head: int = HEAD) -> DataFrame:
    """(doc_id, n_ids, ids, exact): ids of every whole text, and whether decoding them gives the text again."""
    ship(docs.sparkSession)
    pieces = Pieces.read(model or default_model())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    token, shared = encoder(rows, pieces, head)

    def make():
        encode = task_encoder(token, shared)

        def each(b: pa.RecordBatch):
            ids, exact = encode.texts(b.column(1).to_pylist())
            return [b.column(0), pa.compute.fill_null(pa.compute.list_value_length(ids), 0).cast(pa.int64()), ids, pa.array(exact)]

        return each, None

    return scan(rows, "text", "doc_id long, n_ids long, ids array<int>, exact boolean", make, holds=True)


__all__ = ["Pieces", "encode_words", "encode_documents", "decode_documents", "round_trip", "frequent_words", "default_model"]

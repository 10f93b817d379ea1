"""The text operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sonorant.llm import class_lm, components, embed_dedup, html_text, line_dedup, mixing, pieces, quality_classifier, quality_rules, simhash, toxicity, wordvec

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(5)
VOCAB = ["alpha", "beta", "Gamma", "été", "straße", "naïve", "x", "word#", "日本", "idiot", "b4d"]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n\x0b\x0c\r ", "en", "s", 7), (4, "one", "en", "t", 3), (5, "One", "en", "t", 3),
    (6, "a b c", "en", "t", 5), (7, "wide space　here x y z", "fr", None, 9), (None, "null id text here now", "fr", "s", 4),
    (8, "x" * 50_000, "en", "s", 5), (9, prose(3000), "en", "s", 1), (10, "\n".join([prose(12)] * 4), "de", "t", 1), (10, "\n".join(["same line twice", "same line twice"]), "de", "t", 1),
]
ROWS = [*ODD, (9, ODD[9][1], "en", "s", 1), *[(20 + i, prose(int(RNG.integers(1, 120))), "en", f"s{i % 4}", 1) for i in range(60)]]
LABELS = [(20 + i, int(i % 3 > 0), int("idiot" in ROWS[13 + i][1])) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    # An extra column that clashes with a name used inside.
    return spark.createDataFrame(ROWS, DOCS).withColumn("hash", F.lit(1)).withColumn("word", F.lit("w")).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*LABELS, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts():
    return [t or "" for _, t, *_ in ROWS]


def test_words_and_hashes():
    col = pa.array([t for _, t, *_ in ROWS])
    w = wordvec.words(col)
    want = [x.encode() for t in texts() for x in WORD.findall(t)]
    assert [bytes(w.raw[s:e]) for s, e in zip(w.start, w.end, strict=True)] == want
    by = defaultdict(set)
    for x, h in zip(want, w.hash.tolist(), strict=True):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    small = wordvec.Words(*wordvec.utf8(col))
    small.BLOCK = 64
    assert (small.hash == w.hash).all()
    sliced = wordvec.words(col.slice(5, 7))
    assert len(sliced.first) == 8


def base_counts(t):
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = set()
    for i in range(len(words) - 2):
        if c[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(cover)


def test_quality_rules(docs, labels, empty):
    got = quality_rules.quality_rules(docs, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    mine = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert mine == sorted(((i, *base_counts(t or "")) for i, t, *_ in ROWS), key=key)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    kept = sorted(r.doc_id or -1 for r in got if r.kept)
    assert sorted(r.doc_id or -1 for r in quality_rules.keep_documents(docs, labels).collect()) == kept
    assert quality_rules.keep_documents(docs, labels).columns == docs.columns


def test_quality_ratio_is_the_multinomials(docs, labels):
    counts = quality_rules.ngram_counts(docs, labels, 64)
    good = {i for i, q, _ in LABELS if q == 1}
    h = lambda t: wordvec.words(pa.array([t])).hash
    want = np.zeros((2, 64), int)
    for i, t, *_ in ROWS:
        x = h(t or "")
        pair = wordvec.mix64(x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:]) if len(x) > 1 else x[:0]
        b = np.bincount(np.concatenate([x, pair]).astype(np.uint64) % np.uint64(64), minlength=64)
        want[0] += b
        want[1] += b * (i in good)
    assert (counts == want).all()


def test_quality_counts_take_every_trusted_document(docs, labels):
    many = labels.union(labels.limit(3))
    for most in (3, 0):
        assert (quality_rules.ngram_counts(docs, many, 64, most) == quality_rules.ngram_counts(docs, many, 64)).all()


def naive_fp(t):
    w = t.encode().translate(wordvec._LOWER.tobytes()).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    bits = Counter(j for s in sh for h in [xxhash.xxh64_intdigest(s, 42)] for j in range(64) if h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * bits[j] > len(sh))


def naive_components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_simhash(docs, empty):
    got = simhash.simhash_components(docs).collect()
    fp = [naive_fp(t) for t in texts()]
    comp = naive_components(len(ROWS), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    least = defaultdict(list)
    for k, (i, *_) in zip(comp, ROWS, strict=True):
        least[k] += [i] if i is not None else []
    want = sorted((str(i), f"{f:016x}", str(min(least[k], default=None))) for (i, *_), f, k in zip(ROWS, fp, comp, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {min(v) for v in least.values() if v}


def test_keep_one_of_null_and_reused_ids(spark):
    rng = np.random.default_rng(11)

    def long(n=400):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))

    a, b, c, d, e = (long() for _ in range(5))
    rows = [
        (1, a), (None, a + " end"), (None, b), (None, b + " end"), (None, b), (7, b + " stop"), (None, c), (None, c + " end"), (None, c), (None, long()),
        (20, d), (20, e), (3, e + " end"), (30, d + " end"), (40, long()), (40, long()), (40, "twice over here now"), (40, "twice over here now"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("tkey", F.lit(0))
    fp = [naive_fp(t) for _, t in rows]
    comp = naive_components(len(rows), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    groups = [[r for r, k in zip(rows, comp, strict=True) if k == g] for g in sorted(set(comp))]
    assert sorted(len(g) for g in groups) == [1, 1, 1, 2, 2, 2, 2, 3, 4]
    want = {g: min((i is None, i or 0) for i, _ in rs) for g, rs in enumerate(groups)}
    out = simhash.keep_one(df, unique_ids=False)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and len(got) == len(groups)
    for g, rs in enumerate(groups):
        stays = [x for x in got if x in rs]
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0] or 0) == want[g]
    one = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert len(one) == len(groups) - 2 and set(one) < set(got) and sum(i == 40 for i, _ in one) == 1


def test_near_fingerprints_are_all_found(spark):
    base = int(RNG.integers(0, 1 << 62))
    fps = [base]
    for _ in range(300):
        x = fps[int(RNG.integers(0, len(fps)))]
        for j in RNG.choice(64, int(RNG.integers(1, 7)), replace=False):
            x ^= 1 << int(j)
        fps.append(x)
    fps = sorted(set(fps))
    comp = naive_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for many in (None, simhash.MANY):
        rep = {r.fp: r.rep for r in simhash.link_components(spark.createDataFrame([(x,) for x in signed], "fp long"), many=many).collect()}
        pairs = {(comp[i], rep.get(x, x)) for i, x in enumerate(signed)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


@pytest.mark.parametrize("n", [1, 10, 10**9])
def test_segments_cover_the_radius(n):
    s = simhash.segments(n)
    assert sum(b for _, b, _ in s) == 64 and sum(a + 1 for _, _, a in s) > 4
    assert len(simhash.ball(5, 2)) == 16


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (1, 0)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components.components(links.where("false")).count() == 0


def test_embeddings(spark):
    x = RNG.normal(size=(40, 16))
    x = np.concatenate([x, x[:10] + 0.05 * RNG.normal(size=(10, 16)), np.repeat(x[:1], 4, axis=0) + 0.02 * RNG.normal(size=(4, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2 if i < 40 else (i - 40) % 2 if i < 50 else 0) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, x[0].tolist(), None), (104, [None] * 16, 1), (105, x[0].tolist(), 0), (105, x[0].tolist(), 0), (106, [], 1), (107, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [i for i, (_, v, k) in enumerate(rows) if k is not None and v and all(y is not None and math.isfinite(y) for y in v) and any(v)]

    def cos(a, b):
        a, b = np.float64(np.array(a, np.float32)), np.float64(np.array(b, np.float32))
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.93]
    n = Counter(k for p in links for k in p)
    comp = naive_components(len(rows), links)
    least = defaultdict(list)
    for k, r in zip(comp, rows, strict=True):
        least[k].append(r[0])
    want = sorted((r[0], n[i], min(least[comp[i]]), r[0] == min(least[comp[i]])) for i, r in enumerate(rows))
    for block in (1024, 4):
        assert sorted(map(tuple, embed_dedup.embedding_components(df, block=block).collect())) == want
    assert embed_dedup.embedding_components(df.where("false")).count() == 0


def test_line_dedup(spark, docs, empty):
    first_letters = "abcdefghi"
    lines = [(100 + i, f"{first_letters[i]}lpha words of their own\nVisit page {i} of our site now\nAll rights reserved here", "en", "s", 1) for i in range(9)] + [(200 + i, "shared exact copy\nof one text here", "en", "s", 1) for i in range(9)]
    df = spark.createDataFrame([*ROWS, *lines], DOCS).withColumn("places", F.lit(0))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).where("doc_id >= 100").collect()}
    assert got[100].text == lines[0][1] and got[100]._n_dropped == 0  # the first of each template stays
    assert all(got[100 + i].text == f"{first_letters[i]}lpha words of their own" for i in range(1, 9))
    assert all(got[200 + i].text == "shared exact copy\nof one text here" for i in range(9))  # copies count as one text
    out = line_dedup.dedup_lines(df)
    assert out.count() == len(ROWS) + 18 and out.columns[:-2] == df.columns
    same = {(r.doc_id, r.text) for r in out.where("doc_id < 100 or doc_id is null").collect()}
    assert same == {(i, t) for i, t, *_ in ROWS}
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_passages(spark):
    """A long passage goes from three texts on, but for its first place; short lines and passages in two texts stay."""
    rng = np.random.default_rng(3)
    said = lambda n: " ".join(f"w{chr(97 + x)}{chr(97 + y)}{chr(97 + z)}" for x, y, z in rng.integers(0, 26, (n, 3)))
    thrice, twice, short = said(55), said(60), said(6)
    rows = [(i, "\n".join([said(30), thrice if i < 3 else twice if i < 5 else said(25), short if i < 6 else said(8), said(40)])) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for broadcast in (line_dedup.BROADCAST, 0):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, broadcast=broadcast).collect()}
        assert all((got[i] == t) == (i not in (1, 2)) for i, t in rows) and all(got[i] == rows[i][1].replace(thrice + "\n", "") for i in (1, 2))
    none = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, keep_first=False).collect()}
    assert all(none[i] == t.replace(thrice + "\n", "") for i, t in rows)


def test_line_dedup_equals_sql(spark):
    import oracle

    from sonorant.llm import queries

    assert oracle.difference(spark, oracle.connect(), "op6", queries.QUERIES["op6_line_dedup"], queries.ORACLE_SQL["op6_line_dedup"]) == ""


def naive_targets(sizes):
    names = sorted((x for x in sizes if x is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {s for s in names if sizes[s] == 0}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        level = rest / weight if weight else 0
        more = {s for s in names if s not in full and level * w[s] >= 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = [len(WORD.findall(t)) for t in texts()]
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(i), n) for (i, *_), n in zip(ROWS, size, strict=True))
    sums = defaultdict(int)
    for (_, _, _, s, _), n in zip(ROWS, size, strict=True):
        sums[s] += n
    want = sorted((float(sums[s]), round(t, 6)) for s, t in naive_targets(sums).items())
    assert sorted({(float(r.source_size), round(r.target, 6)) for r in got}) == sorted(set(want))
    assert all(r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(mixing.size_of(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == sum(r.taken for r in got)


def test_every_source_comes_near_its_target(spark):
    """Heavy tails, one document larger than half its source, repeated rows and null ids by the thousand."""
    rng = np.random.default_rng(13)
    rows = [(k, "w " * int(n), f"s{k % 5}") for k, n in enumerate(np.minimum(rng.pareto(1.1, 3000) * 20 + 1, 4000))]
    rows += [(9000 + k, "w " * 20_000, f"s{k}") for k in range(3)] + [(None, "w " * 7, "s3")] * 5000 + [(77, "w " * 9, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (mixing.BLOCK, 512):
        marked = df.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
        got = mixing.copies(marked, block=block).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("n_copies")).alias("taken")).collect()
        assert len(got) == 6 and all(abs(r.taken - r.target) <= max(10.0, 0.001 * r.target) for r in got), got


def test_flight_keeps_totals():
    size = RNG.integers(1, 500, 400)
    p = np.full(400, 0.37)
    out = mixing.fly(p, size, RNG.random(400))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    landed = mixing.land(np.array([1.0, 0.5, 0.5]), np.array([5, 10, 3]))
    assert set(landed) <= {0.0, 1.0}


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.read(pieces.default_model())


def test_pieces_equal_the_library(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for t in [*texts(), "  a  b   c", "x\ty\n\n z ", "日本語テスト 🙂", "    ", "a     the   in ", "tt t ttt aaaaaaaaaa", " " * 37 + "x", "don't   stop \r\n now();\r\n"]:
        ids = [i for w in model.words(t) for i in model.encode_word(w)]
        assert ids == lib.encode(t) and model.decode(ids) == t


def test_relational_lattice_equals_the_search(spark, model):
    words = sorted({w for t in texts() if len(t) < 5000 for w in model.words(t)} | {"▁▁▁the", "▁", "🙂", "▁naïve"})
    got = {r.word: r.ids for r in pieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), model).collect()}
    for w in words:
        assert tuple(i for k in got[w] for i in ((k,) if k >= 0 else model.fallback(chr(-k - 1)))) == model.encode_word(w)


def test_unigram_lattice(spark):
    rows = [(0, "<unk>", 0.0, 2), (1, "a", -3.0, 1), (2, "b", -3.0, 1), (3, "ab", -4.0, 1), (4, "ba", -1.0, 1), (5, "▁", -2.0, 1)]
    uni = pieces.Pieces(rows, bpe=False)
    assert uni.encode_word("▁aba") == (5, 1, 4)
    got = pieces.encode_words(spark.createDataFrame([("▁aba",), ("abab",)], "word string"), uni)
    assert {r.word: tuple(r.ids) for r in got.collect()} == {w: uni.encode_word(w) for w in ("▁aba", "abab")}


def test_encoding_documents(docs, empty):
    r = pieces.round_trip(docs).collect()
    assert len(r) == len(ROWS) and all(x.exact for x in r)
    out = pieces.decode_documents(pieces.encode_documents(docs)).collect()
    assert all(x.decoded == x.text for x in out)
    assert pieces.encode_documents(empty).count() == 0


def test_class_lm(docs, empty):
    got = class_lm.score(docs).collect()
    toks = [[w.lower() if w.isascii() else w.encode().translate(wordvec._LOWER.tobytes()).decode() for w in WORD.findall(t)] + [None] for t in texts()]
    out = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, *_ in ROWS]
    c = Counter(w for t, o in zip(toks, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), o, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (i, *_), t, o in zip(ROWS, toks, out, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    small = class_lm.score(docs, words=4, endings=3, classes=3, head=2).collect()  # most words take the join
    assert sorted(round(r.base_score, 6) for r in small) == sorted(w[-1] for w in want)
    assert all(r.score < 0 for r in got) and class_lm.score(empty).count() == 0


def test_class_lm_score_is_that_of_brute_force(docs):
    """Classes of rare words, transitions, emissions and every text's score, one token at a time."""
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, *_ in ROWS]
    trained = class_lm.Trained(class_lm._split(docs, class_lm.SPLIT).where("not held_out").select("text"), 4, 3, 4)
    types, of = trained.types, trained.of
    seqs = []
    for t in texts():
        w = wordvec.Words(*wordvec.utf8(pa.array([t])), lower=True)
        seqs.append((w.hash.view(np.int64).tolist(), types.sequence(w, w.hash)[0].tolist()))
    end, k = types.end, int(of.max()) + 1
    bigrams, context, count, first_type = Counter(), defaultdict(Counter), Counter(), {}
    for (words, kinds), out in zip(seqs, held, strict=True):
        if not out:
            for w, a, b in zip([*words, None], [end, *kinds[:-1]], kinds, strict=True):
                bigrams[a, b] += 1
                count[w] += 1
                context[w][int(of[a])] += 1
                first_type[w] = b
    assert trained.n == sum(count.values()) and trained.v == len(count)
    joint = np.zeros((k, k))
    for (a, b), n in bigrams.items():
        joint[of[a], of[b]] += n

    def smooth(joint):
        uni = [(joint[:, c].sum() + 1) / (joint.sum() + k) for c in range(k)]
        rows = []
        for h in range(k):
            total, seen = joint[h].sum(), (joint[h] > 0).sum()
            rows.append([(max(joint[h, c] - 0.5, 0) + 0.5 * seen * uni[c]) / total if total else uni[c] for c in range(k)])
        return rows, uni

    trans, uni = smooth(joint)
    cls = {}
    for w, t in first_type.items():
        if w is None or t < len(types.words):
            cls[w] = int(of[t])
        else:
            value = [math.log(uni[c]) + sum(n * (math.log(trans[h][c]) - math.log(uni[c])) for h, n in context[w].items()) for c in range(k - 1)]
            cls[w] = int(np.argmax(np.round(value, 6)))
    assert {r.word: (r.cls, r.c) for r in trained.rare.collect()} == {w: (cls[w], count[w]) for w, t in first_type.items() if w is not None and t >= len(types.words)}
    final = np.zeros((k, k))
    for w, hs in context.items():
        for h, n in hs.items():
            final[h, cls[w]] += n
    trans, _ = smooth(final)
    divisor = [sum(count[w] for w in cls if cls[w] == c) + sum(1 for w in cls if cls[w] == c) + 1 for c in range(k)]
    want = []
    for (words, kinds), (i, *_) in zip(seqs, ROWS, strict=True):
        x = 0.0
        for w, a, b in zip([*words, None], [end, *kinds[:-1]], kinds, strict=True):
            c = cls.get(w, int(of[b]))
            x += math.log10(trans[of[a]][c] * (count[w] + 1) / divisor[c])
        want.append((str(i), x))
    for head in (500_000, 30, 0):
        got = sorted((str(r.doc_id), r.score) for r in class_lm.score(docs, words=4, endings=3, classes=4, head=head).collect())
        assert all(a == b and math.isclose(x, y, rel_tol=1e-9) for (a, x), (b, y) in zip(got, sorted(want), strict=True))
    again = class_lm.score(docs.repartition(5), words=4, endings=3, classes=4, head=30).collect()
    once = class_lm.score(docs, words=4, endings=3, classes=4, head=30).collect()
    assert sorted(map(str, again)) == sorted(map(str, once))


def test_class_model_is_a_distribution():
    counts = RNG.integers(0, 9, (12, 12))
    of = class_lm.exchange(counts, 4)
    joint = class_lm.class_bigrams(counts, of)
    transition, unigram = class_lm.smoothed(joint)
    assert np.allclose(transition.sum(axis=1), 1) and np.allclose(unigram.sum(), 1) and of[11] == 3 and (of[:11] < 3).all()


def test_exchange_never_loses_likelihood():
    f = class_lm._xlogx

    def like(of, counts):
        j = np.zeros((of.max() + 1, of.max() + 1))
        np.add.at(j, (of[:, None], of[None]), counts)
        return f(j).sum() - f(j.sum(1)).sum() - f(j.sum(0)).sum()

    for seed in range(25):
        counts = np.random.default_rng(seed).integers(0, 9, (14, 14)).astype(float)
        values = [like(class_lm.exchange(counts, 4, s), counts) for s in range(6)]
        assert all(b >= a - 1e-5 for a, b in zip(values[:-1], values[1:], strict=True))
        of = class_lm.exchange(counts, 4, 50)  # settled: no single move raises the likelihood
        for t in range(13):
            for c in range(3):
                moved = of.copy()
                moved[t] = c
                assert like(moved, counts) <= like(of, counts) + 1e-5


def naive_segments(w):
    """All maximal segments by definition: the best segment, then those to its left and right."""
    best = max(((sum(w[i:j]), -(j - i), -i) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    s, e = -best[2], -best[2] - best[1]
    return [*naive_segments(w[:s]), (s, e, round(best[0], 6)), *[(e + a, e + b, x) for a, b, x in naive_segments(w[e:])]]


def test_maximal_segments():
    for _ in range(60):
        n = int(RNG.integers(1, 14))
        at = sorted(RNG.choice(n, int(RNG.integers(0, n + 1)), replace=False).tolist())
        x = [round(float(y), 3) for y in RNG.random(len(at)) * 1.3 - 0.3]
        w = [-0.31] * n
        for i, y in zip(at, x, strict=True):
            w[i] = y
        assert [(s, e, round(z, 6)) for s, e, z in toxicity.maximal_segments(at, x, -0.31)] == naive_segments(w)


def test_extreme_value_fit_finds_the_parameters():
    rng = np.random.default_rng(7)
    n = rng.integers(50, 2000, 6000)
    s = (np.log(0.004 * n) - np.log(-np.log(rng.random(6000)))) / 1.7  # P(S < x) = exp(-K n exp(-lambda x))
    lam, log_k = toxicity.extreme_value(np.maximum(s, 0.0), n)
    assert abs(lam - 1.7) < 0.1 and abs(log_k - math.log(0.004)) < 0.2
    assert toxicity.extreme_value(np.zeros(50), np.full(50, 100))[0] == 1.0 and toxicity.extreme_value(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_sum_statistic():
    x = [6.0, 5.0, 4.0, -1.0, 9.0]

    def minus_log_p(r):
        t = sum(x[:r])
        return -math.log(math.exp(-t) * t ** (r - 1) / math.factorial(r) / math.factorial(r - 1) * 2**r)

    assert math.isclose(toxicity.sum_evidence(x), max(x[0], minus_log_p(2), minus_log_p(3)))
    assert toxicity.sum_evidence([-2.0]) == -2.0 and toxicity.sum_evidence([]) == 0.0


def toxic_rows():
    plain = [f"{a}{b}" for a in ("the", "cat", "sat", "mat", "hat", "blue", "sky", "run") for b in ("", "ly", "er", "ing")]
    return [(i, " ".join(RNG.choice(plain, 40)) + (" you MORONic fool," if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]


def test_word_scores_are_the_dirichlet_log_odds(spark):
    rows = [(i, t) for i, t, *_ in toxic_rows()] + [(7, "another text of id seven"), (None, "MORONic")]
    df = spark.createDataFrame([*rows, *rows[:40]], "doc_id long, text string")  # repeated rows count once
    ids, y = np.arange(400), (np.arange(400) % 4 == 0).astype(np.int64)
    counts = {r.feature: r for r in toxicity.document_counts(toxicity.one_row_each(df), ids, y).collect()}
    held = defaultdict(lambda: [0, 0])
    text = {i: min(t for j, t in rows if j == i) for i in range(400)}
    for i, t in text.items():
        w = toxicity.tokens(*wordvec.utf8(pa.array([t])))
        for h in {x for _, hs in toxicity.features(w) for x in hs.view(np.int64).tolist()}:
            held[h][i % 4 == 0] += 1
    assert {f: (r.clean0 + r.clean1, r.toxic0 + r.toxic1) for f, r in counts.items()} == {f: tuple(v) for f, v in held.items()}
    sizes = {"toxic0": 60, "toxic1": 40, "clean0": 160, "clean1": 140}
    words, weights = toxicity.evidence(toxicity.document_counts(toxicity.one_row_each(df), ids, y), sizes)
    want = {}
    for f, (c, t) in held.items():
        a = (c + t) / 400 * 50 + 0.01
        odds = lambda k, n: math.log((k + a) / (n + 51 - k - a / 2))  # noqa: E731, B023
        d, e = odds(t, 100) - odds(c, 300), math.sqrt(1 / (t + a) + 1 / (c + a))
        if c + t >= 3 and abs(d) > 3 * e:
            want[f] = math.copysign(abs(d) - 3 * e, d)
    got = {int(f): float(v) for f, v in zip(words.view(np.int64), weights[:, 0], strict=True) if v}
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], rel_tol=1e-9) for f in got)


def test_toxicity(spark, empty, labels):
    rows = toxic_rows() + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(0)).withColumn("fold", F.lit("x"))
    lab = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 11}
    assert all(by[i].predicted == (i % 4 == 0) for i in range(11, 400)) and by[12].segments[0].start >= 40
    again = toxicity.toxicity(df.union(df.where("doc_id % 3 = 0")).repartition(5), lab.union(lab)).collect()
    assert {(r.doc_id, r.score) for r in again if r.doc_id is not None and r.doc_id != 10} == {(r.doc_id, r.score) for r in got if r.doc_id is not None and r.doc_id != 10}
    none = toxicity.toxicity(df, lab.where("false")).collect()
    assert all(r.predicted == 0 for r in none) and toxicity.toxicity(empty, labels).count() == 0


def test_quality_classifier(spark, empty, labels):
    rows = [(i, ("GET IT!! NOW!! " * 30) if i % 3 == 0 else prose(60), "en" if i % 2 else "de", "bad" if i % 3 == 0 else f"h{i % 5}", 1) for i in range(150)] + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("p", F.lit(0))
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(df, lab).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id % 3 > 0) for r in got if r.doc_id is not None and r.doc_id > 10)
    assert sorted(map(str, got)) == sorted(map(str, quality_classifier.quality_scores(df.repartition(5), lab).collect()))
    assert quality_classifier.quality_scores(empty, labels).count() == 0


def simulated_sites(spread, rng):
    """Documents of dense and sparse sites: (doc_id, host, path, evidence, good), with sites' rates drawn around their hosts'."""
    rows, rate = [], {}
    for h in range(60):
        of_host = rng.normal(0, spread)
        for p in range(1 + h % 4):
            rate[h, p] = 1 / (1 + np.exp(-(1 + of_host + rng.normal(0, spread / 2))))
            for _ in range(3 if h % 2 else 120):
                good = int(rng.random() < rate[h, p])
                # Calibrated against the global rate of about 0.7: a likelihood of two normals two deviations of 1.5 apart.
                x = rng.normal(good, 1.5)
                odds = 0.85 + (2 * x - 1) / (2 * 1.5**2)
                rows.append((len(rows), f"h{h}" if h else None, f"p{p}" if p else None, float(1 / (1 + np.exp(-odds))), good))
    return rows, rate


def test_site_posteriors_are_those_of_brute_force(spark):
    rows, _ = simulated_sites(1.0, np.random.default_rng(3))
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, host string, path string, evidence double")
    got = {r.doc_id: r for r in quality_classifier.with_sites(df, hot=0.01).collect()}
    e, hosts, paths = np.array([r[3] for r in rows]), {}, {}
    for i, r in enumerate(rows):
        hosts.setdefault(r[1], []).append(i)
        paths.setdefault(r[1:3], []).append(i)
    n, mu = len(e), e.mean()
    within = sum(((e[x] - e[x].mean()) ** 2).sum() for x in paths.values()) / (n - len(paths))
    share = sum(len(x) ** 2 / len(hosts[k[0]]) for k, x in paths.items())
    between = sum(len(x) * (e[x].mean() - e[hosts[k[0]]].mean()) ** 2 for k, x in paths.items())
    path = max(0, between - (len(paths) - len(hosts)) * within) / (n - share)
    top = sum(len(x) * (e[x].mean() - mu) ** 2 for x in hosts.values())
    squares = sum(len(x) ** 2 for x in paths.values())
    host = max(0, top - (len(hosts) - 1) * within - path * (share - squares / n)) / (n - sum(len(x) ** 2 for x in hosts.values()) / n)
    assert path > 0 and host > 0 and len(got) == n
    logit = lambda p: np.log(p / (1 - p))
    for i, r in enumerate(rows):
        x, y = hosts[r[1]], paths[r[1:3]]
        v = within / len(x) + path * sum(len(z) ** 2 for k, z in paths.items() if k[0] == r[1]) / len(x) ** 2
        host_mean = mu if len(x) == 1 else mu + host / (host + v) * ((e[x].sum() - e[i]) / (len(x) - 1) - mu)
        path_mean = ((e[y].sum() - e[i]) * path + within * host_mean) / ((len(y) - 1) * path + within)
        assert got[i].host_mean == pytest.approx(host_mean, abs=1e-4) and got[i].path_mean == pytest.approx(path_mean, abs=1e-4)
        assert logit(got[i].score) == pytest.approx(logit(e[i]) + logit(path_mean) - logit(mu), abs=4e-3)


def test_sites_help_where_they_differ_and_do_nothing_where_not(spark):
    for spread, gain in ((2.0, 0.015), (0.0, 0.0)):
        rows, rate = simulated_sites(spread, np.random.default_rng(5))
        df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, host string, path string, evidence double")
        got = {r.doc_id: r for r in quality_classifier.with_sites(df).collect()}
        good = np.array([r[4] for r in rows])
        alone = np.mean((np.array([r[3] for r in rows]) >= 0.5) == good)
        joined = np.mean([got[r[0]].kept == bool(r[4]) for r in rows])
        assert joined >= alone + gain if gain else abs(joined - alone) < 0.005
    paths = df.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(F.col("evidence") * 1e6).cast("long")).alias("u"), F.sum(F.round(F.col("evidence") ** 2 * 1e6).cast("long")).alias("q"))
    v = quality_classifier.levels(paths)
    assert v.path < 0.002 and v.host < 0.002 and v.within > 0.01


def test_sparse_sites_stay_near_their_parents(spark):
    rows = [(i, "good", "a", 0.9 + 0.05 * (i % 2)) for i in range(200)] + [(200 + i, "bad", "a", 0.1 + 0.05 * (i % 2)) for i in range(200)] + [(400, "one", "a", 0.1), (401, "two", "a", 0.1), (402, "two", "a", 0.15)]
    got = {r.doc_id: r for r in quality_classifier.with_sites(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")).collect()}
    assert got[0].path_mean > 0.9 and got[200].path_mean < 0.15 and 0.4 < got[400].path_mean < 0.65
    assert quality_classifier.with_sites(spark.createDataFrame([], "doc_id long, host string, path string, evidence double")).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(("html", "want"), [
    (None, []), ("", []), ("plain &lt;text&gt;", ["plain <text>"]),
    (page("<nav><a>x</a></nav><article><h1>T</h1><p>a<b>b</b>  c&nbsp;d<p>e<br>f<ul><li>g<li>h</ul></article><footer>z</footer>"), ["T", "ab c d", "e f", "g", "h"]),
    (page("<article><p>a</p><aside>s</aside><form><p>q</p></form><section id=comments><p>r</p></section><div class='cookie-notice'>n</div><p>b</article>"), ["a", "b"]),
    (page("<main><p>m</p><div hidden>x</div></main><p>out</p>"), ["m"]),
    (page("<article><p>a < b && c <!-- no <p> --> d</p><table><tr><td>1<td>2</table><pre> x\n y </pre>"), ["a < b && c d", "1", "2", "x y"]),
    ("<p>one<p>two</div></p><p title='a>b'>three", ["one", "two", "three"]),
])
def test_blocks(html, want):
    assert (html_text.candidates(html) if html else []) == want


def site(n, seed, menus=4):
    """Pages without article, main or telling class names: a rotating menu, a box that recurs, own text, a rotating footer."""
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in range(400)]

    def said(k):
        return " ".join(rng.choice(words, k))

    pool = [said(3) for _ in range(menus)]
    out = []
    for i in range(n):
        title, own = said(5), [said(30), said(20)]
        menu = "".join(f"<li>{x}</li>" for x in rng.choice(pool, 2))
        out.append((f"<body><div class='q1'><ul>{menu}</ul></div><div class='q2'><h2>{title}</h2><p>{own[0]}</p><p>{own[1]}</p></div><div class='q3'>Join club {i} today</div><div class='q4'>{rng.choice(pool)}</div></body>", "\n\n".join([title, *own])))
    return out


def test_templates_alone_take_the_boilerplate(spark):
    """On pages whose markup says nothing, what stays is each page's own text, and recurring text of others stays."""
    pages = site(30, 3)
    rows = [(i, f"http://h.example/{i}", h) for i, (h, _) in enumerate(pages)]
    rows += [(0, "http://h.example/0", pages[0][0]), (60, "http://h.example/z", None), (61, "http://h.example/y", ""), (62, None, pages[1][0]), (63, "http://one.example/", pages[2][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("q")).withColumn("host", F.lit("q"))
    for broadcast in (html_text.BROADCAST, 0):
        got = sorted(html_text.main_text(df, broadcast=broadcast).collect(), key=lambda r: r.page_id)
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        by = {r.page_id: r for r in got}
        assert all(by[i].text == want and by[i].n_template_blocks == 4 and by[i].n_markup_blocks == 0 for i, (_, want) in enumerate(pages))
        assert by[60].text == by[61].text == "" and all(by[i].n_template_blocks == 0 and "Join club" in by[i].text for i in (62, 63))
    assert html_text.main_text(df.where("false")).count() == 0


def test_subtree_counts_and_templates_are_those_of_brute_force(spark):
    pages = [h for h, _ in site(24, 4, menus=12)]
    pages += [pages[0], pages[1].replace("club 1", "club 77"), pages[2]]  # copies count once
    df = spark.createDataFrame([(i, "http://h.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    seen, text, held = defaultdict(set), defaultdict(dict), defaultdict(dict)
    for h in pages:
        blocks, elements = html_text.parse(h)
        main = html_text.sketch(max((t for t, _, _ in blocks), key=len))
        seen[0, 0].add(main)
        text[0][main] = sum(len(t) for t, _, _ in blocks)
        sizes, inside = Counter(), defaultdict(set)
        for e in elements:
            if e.size and e.slot:
                sizes[e.slot] += e.size
                inside[e.slot].add(e.hash | 1)
        for slot, hashes in inside.items():
            seen[slot, 0].add(main)
            text[slot][main], held[slot][main] = sizes[slot], len(hashes)
            for x in hashes:
                seen[slot, x].add(main)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {(signed(s), signed(c)): len(m) for (s, c), m in seen.items() if len(m) > 1 or c == 0}
    counts = html_text.subtree_counts(df).collect()
    assert {(r.slot, r.content): r.n for r in counts} == want and len(seen[0, 0]) == 24
    of = {r.key: (r.slot, r.content) for r in counts}
    chosen = set()
    for (s, c), m in seen.items():
        small = s % 2 == 0 and sum(text[s].values()) <= 0.3 * sum(text[0].values())
        if s and not c:
            again = sum(len(x) for (t, d), x in seen.items() if t == s and d and len(x) > 1)
            if small and len(m) >= 12 and again >= 3 and again >= 0.1 * sum(held[s].values()):
                chosen.add((signed(s), 0))
        elif c and len(m) >= 8 and len(m) >= (0.1 if small else 0.6) * 24:
            chosen.add((signed(s), signed(c)))
    assert {of[r.key] for r in html_text.templates(df).collect()} == chosen and len(chosen) >= 4


def test_parsing_is_linear_in_nesting():
    import time

    def seconds(n):
        html = "<div>word " * n
        start = time.perf_counter()
        assert len(html_text.candidates(html)) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_labelled_sample_is_that_of_least_hash(spark):
    from sonorant.llm.shared import label_of, labelled_ids

    df = spark.createDataFrame([(i, i % 2, 0) for i in range(500)] + [(3, 0, 0), (None, 1, 1), (9000, 7, 0)], "doc_id long, quality int, toxic int")
    ids, y = labelled_ids(df, "quality", 40)
    want = df.where("quality in (0, 1) and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(40).collect()
    assert ids.tolist() == sorted(r.doc_id for r in want) and (y == ids % 2).all()
    assert label_of(pa.array([int(ids[0]), None, -5]), ids, y).tolist() == [y[0], -1, -1]
    assert label_of(pa.array([1, 2]), ids[:0], y[:0]).tolist() == [-1, -1]

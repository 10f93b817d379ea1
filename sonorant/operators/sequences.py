"""Sequence operators over long-form tokens: columns seq, pos (order inside a sequence), token, and ctx where named.

n-grams are text, tokens joined by a blank. Null tokens are dropped by the callers' scans. Ties in every ranking are
broken by the key. Entropies are in bits unless a docstring says nats; ratios with nothing below are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut, numbered


def in_order():
    """The window of a sequence in its order."""
    return W.partitionBy("seq").orderBy("pos")



def r6(c: Column) -> Column:
    """Rounded to six places, as every derived double of a registered query."""
    return F.round(c, 6)


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: infinite, or NaN for 0 / 0, where b is zero."""
    toward = F.when(F.atan2(b, F.lit(-1.0)) < 0, -F.signum(a)).otherwise(F.signum(a))  # atan2 tells -0.0 from 0.0
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNotNull() & a.isNotNull(), F.when(F.isnan(a) | (a == 0), float("nan")).otherwise(toward * F.lit(float("inf"))))


def tokens(df: DataFrame, seq: str, order: list[str], token: str, ctx: str | None = None) -> DataFrame:
    """Long form (seq, pos, token[, ctx]) of event rows; pos counts from 0 in the given order."""
    w = W.partitionBy(seq).orderBy(*order)
    cols = [F.col(seq).alias("seq"), (F.row_number().over(w) - 1).alias("pos"), F.col(token).cast("string").alias("token")]
    return df.select(*cols, *([F.col(ctx).alias("ctx")] if ctx else []))


def ngrams(t: DataFrame, sizes: range | list[int]) -> DataFrame:
    """(seq, pos, n, ngram[, ctx]) of every window of the given sizes; a sequence shorter than n has none."""
    most = max(sizes)
    ahead = [F.lead("token", k).over(in_order()).alias(f"t{k}") for k in range(1, most)]
    wide = t.select(*t.columns, *ahead)
    parts = [F.when(F.col(f"t{n - 1}" if n > 1 else "token").isNotNull(), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", "token", *[f"t{k}" for k in range(1, n)]).alias("ngram"))) for n in sizes]
    return wide.select("seq", "pos", *(["ctx"] if "ctx" in t.columns else []), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select("*", "x.n", "x.ngram").drop("x")


def bigrams(t: DataFrame) -> DataFrame:
    """(seq, pos, src, dst[, ctx]) of neighbouring tokens; the last token of a sequence has no successor."""
    return t.withColumn("dst", F.lead("token").over(in_order())).where("dst is not null").withColumnRenamed("token", "src")


def ngram_counts(t: DataFrame, sizes: range | list[int]) -> DataFrame:
    """(n, ngram, occurrences, sequences): the last counts different sequences (Q5)."""
    return ngrams(t, sizes).groupBy("n", "ngram").agg(F.count("*").alias("occurrences"), F.countDistinct("seq").alias("sequences"))


def top_ngrams(t: DataFrame, limit: int, n: int) -> DataFrame:
    """W2, W3 (n = 1), W59: the most frequent n-grams."""
    return ngram_counts(t, [n]).orderBy(F.desc("occurrences"), "ngram").limit(limit).select("ngram", "occurrences")


def unique_patterns(t: DataFrame, sizes) -> DataFrame:
    """N-grams that occur once."""
    return ngram_counts(t, sizes).where("occurrences = 1").select("n", "ngram")


def max_ngram_length(t: DataFrame, min_support: int, most: int) -> DataFrame:
    """The longest n (from 2, without a gap) at which some n-gram has the support; 1 if none has. Bounded by most (Q7)."""
    supported = ngram_counts(t, range(2, most + 1)).groupBy("n").agg(F.max("occurrences").alias("m")).where(F.col("m") >= min_support)
    run = supported.withColumn("ok", F.col("n") - 1 == F.row_number().over(W.orderBy("n")))
    return run.agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("n"))), F.lit(1)).alias("max_n"))


def longest_repeated(t: DataFrame, min_support: int, most: int) -> DataFrame:
    """The most frequent n-gram of the length that W5 gives."""
    best = ngram_counts(t, range(2, most + 1)).join(F.broadcast(max_ngram_length(t, min_support, most)), F.col("n") == F.col("max_n"))
    return best.orderBy(F.desc("occurrences"), "ngram").limit(1).select("n", "ngram", "occurrences")


def analyze_pattern(t: DataFrame, pattern: str) -> DataFrame:
    """Occurrences and sequences of one pattern per context, with the share of its occurrences."""
    n = len(pattern.split(" "))
    found = ngrams(t, [n]).where(F.col("ngram") == pattern)
    by = found.groupBy("ctx").agg(F.count("*").alias("occurrences"), F.countDistinct("seq").alias("sequences"))
    total = by.agg(F.sum("occurrences").alias("_total"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", r6(F.col("occurrences") / F.col("_total"))).drop("_total")


def query_ngrams(t: DataFrame, sizes, least: int = 1, most: int | None = None, ctx: object | None = None, limit: int = 100) -> DataFrame:
    """N-grams by frequency, filters always applied (Q6)."""
    found = ngrams(t if ctx is None else t.where(F.col("ctx") == ctx), sizes).groupBy("n", "ngram").agg(F.count("*").alias("occurrences"))
    found = found.where(F.col("occurrences") >= least)
    if most is not None:
        found = found.where(F.col("occurrences") <= most)
    return found.orderBy(F.desc("occurrences"), "n", "ngram").limit(limit)


def shared_bigrams(t: DataFrame, ks: list[int], least: int) -> DataFrame:
    """Per k the different bigrams of (token mod k) that ``least`` or more sequences hold; one job for all k."""
    pairs = bigrams(t).select("seq", F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    held = pairs.groupBy("k", F.pmod("a", "k").alias("a"), F.pmod("b", "k").alias("b")).agg(F.countDistinct("seq").alias("s"))
    return held.groupBy("k").agg(F.count_if(F.col("s") >= least).alias("score"))


def optimal_k(t: DataFrame, ks: list[int], least: int) -> DataFrame:
    """The k of the greatest score; ties: the smallest."""
    return shared_bigrams(t, ks, least).orderBy(F.desc("score"), "k").limit(1)


def summary(t: DataFrame, sizes) -> DataFrame:
    """Totals of a corpus."""
    c = ngram_counts(t, [1, *sizes])
    return c.agg(
        F.sum(F.when(F.col("n") == 1, F.col("occurrences"))).alias("tokens"), F.count_if(F.col("n") == 1).alias("types"),
        F.count_if(F.col("n") > 1).alias("ngrams"), F.count_if((F.col("n") > 1) & (F.col("occurrences") == 1)).alias("once"),
    )


def pmi(t: DataFrame) -> DataFrame:
    """(src, dst, n, pmi) in nats over neighbouring pairs; unigram and bigram totals each for itself. Unseen: no row."""
    uni = t.groupBy("token").agg(F.count("*").alias("c"))
    uni = uni.crossJoin(F.broadcast(uni.agg(F.sum("c").alias("total")))).withColumn("p", F.col("c") / F.col("total"))
    bi = bigrams(t).groupBy("src", "dst").agg(F.count("*").alias("n"))
    bi = bi.crossJoin(F.broadcast(bi.agg(F.sum("n").alias("total")))).withColumn("pb", F.col("n") / F.col("total"))
    a, b = uni.select(F.col("token").alias("src"), F.col("p").alias("pa")), uni.select(F.col("token").alias("dst"), F.col("p").alias("pd"))
    return bi.join(a, "src").join(b, "dst").select("src", "dst", "n", r6(F.log(F.col("pb") / (F.col("pa") * F.col("pd")))).alias("pmi"))


def average_pmi(t: DataFrame, n: int) -> DataFrame:
    """Mean PMI of the transitions inside every n-gram that occurs."""
    grams = ngram_counts(t, [n]).select("ngram", F.posexplode(F.split("ngram", " ")).alias("at", "src"))
    steps = grams.withColumn("dst", F.lead("src").over(W.partitionBy("ngram").orderBy("at"))).where("dst is not null")
    return steps.join(pmi(t), ["src", "dst"]).groupBy("ngram").agg(r6(F.avg("pmi")).alias("avg_pmi"))


def _entropy(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Entropy in nats of n within key."""
    p = F.col(n) / F.sum(n).over(W.partitionBy(key))
    return counts.withColumn("_p", p).groupBy(key).agg(r6(-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"))


def suffix_entropy(t: DataFrame, n: int) -> DataFrame:
    """Entropy (nats) of the token after each n-gram; the divisor is all its occurrences, those that end a sequence too."""
    grams = ngrams(t, [n]).select("seq", (F.col("pos") + n).alias("pos"), "ngram")
    after = grams.join(t.select("seq", "pos", "token"), ["seq", "pos"], "left").groupBy("ngram", "token").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy("ngram"))
    return after.withColumn("p", p).groupBy("ngram").agg(r6(F.coalesce(-F.sum(F.when(F.col("token").isNotNull(), F.col("p") * F.log("p"))), F.lit(0.0))).alias("entropy"))


def discover(t: DataFrame, n: int, least: int) -> DataFrame:
    """N-grams of enough occurrences by rigidity (mean PMI) plus flexibility (suffix entropy)."""
    often = ngram_counts(t, [n]).where(F.col("occurrences") >= least).select("ngram", "occurrences")
    return often.join(average_pmi(t, n), "ngram").join(suffix_entropy(t, n), "ngram").withColumn("score", r6(F.col("avg_pmi") + F.col("entropy")))


def context_windows(t: DataFrame, pattern: str, reach: int = 2) -> DataFrame:
    """(seq, pos, window) around every match of a pattern, matches at a sequence's end included."""
    n = len(pattern.split(" "))
    w = in_order().rowsBetween(-reach, n - 1 + reach)
    around = t.withColumn("window", F.concat_ws(" ", F.collect_list("token").over(w)))
    return ngrams(t, [n]).where(F.col("ngram") == pattern).select("seq", "pos").join(around.select("seq", "pos", "window"), ["seq", "pos"])


def motifs(t: DataFrame, most: int, least: int) -> DataFrame:
    """Per sequence of 4 or more tokens, patterns of length 2..min(most, half of it) with their count and first place."""
    size = t.groupBy("seq").agg(F.count("*").alias("size")).where("size >= 4")
    found = ngrams(t, range(2, most + 1)).join(size, "seq").where("n <= floor(size / 2)")
    return found.groupBy("seq", "n", "ngram").agg(F.count("*").alias("occurrences"), F.min("pos").alias("first")).where(F.col("occurrences") >= least)


def ngram_stats(t: DataFrame) -> DataFrame:
    """Per sequence and n (2, 3): different n-grams and their entropy in bits."""
    c = ngrams(t, [2, 3]).groupBy("seq", "n", "ngram").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy("seq", "n"))
    return c.withColumn("p", p).groupBy("seq", "n").agg(F.count("*").alias("different"), r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def unigram_perplexity(t: DataFrame) -> DataFrame:
    """2 ** entropy of each sequence's unigrams."""
    c = t.groupBy("seq", "token").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy("seq"))
    return c.withColumn("p", p).groupBy("seq").agg(r6(F.pow(F.lit(2.0), -F.sum(F.col("p") * F.log2("p")))).alias("perplexity"))


def transition_matrix(t: DataFrame) -> DataFrame:
    """(src, dst, n, p), p normalised per source."""
    c = bigrams(t).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return c.withColumn("p", r6(F.col("n") / F.sum("n").over(W.partitionBy("src"))))


def smoothed_perplexity(t: DataFrame, n: int) -> DataFrame:
    """exp(-sum c ln(c / context + 1 / (V + 1)) / N) over n-grams."""
    c = ngrams(t, [n]).groupBy("ngram").agg(F.count("*").alias("c")).withColumn("head", F.regexp_replace("ngram", " [^ ]*$", ""))
    v = t.agg(F.countDistinct("token").alias("v"))
    c = c.withColumn("ctx_n", F.sum("c").over(W.partitionBy("head"))).crossJoin(F.broadcast(v))
    return c.agg(r6(F.exp(-F.sum(F.col("c") * F.log(F.col("c") / F.col("ctx_n") + 1 / (F.col("v") + 1))) / F.sum("c"))).alias("perplexity"))


def edit_distance(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edit distance of two token arrays and 1 - d / longer (both empty: 1).

    Tokens of the two arrays are numbered and each number becomes a character, so the JVM's levenshtein does the work.
    """
    vocab = F.array_distinct(F.concat(a, b))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.char(F.array_position(F.col("_vocab"), x).cast("int") + F.lit(33))), "")
    out = df.withColumn("_vocab", vocab).withColumn("distance", F.levenshtein(as_text(F.col(a)), as_text(F.col(b))))
    longer = F.greatest(F.size(a), F.size(b))
    return out.withColumn("similarity", r6(F.when(longer == 0, 1.0).otherwise(1 - F.col("distance") / longer))).drop("_vocab")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; both empty: 1."""
    union = F.size(F.array_union(a, b))
    return r6(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union))


def zipf(counts: DataFrame) -> DataFrame:
    """A12, A13 over counts(token, c): slope and R2 of ln frequency on ln rank, and |Pearson|; under 3 types 0."""
    ranked = numbered(counts, [F.desc("c"), "token"], "rank").withColumn("x", F.log(F.col("rank") + 1)).withColumn("y", F.log("c"))
    few = F.count("*") < 3
    pick = lambda c: r6(F.when(few, 0.0).otherwise(F.coalesce(c, F.lit(0.0))))
    return ranked.agg(pick(F.regr_slope("y", "x")).alias("slope"), pick(F.regr_r2("y", "x")).alias("r2"), pick(F.abs(F.corr("x", "y"))).alias("correlation"))


def linguistic_structure(t: DataFrame, shuffled: DataFrame, zipf_least: float = 0.9, singletons: float = 0.1, reuse: float = 2.0) -> DataFrame:
    """Four tests of a quarter each: Zipf correlation, singleton rate, perplexity under the shuffled corpus', reuse ratio."""
    c = t.groupBy("token").agg(F.count("*").alias("c"))
    marks = c.agg(r6(F.avg((F.col("c") == 1).cast("double"))).alias("singleton_rate"), r6(F.sum("c") / F.count("*")).alias("reuse_ratio"))
    both = zipf(c).select("correlation").crossJoin(marks).crossJoin(smoothed_perplexity(t, 2)).crossJoin(smoothed_perplexity(shuffled, 2).withColumnRenamed("perplexity", "shuffled_perplexity"))
    tests = [F.col("correlation") >= zipf_least, F.col("singleton_rate") >= singletons, F.col("perplexity") < F.col("shuffled_perplexity"), F.col("reuse_ratio") >= reuse]
    score = sum((x.cast("double") * 0.25 for x in tests), F.lit(0.0))
    return both.withColumn("score", score)


def shuffled(t: DataFrame) -> DataFrame:
    """W26's baseline: the tokens of all sequences dealt over the same places in the order of a hash."""
    places = numbered(t.select("seq", "pos"), ["seq", "pos"], "k")
    dealt = numbered(t.select("token", "seq", "pos", F.md5(F.concat_ws("-", "seq", "pos")).alias("draw")), ["draw", "seq", "pos"], "k")
    return places.join(dealt.select("token", "k"), "k").select("seq", "pos", "token")


def turn_taking(t: DataFrame) -> DataFrame:
    """W28 (token: speaker): per sequence turns, switches, share of switches, ABA returns and longest run; order is pos (Q11)."""
    before, two = F.lag("token").over(in_order()), F.lag("token", 2).over(in_order())
    marked = t.select("seq", "pos", "token", before.alias("b1"), two.alias("b2")).withColumn("switch", (F.col("b1") != F.col("token")).cast("int"))
    runs = marked.withColumn("run", F.sum(F.coalesce("switch", F.lit(0))).over(in_order()))
    longest = runs.groupBy("seq", "run").agg(F.count("*").alias("k")).groupBy("seq").agg(F.max("k").alias("longest_run"))
    out = marked.groupBy("seq").agg(
        F.count("*").alias("turns"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches"), F.countDistinct("token").alias("speakers"),
        F.count_if((F.col("b2") == F.col("token")) & (F.col("b1") != F.col("token"))).alias("returns"),
    )
    return out.join(longest, "seq").withColumn("switch_rate", r6(F.when(F.col("turns") > 1, F.col("switches") / (F.col("turns") - 1)).otherwise(0.0)))


def phonotactics(t: DataFrame, rare: float = 0.01) -> DataFrame:
    """Transitions with p below ``rare`` (observed pairs; see laplace_matrix for those never seen, Q14)."""
    return transition_matrix(t).where(F.col("p") < rare)


def gap_sessions(df: DataFrame, key: str, time: str, gap: float, min_size: int = 1) -> DataFrame:
    """Sessions where a start lies more than ``gap`` after the one before (exactly gap: same session); nulls dropped (Q18)."""
    w = W.partitionBy(key).orderBy(time)
    begins = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    marked = df.where(F.col(time).isNotNull()).withColumn("session", F.sum(F.coalesce(begins, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.count("*").alias("size"), F.min(time).alias("start"), F.max(time).alias("stop")).where(F.col("size") >= min_size)


def anchored_windows(df: DataFrame, key: str, time: str, width: float) -> DataFrame:
    """Groups anchored at their first row: a row opens a group if it lies more than ``width`` after the group's start.

    Sequential by nature; an ordered fold per key, in the JVM, over its times.
    """
    times = df.groupBy(key).agg(F.array_sort(F.collect_list(time)).alias("times"))
    step = F.expr(f"aggregate(times, array(named_struct('anchor', cast(null as double), 'time', cast(null as double))), (a, t) -> concat(a, array(named_struct('anchor', if(a[size(a) - 1].anchor is null or t - a[size(a) - 1].anchor > {width}D, cast(t as double), a[size(a) - 1].anchor), 'time', cast(t as double)))))")
    rows = times.select(key, F.explode(step).alias("x")).where("x.time is not null")
    return rows.groupBy(key, F.col("x.anchor").alias("anchor")).agg(F.count("*").alias("size"), F.max("x.time").alias("stop"))


def response_rate(t: DataFrame, system: str, animal: str, time: str | None = None, timeout: float | None = None) -> DataFrame:
    """Share of ``system`` rows whose next row is ``animal``'s, within the timeout if one is given (Q12)."""
    nxt = F.lead("token").over(in_order())
    ok = nxt == animal
    if timeout is not None:
        ok = ok & (F.lead(time).over(in_order()) - F.col(time) <= timeout)
    said = t.withColumn("ok", F.coalesce(ok, F.lit(False))).where(F.col("token") == system)
    return said.agg(F.count("*").alias("said"), F.count_if(F.col("ok")).alias("answered"), r6(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0))).alias("ras"))


def laplace_matrix(t: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed probability of every pair of the vocabulary, seen or not. The vocabulary squared is its size."""
    v = t.select("token").distinct()
    pairs = v.select(F.col("token").alias("src")).crossJoin(v.select(F.col("token").alias("dst")))
    c = bigrams(t).groupBy("src", "dst").agg(F.count("*").alias("n"))
    full = pairs.join(c, ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.partitionBy("src")
    return full.withColumn("p", r6((F.col("n") + alpha) / (F.sum("n").over(w) + alpha * F.count("*").over(w))))


def next_tokens(t: DataFrame, k: int) -> DataFrame:
    """Per token its k most probable successors."""
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return transition_matrix(t).withColumn("rank", rank).where(F.col("rank") <= k)


def row_entropy(t: DataFrame) -> DataFrame:
    """Entropy (nats) of each token's successors."""
    return _entropy(bigrams(t).groupBy("src", "dst").agg(F.count("*").alias("n")), "src")


def padded_bigrams(t: DataFrame, begin: str = "<s>", end: str = "</s>") -> DataFrame:
    """Bigram counts with a begin and an end token around every sequence."""
    first = t.groupBy("seq").agg(F.min_by("token", "pos").alias("dst"), F.max_by("token", "pos").alias("src"))
    edges = bigrams(t).select("src", "dst").unionByName(first.select(F.lit(begin).alias("src"), "dst")).unionByName(first.select("src", F.lit(end).alias("dst")))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def sequence_log_prob(t: DataFrame, begin: str = "<s>") -> DataFrame:
    """Per sequence the sum of ln p of its steps (begin token first, no end) and exp(-mean)."""
    model = padded_bigrams(t, begin).where("dst <> '</s>'")
    model = model.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("src"))).select("src", "dst", "p")
    steps = t.select("seq", F.coalesce(F.lag("token").over(in_order()), F.lit(begin)).alias("src"), F.col("token").alias("dst"))
    return steps.join(model, ["src", "dst"]).groupBy("seq").agg(r6(F.sum(F.log("p"))).alias("log_prob"), r6(F.exp(-F.avg(F.log("p")))).alias("perplexity"))


def conditional_rules(t: DataFrame, n: int) -> DataFrame:
    """(prefix, next, n, p): probability of the last token given the n-gram's others."""
    c = ngrams(t, [n]).groupBy("ngram").agg(F.count("*").alias("n"))
    c = c.select(F.regexp_replace("ngram", " [^ ]*$", "").alias("prefix"), F.substring_index("ngram", " ", -1).alias("next"), "n")
    return c.withColumn("p", r6(F.col("n") / F.sum("n").over(W.partitionBy("prefix"))))


def both_orders(t: DataFrame) -> DataFrame:
    """Among sequences of length 2, pairs seen in both orders, with the count of the given order (a < b)."""
    two = t.groupBy("seq").agg(F.count("*").alias("size"), F.min_by("token", "pos").alias("a"), F.max_by("token", "pos").alias("b")).where("size = 2")
    c = two.groupBy("a", "b").agg(F.count("*").alias("n"))
    back = c.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("reverse_n"))
    return c.join(back, ["a", "b"]).where("a < b")


def surprise(t: DataFrame) -> DataFrame:
    """Per step -log2(p + 1e-10) of the token given the one before, and the token's rank among its successors."""
    m = transition_matrix(t).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst")))
    m = m.withColumn("q", F.col("n") / F.sum("n").over(W.partitionBy("src")))
    return bigrams(t).join(m.select("src", "dst", "q", "rank"), ["src", "dst"]).select("seq", "pos", "src", "dst", r6(-F.log2(F.col("q") + 1e-10)).alias("surprise"), "rank")


def surprise_profile(t: DataFrame) -> DataFrame:
    """Per sequence mean and deviation of its surprise and how many steps lie over 2 deviations above or below."""
    s = surprise(t)
    w = W.partitionBy("seq")
    z = F.try_divide(F.col("surprise") - F.avg("surprise").over(w), F.stddev_pop("surprise").over(w))
    return s.withColumn("z", F.round(z, 6)).groupBy("seq").agg(r6(F.avg("surprise")).alias("mean"), r6(F.stddev_pop("surprise")).alias("std"), F.count_if(F.col("z") > 2).alias("high"), F.count_if(F.col("z") < -2).alias("low"))


def surprise_over_time(t: DataFrame, width: int) -> DataFrame:
    """Running mean of the surprise over the last ``width`` places of a sequence."""
    w = W.partitionBy("seq").orderBy("pos").rangeBetween(-(width - 1), 0)
    return surprise(t).withColumn("running", r6(F.avg("surprise").over(w))).select("seq", "pos", "running")


def joint_perplexity(t: DataFrame, n: int) -> DataFrame:
    """Exp of the mean -ln of the smoothed joint probability (c + 1) / (N + D), D the different n-grams."""
    c = ngrams(t, [n]).groupBy("ngram").agg(F.count("*").alias("c"))
    return c.withColumn("p", (F.col("c") + 1) / (F.sum("c").over(W.partitionBy()) + F.count("*").over(W.partitionBy()))).agg(r6(F.exp(-F.sum(F.col("c") * F.log("p")) / F.sum("c"))).alias("perplexity"))


def context_perplexity(t: DataFrame, n: int) -> DataFrame:
    """Joint perplexity per context (of its own n-grams), and relative to that of the whole corpus (Q16)."""
    c = ngrams(t, [n]).groupBy("ctx", "ngram").agg(F.count("*").alias("c"))
    w = W.partitionBy("ctx")
    c = c.withColumn("p", (F.col("c") + 1) / (F.sum("c").over(w) + F.count("*").over(w)))
    per = c.groupBy("ctx").agg(F.exp(-F.sum(F.col("c") * F.log("p")) / F.sum("c")).alias("x"))
    return per.crossJoin(F.broadcast(joint_perplexity(t, n).withColumnRenamed("perplexity", "whole"))).select("ctx", r6("x").alias("perplexity"), r6(F.col("x") / F.col("whole")).alias("relative"))


def edge_motifs(t: DataFrame, k: int, least: int) -> DataFrame:
    """Windows of k transitions with their count against the count that independent transitions would give (Q17)."""
    grams = ngrams(t, [k + 1]).groupBy("ngram").agg(F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)
    total = t.agg(F.count("*").alias("total"))
    uni = t.groupBy("token").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("token", F.log(F.col("c") / F.col("total")).alias("lp"), "total")
    parts = grams.select("ngram", "occurrences", F.explode(F.split("ngram", " ")).alias("token")).join(uni, "token")
    e = parts.groupBy("ngram", "occurrences").agg((F.exp(F.sum("lp")) * F.max("total")).alias("expected"))
    return e.select("ngram", "occurrences", r6((F.col("occurrences") - F.col("expected")) / F.sqrt("expected")).alias("z"))


def discover_rules(t: DataFrame, least: float) -> DataFrame:
    """Transitions with a PMI of ``least`` or more."""
    return pmi(t).where(F.col("pmi") >= least)


def modal_tokens(t: DataFrame) -> DataFrame:
    """The most frequent token of each place (ties: least token)."""
    c = t.groupBy("pos", "token").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(W.partitionBy("pos").orderBy(F.desc("n"), "token"))).where("k = 1").select("pos", "token", "n")


def context_transitions(t: DataFrame, top: int) -> DataFrame:
    """Per context its most frequent transitions."""
    c = bigrams(t).groupBy("ctx", "src", "dst").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("ctx").orderBy(F.desc("n"), "src", "dst"))).where(F.col("rank") <= top)


def segment_roles(t: DataFrame, share: float = 0.7, successors: int = 5) -> DataFrame:
    """Per token the share of bigram slots that it opens, its different successors, and its role."""
    b = bigrams(t)
    slots = b.select(F.col("src").alias("token"), F.lit(1).alias("opens"), F.col("dst").alias("succ")).unionByName(b.select(F.col("dst").alias("token"), F.lit(0).alias("opens"), F.lit(None).cast("string").alias("succ")))
    out = slots.groupBy("token").agg(r6(F.avg("opens")).alias("open_share"), F.countDistinct("succ").alias("successors"))
    role = F.when(F.col("open_share") > share, "opener").when(F.col("open_share") < 1 - share, "closer").when(F.col("successors") > successors, "function").otherwise("content")
    return out.withColumn("role", role)


def dyads(df: DataFrame, emitter: str, addressee: str, order: list[str], token: str) -> DataFrame:
    """Per pair of ids calls, first and last token; an emitter of 0 is unknown and dropped."""
    at = F.struct(*order)
    return df.where(F.col(emitter) != 0).groupBy(emitter, addressee).agg(F.count("*").alias("calls"), F.min_by(token, at).alias("opener"), F.max_by(token, at).alias("closer"))


def find_pattern(t: DataFrame, pattern: list[str]) -> DataFrame:
    """Places where a token pattern begins."""
    return ngrams(t, [len(pattern)]).where(F.col("ngram") == " ".join(pattern)).select("seq", "pos")


def quantized(vector: Column, bins: int, vocabulary: int = 1020) -> Column:
    """A vector's token: its binned components folded with base 31, modulo the vocabulary."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + F.floor(x.cast("double") * bins).cast("long"), F.lit(vocabulary)))


def runs(t: DataFrame) -> DataFrame:
    """(seq, run, token, length) of maximal runs of one token."""
    marked = t.withColumn("new", (F.coalesce(F.lag("token").over(in_order()) != F.col("token"), F.lit(True))).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(in_order().rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("seq", "run").agg(F.first("token").alias("token"), F.count("*").alias("length"))


def alternation(t: DataFrame) -> DataFrame:
    """Per sequence the mean run length and the share of steps that change the token."""
    r = runs(t).groupBy("seq").agg(F.count("*").alias("runs"), F.sum("length").alias("size"))
    return r.select("seq", "runs", r6(F.col("size") / F.col("runs")).alias("mean_run"), r6(F.when(F.col("size") > 1, (F.col("runs") - 1) / (F.col("size") - 1)).otherwise(0.0)).alias("alternation"))


def common_patterns(t: DataFrame, least_n: int, least: int, top: int = 20) -> DataFrame:
    """N-grams of length m..m+3, shorter than their sequence, by count."""
    size = t.groupBy("seq").agg(F.count("*").alias("size"))
    c = ngrams(t, range(least_n, least_n + 4)).join(size, "seq").where("n < size").groupBy("n", "ngram").agg(F.count("*").alias("occurrences"))
    return c.where(F.col("occurrences") >= least).orderBy(F.desc("occurrences"), "n", "ngram").limit(top)


def finite_differences(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Forward difference (last value repeated) and central difference / 2 with one-sided ends; a single row has 0."""
    w = W.partitionBy(key).orderBy(order)
    fwd, back = F.lead(value).over(w) - F.col(value), F.col(value) - F.lag(value).over(w)
    return df.select(key, order, r6(F.coalesce(fwd, back, F.lit(0.0))).alias("n1"), r6(F.when(fwd.isNotNull() & back.isNotNull(), (fwd + back) / 2).otherwise(F.coalesce(fwd, back, F.lit(0.0)))).alias("n2"))


def causal_chain(entries: DataFrame, start: object, depth: int = 32) -> DataFrame:
    """(id, depth) of the ancestors of an entry in entries(id, parents array); each once at its least depth, capped (Q15)."""
    edges = entries.select("id", F.explode("parents").alias("parent"))
    seen = entries.where(F.col("id") == start).select("id", F.lit(0).alias("depth"))
    edge = seen
    for d in range(1, depth + 1):
        edge = edge.select("id").join(edges, "id").select(F.col("parent").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        edge = cut(edge)
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen

"""Aggregations and statistics over labelled rows.

Population and sample moments are named; a group with nothing to divide by gives 0; ties go to the lower key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .blocks import group_distances
from .sequences import in_order, r6


def all_rows():
    """The window of all rows; only of few, aggregated ones."""
    return W.partitionBy()


def library_statistics(phrases: DataFrame) -> DataFrame:
    """A1: per species, per modality and overall (grouping sets): count, least, greatest and mean pitch and duration."""
    return phrases.groupingSets([["species"], ["modality"], []], "species", "modality").agg(
        F.count("*").alias("n"), F.min("f0").alias("min_f0"), F.max("f0").alias("max_f0"), r6(F.avg("f0")).alias("avg_f0"), r6(F.avg("duration_ms")).alias("avg_duration"),
    )


def grammar_network(edges: DataFrame, k: int = 10) -> DataFrame:
    """A2: the k nodes of greatest degree in edges(src, dst, n), with their weight; duplicates are summed (Q4)."""
    e = edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"), "n")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("n").alias("weight")).orderBy(F.desc("degree"), "node").limit(k)


def database_info(phrases: DataFrame) -> DataFrame:
    """A3."""
    return phrases.agg(F.count("*").alias("phrases"), F.countDistinct("species").alias("species"), F.countDistinct("modality").alias("modalities"), F.sum("occurrences").alias("occurrences"))


def metric_statistics(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A4, A5: count, mean, population deviation, least, greatest, median."""
    return df.groupBy(*(by or [])).agg(F.count(value).alias("n"), r6(F.avg(value)).alias("mean"), r6(F.stddev_pop(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), r6(F.median(value)).alias("median"))


def variants(df: DataFrame, variant: str, success: str) -> DataFrame:
    """Per variant totals, success rate, Wilson interval."""
    out = df.groupBy(F.col(variant).alias("variant")).agg(F.count("*").alias("n"), F.count_if(F.col(success)).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": r6(F.col("k") / F.col("n")), "low": r6(low), "high": r6(high)})


def pairwise_z(v: DataFrame) -> DataFrame:
    """Pooled two-proportion z and two-sided p of every pair of variants (rows are variants, few)."""
    a, b = (v.select(F.col("variant").alias(x), F.col("n").alias(f"{x}n"), F.col("k").alias(f"{x}k")) for x in "ab")
    pool = (F.col("ak") + F.col("bk")) / (F.col("an") + F.col("bn"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("an") + 1 / F.col("bn")))
    z = F.coalesce(F.try_divide(F.col("ak") / F.col("an") - F.col("bk") / F.col("bn"), se), F.lit(0.0))
    p = stats.udf(lambda x: 2 * (1 - stats.normal_cdf(abs(x))))
    return a.join(b, F.col("a") < F.col("b")).withColumn("z", r6(z)).select("a", "b", "z", r6(p("z")).alias("p"))


def social_network(df: DataFrame, emitter: str, addressee: str, k: int = 20) -> DataFrame:
    """A10: the k most frequent pairs with their count and the numbers of different emitters, addressees and pairs."""
    c = df.groupBy(emitter, addressee).agg(F.count("*").alias("n"))
    totals = c.agg(F.countDistinct(emitter).alias("emitters"), F.countDistinct(addressee).alias("addressees"), F.count("*").alias("pairs"))
    return c.orderBy(F.desc("n"), emitter, addressee).limit(k).crossJoin(F.broadcast(totals))


def context_switches(t: DataFrame) -> DataFrame:
    """Per context its tokens and how often the token differs from the one before."""
    m = t.withColumn("sw", (F.lag("token").over(in_order()) != F.col("token")).cast("double"))
    return m.groupBy("ctx").agg(F.count("*").alias("n"), r6(F.coalesce(F.avg("sw"), F.lit(0.0))).alias("switch_rate"))


def reuse(counts: DataFrame) -> DataFrame:
    """A14, A15 over counts(token, c): tokens per type and share of types seen once."""
    return counts.agg(r6(F.sum("c") / F.count("*")).alias("reuse"), r6(F.avg((F.col("c") == 1).cast("double"))).alias("singletons"))


def presence_pmi(t: DataFrame) -> DataFrame:
    """Ln PMI of a token's presence with its context, over (sequence, context) groups as units."""
    units = t.select("seq", "ctx").distinct()
    n = units.agg(F.count("*").alias("units"))
    has = t.select("seq", "ctx", "token").distinct()
    both = has.groupBy("token", "ctx").agg(F.count("*").alias("n_both"))
    tok = has.groupBy("token").agg(F.count("*").alias("n_tok"))
    ctx = units.groupBy("ctx").agg(F.count("*").alias("n_ctx"))
    out = both.join(tok, "token").join(ctx, "ctx").crossJoin(F.broadcast(n))
    return out.select("token", "ctx", r6(F.log(F.col("n_both") * F.col("units") / (F.col("n_tok") * F.col("n_ctx")))).alias("pmi"))


def contingency(df: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """(a, b, n, row, col, total, expected): counts of pairs with their margins, pairs never seen too."""
    n = F.count("*") if weight is None else F.sum(weight)
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))
    full = c.select("a").distinct().crossJoin(c.select("b").distinct()).join(c, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = full.withColumns({"row": F.sum("n").over(W.partitionBy("a")), "col": F.sum("n").over(W.partitionBy("b")), "total": F.sum("n").over(all_rows())})
    return full.withColumn("expected", F.col("row") * F.col("col") / F.col("total"))


def mutual_information(c: DataFrame) -> DataFrame:
    """Contribution of each a to the mutual information (bits) with b."""
    part = F.when(F.col("n") > 0, F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("expected"))).otherwise(0.0)
    return c.groupBy("a").agg(r6(F.sum(part)).alias("mi"))


def specificity(df: DataFrame, token: str, flag: Column, least: int = 10, band: float = 0.2) -> DataFrame:
    """Share of a flag per token minus its base rate, banded; tokens under ``least`` rows are dropped."""
    base = df.agg(F.avg(flag.cast("double")).alias("base"))
    per = df.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate")).where(F.col("n") >= least)
    out = per.crossJoin(F.broadcast(base)).withColumn("specificity", r6(F.col("rate") - F.col("base")))
    return out.select("token", "n", "specificity", F.when(F.col("specificity") > band, "specific").when(F.col("specificity") < -band, "avoided").otherwise("neutral").alias("band"))


def chi_square(c: DataFrame) -> DataFrame:
    """Chi-squared, degrees of freedom, p, Cramer's V of a contingency."""
    out = c.agg(F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("x"), F.countDistinct("a").alias("ra"), F.countDistinct("b").alias("rb"), F.max("total").alias("total"))
    dof, least = (F.col("ra") - 1) * (F.col("rb") - 1), F.least(F.col("ra"), F.col("rb")) - 1
    p = stats.udf(lambda x, d: stats.chi2_sf(x, d) if d else 1.0)
    return out.select(r6("x").alias("chi2"), dof.alias("dof"), r6(p("x", dof.cast("double"))).alias("p"), r6(F.coalesce(F.sqrt(F.try_divide("x", F.col("total") * least)), F.lit(0.0))).alias("cramers_v"))


def residuals(c: DataFrame) -> DataFrame:
    """(observed - expected) / sqrt(expected) per cell."""
    return c.select("a", "b", "n", r6((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("residual"))


def enrichment(c: DataFrame) -> DataFrame:
    """log2(observed / expected), -inf where nothing was observed."""
    return c.select("a", "b", F.when(F.col("n") == 0, float("-inf")).otherwise(r6(F.log2(F.col("n") / F.col("expected")))).alias("enrichment"))


def fisher(c: DataFrame) -> DataFrame:
    """One-sided Fisher exact p of every observed cell against all else, Bonferroni over all cells."""
    f = stats.udf(lambda a, b, x, d: stats.fisher_greater(int(a), int(b), int(x), int(d)))
    rest = F.col("total") - F.col("row") - F.col("col") + F.col("n")
    out = c.withColumn("cells", F.count("*").over(all_rows())).where("n > 0").withColumn("p", f("n", F.col("row") - F.col("n"), F.col("col") - F.col("n"), rest))
    return out.select("a", "b", r6("p").alias("p"), r6(F.least(F.lit(1.0), F.col("p") * F.col("cells"))).alias("adjusted"))


def uniformity(edges: DataFrame) -> DataFrame:
    """Chi-squared of the sources' totals in edges(src, n) against equal shares, p by Wilson and Hilferty's cube root."""
    s = edges.groupBy("src").agg(F.sum("n").alias("n"))
    mean = F.avg("n").over(all_rows())
    out = s.withColumn("part", (F.col("n") - mean) ** 2 / mean).agg(F.sum("part").alias("x"), (F.count("*") - 1).alias("dof"))

    def wh(x, d):
        return 1 - stats.normal_cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / (2 / (9 * d)) ** 0.5) if d else 1.0

    return out.select(r6("x").alias("chi2"), "dof", r6(stats.udf(wh)("x", F.col("dof").cast("double"))).alias("p"))


def binary_metrics(df: DataFrame, pred: Column, label: Column) -> DataFrame:
    """Counts with classes above 0 as positive; a wrong class above 0 is a false positive."""
    hit = pred == label
    c = df.agg(F.count_if(hit & (label > 0)).alias("tp"), F.count_if(hit & (label <= 0)).alias("tn"), F.count_if(~hit & (pred > 0)).alias("fp"), F.count_if(~hit & (pred <= 0)).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.withColumns({"accuracy": r6(ratio(tp + tn, tp + tn + fp + fn)), "precision": r6(p), "recall": r6(r), "f1": r6(ratio(2 * p * r, p + r))})


def class_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Per class precision, recall, F1, support, with macro and support-weighted F1 on each row."""
    cells = df.groupBy(F.col(pred).alias("p"), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    rows = cells.select(F.explode(F.array(F.struct(F.col("p").alias("c"), F.col("n").alias("said"), F.lit(0).cast("long").alias("is"), F.when(F.col("p") == F.col("l"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("l").alias("c"), F.lit(0).cast("long").alias("said"), F.col("n").alias("is"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = rows.groupBy(F.col("c").alias("class")).agg(F.sum("said").alias("said"), F.sum("is").alias("support"), F.sum("hit").alias("hit"))
    z = F.lit(0.0)
    per = per.withColumns({"precision": F.coalesce(F.try_divide("hit", "said"), z), "recall": F.coalesce(F.try_divide("hit", "support"), z)})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), z))
    macro = F.avg(F.when(F.col("support") > 0, F.col("f1"))).over(all_rows())
    weighted = F.sum(F.col("f1") * F.col("support")).over(all_rows()) / F.sum("support").over(all_rows())
    return per.select("class", "support", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"), r6(macro).alias("macro_f1"), r6(weighted).alias("weighted_f1"))


def moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation, skew and excess kurtosis as means of ((x - mean) / sample deviation)^k, range, index quartile range."""
    w = W.partitionBy(key)
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    a = df.withColumn("_z", F.coalesce(z, F.lit(0.0)))
    n = F.count("*")
    v = F.array_sort(F.collect_list(value))
    at = lambda k: F.get(v, F.floor(n * k / 4).cast("int"))
    iqr = F.when(n < 4, F.max(value) - F.min(value)).otherwise(at(3) - at(1))
    return a.groupBy(key).agg(r6(F.avg(value)).alias("mean"), r6(F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), r6(F.avg(F.col("_z") ** 3)).alias("skew"), r6(F.avg(F.col("_z") ** 4) - 3).alias("kurtosis"), r6(F.max(value) - F.min(value)).alias("range"), r6(iqr).alias("iqr"))


def intervals(df: DataFrame, key: str, time: str) -> DataFrame:
    """Mean, sample deviation, variation, tempo (per minute) and trend (slope on the index) of the gaps between a key's times in s."""
    w = W.partitionBy(key).orderBy(time)
    g = df.withColumn("gap", F.col(time) - F.lag(time).over(w)).withColumn("i", F.row_number().over(w)).where("gap is not null")
    sd = F.coalesce(F.stddev_samp("gap"), F.lit(0.0))
    return g.groupBy(key).agg(F.count("*").alias("n"), r6(F.avg("gap")).alias("mean"), r6(sd).alias("std"), r6(sd / F.avg("gap")).alias("cv"), r6(60 / F.avg("gap")).alias("tempo"), r6(F.coalesce(F.regr_slope("gap", "i"), F.lit(0.0))).alias("trend"))


def prosody(df: DataFrame, key: str, start: str, stop: str) -> DataFrame:
    """Variation (population) of the positive gaps between ordered phrases and its band."""
    gap = F.lead(start).over(W.partitionBy(key).orderBy(start)) - F.col(stop)
    out = df.withColumn("gap", gap).where("gap > 0").groupBy(key).agg(r6(F.stddev_pop("gap") / F.avg("gap")).alias("cv"))
    return out.withColumn("band", F.when(F.col("cv") < 0.3, "regular").when(F.col("cv") < 0.7, "variable").otherwise("irregular"))


def latencies(df: DataFrame, key: str, latency: str, low: float, high: float, rapid: float) -> DataFrame:
    """Per key mean and population deviation of the latency, share inside [low, high] and share under ``rapid``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), r6(F.avg(latency)).alias("mean"), r6(F.stddev_pop(latency)).alias("std"), r6(F.avg(F.col(latency).between(low, high).cast("double"))).alias("valid"), r6(F.avg((F.col(latency) < rapid).cast("double"))).alias("rapid"))


def student(df: DataFrame, condition: str, value: str, a: object, b: object) -> DataFrame:
    """Student's t (equal variances), two-sided p and effect (mean gap over the root of the mean population variance)."""
    pick = lambda f, x: f(F.when(F.col(condition) == x, F.col(value)))
    m = df.agg(*[pick(f, x).alias(f"{n}{k}") for k, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp), ("p", F.var_pop))])
    dof = F.col("na") + F.col("nb") - 2
    pooled = ((F.col("na") - 1) * F.col("sa") + (F.col("nb") - 1) * F.col("sb")) / dof
    t = F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))), F.lit(0.0))
    effect = F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), F.sqrt((F.col("pa") + F.col("pb")) / 2)), F.lit(0.0))
    return m.select(r6(t).alias("t"), dof.alias("dof"), r6(stats.udf(stats.t_sf2)(t, dof.cast("double"))).alias("p"), r6(effect).alias("effect"))


def drift_by_category(df: DataFrame, map_col: str) -> DataFrame:
    """Mean of a map's values per key."""
    return df.select(F.explode(map_col).alias("category", "drift")).groupBy("category").agg(F.count("*").alias("n"), r6(F.avg("drift")).alias("mean"))


def latency_percentiles(df: DataFrame, value: str) -> DataFrame:
    """Interpolated p50, p95, p99, greatest and mean."""
    return df.agg(*[r6(F.percentile(value, p / 100)).alias(f"p{p}") for p in (50, 95, 99)], F.max(value).alias("max"), r6(F.avg(value)).alias("mean"))


def coverage(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Share of rows whose feature is above 0, per key and feature."""
    return df.select(key, *columns).unpivot(key, columns, "feature", "v").groupBy(key, "feature").agg(r6(F.avg((F.col("v") > 0).cast("double"))).alias("covered"))


def set_overlaps(df: DataFrame, group: str, item: str, least: float = 0.1) -> DataFrame:
    """Pairs of groups with Jaccard and overlap of their item sets; pairs that share nothing aren't made. Equi-join on the item."""
    d = df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    size = d.groupBy("g").agg(F.count("*").alias("size"))
    common = d.withColumnRenamed("g", "a").join(d.withColumnRenamed("g", "b"), "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = common.join(size.selectExpr("g as a", "size as sa"), "a").join(size.selectExpr("g as b", "size as sb"), "b")
    return out.select("a", "b", "common", r6(F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))).alias("jaccard"), r6(F.col("common") / F.least("sa", "sb")).alias("overlap")).withColumn("significant", F.col("overlap") > least)


def specific_pairs(df: DataFrame, token: str, ctx: str, share: float = 0.7) -> DataFrame:
    """(token, context) pairs that hold more than ``share`` of the token's rows."""
    c = df.groupBy(F.col(token).alias("token"), F.col(ctx).alias("ctx")).agg(F.count("*").alias("n"))
    return c.withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy("token")))).where(F.col("share") > share)


def argmax_matrix(scores: DataFrame, key: str, persona: str, score: str, contexts: DataFrame) -> DataFrame:
    """Each key's best persona (ties: least name) against the contexts(key, ctx, n) it occurs in."""
    best = scores.groupBy(key).agg(F.min_by(persona, F.struct(-F.col(score), F.col(persona))).alias("persona"))
    return best.join(contexts, key).groupBy("persona", "ctx").agg(F.sum("n").alias("n"))


def label_distances(rows: DataFrame) -> DataFrame:
    """Mean and least Euclidean distance of every label pair over rows(id, label, v); all pairs, block against block."""
    d = group_distances(rows)
    mean = F.coalesce("odd", F.try_divide(F.col("total").cast("double"), F.col("k")) / 1e6)
    return d.select("a", "b", "n", r6(mean).alias("mean"), r6(F.coalesce(F.col("least") / 1e6, "odd")).alias("least"))

"""Registered queries of the aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import vectors as v
from ..operators import aggregates as a
from ..operators import sequences as seq
from ..registry import query, table
from .join_queries import _IV, _VEC, _L2, intervals, vectors
from .library import CONTEXTS, PHRASES, phrases
from .sequence_queries import T, T23, events, numbers

P = f"with {PHRASES} "


def ev(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.floor(F.hour("ts") / 6).cast("long").alias("ctx"))


EV = "e as (select event_id, user_id, event_type, value, hour(ts) // 6 as ctx from events)"
query("a01_library_statistics", P + "select species, modality, count(*) as n, min(f0) as min_f0, max(f0) as max_f0, round(avg(f0), 6) as avg_f0, round(avg(duration_ms), 6) as avg_duration from phrases group by grouping sets ((species), (modality), ())")(lambda s, d: a.library_statistics(phrases(s, d)))
_EDGES = "ed as (select l_suppkey as src, l_partkey % 100 as dst, count(*) as n from lineitem group by all)"
query("a02_grammar_network", f"with {_EDGES}, x as (select src as node, n from ed union all select dst, n from ed) select node, count(*) as degree, sum(n)::bigint as weight from x group by node order by degree desc, node limit 10")(lambda s, d: a.grammar_network(table(s, d, "lineitem").selectExpr("l_suppkey as src", "l_partkey % 100 as dst", "1 as n")))
query("a03_database_info", P + "select count(*) as phrases, count(distinct species) as species, count(distinct modality) as modalities, sum(occurrences)::bigint as occurrences from phrases")(lambda s, d: a.database_info(phrases(s, d)))
_MS = "count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, round(median(value), 6) as median"
query("a04_metric_statistics", f"select {_MS} from events")(lambda s, d: a.metric_statistics(ev(s, d), "value"))
query("a05_compare_conditions", f"select event_type, {_MS} from events group by 1")(lambda s, d: a.metric_statistics(ev(s, d), "value", ["event_type"]))
_VAR = "va as (select event_type as variant, count(*) as n, count(*) filter (value > 20) as k from events group by 1)"
_PZ = "pz as (select x.variant as a, y.variant as b, x.n as an, x.k as ak, y.n as bn, y.k as bk, (x.k + y.k) / (x.n + y.n) as q from va x join va y on x.variant < y.variant), zz as (select a, b, (ak / an - bk / bn) / sqrt(q * (1 - q) * (1 / an + 1 / bn)) as z from pz)"


def _variants(s, d):
    return a.variants(ev(s, d).withColumn("ok", F.col("value") > 20), "event_type", "ok")


query("a06_experiment_stats", f"with {_VAR} select variant, n, k, round(k / n, 6) as rate from va")(lambda s, d: _variants(s, d).select("variant", "n", "k", "rate"))
query("a07_significance", f"with {_VAR}, {_PZ} select a, b, round(z, 6) as z from zz")(lambda s, d: a.pairwise_z(_variants(s, d)).drop("p"))
query("a07_significance_p")(lambda s, d: a.pairwise_z(_variants(s, d)))
_Z = "1.959963984540054::double"
query("a08_confidence_intervals", f"with {_VAR} select variant, round(greatest(0, (k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) as low, round(least(1, (k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6) as high from va")(lambda s, d: _variants(s, d).select("variant", "low", "high"))
query("a09_sample_size", "select 3841::bigint as n")(lambda s, d: s.createDataFrame([(stats.sample_size(0.1, 0.02),)], "n long"))
query("a10_social_network", "with c as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all), t as (select count(distinct l_suppkey) as emitters, count(distinct l_partkey) as addressees, count(*) as pairs from c) select c.*, t.* from c, t order by n desc, l_suppkey, l_partkey limit 20")(lambda s, d: a.social_network(table(s, d, "lineitem"), "l_suppkey", "l_partkey"))
query("a11_context_switches", f"with {T}, x as (select ctx, (lag(token) over (partition by seq order by pos) <> token)::int as sw from t) select ctx, count(*) as n, round(coalesce(avg(sw), 0), 6) as switch_rate from x group by ctx")(lambda s, d: a.context_switches(events(s, d)))
_CNT = "c as (select token, count(*) as c from t group by token)"
query("a14_reuse_ratio", f"with {T23}, {_CNT} select round(sum(c) / count(*), 6) as reuse from c")(lambda s, d: a.reuse(numbers(s, d).groupBy("token").agg(F.count("*").alias("c"))).select("reuse"))
query("a15_singleton_rate", "with c as (select l_partkey as token, count(*) as c from lineitem group by 1) select round(avg((c = 1)::int), 6) as singletons from c")(lambda s, d: a.reuse(table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.count("*").alias("c"))).select("singletons"))
query("a16_presence_pmi", f"with {T}, u as (select distinct seq, ctx from t), h as (select distinct seq, ctx, token from t), n as (select count(*) as units from u), b as (select token, ctx, count(*) as nb from h group by all), k as (select token, count(*) as nt from h group by 1), c as (select ctx, count(*) as nc from u group by 1) select b.token, b.ctx, round(ln(nb * units / (nt * nc)), 6) as pmi from b join k on b.token = k.token join c on b.ctx = c.ctx, n")(lambda s, d: a.presence_pmi(events(s, d)))
_CT = "k as (select l_returnflag as a, l_linestatus || (l_linenumber % 3) as b, count(*) as n from lineitem group by all), f as (select x.a, y.b, coalesce(k.n, 0) as n from (select distinct a from k) x, (select distinct b from k) y left join k on k.a = x.a and k.b = y.b), ct as (select *, sum(n) over (partition by a) as row, sum(n) over (partition by b) as col, sum(n) over () as total from f), cx as (select *, row * col / total as expected from ct)"


def _table(s, d):
    return a.contingency(table(s, d, "lineitem").select("l_returnflag", F.concat("l_linestatus", F.col("l_linenumber") % 3).alias("b")), "l_returnflag", "b")


query("a17_mutual_information", f"with {_CT} select a, round(sum(case when n > 0 then n / total * log2(n / expected) else 0 end), 6) as mi from cx group by a")(lambda s, d: a.mutual_information(_table(s, d)))
query("a18_specificity", f"with {EV}, b as (select avg((value > 20)::int) as base from e), p as (select user_id as token, count(*) as n, avg((value > 20)::int) as rate from e group by 1 having count(*) >= 10), o as (select token, n, round(rate - base, 6) as specificity from p, b) select *, case when specificity > 0.2 then 'specific' when specificity < -0.2 then 'avoided' else 'neutral' end as band from o")(lambda s, d: a.specificity(ev(s, d), "user_id", F.col("value") > 20))
query("a19_persona_matrix", f"with {EV}, s as (select user_id, event_type, avg(value) as v from e group by all), b as (select user_id, arg_min(event_type, struct_pack(x := -v, y := event_type)) as persona from s group by 1), c as (select user_id, ctx, count(*) as n from e group by all) select persona, ctx, sum(n)::bigint as n from b join c on b.user_id = c.user_id group by all")(
    lambda s, d: a.argmax_matrix(ev(s, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("v")), "user_id", "event_type", "v", ev(s, d).groupBy("user_id", "ctx").agg(F.count("*").alias("n")))
)
_CHI = "xx as (select sum((n - expected) * (n - expected) / expected) as x, count(distinct a) as ra, count(distinct b) as rb, max(total) as total from cx)"
query("a20_chi_square", f"with {_CT}, {_CHI} select round(x, 6) as chi2, (ra - 1) * (rb - 1) as dof from xx")(lambda s, d: a.chi_square(_table(s, d)).select("chi2", "dof"))
query("a20_chi_square_p")(lambda s, d: a.chi_square(_table(s, d)))
query("a20_residuals", f"with {_CT} select a, b, n, round((n - expected) / sqrt(expected), 6) as residual from cx")(lambda s, d: a.residuals(_table(s, d)))
query("a21_enrichment", f"with {_CT} select a, b, case when n = 0 then '-infinity'::double else round(log2(n / expected), 6) end as enrichment from cx")(lambda s, d: a.enrichment(_table(s, d)))
query("a22_fisher")(lambda s, d: a.fisher(a.contingency(ev(s, d), "event_type", "ctx")))
query("a23_cramers_v", f"with {_CT}, {_CHI} select round(sqrt(x / (total * (least(ra, rb) - 1))), 6) as cramers_v from xx")(lambda s, d: a.chi_square(_table(s, d)).select("cramers_v"))
query("a24_uniformity", f"with {_EDGES}, s as (select src, sum(n) as n from ed group by src), p as (select (n - avg(n) over ()) * (n - avg(n) over ()) / avg(n) over () as part from s) select round(sum(part), 6) as chi2, count(*) - 1 as dof from p")(lambda s, d: a.uniformity(table(s, d, "lineitem").selectExpr("l_suppkey as src", "1 as n")).drop("p"))
_BIN = "c as (select count(*) filter (p = l and l > 0) as tp, count(*) filter (p = l and l <= 0) as tn, count(*) filter (p <> l and p > 0) as fp, count(*) filter (p <> l and p <= 0) as fn from pl), m as (select *, tp / (tp + fp) as pr, tp / (tp + fn) as re from c)"
query("a25_binary_metrics", f"with pl as (select quality as l, (doc_id % 3 > 0)::int as p from labels), {_BIN} select tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / (pr + re), 6) as f1 from m")(lambda s, d: a.binary_metrics(table(s, d, "labels"), (F.col("doc_id") % 3 > 0).cast("int"), F.col("quality")))
_REP = "pl as (select l_linenumber % 4 as p, l_orderkey % 4 as l from lineitem), k as (select unnest([0, 1, 2, 3]) as c), r as (select c, count(*) filter (l = c) as support, count(*) filter (p = c) as said, count(*) filter (p = c and l = c) as hit from pl, k group by c), f as (select *, coalesce(hit / nullif(said, 0), 0) as pr, coalesce(hit / nullif(support, 0), 0) as re from r), g as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) as f1 from f)"


def _report(s, d):
    return a.class_report(table(s, d, "lineitem").selectExpr("l_linenumber % 4 as p", "l_orderkey % 4 as l"), "p", "l")


query("a26_class_report", f"with {_REP} select c as class, support, round(pr, 6) as precision, round(re, 6) as recall, round(f1, 6) as f1, round(avg(f1) over (), 6) as macro_f1, round(sum(f1 * support) over () / sum(support) over (), 6) as weighted_f1 from g")(_report)
query("a27_macro_scores", f"with {_REP} select round(avg(pr), 6) as precision, round(avg(re), 6) as recall from g where support > 0")(lambda s, d: _report(s, d).where("support > 0").agg(seq.r6(F.avg("precision")).alias("precision"), seq.r6(F.avg("recall")).alias("recall")))
_PROTO = f"with {_VEC}, x as (select label, k, avg(v[k]) as m, stddev_pop(v[k]) as s from (select label, v, unnest(range(1, 65)) as k from ve) group by label, k)"


def _long(df):
    return df.select("label", F.posexplode(F.arrays_zip("mean", "std")).alias("k", "z")).select("label", (F.col("k") + 1).cast("long").alias("k"), seq.r6("z.mean").alias("mean"), seq.r6("z.std").alias("std"))


for _n in ("a28_prototypes", "a29_species_prototype"):
    query(_n, f"{_PROTO} select label, k, round(m, 6) as mean, round(s, 6) as std from x")(lambda s, d: _long(v.means(vectors(s, d), "label", "v", more=True)))
query("a31_moments", f"with {EV}, z as (select user_id, value, coalesce((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 0) as z from e window w as (partition by user_id)), g as (select user_id, avg(value) as m, coalesce(stddev_samp(value), 0) as sd, avg(z * z * z) as sk, avg(z * z * z * z) - 3 as ku, max(value) - min(value) as r, list_sort(list(value)) as l, count(*) as n from z group by 1) select user_id, round(m, 6) as mean, round(sd, 6) as std, round(sk, 6) as skew, round(ku, 6) as kurtosis, round(r, 6) as \"range\", round(case when n < 4 then r else l[n * 3 // 4 + 1] - l[n // 4 + 1] end, 6) as iqr from g")(lambda s, d: a.moments(ev(s, d), "user_id", "value"))
_GAP = f"with {_IV}, g as (select user_id, start - lag(start) over w as gap, row_number() over w as i from iv window w as (partition by user_id order by start))"
query("a32_intervals", f"{_GAP} select user_id, count(*) as n, round(avg(gap), 6) as mean, round(coalesce(stddev_samp(gap), 0), 6) as std, round(coalesce(stddev_samp(gap), 0) / avg(gap), 6) as cv, round(60 / avg(gap), 6) as tempo, round(coalesce(regr_slope(gap, i), 0), 6) as trend from g where gap is not null group by 1")(lambda s, d: a.intervals(intervals(s, d), "user_id", "start"))
query("a33_prosody", f"with {_IV}, g as (select user_id, lead(start) over (partition by user_id order by start) - stop as gap from iv), c as (select user_id, round(stddev_pop(gap) / avg(gap), 6) as cv from g where gap > 0 group by 1) select *, case when cv < 0.3 then 'regular' when cv < 0.7 then 'variable' else 'irregular' end as band from c")(lambda s, d: a.prosody(intervals(s, d), "user_id", "start", "stop"))
query("a34_latencies", "select event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(avg((value between 2 and 30)::int), 6) as valid, round(avg((value < 5)::int), 6) as rapid from events group by 1")(lambda s, d: a.latencies(ev(s, d), "event_type", "value", 2, 30, 5))
query("a35_evaluate_batch", "select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, round(median(value), 6) as median from events where value > 1 group by 1")(lambda s, d: a.metric_statistics(ev(s, d).where("value > 1"), "value", ["event_type"]).select("event_type", "n", "mean", "std", "median"))
_ST = "m as (select count(*) filter (event_type = 'click') as na, count(*) filter (event_type = 'view') as nb, avg(value) filter (event_type = 'click') as ma, avg(value) filter (event_type = 'view') as mb, var_samp(value) filter (event_type = 'click') as sa, var_samp(value) filter (event_type = 'view') as sb, var_pop(value) filter (event_type = 'click') as pa, var_pop(value) filter (event_type = 'view') as pb from events)"
query("a36_student", f"with {_ST} select round((ma - mb) / sqrt(((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) as t, na + nb - 2 as dof, round((ma - mb) / sqrt((pa + pb) / 2), 6) as effect from m")(lambda s, d: a.student(ev(s, d), "event_type", "value", "click", "view").drop("p"))
query("a36_student_p")(lambda s, d: a.student(ev(s, d), "event_type", "value", "click", "view"))
query("a37_drift_by_category", "select 'k' as category, count(*) as n, round(avg(json_extract(props, '$.k')::double), 6) as mean from events")(lambda s, d: a.drift_by_category(table(s, d, "events").select(F.from_json("props", "map<string,double>").alias("m")), "m"))
query("a38_percentiles", "select round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99, max(value) as max, round(avg(value), 6) as mean from events")(lambda s, d: a.latency_percentiles(ev(s, d), "value"))
query("a39_coverage", P + "select species, feature, round(avg((v > 0)::int), 6) as covered from (select species, 'hnr' as feature, hnr as v from phrases union all select species, 'icv', icv from phrases) group by all")(lambda s, d: a.coverage(phrases(s, d), "species", ["hnr", "icv"]))
query("a40_set_overlaps", f"with {PHRASES}, {CONTEXTS}, d as (select distinct species as g, name as i from contexts), z as (select g, count(*) as n from d group by g), c as (select x.g as a, y.g as b, count(*) as common from d x join d y on x.i = y.i and x.g < y.g group by all) select a, b, common, round(common / (p.n + q.n - common), 6) as jaccard, round(common / least(p.n, q.n), 6) as overlap, round(common / least(p.n, q.n), 6) > 0.1 as significant from c join z p on p.g = a join z q on q.g = b")(lambda s, d: a.set_overlaps(phrases(s, d).select("species", F.explode("contexts.name").alias("w")), "species", "w"))
query("a41_specific_pairs", f"with {EV}, c as (select event_id // 2 as token, event_type as ctx, count(*) as n from e group by all), s as (select *, round(n / sum(n) over (partition by token), 6) as share from c) select * from s where share > 0.7")(lambda s, d: a.specific_pairs(ev(s, d).withColumn("user_id", F.expr("event_id div 2")), "user_id", "event_type").withColumnRenamed("user_id", "token"))
query("a42_label_distances", f"with {_VEC}, p as (select least(a.label, b.label) as a, greatest(a.label, b.label) as b, {_L2} as d from ve a join ve b on a.id < b.id) select a, b, count(*) as n, round(avg(d), 6) as mean, min(d) as least from p group by all")(lambda s, d: a.label_distances(vectors(s, d)))

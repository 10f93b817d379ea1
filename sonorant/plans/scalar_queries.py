"""Registered queries of the scalar scores and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as c
from ..functions import vectors as v
from ..operators.sequences import r6
from ..registry import query, table
from .join_queries import _VEC, vectors
from .library import PHRASES, phrases

P = f"with {PHRASES} "
#: Every vector next to that of the next id.
_NEXT = f"with {_VEC}, pr as (select a.id, a.v as a, b.v as b from ve a join ve b on b.id = a.id + 1)"
_Z = "list_transform(list_zip(a, b), lambda x: {})"


def pairs(s, d):
    x = vectors(s, d).selectExpr("id", "v as a")
    return x.join(x.selectExpr("id - 1 as id", "a as b"), "id")


def _vec(name, sql, expr):
    query(name, f"{_NEXT} select id, {sql} from pr")(lambda s, d: pairs(s, d).select("id", *expr(F.col("a"), F.col("b"))))


_SS = f"sqrt(list_sum({_Z.format('(x[1] - x[2]) * (x[1] - x[2])')}))"
_vec("s01_distances", f"round({_SS}, 6) as l2, round(list_sum({_Z.format('abs(x[1] - x[2])')}), 6) as l1, round(list_max({_Z.format('abs(x[1] - x[2])')}), 6) as linf, round(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6) as cosine", lambda a, b: [r6(v.euclidean(a, b)).alias("l2"), r6(v.manhattan(a, b)).alias("l1"), r6(v.chebyshev(a, b)).alias("linf"), r6(v.cosine_distance(a, b)).alias("cosine")])
_vec("s02_similarity", f"round(exp(-{_SS}), 6) as similarity, round(1 - exp(-{_SS}), 6) as compat", lambda a, b: [r6(v.similarity(v.euclidean(a, b))).alias("similarity"), r6(v.similarity(v.euclidean(a, b), True)).alias("compat")])
for _n in ("s03_weighted_distance", "s06_weighted_distance_45"):
    _vec(_n, f"round(sqrt(list_sum({_Z.format('0.5 * (x[1] - x[2]) * (x[1] - x[2])')})), 6) as distance", lambda a, b: [r6(v.euclidean(a, b, F.array(*[F.lit(0.5)] * 64))).alias("distance")])
_vec("s04_interpolate", f"round(list_sum({_Z.format('x[1] * 0.75 + x[2] * 0.25')}), 6) as total", lambda a, b: [r6(v._sum(v.interpolate(a, b, 0.25))).alias("total")])
_vec("s05_extrapolate", f"round(list_sum({_Z.format('x[1] + x[2] * 2')}), 6) as total", lambda a, b: [r6(v._sum(v.extrapolate(a, b, 2.0))).alias("total")])
_vec("s07_clamp", f"round(least({_SS}, 1.5), 6) as moved", lambda a, b: [r6(v.euclidean(v.clamp(b, a, 1.5), a)).alias("moved")])
query("s08_soft_gate", f"with {_VEC} select id, round(case when (id % 10) / 10 >= 0.5 or 1 - (id % 10) / 10 >= 0.5 then list_sum(v) * ((id % 10) / 10 + 0.5 * (1 - (id % 10) / 10)) else list_sum(v) end, 6) as total from ve")(
    lambda s, d: vectors(s, d).select("id", r6(v._sum(v.soft_gate(F.col("v"), [[1.0] * 64, [0.5] * 64], F.array((F.col("id") % 10) / 10, 1 - (F.col("id") % 10) / 10)))).alias("total"))
)
_SC = f"with {_VEC}, sc as (select k, avg(v[k]) as m, stddev_pop(v[k]) as s from (select v, unnest(range(1, 65)) as k from ve) group by k) select id, k, round((v[k] - m) / s, 6) as z from (select id, v, unnest(range(1, 65)) as k from ve) join sc using (k)"
for _n in ("s09_normalize", "s10_standardize"):
    query(_n, _SC)(lambda s, d: v.scaled(vectors(s, d), "v").select("id", F.posexplode("v").alias("k", "z")).select("id", (F.col("k") + 1).cast("long").alias("k"), r6("z").alias("z")))
_TRI = f"with {_VEC}, tr as (select a.id, a.v as a, b.v as b, c.v as c from ve a join ve b on b.id = a.id + 1 join ve c on c.id = a.id + 2), g as (select id, round({_SS} - {_SS.replace('(a, b)', '(c, b)')}, 6) as gain from tr)"
query("s11_convergence", f"{_TRI} select id, gain, round(1 / (1 + exp(-10 * gain)), 6) as score, case when gain > 0.01 then 'converging' when gain < -0.01 then 'diverging' else 'neutral' end as direction from g")(lambda s, d: pairs(s, d).join(vectors(s, d).selectExpr("id - 2 as id", "v as c"), "id").select("id", *[x.alias(k) for k, x in c.convergence(F.col("a"), F.col("b"), F.col("c")).items()]))
query("s12_latency_score", "select event_id, round(case when value between 2 and 60 then exp(-3 * abs(value - 20) / 20) else 0 end, 6) as score from events")(lambda s, d: table(s, d, "events").select("event_id", c.latency_score(F.col("value"), 2, 60, 20).alias("score")))
query("s13_interaction", "select event_id, round(case when value between 2 and 60 then 0.6 * (event_id % 10) / 10 + 0.4 * (user_id % 10) / 10 else 0 end, 6) as score from events")(lambda s, d: table(s, d, "events").select("event_id", c.interaction(F.col("value"), 2, 60, F.col("event_id") % 10 / 10, F.col("user_id") % 10 / 10).alias("score")))
query("s14_mahalanobis", "select event_id, round(2 * (value - 40) * (value - 40) + 2 * 0.5 * (value - 40) * (user_id - 70) + (user_id - 70) * (user_id - 70), 6) as d2 from events")(lambda s, d: table(s, d, "events").select("event_id", r6(c.mahalanobis(F.array(F.col("value"), F.col("user_id").cast("double")), F.array(F.lit(40.0), F.lit(70.0)), F.array(F.array(F.lit(2.0), F.lit(0.5)), F.array(F.lit(0.5), F.lit(1.0))))).alias("d2")))
query("s15_anomaly", "select event_id, round(least(1, greatest(0, 1 - exp(-value / 10))), 6) as anomaly from events")(lambda s, d: table(s, d, "events").select("event_id", c.anomaly(F.col("value")).alias("anomaly")))
_ED = "ed as (select l_suppkey as src, l_partkey as dst, l_quantity / 50 as distance, l_discount * 10 as tie, l_linenumber % 2 = 0 as sight, l_tax * 10 as facing, l_tax * 10 as arousal from lineitem)"


def edges(s, d):
    return table(s, d, "lineitem").selectExpr("l_suppkey as src", "l_partkey as dst", "l_quantity / 50 as distance", "l_discount * 10 as tie", "l_linenumber % 2 = 0 as sight", "l_tax * 10 as facing", "l_tax * 10 as arousal")


query("s16_receivers", f"with {_ED}, sc as (select *, round(0.4 * exp(-distance) + 0.3 * tie + 0.3 * case when sight then 1 else 0.1 end + 0.1 * cos(facing), 6) as score from ed), b as (select src, arg_max(struct_pack(d := dst, s := score), struct_pack(s := score, d := -dst)) as m, max(arousal) as arousal from sc group by src) select src, case when m.s < 0.8 and arousal > 0.7 then 'system' when m.s < 0.8 then 'broadcast' else m.d::varchar end as receiver, m.s as score from b")(lambda s, d: c.receivers(edges(s, d), 0.8))
query("s17_receiver_shares", f"with {_ED}, w as (select src, dst, 1 / (1 + distance) * case when sight then 1 else 0.2 end * coalesce(tie, 0.5) as w from ed), h as (select src, dst, round(w / sum(w) over (partition by src), 6) as share from w) select *, max(share) over (partition by src) > 0.2 as unicast from h")(lambda s, d: c.receiver_shares(edges(s, d), 0.2))
query("s18_is_broadcast", "select l_orderkey, l_linenumber, l_partkey, l_tax * 10 > 0.7 or l_quantity / 20 > 1.5 or l_linenumber = 0 as b from lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c.is_broadcast(F.col("l_tax") * 10, F.col("l_quantity") / 20, F.col("l_linenumber")).alias("b")))
query("s19_is_graded", "select event_id, list_sort([value / 100, user_id / 300, 0.25])[2] >= 0.3 as graded from events")(lambda s, d: table(s, d, "events").select("event_id", c.is_graded(F.create_map(F.lit("a"), F.col("value") / 100, F.lit("b"), F.col("user_id") / 300, F.lit("c"), F.lit(0.25))).alias("graded")))
query("s20_bucket", "select c_custkey, (('0x' || substr(md5('exp_' || c_custkey), 1, 8))::bigint) / 4294967295 < 0.3 as interactive from customer")(lambda s, d: table(s, d, "customer").select("c_custkey", c.bucket(F.concat(F.lit("exp_"), F.col("c_custkey").cast("string")), 0.3).alias("interactive")))
query("s21_harmonic_distance", P + "select key, case when round_even(f0 / 440, 0) = 0 then 'infinity'::double else round(abs(f0 / 440 - round_even(f0 / 440, 0)) / round_even(f0 / 440, 0), 6) end as distance from phrases")(lambda s, d: phrases(s, d).select("key", c.harmonic_distance(F.col("f0"), F.lit(440.0)).alias("distance")))
query("s22_persona_score", P + ", x as (select key, list_filter([case when hnr <> 0 and hnr between 5 and 25 then (hnr - 5) / 20 end, case when jitter <> 0 and jitter between 0.05 and 0.2 then (jitter - 0.05) / (0.2 - 0.05) end], lambda z: z is not null) as l from phrases) select key, round(case when len(l) = 0 then 0 else list_sum(l) / len(l) end, 6) as score from x")(lambda s, d: phrases(s, d).select("key", c.persona_score([(F.col("hnr"), 5.0, 25.0), (F.col("jitter"), 0.05, 0.2)]).alias("score")))
_TW = P + ", q as (select a.*, b.f0 as bf, b.hnr as bh from phrases a join phrases b on b.key = a.key + 1)"


def twin(s, d):
    p = phrases(s, d)
    return p.join(p.selectExpr("key - 1 as key", "f0 as bf", "hnr as bh"), "key")


query("s23_feature_similarity", _TW + "select key, round(greatest(0, 1 - (2 * abs(f0 - bf) / 5000 + case when hnr > 0 and bh > 0 then abs(hnr - bh) / 30 else 0 end) / (2 + case when hnr > 0 and bh > 0 then 1 else 0 end)), 6) as similarity from q")(lambda s, d: twin(s, d).select("key", c.feature_similarity([F.col("f0"), F.col("hnr")], [F.col("bf"), F.col("bh")], [2.0, 1.0], [5000.0, 30.0]).alias("similarity")))
query("s24_timbre_distance", _TW + "select key, round(sqrt(pow((f0 - bf) / 5000, 2) + pow((hnr - bh) / 30, 2)), 6) as distance from q")(lambda s, d: twin(s, d).select("key", c.timbre_distance([F.col("f0"), F.col("hnr")], [F.col("bf"), F.col("bh")], [5000.0, 30.0]).alias("distance")))
_CA = "ca as (select l_orderkey as id, l_partkey as class, l_partkey % 3 as grp, l_orderkey % 3 as wanted, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rank, l_quantity / 50 as conf, l_discount * 10 as p from lineitem)"


def candidates(s, d):
    from pyspark.sql import Window as W

    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("class"), (F.col("l_partkey") % 3).alias("grp"), (F.col("l_orderkey") % 3).alias("wanted"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("rank"), (F.col("l_quantity") / 50).alias("conf"), (F.col("l_discount") * 10).alias("p"))


query("s25_vote", f"with {_CA}, x as (select *, round(0.6 * conf + 0.4 * p, 6) as score from ca) select id, class, score from (select *, row_number() over (partition by id order by score desc, rank) as k from x) where k = 1")(lambda s, d: c.vote(candidates(s, d)))
query("s26_veto", f"with {_CA}, h as (select id, arg_min(class, rank) filter (grp = wanted) as hc, arg_min(conf, rank) filter (grp = wanted) as hf, arg_min(class, rank) as fc, arg_min(conf, rank) as ff from ca group by id) select id, coalesce(hc, fc) as class, round(coalesce(hf, ff * 0.5), 6) as conf from h")(lambda s, d: c.veto(candidates(s, d)))
query("s27_blend", "with q as (select event_id, (event_id % 10) / 10 as p, (user_id % 10) / 10 as q from events), z as (select *, greatest(p, 1 - p) as a, greatest(q, 1 - q) as b from q) select event_id, round((p * a + q * b) / (a + b), 6) as first from z")(lambda s, d: table(s, d, "events").select("event_id", r6(F.get(c.blend(F.array(F.col("event_id") % 10 / 10, 1 - F.col("event_id") % 10 / 10), F.array(F.col("user_id") % 10 / 10, 1 - F.col("user_id") % 10 / 10)), F.lit(0))).alias("first")))
query("s28_uncertainty", f"with {_VEC} select id, round(list_var_samp(v), 6) as u from ve".replace("list_var_samp(v)", "(select var_samp(x) from (select unnest(v) as x))"))(lambda s, d: vectors(s, d).select("id", c.uncertainty(F.col("v")).alias("u")))
query("s29_next_token", f"with {_VEC}, l as (select id, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from ve) select id, arg_max(i, struct_pack(x := x, i := -i))::int as token from l where i <> id % 64 group by id")(lambda s, d: vectors(s, d).select("id", c.next_token(F.col("v"), F.array((F.col("id") % 64).cast("int"))).cast("int").alias("token")))
query("s30_sweeps", "with d as (select user_id, event_id, value - lag(value) over w as d from events window w as (partition by user_id order by event_id)), m as (select *, case when d >= 3 then 1 when d <= -3 then -1 else 0 end as dir from d), r as (select *, coalesce((lag(dir) over (partition by user_id order by event_id) <> dir)::int, 1) as nw from m), g as (select *, sum(nw) over (partition by user_id order by event_id) as run from r) select user_id, run::bigint as run, dir, count(*) as frames, min(event_id) as start, max(event_id) as stop from g where dir <> 0 group by user_id, run, dir having count(*) >= 3")(lambda s, d: c.sweeps(table(s, d, "events"), "user_id", "event_id", "value", 3, 3))

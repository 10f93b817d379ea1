"""Registered queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import joins as j
from ..operators import sequences as seq
from ..operators.blocks import nearest
from ..registry import query, table
from .library import PHRASES, phrases
from .sequence_queries import T23, B23, M, events, numbers, B, T

P = f"with {PHRASES} "
#: Intervals: events by second of the log, long as value (in units of 100 s), clicks against views.
_IV = "iv as (select event_id as id, epoch(ts) as start, epoch(ts) + value * 100 as stop, event_type, user_id from events)"


def intervals(spark, d):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select(F.col("event_id").alias("id"), start.alias("start"), (start + F.col("value") * 100).alias("stop"), "event_type", "user_id")


def _sides(spark, d):
    iv = intervals(spark, d)
    a = iv.where("event_type = 'click'").selectExpr("id as a_id", "start as a_start", "stop as a_stop")
    b = iv.where("event_type = 'view'").selectExpr("id as b_id", "start as b_start", "stop as b_stop", "concat('u', user_id % 5) as label")
    return a, b


_ALIGN = """a as (select id as a_id, start as a_start, stop as a_stop from iv where event_type = 'click'), b as (select id as b_id, start as b_start, stop as b_stop, 'u' || (user_id % 5) as label from iv where event_type = 'view'),
 o as (select a_id, b_id, label, least(a_stop, b_stop) - greatest(a_start, b_start) as common, round((least(a_stop, b_stop) - greatest(a_start, b_start)) / (greatest(a_stop, b_stop) - least(a_start, b_start)), 6) as iou from a join b on a_start < b_stop and b_start < a_stop),
 al as (select a.a_id, coalesce(x.b_id, -1) as b_id, coalesce(x.label, 'Unknown') as label, coalesce(x.iou, 0) as iou from a left join (select *, row_number() over (partition by a_id order by iou desc, b_id) as k from o where iou >= 0.3 and common >= 10) x on x.a_id = a.a_id and x.k = 1)"""
query("j01_align", f"with {_IV}, {_ALIGN} select * from al")(lambda s, d: j.align(*_sides(s, d), 2000))
query("j02_type_profiles", f"with {_IV}, {_ALIGN}, c as (select a_id % 7 as cluster, label, count(*) as n from al where label <> 'Unknown' group by all), r as (select cluster, label, round(n / sum(n) over (partition by cluster), 6) as share, row_number() over (partition by cluster order by n desc, label) as k from c) select cluster, label, share from r where k = 1")(
    lambda s, d: j.type_profiles(a := j.align(*_sides(s, d), 2000), a.select("a_id", (F.col("a_id") % 7).alias("cluster")))
)
query("j03_superpositions", f"with {_IV} select a.id as a_id, b.id as b_id, round((least(a.stop, b.stop) - greatest(a.start, b.start)) / least(a.stop - a.start, b.stop - b.start), 6) as ratio from iv a join iv b on a.id < b.id and a.event_type = b.event_type and a.start < b.stop and b.start < a.stop where round((least(a.stop, b.stop) - greatest(a.start, b.start)) / least(a.stop - a.start, b.stop - b.start), 6) >= 0.3")(
    lambda s, d: j.superpositions(intervals(s, d).withColumnRenamed("event_type", "modality"), 2000)
)
query("j04_vocabulary", f"with {_IV}, x as (select i.id, i.user_id % 6 - 1 as cluster, any_value(i.stop - i.start) as duration, count(o.id) > 0 as has from iv i left join (select * from iv where event_type = 'error') o on o.user_id = i.user_id and o.start between i.start and i.stop where i.event_type = 'click' and i.user_id % 6 <> 0 group by all) select cluster, count(*) as members, round(avg(duration), 6) as mean_ms, round(stddev_pop(duration), 6) as std_ms, sum(has::int)::bigint as annotated from x group by cluster")(
    lambda s, d: j.vocabulary(
        intervals(s, d).where("event_type = 'click'").selectExpr("id", "user_id as file", "user_id % 6 - 1 as cluster", "start", "stop", "stop - start as duration"),
        intervals(s, d).where("event_type = 'error'").selectExpr("user_id as a_file", "start as at"),
    )
)
query("j05_nearest_by_value", P + ", q as (select c_custkey as q_id, abs(c_acctbal) as x from customer) select q_id, key, round(gap, 6) as gap from (select q_id, key, abs(x - f0) as gap, row_number() over (partition by q_id order by abs(x - f0), key) as k from q join phrases on abs(x - f0) < 20) where k = 1")(
    lambda s, d: j.nearest_by_value(table(s, d, "customer").select(F.col("c_custkey").alias("q_id"), F.abs("c_acctbal").alias("x")), phrases(s, d).select("key", F.col("f0").alias("v")), 20.0)
)
_SIM = "round((greatest(0, 1 - abs(q_f0 - f0) / 2000) + greatest(0, 1 - abs(q_duration - duration_ms) / 500)) / 2, 6)"
query("j06_match_library", P + f", q as (select s_suppkey as q_id, abs(s_acctbal) as q_f0, s_nationkey * 20e0 as q_duration from supplier), r as (select q_id, key, {_SIM} as sim, row_number() over (partition by q_id order by {_SIM} desc, key) as k from q, phrases) select q_id, case when sim >= 0.8 then key end as key, sim from r where k = 1")(
    lambda s, d: j.match_library(table(s, d, "supplier").select(F.col("s_suppkey").alias("q_id"), F.abs("s_acctbal").alias("q_f0"), (F.col("s_nationkey") * 20.0).alias("q_duration")), phrases(s, d).select("key", "f0", "duration_ms"))
)
query("j07_match_keys", "with a as (select 'F0_' || (p_partkey % 40 + 1) || '_DUR_' || p_size || '_R' as key from part where p_partkey % 2 = 0), t as (select distinct 'F0_' || (p_partkey % 50) || '_DUR_' || p_size || '_R' as key from part where p_partkey % 2 = 1) select t.key, min(a.key) as match from t join a on regexp_replace(t.key, '_DUR_[0-9]+', '') = regexp_replace(a.key, '_DUR_[0-9]+', '') group by t.key")(
    lambda s, d: j.match_keys(table(s, d, "part").where("p_partkey % 2 = 1").selectExpr("concat('F0_', p_partkey % 50, '_DUR_', p_size, '_R') as key").distinct(), table(s, d, "part").where("p_partkey % 2 = 0").selectExpr("concat('F0_', p_partkey % 40 + 1, '_DUR_', p_size, '_R') as key"))
)
query("j08_as_of", f"with {_IV}, r as (select user_id, start as time, stop - start as v from iv where event_type = 'view'), l as (select id, user_id, start as time from iv where event_type = 'click') select l.id, l.user_id, l.time, case when l.time - r.time <= 50000 then round(r.v, 4) end as v from l asof left join r on l.user_id = r.user_id and l.time >= r.time")(
    lambda s, d: j.as_of(intervals(s, d).where("event_type = 'click'").selectExpr("id", "user_id", "start as time"), intervals(s, d).where("event_type = 'view'").selectExpr("user_id", "start as time", "stop - start as v"), "user_id", "time", "v", 50000).withColumn("v", F.round("v", 4))
)
_PTS = "pt as (select c_custkey as id, c_acctbal / 100 as x, (c_custkey % 97)::double as y, (c_nationkey * 3)::double as z from customer)"


def points(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey as id", "c_acctbal / 100 as x", "double(c_custkey % 97) as y", "double(c_nationkey * 3) as z")


_D3 = "round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6)"
query("j09_within_radius", f"with {_PTS} select a.id as a_id, b.id as b_id, {_D3} as distance from pt a join pt b on a.id <> b.id and {_D3} <= 6")(lambda s, d: j.within_radius(points(s, d), points(s, d), 6.0))


query("j10_nearest_points", f"with {_PTS}, r as (select a.id as a_id, b.id as b_id, {_D3} as distance, row_number() over (partition by a.id order by {_D3}, b.id) as rank from pt a join pt b on a.id <> b.id) select a_id, b_id, distance, rank from r where rank <= 5")(lambda s, d: j.nearest_points(points(s, d), 5))


_COLS = ["f0", "duration_ms", "f0_range", "hnr", "flatness", "attack", "jitter", "onset_rate", "icv", "ici"]
_SQ = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _COLS)


@query("j11_nearest_phrases", P + f"select b.key, round(sqrt({_SQ}), 6) as distance from phrases a, phrases b where a.key = 100 and b.key <> 100 order by 2, 1 limit 10")
def j11(spark, d):
    p = phrases(spark, d)
    q = p.where("key = 100").select(*[F.col(c).alias(f"q_{c}") for c in _COLS])
    total = sum(((F.col(c) - F.col(f"q_{c}")) ** 2 for c in _COLS[1:]), (F.col("f0") - F.col("q_f0")) ** 2)
    return p.where("key <> 100").crossJoin(F.broadcast(q)).select("key", seq.r6(F.sqrt(total)).alias("distance")).orderBy("distance", "key").limit(10)


@query("j12_similar_phrases", P + "select b.key, round(0.5 * (1 - least(abs(a.f0 - b.f0) / 10000, 1)) + 0.3 * (1 - least(abs(a.duration_ms - b.duration_ms) / 1000, 1)) + 0.2 * (1 - least(abs(a.f0_range - b.f0_range) / 5000, 1)), 6) as similarity from phrases a, phrases b where a.key = 7 and b.key <> 7 and round(0.5 * (1 - least(abs(a.f0 - b.f0) / 10000, 1)) + 0.3 * (1 - least(abs(a.duration_ms - b.duration_ms) / 1000, 1)) + 0.2 * (1 - least(abs(a.f0_range - b.f0_range) / 5000, 1)), 6) >= 0.97")
def j12(spark, d):
    p = phrases(spark, d)
    q = p.where("key = 7").selectExpr("f0 as qf", "duration_ms as qd", "f0_range as qr")
    sim = j.phrase_similarity(F.col("f0"), F.col("qf"), F.col("duration_ms"), F.col("qd"), F.col("f0_range"), F.col("qr"))
    return p.where("key <> 7").crossJoin(F.broadcast(q)).select("key", sim.alias("similarity")).where("similarity >= 0.97").orderBy(F.desc("similarity"), "key")


@query("j13_delta", P + "select " + ", ".join(f"round(b.{c} - a.{c}, 6) as {c}" for c in _COLS) + " from phrases a, phrases b where a.key = 3 and b.key = 9")
def j13(spark, d):
    p = phrases(spark, d).select("key", *_COLS)
    a, b = (p.where(f"key = {k}").select(*[F.col(c).alias(f"{x}_{c}") for c in _COLS]) for x, k in (("a", 3), ("b", 9)))
    return a.crossJoin(b).select(*[seq.r6(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(c) for c in _COLS])


_VEC = "ve as (select vec_id as id, label, embedding::double[] as v from embeddings)"
_L2 = "round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def knn(spark, d, k, distance=v.euclidean):
    """The k nearest of every vector whose id is divisible by 20 against all rows."""
    all_ = vectors(spark, d)
    q = all_.where("id % 20 = 0").selectExpr("id as q_id", "v as q")
    near = all_.crossJoin(q).where("id <> q_id").select("q_id", "id", "label", seq.r6(distance(F.col("q"), F.col("v"))).alias("distance"))
    return j.top_k(near, "q_id", "id", "distance", k)


def _knn_sql(expr: str, k: int) -> str:
    return f"kn as (select q_id, id, label, distance, rank from (select a.id as q_id, b.id, b.label, {expr} as distance, row_number() over (partition by a.id order by {expr}, b.id) as rank from ve a join ve b on a.id <> b.id where a.id % 20 = 0) where rank <= {k})"


KNN = _knn_sql(_L2, 5)
query("j14_find_similar", f"with {_VEC}, {_knn_sql(_L2.replace('(x[1] - x[2]) * (x[1] - x[2])', 'abs(x[1] - x[2])').replace('sqrt(', '('), 5)} select q_id, id, distance, rank from kn")(lambda s, d: knn(s, d, 5, v.manhattan).drop("label"))
query("j15_knn_search", f"with {_VEC}, {KNN} select q_id, id, label, distance, rank from kn")(lambda s, d: knn(s, d, 5))
_SD = "sd as (select list(s order by k) as s from (select k, stddev_pop(v[k]) as s from (select v, unnest(range(1, 65)) as k from ve) group by k)), "


@query("j16_scaled_knn", f"with {_VEC}, {_SD}vs as (select id, label, list_transform(list_zip(v, s), lambda x: x[1] / x[2]) as v from ve, sd), {KNN.replace('from ve a join ve b', 'from vs a join vs b')} select q_id, id, distance, rank from kn")
def j16(spark, d):
    rows = v.scaled(vectors(spark, d), "v", center=False)
    q = rows.where("id % 20 = 0").selectExpr("id as q_id", "v as q")
    near = rows.crossJoin(q).where("id <> q_id").select("q_id", "id", seq.r6(v.euclidean(F.col("q"), F.col("v"))).alias("distance"))
    return j.top_k(near, "q_id", "id", "distance", 5)


_CEN = "ce as (select label as c_id, list(m order by k) as v from (select label, k, avg(v[k]) as m from (select label, v, unnest(range(1, 65)) as k from ve) group by label, k) group by label)"
NEAR = f"nc as (select id, label, c_id, distance from (select a.id, a.label, b.c_id, {_L2} as distance, row_number() over (partition by a.id order by {_L2}, b.c_id) as k from ve a, ce b) where k = 1)"
for _n in ("j17_nearest_centroid", "j18_student_predict"):
    query(_n, f"with {_VEC}, {_CEN}, {NEAR} select id, c_id, distance from nc")(lambda s, d: j.nearest_centroid(vectors(s, d), v.means(vectors(s, d), "label", "v").selectExpr("label as c_id", "mean as c"), v.euclidean))
query("j19_validate_sequences", f"with {T23}, {B23}, {M} , p as (select src, dst, q as p from m where n >= 20) select seq, count(*) as steps, count(*) filter (coalesce(round(p, 6), 0) <= 0.01) as violations, round(avg((coalesce(round(p, 6), 0) > 0.01)::int) / 2 + avg(coalesce(round(p, 6), 0)) / 2, 6) as confidence from b left join p on b.src = p.src and b.dst = p.dst group by seq")(
    lambda s, d: j.validate_sequences(seq.bigrams(numbers(s, d)), seq.transition_matrix(numbers(s, d)).where("n >= 20"))
)
_EDGE = "select o_custkey as src, (o_custkey * 6) % 1500 as dst from orders"
query("j20_without_incoming", f"with e as ({_EDGE}) select distinct src from e where src not in (select dst from e)")(lambda s, d: j.without_incoming(table(s, d, "orders").selectExpr("o_custkey as src", "(o_custkey * 6) % 1500 as dst")))
query("j21_across_groups", "select p_name, count(distinct p_brand) as groups from part group by p_name having count(distinct p_brand) > 1")(lambda s, d: j.across_groups(table(s, d, "part"), "p_name", "p_brand"))
query("j22_allowed_probabilities", f"with {T}, {B}, c as (select src, dst, count(*) as n from b where (src, dst) in (('click', 'view'), ('view', 'click'), ('click', 'error')) group by all) select *, round(n / sum(n) over (partition by src), 6) as p from c")(
    lambda s, d: j.allowed_probabilities(seq.bigrams(events(s, d)), s.createDataFrame([("click", "view"), ("view", "click"), ("click", "error")], "src string, dst string"))
)
query("j23_compare_predictions", "with a as (select l_orderkey * 10 + l_linenumber as id, min(l_returnflag) as l, avg(l_tax + 0.01) as c, avg(l_discount) as s from lineitem group by 1), b as (select l_orderkey * 10 + l_linenumber as id, max(l_returnflag) as l, max(l_tax + 0.01) as c, max(l_discount) as s from lineitem group by 1) select a.id, a.l = b.l as same, round(case when a.l <> b.l then 1 else (abs(a.c - b.c) / greatest(a.c, b.c) + abs(a.s - b.s)) / 2 end, 6) as divergence from a join b on a.id = b.id")(
    lambda s, d: j.compare_predictions(
        table(s, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_returnflag").alias("a_label"), F.avg(F.col("l_tax") + 0.01).alias("a_conf"), F.avg("l_discount").alias("a_score")),
        table(s, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.max("l_returnflag").alias("b_label"), F.max(F.col("l_tax") + 0.01).alias("b_conf"), F.max("l_discount").alias("b_score")),
    )
)

"""Registered queries of the stateful operators (batch forms; tests replay the same rows as streams) and of the function-shaped ones."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import udfs as u
from ..functions import vectors as v
from ..operators.sequences import r6
from ..registry import query, table
from ..streaming import operators as st
from .join_queries import _CEN, _IV, _L2, _VEC, NEAR, intervals, vectors
from .model_queries import centroids, series
from .sequence_queries import T, events

E = "e as (select event_id, user_id, event_type, value, ts, epoch(ts) as time from events)"


def rows(s, d):
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))


query("st01_recent", f"with {E} select event_id from e where (select max(time) from e) - time <= 86400")(lambda s, d: st.recent(rows(s, d), "time", 86400).select("event_id"))
query("st02_range_from_oldest", f"with {E} select event_id from e where time - (select min(time) from e) between 3600 and 90000")(lambda s, d: st.range_from_oldest(rows(s, d), "time", 3600, 90000).select("event_id"))
_DEB = "n as (select user_id, event_id::double as time, row_number() over (partition by user_id order by event_id) as k from events {0}), w as (select user_id, k, time, time as last, true as ok from n where k = 1 union all select n.user_id, n.k, n.time, case when n.time - w.last >= {1} then n.time else w.last end, n.time - w.last >= {1} from w join n on n.user_id = w.user_id and n.k = w.k + 1)"
for _n, _w, _g in (("st03_debounce", "", 200), ("st19_detection_debounce", "where value > 20", 400)):
    query(_n, f"with recursive {_DEB.format(_w, _g)} select user_id, time from w where ok")(lambda s, d, w=_w, g=_g: st.debounce((rows(s, d).where("value > 20") if w else rows(s, d)).select("user_id", F.col("event_id").cast("double").alias("time")), "user_id", "time", g))
query("st04_turn_states", "with m as (select user_id, event_id, (value >= 30)::int as v, row_number() over (partition by user_id order by event_id) as k from events), l as (select *, max(case when v = 1 then k end) over (partition by user_id order by event_id) as last from m) select event_id, case when v = 1 then 'vocalising' when last is null then 'idle' when k - last = 1 then 'turn_end' when k - last < 3 then 'waiting' else 'ready' end as state from l")(lambda s, d: st.turn_states(rows(s, d), "user_id", "event_id", "value", 30, 3).select("event_id", "state"))
query("st05_parse_events", "select event_id, json_extract(props, '$.k')::int as k from events where json_extract(props, '$.k') is not null")(lambda s, d: st.parse_events(table(s, d, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.substring("props", 2, 100)).alias("value")), "event_id long, k int")[0])
query("st06_paired_with_last", "with p as (select event_id, event_type, max(case when event_type = 'click' then event_id end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as r from events) select event_id, case when event_id - r <= 500 then r end as response_to from p where event_type <> 'click'")(lambda s, d: st.paired_with_last(rows(s, d), "user_id", "event_id", "event_type", "click", 500).select("event_id", "response_to"))
query("st07_drop_late", "with a as (select event_id, value, event_id + value as t from events) select event_id from (select *, max(t) over (order by event_id rows unbounded preceding) as m from a) where t >= m - 100")(lambda s, d: st.drop_late(table(s, d, "events").select("event_id", (F.col("event_id") + F.col("value")).alias("t"), F.col("event_id").alias("arrival")), "t", 100).select("event_id"))
query("st08_latest_positions", "with p as (select user_id, event_id, value, round((value - lag(value) over w) / (event_id - lag(event_id) over w), 6) as velocity from events window w as (partition by user_id order by event_id)) select user_id, event_id, value, velocity from (select *, row_number() over (partition by user_id order by event_id desc) as k from p) where k = 1")(lambda s, d: st.latest_positions(rows(s, d), "user_id", "event_id", "value"))
query("st09_prune_stale", "with l as (select user_id, max(event_id) as last from events group by 1) select * from l where (select max(last) from l) - last <= 100")(lambda s, d: st.prune_stale(rows(s, d).groupBy("user_id").agg(F.max("event_id").alias("last")), "last", 100))
query("st10_ema", "with recursive n as (select user_id, value, row_number() over (partition by user_id order by event_id) as k from events), w as (select user_id, k, value as a from n where k = 1 union all select n.user_id, n.k, w.a * 0.7 + n.value * 0.3 from w join n on n.user_id = w.user_id and n.k = w.k + 1) select user_id, round(arg_max(a, k), 6) as ema from w group by user_id")(lambda s, d: st.ema(rows(s, d), "user_id", "event_id", "value"))
query("st11_boundaries")(lambda s, d: st.boundaries(rows(s, d), "user_id", "event_id", "value", 0.8, 0.3, 2))
query("st12_known_or_new", f"with {_VEC}, {_CEN}, {NEAR} select id, c_id, distance, distance <= 7.5 as known from nc")(lambda s, d: st.known_or_new(vectors(s, d), centroids(s, d), v.euclidean, 7.5))
query("st13_promotions", "with c as (select user_id as id, min(event_id) as seen from events group by 1), n as (select user_id as id, count(*) as n from events where event_type = 'error' group by 1) select c.id, coalesce(n, 0) as n, case when coalesce(n, 0) >= 15 then 'promoted' when 500 - seen > 300 then 'expired' else 'waiting' end as state from c left join n on c.id = n.id")(lambda s, d: st.promotions(rows(s, d).groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("seen")), rows(s, d).where("event_type = 'error'").selectExpr("user_id as id"), 15, 500, 300))
query("st14_alerts", "select epoch(time_bucket(interval '1 hour', ts))::bigint as start, round(avg(value), 6) as mean, max(value) as max, max(value) > 250 as alert from events group by 1")(lambda s, d: st.alerts(rows(s, d), "ts", "value", 3600, 250).withColumn("start", F.unix_seconds("start")))
query("st15_leak", "with t as (select user_id, value, ntile(10) over (partition by user_id order by event_id) as t from events), g as (select user_id, count(*) as n, avg(value) filter (t = 1) as a, avg(value) filter (t = 10) as b from t group by 1) select user_id, n, round((b - a) / a, 6) as growth, case when n >= 60 then (b - a) / a > 0.1 end as leak from g")(lambda s, d: st.leak(rows(s, d), "user_id", "event_id", "value", 60))
query("st16_responses", f"with {_IV}, s as (select user_id, start as s_time, lead(start) over (partition by user_id order by start) as nx from iv where event_type = 'purchase'), r as (select user_id, start as time, stop - start as score, event_type = 'error' as alarm from iv where event_type <> 'purchase') select s.user_id, s_time, count(time) as responses, round(avg(alarm::int), 6) as alarm_rate, round(avg(score), 4) as mean_score from s left join r on r.user_id = s.user_id and time > s_time and time < least(s_time + 50000, coalesce(nx, 'infinity'::double)) group by all")(
    lambda s, d: st.responses(intervals(s, d).where("event_type = 'purchase'").selectExpr("user_id", "start as s_time"), intervals(s, d).where("event_type <> 'purchase'").selectExpr("user_id", "start as time", "stop - start as score", "event_type = 'error' as alarm"), "user_id", 50000).withColumn("mean_score", F.round("mean_score", 4))
)
query("st17_downsample", "select epoch(time_bucket(interval '10 minutes', ts))::bigint as start, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events group by 1")(lambda s, d: st.downsample(rows(s, d), "ts", "value", "10 minutes").withColumn("start", F.unix_seconds("start")))
query("st18_retained", "select event_id from events where ts >= timestamp '2024-01-08' - interval 3 days")(lambda s, d: st.retained(rows(s, d), "ts", F.lit("2024-01-08 00:00:00").cast("timestamp"), 3).select("event_id"))
query("st20_soak", "with g as (select user_id, round(100 * (arg_max(value, event_id) - arg_min(value, event_id)) / arg_min(value, event_id), 6) as growth from events group by 1) select *, case when growth > 100 then 'confirmed' when growth > 50 then 'potential' else 'ok' end as verdict from g")(lambda s, d: st.soak(rows(s, d), "user_id", "event_id", "value", 50))
query("st21_relationships", "select least(l_suppkey, l_partkey % 100) as a, greatest(l_suppkey, l_partkey % 100) as b, round(least(1, 0.1 * count(*)), 6) as strength from lineitem group by 1, 2")(lambda s, d: st.relationships(table(s, d, "lineitem").selectExpr("l_suppkey as a", "l_partkey % 100 as b")))
_NC = "h as (select token as src, lead(token) over (partition by seq order by pos) as dst, (seq % 10) / 10 as f from t), c as (select src, dst, count(*) as n, avg(f) as f from h where dst is not null group by all), k as (select count(distinct dst) as k from c), p as (select *, (n + 1) / (sum(n) over (partition by src) + k) as p, sum(n) over (partition by src) as t from c, k)"
query("st22_next_context", f"with {T}, {_NC} select src, dst, round(case when t >= 5 then 0.7 * p + 0.3 * f else p end, 6) as p from p")(lambda s, d: st.next_context(events(s, d).withColumn("dst", F.lead("token").over(W.partitionBy("seq").orderBy("pos"))).where("dst is not null").select(F.col("token").alias("src"), "dst", (F.col("seq") % 10 / 10).alias("feature_p"))))
query("st23_sync_batch", "select event_id as id, case when sum(length(props)) over (order by user_id desc, event_id rows unbounded preceding) <= 9000 then 'sent' else 'left' end as state from events")(lambda s, d: (lambda q: q[0].select("id", F.lit("sent").alias("state")).union(q[1].select("id", F.lit("left").alias("state"))))(st.sync_batch(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("priority"), F.col("event_id").alias("time"), F.length("props").alias("bytes")), 9000)))
query("st24_strategy_scores", "select event_type as strategy, round(avg(0.3 * (value > 5)::int + 0.5 * (value > 30)::int + 0.2 * (user_id % 2)), 6) as score from events group by 1")(lambda s, d: st.strategy_scores(rows(s, d).selectExpr("event_type as strategy", "value > 5 as answered", "value > 30 as matched", "user_id % 2 = 1 as positive")))
query("st25_arousal", "with x as (select event_id, least(value / 100, 1) as a, (user_id % 10) / 10 as b from events), y as (select *, (2 * a + b) / 3 as s, (a + b) / 2 as m from x) select event_id, round(s, 6) as score, case when s < 0.33 then 'low' when s < 0.66 then 'medium' else 'high' end as level, round(1 / (1 + ((a - m) * (a - m) + (b - m) * (b - m)) / 2), 6) as confidence from y")(lambda s, d: rows(s, d).select("event_id", *[x.alias(k) for k, x in st.arousal([F.least(F.col("value") / 100, F.lit(1.0)), F.col("user_id") % 10 / 10], [2.0, 1.0]).items()]))
query("st26_bayes_filter", "with recursive n as (select user_id, row_number() over (partition by user_id order by event_id) as k, 0.2 + (event_id % 5) / 10 as a, 0.2 + (event_id % 3) / 10 as b from events), w as (select user_id, k, a / (a + b) as p from n where k = 1 union all select n.user_id, n.k, (0.9 * p + 0.05) * a / ((0.9 * p + 0.05) * a + (0.9 * (1 - p) + 0.05) * b) from w join n on n.user_id = w.user_id and n.k = w.k + 1) select user_id, round(arg_max(p, k), 6) as p from w group by user_id")(lambda s, d: st.bayes_filter(rows(s, d).withColumn("l", F.array(0.2 + F.col("event_id") % 5 / 10, 0.2 + F.col("event_id") % 3 / 10)), "user_id", "event_id", "l").select("user_id", r6(F.get("posterior", F.lit(0))).alias("p")))
query("m21_online_clusters")(lambda s, d: st.clusters_online(vectors(s, d).where("id >= 100"), st.clusters_online(vectors(s, d).where("id < 100"), None, 6.0), 6.0).select("c_id", "n"))


def waves(s, d):
    """Synthetic waveforms of the suppliers: tones, sweeps and bursts, made in the JVM."""
    t = F.sequence(F.lit(0), F.lit(1599))
    f = 200 + F.col("s_suppkey") * 5
    x = F.transform(t, lambda i: F.when((i % 800) < 500, F.sin(2 * math.pi * f * i / 16000 + F.when(F.col("s_suppkey") % 3 == 0, i * i * 2e-5).otherwise(0.0))).otherwise(0.0))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(16000.0).alias("rate"), x.alias("x"))


query("u01_validate", "select event_id, value > 0 and sqrt(value) < 6 as valid from events")(lambda s, d: u.validate(table(s, d, "events"), "value", lambda x: x > 0 and math.sqrt(x) < 6).select("event_id", F.when(F.col("value").isNotNull(), F.col("valid")).alias("valid")))
query("u02_segment")(lambda s, d: u.phrases(waves(s, d), 5, 5))
query("u03_parse_idioms")(lambda s, d: u.parse_idioms(events(s, d), {"click": ["click", "view"]}, ["view"], ["error"]))
query("u04_parse_tokens", f"with {T} select seq, pos, token, case token when 'click' then 'touch' when 'view' then 'look' end as meaning, case when token in ('click', 'view') then 1.0 else 0.5 end as confidence from t")(lambda s, d: u.parsed_tokens(events(s, d).drop("ctx"), {"click": "touch", "view": "look"}))
for _n, _b in (("u05_features_112", 112), ("u06_micro_dynamics", 112), ("u07_features_45", 45)):
    query(_n)(lambda s, d, b=_b: u.extract(waves(s, d), b).select("id", F.size("features").alias("n"), r6(F.get("features", F.lit(0))).alias("level")))
query("u08_segment_phrases")(lambda s, d: u.phrases(waves(s, d), 20, 10))
query("u09_modality")(lambda s, d: u.modality(waves(s, d)))
query("u10_codas", "with m as (select user_id, event_id, coalesce((event_id - lag(event_id) over (partition by user_id order by event_id) > 150)::int, 0) as b from events), s as (select *, sum(b) over (partition by user_id order by event_id) as session from m) select user_id, session::bigint as session, count(*) as size, min(event_id) as start, max(event_id) as stop from s group by all")(lambda s, d: u.codas(table(s, d, "events"), "user_id", "event_id", 150))
query("u11_pitch")(lambda s, d: u.pitch(waves(s, d)))
query("u12_response_scores")(lambda s, d: u.response_scores(series(s, d), [[1.0, 20.0, 60.0], [30.0, 30.0, 5.0]], 50.0))
query("u13_turing_ratio", "with x as (select avg(value) filter (event_type = 'click') as a, avg(value) filter (event_type = 'view') as n from events) select round(a / n, 6) as ratio, a / n >= 0.9 as passed from x")(lambda s, d: u.turing_ratio(table(s, d, "events").select(F.when(F.col("event_type") == "click", "ai").when(F.col("event_type") == "view", "natural").alias("kind"), F.col("value").alias("s"))))
query("u14_dispute", "with x as (select user_id, event_id, least(value / 100, 1) as v, least(value / 100, 1) - lag(least(value / 100, 1)) over (partition by user_id order by event_id) as d from events) select user_id, count(*) filter (v < 0.33) as calm, count(*) filter (v >= 0.33 and v < 0.66) as tense, count(*) filter (v >= 0.66) as escalated, min(event_id) filter (d > 0.2 and v >= 0.66) as tipping_point from x group by 1")(lambda s, d: u.dispute_phases(table(s, d, "events").select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("v")), "user_id", "event_id", "v"))
query("w48_align_multiple")(lambda s, d: _align(s, d))
query("w57_grammar_from_sentences", f"with {_VEC}, {_CEN}, {NEAR}, p as (select id // 10 as g, c_id as src, lead(c_id) over (partition by id // 10 order by id) as dst from nc) select src, dst, count(*) as n from p where dst is not null group by all")(lambda s, d: _grammar(s, d))
query("w60_transition_shape", f"with {_VEC}, st as (select k, avg(v[k]) as m, stddev_pop(v[k]) as s from (select v, unnest(range(1, 65)) as k from ve) group by k), z as (select id, k, (v[k] - m) / s as x from (select id, v, unnest(range(1, 65)) as k from ve) join st using (k)), p as (select b.id, b.k, a.x as s, b.x as e from z a join z b on b.id = a.id + 1 and b.k = a.k and a.id // 10 = b.id // 10), m as (select id, sqrt(sum((e - s) * (e - s))) as magnitude, sqrt(sum(((s + e) / 2 - (e - s) / 2) * ((s + e) / 2 - (e - s) / 2))) as curvature from p group by id) select p.id, p.k::bigint as k, round(case when magnitude > 1e-10 then (e - s) / magnitude else 0 end, 6) as direction, round(magnitude, 6) as magnitude, round(magnitude / 10, 6) as velocity, round(curvature, 6) as curvature from p join m on p.id = m.id")(lambda s, d: _shape(s, d))


def _align(s, d):
    """Multiple alignment of the first sequences of each group of users, with the share of places all agree on."""
    import pandas as pd

    from ..functions import kernels

    t = events(s, d).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("v")).withColumn("g", F.floor(F.col("seq") / 4).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        if len(pdf) < 2:
            return pd.DataFrame({"g": [], "seq": [], "aligned": [], "conserved": []})
        got = kernels.align_progressive([list(x) for x in pdf["v"]])
        same = sum(len(set(c)) == 1 for c in zip(*got, strict=True)) / max(1, len(got[0]))
        return pd.DataFrame({"g": pdf["g"], "seq": pdf["seq"], "aligned": [" ".join(x) for x in got], "conserved": round(same, 6)})

    return t.groupBy("g").applyInPandas(run, "g long, seq long, aligned string, conserved double")


def _grammar(s, d):
    from ..operators import joins as j

    near = j.nearest_centroid(vectors(s, d), centroids(s, d), v.euclidean)
    w = W.partitionBy(F.floor(F.col("id") / 10)).orderBy("id")
    return near.select(F.col("c_id").alias("src"), F.lead("c_id").over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shape(s, d):
    w = W.partitionBy(F.floor(F.col("id") / 10)).orderBy("id")
    x = v.scaled(vectors(s, d), "v").withColumn("before", F.lag("v").over(w)).where("before is not null")
    return v.transition_shape(x, "before", "v", F.lit(10.0)).select("id", F.posexplode("direction").alias("k", "direction"), "magnitude", "velocity", "curvature").select("id", (F.col("k") + 1).cast("long").alias("k"), *[r6(c).alias(c) for c in ("direction", "magnitude", "velocity", "curvature")])

"""Registered queries of the scans, imports and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sequences import ngram_counts
from ..registry import query, table
from ..sources import readers as r
from .library import CONTEXTS, PHRASES, phrases
from .lineage import shared_path
from .sequence_queries import C, T, all_grams, events

P = f"with {PHRASES} "
#: Rows of a table that one document of a written file holds.
CHUNK = 1000


def _written(spark, rows, key, entry, keys=()):
    """The path of JSON documents {**keys, entries: map of key to entry}, made of rows and written for the readers."""
    by = rows.groupBy(*keys, F.floor(F.col(key) / CHUNK).alias("_chunk"))
    return by.agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), entry))).alias("phrases")), shared_path(spark, "fixture")


def _database(spark, d):
    """phrases of a nested JSON database that is written from part."""
    contexts = F.transform("contexts", lambda c: F.struct(c["name"].alias("context_name"), c["n"].cast("int").alias("count")))
    p = phrases(spark, d).withColumn("contexts", contexts)
    docs, path = _written(spark, p, "key", F.struct(F.struct(F.col("f0").alias("mean_f0_hz")).alias("acoustic_features"), "contexts"), ["species"])
    r.write_documents(docs.select(F.to_json(F.struct(F.create_map("species", F.struct("phrases")).alias("species_data"))).alias("json")), path)
    return r.read_database(spark, path)["phrases"]


def _library(spark, d, name, brand):
    """The phrases of a species' library files that are written from part, one brand's under the species' column names."""
    given = phrases(spark, d).where(F.col("species") == brand)
    docs, path = _written(spark, given, "key", F.struct(F.col("f0").alias(r.LIBRARIES[name][0]["mean_f0_hz"])))
    r.write_documents(docs.select(F.to_json(F.struct("phrases")).alias("json")), path)
    return r.read_library(spark, path, name).select(F.col("key").cast("long").alias("key"), F.lit(brand).alias("species"), "mean_f0_hz")


def _manifest(spark, d):
    """Segments of manifest files that are written from embeddings; the file's name is the vector's id."""
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    segment = F.struct(F.col("vec_id").cast("string").alias("file_path"), F.col("embedding").alias("features_112d"))
    path = shared_path(spark, "fixture")
    docs = e.groupBy(F.floor(F.col("vec_id") / CHUNK)).agg(F.collect_list(segment).alias("segments"))
    r.write_documents(docs.select(F.to_json(F.struct(F.lit("1").alias("version"), F.lit(44100).alias("sample_rate"), "segments")).alias("json")), path)
    return r.read_manifest(spark, path, 64).select(F.col("file_path").cast("long").alias("vec_id"), F.size("features_112d").alias("width"))


query("io01_nested_scan", f"with {PHRASES}, {CONTEXTS}, t as (select key, sum(i) as t from contexts group by key) select c.key, c.name as context, round(100 * i / t, 6) as percentage from contexts c join t on c.key = t.key")(
    lambda s, d: _database(s, d).select(F.col("key").cast("long").alias("key"), F.explode("contexts").alias("c")).select("key", F.col("c.context_name").alias("context"), "c.percentage")
)
query("io02_database_json", P + "select species, '{\"rules\":' || n || '}' as json from (select species, count(*) as n from phrases group by 1)")(lambda s, d: phrases(s, d).groupBy("species").agg(F.count("*").alias("rules")).select("species", F.to_json(F.struct("rules")).alias("json")))
query("io03_props_scan", "select event_id, json_extract(props, '$.k')::int as k from events")(lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")))
query("io04_export_csv", "select p_partkey::varchar || ',' || p_brand || ',' || p_size as line from part")(lambda s, d: table(s, d, "part").select(F.to_csv(F.struct("p_partkey", "p_brand", "p_size")).alias("line")))
for _i, _name in enumerate(("io05_marmoset", "io06_egyptian_bat", "io07_dolphin", "io08_chimpanzee")):
    query(_name, P + f"select key, species, f0 as mean_f0_hz from phrases where species = 'Brand#{_i + 1}'")(lambda s, d, i=_i, n=_name: _library(s, d, n[5:], f"Brand#{i + 1}"))
query("io09_sentences", "select 's_' || c_custkey || '_' || i as sentence_id, 'unknown' as context from (select c_custkey, unnest([0, 1]) as i from customer)")(lambda s, d: r.sentence_rows(table(s, d, "customer").select(F.col("c_custkey").alias("cluster"), F.array(F.array("c_name"), F.array("c_mktsegment")).alias("sentences"), F.lit(None).cast("string").alias("context"))).select("sentence_id", "context"))
query("io10_grammar_rules", "select l_returnflag as src, l_linestatus as dst, count(*) as n, 1.0::double as confidence from lineitem group by all")(lambda s, d: r.grammar_rows(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("m")).select(F.create_map("l_returnflag", "m").alias("grammar"))))
query("io11_import_all", "select s_suppkey as id, s_name as name, null::varchar as segment from supplier union all select c_custkey, c_name, c_mktsegment from customer")(lambda s, d: r.union_all([table(s, d, "supplier").selectExpr("s_suppkey as id", "s_name as name"), table(s, d, "customer").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as segment")]))
for _name, _hz, _ms in (("io12_binned_library", 100, 5), ("io13_sweep_library", 1000, 10)):
    _k = f"'F0_' || (floor(f0 / {_hz}) * {_hz})::bigint || '_DUR_' || (floor(duration_ms / {_ms}) * {_ms})::bigint || '_RANGE_' || (floor(f0_range / {_hz}) * {_hz})::bigint"
    query(_name, P + f", k as (select *, {_k} as k from phrases) select k as key, count(*) as members, arg_min(f0, key) as f0, arg_min(duration_ms, key) as duration_ms, arg_min(f0_range, key) as f0_range from k group by k")(
        lambda s, d, hz=_hz, ms=_ms: r.grouped_library(phrases(s, d).withColumnRenamed("key", "id"), r.bin_key(F.col("f0"), F.col("duration_ms"), F.col("f0_range"), hz, ms), "id")
    )
query("io14_capped_per_label", "select p_partkey, p_type from (select *, row_number() over (partition by p_type order by md5(p_partkey::varchar), p_partkey) as k from part) where k <= 20")(lambda s, d: r.capped_per_label(table(s, d, "part"), "p_type", "p_partkey", 20).select("p_partkey", "p_type"))
query("io15_last_per_key", "select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")(lambda s, d: r.last_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderstatus"))
query("io16_parse_annotations", "select o_orderkey * 1000.0 as start_ms, (o_orderkey + 0.5) * 1000.0 as end_ms, o_orderstatus as label, o_orderpriority as context, 1.0 as confidence from orders")(
    lambda s, d: r.parse_annotations(table(s, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), (F.col("o_orderkey") + 0.5).cast("string"), F.lit("\t"), "o_orderstatus", F.lit("|"), "o_orderpriority").alias("value")), "audacity")
)
query("io17_numbered", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as global_id from orders")(lambda s, d: r.numbered(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "global_id"))
query("io18_cluster_exemplars", "select vec_id as id, embedding[1]::double as mean_f0_hz, embedding[2]::double as duration_ms, 0.0 as f0_range_hz, 10.0 as hnr from embeddings")(lambda s, d: r.cluster_exemplars(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 2).cast("array<double>").alias("v"))))
query("io19_manifest_rows", "select vec_id, len(embedding) as width from embeddings where len(embedding) = 64")(_manifest)
for _name, _sql in (("io21_session_export", "select event_id, event_type from events where user_id = 46"), ("io24_experiment", "select event_id, event_type from events where user_id = 8 and event_type = 'error'")):
    query(_name, _sql)(lambda s, d, n=_name: r.lookup(table(s, d, "events"), **({"user_id": 46} if n.startswith("io21") else {"user_id": 8, "event_type": "error"})).select("event_id", "event_type"))
def _upserts(s, d):
    """Parts, and their new sizes with suppliers; the origin is part of the key, as part keys beyond a million meet those of suppliers."""
    part = table(s, d, "part").select("p_partkey", "p_size", F.lit("part").alias("origin"))
    new = part.where("p_partkey % 3 = 0").withColumn("p_size", F.lit(0))
    return part, new.union(table(s, d, "supplier").select(F.col("s_suppkey") + 1000000, F.lit(1), F.lit("supplier")))


query("io22_upsert", "select p_partkey, case when p_partkey % 3 = 0 then 0 else p_size end as p_size from part union all select 1000000 + s_suppkey, 1 from supplier")(lambda s, d: r.upsert(*_upserts(s, d), ["p_partkey", "origin"]).select("p_partkey", "p_size"))
query("io23_access_counts", "select user_id, count(*) as accesses from events where event_type = 'view' group by 1")(lambda s, d: table(s, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("accesses")))
query("io25_latest", "select o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) as o_totalprice from orders group by 1")(lambda s, d: r.last_per_key(table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_totalprice"))
query("io26_table_sizes", "select 'part' as name, count(*) as n from part union all select 'orders', count(*) from orders union all select 'events', count(*) from events union all select 'supplier', count(*) from supplier")(lambda s, d: r.table_sizes({n: table(s, d, n) for n in ("part", "orders", "events", "supplier")}))
query("io27_time_range", "select event_id from events where event_type = 'click' and ts between timestamp '2024-01-02' and timestamp '2024-01-05'")(lambda s, d: r.time_range(table(s, d, "events").withColumnRenamed("event_type", "measurement"), "click", F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-05").cast("timestamp_ntz")).select("event_id"))


def _decisions(spark, d):
    """Decisions logged in two appends and read again."""
    path, rows = shared_path(spark, "decisions"), table(spark, d, "events").select(F.col("event_type").alias("session"), "event_id", "value")
    for part in (F.col("value") < 50, ~F.coalesce(F.col("value") < 50, F.lit(False))):
        r.log_decisions(rows.where(part), path)
    return spark.read.schema("event_id long, value double, session string").parquet(path).select("session", "event_id", "value")


def _archive(spark, d):
    path, rows = shared_path(spark, "archive"), table(spark, d, "events").select("event_id", "user_id", "value")
    r.export_parquet(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def _traces(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("session"), F.lit(1).alias("kind"), F.length("props").alias("flags"), F.col("event_id").cast("double").alias("time"), "value", F.col("event_type").alias("note"))
    return r.unpack_traces(r.pack_traces(rows)).drop("file", "record")


def _snapshot(spark, d):
    path, counts = shared_path(spark, "ngrams"), ngram_counts(events(spark, d), [2, 3])
    r.save_ngrams(counts, path)
    return spark.read.schema(counts.schema).parquet(path)


query("io20_decision_log", "select event_type as session, event_id, value from events")(_decisions)
query("io28_archive", "select event_id, user_id, value from events")(_archive)
query("io29_trace_records", "select user_id as session, 1 as kind, length(props) as flags, event_id::double as time, value, event_type as note, true as ok from events")(_traces)
query("io30_ngram_snapshot", f"with {T}, {all_grams([2, 3])}, {C} select * from c")(_snapshot)

"""Files round trip; a replayed stream equals the batch."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from sonorant.functions import udfs
from sonorant.sources import readers
from sonorant.streaming import operators as st


def test_database(spark, tmp_path):
    doc = {"species_data": {"bat": {"phrases": {"P1": {"signature": "s", "modality": "fm", "acoustic_features": {"mean_f0_hz": 5.5}, "contexts": [{"context_name": "feed", "count": 3}, {"context_name": "rest", "count": 1}]}}, "sentences": [{"sentence_id": "x", "phrase_sequence": ["P1"]}], "grammar_rules": [{"from_phrase": "P1", "to_phrase": "P1", "frequency": 2}]}}}
    path = tmp_path / "db.json"
    path.write_text(json.dumps(doc))
    got = readers.read_database(spark, str(path))
    r = got["phrases"].first()
    assert (r.mean_f0_hz, r.hnr, [c.percentage for c in r.contexts]) == (5.5, 0.0, [75.0, 25.0])
    assert got["sentences"].first().phrase_sequence == ["P1"] and got["grammar_rules"].first().frequency == 2
    assert readers.read_database(spark, str(tmp_path / "none.json"), True)["phrases"].count() == 0
    with pytest.raises(Exception):
        readers.read_database(spark, str(tmp_path / "none.json"))


def test_libraries(spark, tmp_path):
    path = tmp_path / "lib.json"
    path.write_text(json.dumps({"phrases": {"A": {"mean_f0_hz": 1.0, "mean_range_hz": 2.0, "contexts": {"x": 1}}}}))
    r = readers.read_library(spark, str(path), "egyptian_bat").first()
    assert (r.f0_range_hz, r.modulation_rate, r.contexts) == (2.0, 0.0, {"x": 1})
    assert "contexts" not in readers.read_library(spark, str(path), "dolphin").columns


def test_annotations(spark, tmp_path):
    head = "Emitter,Addressee,Context,a,b,c,d,File Name\n"
    (tmp_path / "a.csv").write_text(head + "1,2,3,0,0,0,0,f1\n5,6,7,0,0,0,0,f1\n")
    assert readers.read_annotations(spark, str(tmp_path / "a.csv")).first().emitter == 5
    (tmp_path / "b.csv").write_text(head + "x,2,3,0,0,0,0,f1\n")
    with pytest.raises(Exception):
        readers.read_annotations(spark, str(tmp_path / "b.csv")).collect()
    lines = spark.createDataFrame([("start,end,label",), ("1,2,call,feed,0.5",), ("oops",), ("3,4,x",)], "value string")
    assert [(r.start_ms, r.context, r.confidence) for r in readers.parse_annotations(lines, "csv").collect()] == [(1.0, "feed", 0.5), (3.0, "", 1.0)]
    raven = spark.createDataFrame([("Selection\tView",), ("1\tw\t1\t0.5\t1.5\t0\t9\tcall",)], "value string")
    assert [(r.start_ms, r.end_ms, r.label) for r in readers.parse_annotations(raven, "raven").collect()] == [(500.0, 1500.0, "call")]


def test_traces(spark, tmp_path):
    good = readers.pack_trace(1, 2, 3, 0.5, 1.5, b"note")
    (tmp_path / "t.bin").write_bytes(good + good[:60][:20] + b"\xff" + good[21:])
    got = readers.read_traces(spark, str(tmp_path / "t.bin")).orderBy("record").collect()
    assert [r.ok for r in got] == [True, False] and got[0].note == "note"
    (tmp_path / "u.bin").write_bytes(good[:50])
    with pytest.raises(Exception):
        readers.read_traces(spark, str(tmp_path / "u.bin")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0])], "id int, s string, v array<double>")
    readers.export_results(df, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["id", "s"]
    readers.export_results(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first().v == [1.0]
    with pytest.raises(ValueError):
        readers.export_results(df, str(tmp_path / "x"), "xml")
    assert readers.export_parquet(df, str(tmp_path / "p")) == 1
    readers.log_decisions(df.withColumn("session", F.lit("q")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("session = 'q'").count() == 1
    readers.save_ngrams(df, str(tmp_path / "n"))
    doc = readers.database_json(spark.createDataFrame([("b", 1, 2.5)], "species string, key int, f0 double"), spark.createDataFrame([("b", "x", "y", 3)], "species string, src string, dst string, n int")).first()
    assert json.loads(doc.json) == {"phrases": {"1": 2.5}, "rules": [{"src": "x", "dst": "y", "n": 3}]}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"segments": [{"file_path": "f", "features_112d": [0.0] * 112}]}))
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).count() == 1
    with pytest.raises(Exception):
        readers.read_manifest(spark, str(tmp_path / "m.json"), 45).collect()


def stream(spark, tmp_path, rows, schema, parts=3):
    """rows in time order as a stream of several files."""
    n = -(-len(rows) // parts)
    for i in range(parts):
        if rows[i * n : (i + 1) * n]:
            spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return st.replay(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)


def drain(spark, df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [(i % 2, float(i * 7 % 90 + i * 3)) for i in range(30)]
    rows.sort(key=lambda r: r[1])
    batch = {tuple(r) for r in st.debounce(spark.createDataFrame(rows, "k int, t double"), "k", "t", 20).collect()}
    got = drain(spark, st.debounce_stream(stream(spark, tmp_path, rows, "k int, t double", 1), "k", "t", 20), "deb", "append", tmp_path)
    assert {tuple(r) for r in got.collect()} == batch


def test_ema_stream_equals_batch(spark, tmp_path):
    rows = [(i % 2, float(i), float(i * i % 11)) for i in range(20)]
    batch = {r.k: r.ema for r in st.ema(spark.createDataFrame(rows, "k int, t double, v double"), "k", "t", "v").collect()}
    got = drain(spark, st.ema_stream(stream(spark, tmp_path, rows, "k int, t double, v double", 1), "k", "t", "v"), "ema", "update", tmp_path)
    assert {r.k: round(r.ema, 6) for r in got.collect()} == batch


def test_windows_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(30)]
    src = stream(spark, tmp_path, rows, "id int, ts string, v double", 1).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute")
    got = drain(spark, st.downsample(src, "ts", "v", "10 minutes"), "down", "append", tmp_path)
    assert {r.n for r in got.collect()} == {10}


def test_parse_events_dead_letters(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("broken",)], "value string")
    good, bad = st.parse_events(raw, "a int")
    assert [r.a for r in good.collect()] == [1] and [r.value for r in bad.collect()] == ["broken"]


def test_traces_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.trace").write_bytes(b"".join(readers.pack_trace(i, k, 0, float(k), 0.5, b"n") for k in range(i)))
    got = readers.read_traces(spark, str(tmp_path)).collect()
    assert sorted((r.session, r.kind, r.record, r.ok) for r in got) == [(1, 0, 0, True), (2, 0, 0, True), (2, 1, 1, True)]


def test_sync_loses_nothing(spark):
    q = spark.createDataFrame([(1, 9, 0, 50), (2, 5, 0, 80), (3, 1, 0, 10)], "id int, priority int, time int, bytes int")
    sent, left = st.sync_batch(q, 100)
    assert {r.id for r in sent.collect()} == {1} and {r.id for r in left.collect()} == {2, 3}


def test_late_rows_at_the_limit(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 90.0), (3, 89.0)], "arrival int, t double")
    assert {r.arrival for r in st.drop_late(df, "t", 10).collect()} == {1, 2}


def test_predicate_errors_are_false(spark):
    assert [r.valid for r in udfs.validate(spark.createDataFrame([(0,), (2,)], "x int"), "x", lambda x: 1 / x < 1).orderBy("x").collect()] == [False, True]


def test_idioms(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcab")], "seq int, pos int, token string")
    got = [(r.pos, r.part, r.role) for r in udfs.parse_idioms(t, {"a": ["a", "b"]}, ["c"], []).orderBy("pos").collect()]
    assert got == [(0, "a b", "idiom"), (2, "c", "content"), (3, "a b", "idiom")]


def tables_with(spark, tmp_path, **tables):
    """A folder of the driver's tables with some of them put in place."""
    import os

    import oracle

    for t in oracle.TABLES:
        if t in tables:
            tables[t].coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        else:
            os.symlink(f"{oracle.DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def differs(spark, sf_dir, name):
    import duckdb
    import oracle

    from sonorant import registry
    from sonorant.plans import catalog  # noqa: F401

    con = duckdb.connect()
    for t in oracle.TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{at}/*.parquet')" if pathlib.Path(at).is_dir() else f"create view {t} as select * from read_parquet('{at}')")
    return oracle.difference(spark, con, name, registry.QUERIES[name], registry.ORACLES[name], sf_dir)


def test_upsert_keeps_parts_whose_key_meets_a_supplier(spark, tmp_path):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 999990)
    assert differs(spark, tables_with(spark, tmp_path, part=part), "io22_upsert") == ""


def odd_events(spark):
    """Users that start at zero, from or to null, and fall to zero."""
    pairs = [(0.0, 5.0), (0.0, 0.0), (None, 3.0), (2.0, None), (None, None), (4.0, 0.0), (5.0, 12.0), (0.0, None)]
    rows = [(2 * u + k, u, "click", p[k]) for u, p in enumerate(pairs) for k in (0, 1)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    return e.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' as ts", "user_id", "event_type", "value", "'{}' as props")


def test_soak_from_zero_and_null_equals_sql(spark, tmp_path):
    assert differs(spark, tables_with(spark, tmp_path, events=odd_events(spark)), "st20_soak") == ""


def test_validate_zero_and_null_equals_sql(spark, tmp_path):
    assert differs(spark, tables_with(spark, tmp_path, events=odd_events(spark)), "u01_validate") == ""


def test_superpositions_of_no_length_equal_sql(spark, tmp_path):
    rows = [(1, 0, 5.0), (2, 100, 0.0), (3, 100, 0.0), (4, 50, 3.0), (5, 0, None), (6, 500, 0.0)]
    e = spark.createDataFrame(rows, "event_id long, s int, value double").selectExpr("event_id", "timestampadd(second, s, timestamp_ntz '2024-01-01 00:00:00') as ts", "1L as user_id", "'click' as event_type", "value", "'{}' as props")
    assert differs(spark, tables_with(spark, tmp_path, events=e), "j03_superpositions") == ""


def test_superpositions_without_end_equal_sql(spark, tmp_path):
    rows = [(1, 0, float("nan")), (2, 9000, 5.0), (3, 20000, float("inf")), (4, 90000, 0.0), (5, 90000, -3.0), (6, 100, 400.0), (7, 200000, 1.0)]
    e = spark.createDataFrame(rows, "event_id long, s int, value double").selectExpr("event_id", "timestampadd(second, s, timestamp_ntz '2024-01-01 00:00:00') as ts", "1L as user_id", "'click' as event_type", "value", "'{}' as props")
    assert differs(spark, tables_with(spark, tmp_path, events=e), "j03_superpositions") == ""


def test_superpositions_of_split_cells_equal_brute_force(spark):
    import numpy as np

    from sonorant.operators import joins

    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2] if i % 11 else None, float(s), float(s + n)) for i, s, n in zip(range(300), rng.integers(0, 900, 300), rng.integers(-2, 60, 300), strict=True)]
    got = joins.superpositions(spark.createDataFrame(rows, "id int, modality string, start double, stop double"), 20, size=25).collect()
    want = {}
    for i, m, s, t in rows:
        for j, n, u, v in rows[i + 1 :]:
            if m is not None and m == n and s < v and u < t:
                common, length = min(t, v) - max(s, u), min(t - s, v - u)
                want[i, j] = round(common / length, 6) if length else float("nan")
    want = {k: v for k, v in want.items() if not v < 0.3}
    assert len(got) == len(want) and all(r.ratio == pytest.approx(want[r.a_id, r.b_id], abs=1e-6, nan_ok=True) for r in got)

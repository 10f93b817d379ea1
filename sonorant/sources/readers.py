"""Readers and writers of the corpus formats. Schemas are explicit, so no inference pass reads the data twice."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import lineage

FEATURES = "mean_f0_hz double, f0_range_hz double, duration_ms double, hnr double, spectral_flatness double, attack_time_ms double, jitter double, onset_rate_hz double"
CONTEXT = "struct<context_name:string,count:int,percentage:double>"
PHRASE = f"struct<signature:string,species:string,modality:string,acoustic_features:struct<{FEATURES.replace(' double', ':double')}>,total_occurrences:int,contexts:array<{CONTEXT}>,social_contexts:map<string,int>>"
SENTENCE = "struct<sentence_id:string,phrase_sequence:array<string>,context:string>"
RULE = "struct<rule_id:string,from_phrase:string,to_phrase:string,frequency:int,confidence:double>"
DATABASE = f"species_data map<string,struct<phrases:map<string,{PHRASE}>,sentences:array<{SENTENCE}>,grammar_rules:array<{RULE}>>>"


def read_database(spark: SparkSession, path: str, empty_on_failure: bool = False) -> dict[str, DataFrame]:
    """IO1, IO3: phrases, sentences and grammar_rules of a nested JSON database; missing optional numbers are 0, shares are recomputed.

    A missing or unreadable file is an error, or three empty tables if asked.
    """
    try:
        doc = spark.read.schema(DATABASE).json(path, multiLine=True, mode="FAILFAST")
        doc.limit(1).count()
    except Exception:
        if not empty_on_failure:
            raise
        doc = spark.createDataFrame([], DATABASE)
    by = doc.select(F.explode("species_data").alias("species", "d"))
    p = by.select("species", F.explode("d.phrases").alias("key", "p"))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    total = F.aggregate(F.coalesce("p.contexts", F.array().cast(f"array<{CONTEXT}>")), F.lit(0), lambda s, c: s + F.coalesce(c["count"], F.lit(0)))
    shares = F.transform("p.contexts", lambda c: F.struct(c["context_name"].alias("context_name"), c["count"].alias("count"), F.when(total > 0, F.round(100 * c["count"] / total, 6)).otherwise(0.0).alias("percentage")))
    phrases = p.select("species", "key", F.col("p.signature").alias("signature"), F.col("p.modality").alias("modality"), *[F.coalesce(f"p.acoustic_features.{n}", F.lit(0.0)).alias(n) for n in names], F.coalesce("p.total_occurrences", F.lit(0)).alias("total_occurrences"), F.coalesce(shares, F.array().cast(f"array<{CONTEXT}>")).alias("contexts"))
    return {"phrases": phrases, "sentences": by.select("species", F.explode("d.sentences").alias("s")).select("species", "s.*"), "grammar_rules": by.select("species", F.explode("d.grammar_rules").alias("r")).select("species", "r.*")}


def database_json(phrases: DataFrame, rules: DataFrame) -> DataFrame:
    """IO2: (species, json) documents of phrases(species, key, f0) and rules(species, src, dst, n), keys in order."""
    p = phrases.groupBy("species").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key").cast("string"), F.col("f0"))))).alias("phrases"))
    r = rules.groupBy("species").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "n"))).alias("rules"))
    return p.join(r, "species", "full").select("species", F.to_json(F.struct("phrases", "rules")).alias("json"))


def export_results(results: DataFrame, path: str, kind: str) -> None:
    """IO4, IO21: JSON lines, or CSV of the scalar columns; any other format is an error."""
    if kind == "json":
        results.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [f.name for f in results.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
        results.select(*flat).write.mode("overwrite").csv(path, header=True)
    else:
        raise ValueError(f"unknown format {kind}")


#: IO5 to IO8: what a species library file calls the common columns, whether contexts are kept, and the modality.
LIBRARIES = {
    "marmoset": ({"mean_f0_hz": "mean_f0_hz", "f0_range_hz": "f0_range_hz"}, True, "harmonic"),
    "egyptian_bat": ({"mean_f0_hz": "mean_f0_hz", "f0_range_hz": "mean_range_hz", "modulation_rate": "mean_modulation_rate"}, True, "fm_sweep"),
    "dolphin": ({"mean_f0_hz": "mean_f0_hz", "f0_slope": "mean_slope"}, False, "whistle"),
    "chimpanzee": ({"mean_f0_hz": "mean_f0_hz"}, False, "harmonic"),
}


def read_library(spark: SparkSession, path: str, species: str) -> DataFrame:
    """IO5 to IO8: a library file, a map from phrase key to its numbers and contexts, with the species' column names."""
    names, contexts, modality = LIBRARIES[species]
    fields = ",".join(f"{x}:double" for x in dict.fromkeys(names.values()))
    doc = spark.read.schema(f"phrases map<string,struct<{fields},contexts:map<string,int>>>").json(path, multiLine=True)
    x = doc.select(F.explode("phrases").alias("key", "p"))
    return x.select(F.lit(species).alias("species"), "key", F.lit(modality).alias("modality"), *[F.coalesce(f"p.{b}", F.lit(0.0)).alias(a) for a, b in names.items()], *([F.col("p.contexts").alias("contexts")] if contexts else []))


def sentence_rows(clusters: DataFrame) -> DataFrame:
    """IO9 over clusters(cluster, sentences array<array<string>>, context): one row each, with a made id; no context: 'unknown'."""
    x = clusters.select("cluster", F.posexplode("sentences").alias("i", "phrases"), F.coalesce("context", F.lit("unknown")).alias("context"))
    return x.select(F.concat_ws("_", F.lit("s"), "cluster", "i").alias("sentence_id"), "phrases", "context")


def grammar_rows(nested: DataFrame) -> DataFrame:
    """IO10 over nested(grammar map<from, map<to, n>>): edges with confidence 1."""
    x = nested.select(F.explode("grammar").alias("src", "m"))
    return x.select("src", F.explode("m").alias("dst", "n")).withColumn("confidence", F.lit(1.0))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """IO11: union by name of several species' tables; what one lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def bin_key(f0: Column, duration: Column, f0_range: Column, hz: int = 100, ms: int = 5) -> Column:
    """IO12, IO13: the key of a phrase's bins (1000 Hz and 10 ms for sweeps)."""
    cut = lambda c, w: (F.floor(c / w) * w).cast("long").cast("string")
    return F.concat(F.lit("F0_"), cut(f0, hz), F.lit("_DUR_"), cut(duration, ms), F.lit("_RANGE_"), cut(f0_range, hz))


def grouped_library(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """IO12, IO13: one row per key: members, and the features of its first member."""
    return rows.withColumn("key", key).groupBy("key").agg(F.count("*").alias("members"), F.min_by(F.struct("f0", "duration_ms", "f0_range"), order).alias("x")).select("key", "members", "x.*")


def capped_per_label(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """IO14: at most ``most`` rows per label, in the order of the key's MD5."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(F.md5(F.col(key).cast("string")), key))).where(F.col("_k") <= most).drop("_k")


ANNOTATION = "emitter int, addressee int, context int, emitter_pre int, addressee_pre int, emitter_post int, addressee_post int, file string"


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """IO15: strict integer CSV with a header; of a file's duplicates the last line counts."""
    rows = spark.read.schema(ANNOTATION).csv(path, header=True, mode="FAILFAST").select("*", F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return last_per_key(rows, "file", F.struct("_b", "_i")).drop("_b", "_i")


def last_per_key(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """IO15, IO25: the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def parse_annotations(lines: DataFrame, kind: str) -> DataFrame:
    """IO16 over lines(value): (start_ms, end_ms, label, context, confidence).

    raven: tabs, seconds in columns 4 and 5, label in 8, header dropped; audacity: tabs, seconds, 'label|context';
    csv: milliseconds, bad lines dropped. Bad times of the first two are errors.
    """
    if kind == "csv":
        c = F.split("value", ",")
        x = lines.select(F.trim(F.get(c, F.lit(0))).try_cast("double").alias("start_ms"), F.trim(F.get(c, F.lit(1))).try_cast("double").alias("end_ms"), F.trim(F.get(c, F.lit(2))).alias("label"), F.coalesce(F.trim(F.get(c, F.lit(3))), F.lit("")).alias("context"), F.coalesce(F.trim(F.get(c, F.lit(4))).try_cast("double"), F.lit(1.0)).alias("confidence"))
        return x.where("start_ms is not null and end_ms is not null")
    c = F.split("value", "\t")
    a, b, k = (3, 4, 7) if kind == "raven" else (0, 1, 2)
    rows = lines.where(~F.col("value").startswith("Selection") & (F.trim("value") != ""))
    label = F.split(F.get(c, F.lit(k)), r"\|")
    return rows.select((F.get(c, F.lit(a)).cast("double") * 1000).alias("start_ms"), (F.get(c, F.lit(b)).cast("double") * 1000).alias("end_ms"), F.get(label, F.lit(0)).alias("label"), F.coalesce(F.get(label, F.lit(1)), F.lit("")).alias("context"), F.lit(1.0).alias("confidence"))


def numbered(rows: DataFrame, order: list[str], name: str = "global_id") -> DataFrame:
    """IO17: a running number from 0 over all rows in an order, without one task for all: range partitions plus their offsets."""
    return lineage.numbered(rows, order, name)


def cluster_exemplars(clusters: DataFrame) -> DataFrame:
    """IO18 over clusters(id, v): named vector places 0, 1, 2, 3 with defaults where a vector is short."""
    names = (("mean_f0_hz", 0, 0.0), ("duration_ms", 1, 100.0), ("f0_range_hz", 2, 0.0), ("hnr", 3, 10.0))
    return clusters.select("id", *[F.coalesce(F.get("v", F.lit(i)), F.lit(x)).alias(n) for n, i, x in names])


MANIFEST = "version string, sample_rate int, segments array<struct<file_path:string,features_112d:array<float>,duration_ms:float,mean_f0_hz:float,start_time_ms:double,end_time_ms:double>>"


def read_manifest(spark: SparkSession, path: str, width: int = 112) -> DataFrame:
    """IO19: segments with a file and a vector of the stated width; others are an error."""
    x = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("segments").alias("segment", "s")).select("segment", "s.*")
    bad = F.col("file_path").isNull() | F.col("features_112d").isNull() | (F.size("features_112d") != width)
    return x.withColumn("file_path", F.when(bad, F.raise_error(F.lit("segment without file or vector"))).otherwise(F.col("file_path")))


def write_documents(documents: DataFrame, path: str) -> None:
    """IO1, IO5 to IO8, IO19: the form their readers take: each value of documents(json) is a file of its own."""
    documents.select("json").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def log_decisions(rows: DataFrame, path: str) -> None:
    """IO20: append decisions, one folder per session."""
    rows.write.mode("append").partitionBy("session").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """IO22, IO25: new rows replace old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def lookup(rows: DataFrame, **key: object) -> DataFrame:
    """IO21, IO23, IO24: rows of an exact composite key."""
    for c, v in key.items():
        rows = rows.where(F.col(c) == v)
    return rows


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """IO26: (name, n) of several tables."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def time_range(points: DataFrame, measurement: str, start, stop) -> DataFrame:
    """IO27: points of a measurement in a closed time range; both predicates reach the scan."""
    return points.where((F.col("measurement") == measurement) & F.col("ts").between(start, stop))


def export_parquet(points: DataFrame, path: str, codec: str = "zstd") -> int:
    """IO28: write a compressed archive; returns its rows."""
    points.write.mode("overwrite").option("compression", codec).parquet(path)
    return points.sparkSession.read.parquet(path).count()


_TRACE = "<QIIdd22s"


def pack_trace(session: int, kind: int, flags: int, time: float, value: float, note: bytes) -> bytes:
    """IO29: a 64-byte record: 54 packed bytes, their CRC32, 6 zero bytes."""
    body = struct.pack(_TRACE, session, kind, flags, time, value, note)
    return body + struct.pack("<I", zlib.crc32(body)) + bytes(6)


def pack_traces(rows: DataFrame, records: int = 4096) -> DataFrame:
    """IO29 over rows(session, kind, flags, time, value, note): (path, content) of binary files of ``records`` records or fewer."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), records):
                part = pdf.iloc[at : at + records]
                first = part.iloc[0]
                data = b"".join(pack_trace(r.session, r.kind, r.flags, r.time, r.value, r.note.encode()) for r in part.itertuples())
                yield pd.DataFrame({"path": [f"{first.session}-{first.time}.trace"], "content": [data]})

    return rows.select("session", "kind", "flags", "time", "value", "note").mapInPandas(run, "path string, content binary")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """IO29: records of a folder's binary files."""
    return unpack_traces(spark.read.format("binaryFile").load(path).select("path", "content"))


def unpack_traces(files: DataFrame) -> DataFrame:
    """IO29 over files(path, content): their records; a length that isn't a multiple of 64 is an error, ok tells whether the checksum fits."""

    def run(batches):
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if len(data) % 64:
                    raise ValueError(f"{name}: {len(data)} bytes are no whole records")
                for i in range(0, len(data), 64):
                    r = bytes(data[i : i + 64])
                    s, k, f, t, v, note = struct.unpack(_TRACE, r[:54])
                    out.append((Path(name).name, i // 64, s, k, f, t, v, note.rstrip(b"\0").decode("utf-8", "replace"), struct.unpack("<I", r[54:58])[0] == zlib.crc32(r[:54])))
            yield pd.DataFrame(out, columns=["file", "record", "session", "kind", "flags", "time", "value", "note", "ok"])

    return files.select("path", "content").mapInPandas(run, "file string, record long, session long, kind long, flags long, time double, value double, note string, ok boolean")


def save_ngrams(counts: DataFrame, path: str) -> None:
    """IO30: an n-gram snapshot; Parquet keeps the columns as they are."""
    counts.write.mode("overwrite").parquet(path)

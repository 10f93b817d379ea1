"""Registered queries of the lookups, predicates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..registry import query, table
from .library import CONTEXTS, PHRASES, phrases

P = f"with {PHRASES} "
PC = f"with {PHRASES}, {CONTEXTS} "
INTENTS = {"heavy": ["steel", "iron"], "small": ["small", "tiny"]}


def _add(name, function, sql, keep=("key",)):
    query(name, sql)(lambda spark, d: function(phrases(spark, d)).select(*keep))


_add("f01_by_key", lambda p: f.by_key(p, 77), P + "select key, species, f0 from phrases where key = 77", ("key", "species", "f0"))
_add("f02_by_species", lambda p: f.by_species(p, "Brand#2"), P + "select key, f0 from phrases where species = 'Brand#2'", ("key", "f0"))
query("f03_by_modality", P + "select species, string_agg(key::varchar, ' ' order by key) as keys from phrases where modality = 'ECONOMY' group by species")(lambda s, d: f.by_modality(phrases(s, d), "ECONOMY").select("species", F.concat_ws(" ", F.transform("keys", lambda x: x.cast("string"))).alias("keys")))
query("f04_transitions_from", "with e as (select l_returnflag as src, l_linestatus as dst, l_linenumber as n from lineitem) select src, dst, sum(n)::bigint as n from e where src = 'A' group by all")(lambda s, d: f.transitions_from(table(s, d, "lineitem").selectExpr("l_returnflag as src", "l_linestatus as dst", "l_linenumber as n"), "A"))
for _name, _col, _low, _high, _desc in (("f05_f0_range", "f0", 950, 1000, None), ("f06_duration", "duration_ms", 100, 150, None), ("f07_hnr", "hnr", 10, 20, True), ("f08_flatness", "flatness", 0.2, 0.4, False), ("f09_attack", "attack", 5, 9, False), ("f10_jitter", "jitter", 0.03, 0.06, False), ("f11_onset_rate", "onset_rate", 4, 9, True)):
    _add(_name, lambda p, c=_col, a=_low, b=_high, k=_desc: f.in_range(p, c, a, b, "Brand#3", k), P + f"select key, {_col} from phrases where {_col} between {_low} and {_high} and species = 'Brand#3'", ("key", _col))
for _name, _rule in (("f12_pure", "hnr > 20 and flatness < 0.1 and attack > 20 and jitter < 0.05"), ("f13_gritty", "hnr < 5 and flatness > 0.6 and attack < 5 and jitter > 0.1"), ("f14_rhythmic", "onset_rate > 15 and icv > 0 and icv < 0.3"), ("f15_harmonic", "onset_rate = 0 and ici = 0")):
    _add(_name, lambda p, n=_name: f.persona(p, n.split("_")[1]), P + f"select key, hnr, onset_rate from phrases where {_rule}", ("key", "hnr", "onset_rate"))
_LABEL = "h as (select key, species, name as context, confidence, row_number() over (partition by key order by i) as k from contexts where contains(lower(name), 'ri') and confidence >= 0.5)"
_add("f16_by_label", lambda p: f.by_label(p, "RI", 0.5), f"with {PHRASES}, {CONTEXTS}, {_LABEL} select key, species, context, confidence from h where k = 1", ("key", "species", "context", "confidence"))
_add("f17_by_intent", lambda p: f.by_intent(p, "Small", INTENTS), PC + "select distinct key from contexts where contains(name, 'small') or contains(name, 'tiny')")
_add("f18_by_grading", lambda p: f.by_grading(p, 0.2, 0.5), P + "select key, score from (select key, round(least(1, (5 * jitter + flatness + f0_range / 5000) / 3), 6) as score from phrases) where score between 0.2 and 0.5", ("key", "score"))
query("f19_label_across_species", f"with {PHRASES}, {CONTEXTS}, {_LABEL} select species, count(*) as n from h where k = 1 group by species")(lambda s, d: f.by_label(phrases(s, d), "ri", 0.5).groupBy("species").agg(F.count("*").alias("n")))
query("f20_labels", PC + "select distinct name as label from contexts")(lambda s, d: f.labels(phrases(s, d)))
query("f21_intents", "select * from (values ('heavy', 'steel'), ('heavy', 'iron'), ('small', 'small'), ('small', 'tiny')) t(intent, label)")(lambda s, d: f.constant(s, [(k, x) for k, v in INTENTS.items() for x in v], "intent string, label string"))
query("f22_containing", PC + "select distinct key from contexts where name = 'ring'")(lambda s, d: f.containing(phrases(s, d).select("key", F.col("contexts.name").alias("words")), "words", "ring").select("key"))
query("f23_inside", "select event_id from events where event_id >= 100 and event_id + value <= 300")(lambda s, d: f.inside(table(s, d, "events").select("event_id", (F.col("event_id") + F.col("value")).alias("stop")), "event_id", "stop", 100, 300).select("event_id"))
_add("f24_with_context", lambda p: f.with_context(p, "small"), PC + "select distinct key from contexts where name = 'small'")
query("f25_traces", "select event_id as id from events where event_type = 'click' and event_id between 50 and 900 and user_id = 46")(lambda s, d: f.traces(table(s, d, "events").selectExpr("event_id as id", "event_id as time", "event_type as kind", "user_id as session"), "click", 50, 900, 46).select("id"))
_CHECK = "case when duration_ms < 50 then 'duration' when hnr < 5 then 'hnr' when flatness > 0.8 then 'flatness' else 'ok' end"
query("f26_purity", P + f"select {_CHECK} as reason, count(*) as n from phrases group by 1")(lambda s, d: phrases(s, d).select(f.purity([("duration", F.col("duration_ms") < 50), ("hnr", F.col("hnr") < 5), ("flatness", F.col("flatness") > 0.8)]).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")))
query("f27_canonical", "select c_custkey, replace(lower(c_mktsegment || '_X'), '_', ' ') as label from customer")(lambda s, d: table(s, d, "customer").select("c_custkey", f.canonical(F.concat("c_mktsegment", F.lit("_X"))).alias("label")))
RULES = [("econ", "cheap"), ("stand", "plain"), ("prom", "offer")]
_RULE = "case when contains(lower(p_type), 'econ') then 'cheap' when contains(lower(p_type), 'stand') then 'plain' when contains(lower(p_type), 'prom') then 'offer' else 'other' end"
for _name in ("f28_acoustic_group", "f29_taxon", "f30_taxonomic_group"):
    query(_name, f"select p_partkey, {_RULE} as grp from part")(lambda s, d: table(s, d, "part").select("p_partkey", f.first_rule(F.col("p_type"), RULES, "other").alias("grp")))
query("f31_rain", "select event_id, case when value <= 0 then 'none' when value < 2.5 then 'light' when value < 10 then 'moderate' when value < 50 then 'heavy' else 'storm' end as rain from events")(lambda s, d: table(s, d, "events").select("event_id", f.rain(F.col("value")).alias("rain")))
query("f32_describe", P + "select key, 'pitch: ' || case when f0 < 1000 then 'low' else 'high' end || ', noise: ' || case when flatness < 0.3 then 'clear' when flatness < 0.6 then 'mixed' else 'noisy' end as said from phrases")(lambda s, d: phrases(s, d).select("key", f.describe({"pitch": f.banded(F.col("f0"), [(1000, "low")], "high"), "noise": f.banded(F.col("flatness"), [(0.3, "clear"), (0.6, "mixed")], "noisy")}).alias("said")))
query("f33_nervousness", P + "select key, case when jitter < 0.02 and icv / 10 < 0.02 then 'calm' when jitter > 0.05 and icv / 10 > 0.05 then 'agitated' when jitter > 0.05 and icv / 10 < 0.02 then 'pitch-unstable' when jitter < 0.02 and icv / 10 > 0.05 then 'amplitude-unstable' else 'intermediate' end as mood from phrases")(lambda s, d: phrases(s, d).select("key", f.nervousness(F.col("jitter"), F.col("icv") / 10).alias("mood")))
#: Species registry: vocabulary size and pitch range, as a caller would supply it.
REGISTRY = [("Brand#1", 50, 900.0, 1000.0), ("Brand#2", 80, 950.0, 1100.0)]
query("a43_species_registry", P + ", r(species, vocabulary, low, high) as (values ('Brand#1', 50, 900e0, 1000e0), ('Brand#2', 80, 950e0, 1100e0)) select r.species, vocabulary, count(key) as inside from r left join phrases p on p.species = r.species and f0 between low and high group by all")(
    lambda s, d: (lambda r: r.join(phrases(s, d).withColumnRenamed("species", "sp"), (F.col("sp") == F.col("species")) & F.col("f0").between(F.col("low"), F.col("high")), "left").groupBy("species", "vocabulary").agg(F.count("key").alias("inside")))(f.constant(s, REGISTRY, "species string, vocabulary int, low double, high double"))
)

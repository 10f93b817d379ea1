"""Point lookups, range predicates and rule projections over a phrase library.

Phrase columns: key, species, modality, f0, duration_ms, f0_range, hnr, flatness, attack, jitter, onset_rate, icv, ici,
occurrences, contexts (array of struct<name, n, confidence>). A species that the data lack gives no rows (Q2); every
ranking is broken by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_key(phrases: DataFrame) -> DataFrame:
    """one row per key, that of the last species."""
    return phrases.groupBy("key").agg(F.max_by(F.struct(*phrases.columns), "species").alias("x")).select("x.*")


def by_key(phrases: DataFrame, key: object) -> DataFrame:
    """the phrase of a key."""
    return one_per_key(phrases.where(F.col("key") == key))


def by_species(phrases: DataFrame, species: str) -> DataFrame:
    """F2."""
    return phrases.where(F.col("species") == species)


def by_modality(phrases: DataFrame, modality: str) -> DataFrame:
    """the keys of a modality per species, in key order."""
    return phrases.where(F.col("modality") == modality).groupBy("species").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def transitions_from(edges: DataFrame, src: object) -> DataFrame:
    """edges (src, dst, n) that leave a phrase; duplicates are summed (Q4)."""
    return edges.where(F.col("src") == src).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def in_range(phrases: DataFrame, column: str, low: float, high: float, species: str | None = None, descending: bool | None = None) -> DataFrame:
    """Closed interval on a column, optionally of one species, sorted if asked."""
    out = phrases.where(F.col(column).between(low, high))
    if species is not None:
        out = out.where(F.col("species") == species)
    if descending is not None:
        out = out.orderBy(F.desc(column) if descending else F.asc(column), "key")
    return out


PERSONAS = {
    "pure": ("hnr > 20 and flatness < 0.1D and attack > 20 and jitter < 0.05D", ["hnr desc"]),
    "gritty": ("hnr < 5 and flatness > 0.6D and attack < 5 and jitter > 0.1D", ["hnr asc", "flatness desc"]),
    "rhythmic": ("onset_rate > 15 and icv > 0 and icv < 0.3D", ["onset_rate desc"]),
    "harmonic": ("onset_rate = 0 and ici = 0", ["hnr desc"]),
}


def persona(phrases: DataFrame, name: str, species: str | None = None) -> DataFrame:
    """The phrases of a persona, in its order."""
    rule, order = PERSONAS[name]
    out = phrases.where(rule) if species is None else phrases.where(rule).where(F.col("species") == species)
    return out.orderBy(*[F.expr(x.split()[0]).desc() if x.endswith("desc") else F.expr(x.split()[0]).asc() for x in order], "key")


def by_label(phrases: DataFrame, label: str, least: float = 0.0) -> DataFrame:
    """Phrases with a context whose name holds the label (any case) at the confidence; the first such context."""
    hits = F.filter("contexts", lambda c: F.lower(c["name"]).contains(label.lower()) & (c["confidence"] >= least))
    out = phrases.withColumn("hit", F.get(hits, F.lit(0))).where("hit is not null")
    return out.select("key", "species", F.col("hit.name").alias("context"), F.col("hit.confidence").alias("confidence")).orderBy(F.desc("confidence"), "key")


def by_intent(phrases: DataFrame, intent: str, intents: dict[str, list[str]]) -> DataFrame:
    """phrases with any context that names one of the intent's labels; an unknown intent is its own label."""
    labels = intents.get(intent.lower(), [intent.lower()])
    def any_of(c):
        found = F.lit(False)
        for x in labels:
            found = found | F.lower(c["name"]).contains(x.lower())
        return found
    return phrases.where(F.exists("contexts", any_of))


def grading(jitter: Column, flatness: Column, f0_range: Column) -> Column:
    """min(1, (5 jitter + flatness + range / 5000) / 3)."""
    return F.round(F.least(F.lit(1.0), (5 * jitter + flatness + f0_range / 5000) / 3), 6)


def by_grading(phrases: DataFrame, low: float, high: float) -> DataFrame:
    """phrases by grading score in [low, high], greatest first."""
    out = phrases.withColumn("score", grading(F.col("jitter"), F.col("flatness"), F.col("f0_range")))
    return out.where(F.col("score").between(low, high)).orderBy(F.desc("score"), "key")


def labels(phrases: DataFrame) -> DataFrame:
    """different context names, sorted."""
    return phrases.select(F.explode("contexts.name").alias("label")).distinct().orderBy("label")


def constant(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A constant relation, such as the intents or a species registry."""
    return spark.createDataFrame(rows, schema)


def containing(sentences: DataFrame, column: str, token: object) -> DataFrame:
    """sentences whose token array holds the token."""
    return sentences.where(F.array_contains(column, token))


def inside(df: DataFrame, start: str, stop: str, low: float, high: float) -> DataFrame:
    """intervals that lie in [low, high]."""
    return df.where((F.col(start) >= low) & (F.col(stop) <= high))


def with_context(phrases: DataFrame, name: str) -> DataFrame:
    """phrases any of whose occurrences has this context."""
    return phrases.where(F.exists("contexts", lambda c: c["name"] == name))


def traces(df: DataFrame, kind: str | None = None, start: float = 0, stop: float = 0, session: object = None) -> DataFrame:
    """conjunction of the given predicates (0 or None: absent), closed time range, in time order."""
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    if start:
        df = df.where(F.col("time") >= start)
    if stop:
        df = df.where(F.col("time") <= stop)
    if session is not None:
        df = df.where(F.col("session") == session)
    return df.orderBy("time", "id")


def purity(checks: list[tuple[str, Column]]) -> Column:
    """name of the first failing check (name, condition for failure) in order; 'ok' if none fails; null fails none."""
    out = None
    for name, failing in checks:
        out = F.when(failing, name) if out is None else out.when(failing, name)
    return out.otherwise("ok")


def canonical(label: Column) -> Column:
    """lower case, underscores as blanks."""
    return F.regexp_replace(F.lower(label), "_", " ")


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Group of the first rule (substring, group) that the lower-case text holds. Rules are the caller's."""
    out = None
    for part, group in rules:
        hit = F.lower(text).contains(part)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise(default) if out is not None else F.lit(default)


def banded(value: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    """Name of the first band whose upper bound exceeds the value. F31's rain bands are such a list."""
    out = None
    for top, name in bounds:
        out = F.when(value < top, name) if out is None else out.when(value < top, name)
    return out.otherwise(above)


def rain(mm_h: Column) -> Column:
    """none at or below 0, light under 2.5, moderate under 10, heavy under 50, else storm."""
    return F.when(mm_h <= 0, "none").otherwise(banded(mm_h, [(2.5, "light"), (10, "moderate"), (50, "heavy")], "storm"))


def describe(facets: dict[str, Column]) -> Column:
    """F32: words of several banded facets in one text."""
    return F.concat_ws(", ", *[F.concat_ws(": ", F.lit(k), v) for k, v in facets.items()])


def nervousness(jitter: Column, shimmer: Column) -> Column:
    """calm, agitated, and the two mixed corners; anything else is intermediate."""
    low_j, high_j, low_s, high_s = jitter < 0.02, jitter > 0.05, shimmer < 0.02, shimmer > 0.05
    return F.when(low_j & low_s, "calm").when(high_j & high_s, "agitated").when(high_j & low_s, "pitch-unstable").when(low_j & high_s, "amplitude-unstable").otherwise("intermediate")

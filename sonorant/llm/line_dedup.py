r"""Line deduplication by a log-template tree (operator 6), with DataFrame functions only.

A line's tokens stand between single blanks. Tokens with a digit are variable fields and count as ``<*>``. The tree has a
fixed depth: number of tokens, then the leading tokens; a leaf is what shares all of these. In a leaf that ``min_docs``
or more different texts reach, a token stays where ``min_docs`` or more texts have it at that place, and every other
place is a variable field too. The result is the line's template. A template that recurs in ``min_docs`` or more
different texts, with at least ``steady`` of its tokens fixed, is dropped wherever it stands. Lines of ``long_tokens``
tokens or more are passages: they hardly recur by chance, so ``long_docs`` texts are enough, with ``long_steady`` of the
tokens fixed. With ``keep_first`` (the default) a template's first line stays (of least doc_id, then text hash, then
place), so that of a family of near copies one stays whole. Whole copies of a text count as one text here.

Only narrow rows are shuffled to count leaves; lines travel only if their leaf is reached often enough. The leaves reached
often enough come to the lines in a broadcast while there are at most ``broadcast`` of them (8 bytes each), so a frequent
leaf is no single task; beyond that by an equi-join that adaptive execution may split. Every grouping pre-aggregates.

Edge cases: null text stays null with no lines; empty text is one blank line; blank lines and lines of fewer than
``min_tokens`` tokens always stay; null doc_ids are first of all; repeated rows lose the same lines; an empty table gives
no rows. Extra columns pass through ``dedup_lines`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

MIN_DOCS = 8
MIN_TOKENS = 3
DEPTH = 3
STEADY = 0.5
#: Tokens of a passage, texts that it must recur in, share of its tokens that must be fixed.
LONG_TOKENS, LONG_DOCS, LONG_STEADY = 20, 3, 0.8
#: Leaves that are broadcast at most.
BROADCAST = 1_000_000
#: A recurring template's row (its hash and its first line's place) is so many times a leaf's.
WIDER = 4

#: A token with a digit, after the start of the line or a blank.
_VARIABLE = "(^| )[^ ]*[0-9][^ ]*"


def _masked(line: Column) -> Column:
    return F.regexp_replace(line, _VARIABLE, "$1<*>")


def _leaf(line: Column, depth: int) -> tuple[Column, Column]:
    """(tokens, leaf): the tree path, without cutting the whole line into tokens."""
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return tokens, F.xxhash64(tokens, _masked(F.substring_index(line, " ", depth)))


def _lines(docs: DataFrame, depth: int, min_tokens: int, distinct: bool) -> DataFrame:
    """(doc_id, tkey, place, line, size, leaf) of the lines that may be dropped; with distinct once per row of docs, without place."""
    cut = F.split("text", "\n")
    some = docs.select("doc_id", F.xxhash64("text").alias("tkey"), F.explode(F.array_distinct(cut)).alias("line") if distinct else F.posexplode(cut).alias("place", "line"))
    tokens, leaf = _leaf(F.col("line"), depth)
    return some.where((tokens >= min_tokens) & (F.trim("line") != "")).withColumns({"size": tokens, "leaf": leaf})


def recurring_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, steady: float = STEADY,
    long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS, long_steady: float = LONG_STEADY, broadcast: int = BROADCAST,
) -> DataFrame:
    """(doc_id, tkey, place, template, first) of every line whose template recurs; first marks one line of each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    need = F.when(F.col("size") >= long_tokens, F.lit(long_docs)).otherwise(F.lit(min_docs))  # of a leaf, as its lines are equally long
    hot = _lines(docs, depth, min_tokens, True).select("leaf", "size", "tkey").distinct().groupBy("leaf", "size").count().where(F.col("count") >= need).select("leaf")
    hot = materialize(hot, "hot-leaves")
    if hot.count() <= broadcast:
        hot = F.broadcast(hot)
    lines = _lines(docs, depth, min_tokens, False).join(hot, "leaf", "left_semi")
    lines = materialize(lines.select("doc_id", "tkey", "place", "leaf", "size", _masked(F.col("line")).alias("masked")), "hot-lines")
    forms = lines.select("leaf", "size", "masked", "tkey").distinct().groupBy("leaf", "size", "masked").agg(F.count("*").alias("texts"))
    forms = materialize(forms.withColumn("form", F.xxhash64("leaf", "masked")), "line-forms")
    places = forms.select("leaf", "size", "form", "texts", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    often = places.groupBy("leaf", "size", "at", "token").agg(F.sum("texts").alias("n")).where(F.col("n") >= need).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    named = places.join(often, ["leaf", "at", "token"], "left").withColumn("token", F.when(F.col("fixed"), F.col("token")).otherwise("<*>"))
    templates = named.groupBy("leaf", "size", "form").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("tokens"), F.count_if(F.col("token") != "<*>").alias("fixed"))
    least = F.when(F.col("size") >= long_tokens, F.lit(long_steady)).otherwise(F.lit(steady)) * F.col("size")
    templates = templates.where(F.col("fixed") >= least).select("leaf", "form", F.concat_ws(" ", F.col("tokens.token")).alias("template"))
    marked = lines.withColumn("form", F.xxhash64("leaf", "masked")).drop("masked").join(templates, ["leaf", "form"])
    marked = materialize(marked.select("doc_id", "tkey", "place", "size", "template", F.xxhash64("leaf", "template").alias("tid")), "templates")
    reach = marked.select("tid", "size", "tkey").distinct().groupBy("tid", "size").count().where(F.col("count") >= need)
    first = marked.groupBy("tid").agg(F.min(F.struct("doc_id", "tkey", "place")).alias("first"))
    known = materialize(reach.join(first, "tid").select("tid", "first"), "known-templates")
    if known.count() <= broadcast // WIDER:
        known = F.broadcast(known)
    out = marked.join(known, "tid")
    return out.select("doc_id", "tkey", "place", "template", F.struct("doc_id", "tkey", "place").eqNullSafe(F.col("first")).alias("first"))


def dropped_places(docs: DataFrame, keep_first: bool = True, **options) -> DataFrame:
    """(did, tkey, places): per different document the places of its lines that go; did is doc_id."""
    gone = recurring_lines(docs, **options)
    gone = gone.where("not first") if keep_first else gone
    return gone.groupBy(F.col("doc_id").alias("did"), "tkey").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text without its recurring lines, and two more columns: _n_lines, _n_dropped (int)."""
    gone = dropped_places(docs, **options)
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("did")) & (F.xxhash64("text") == F.col("tkey"))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text").join(gone, key, "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("places", i))
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    counts = [F.coalesce(F.size(lines), F.lit(0)).alias("_n_lines"), F.coalesce(F.size("places"), F.lit(0)).alias("_n_dropped")]
    return joined.select(*columns, *[F.when(F.col("text").isNull(), 0).otherwise(c).alias(n) for c, n in zip(counts, ("_n_lines", "_n_dropped"), strict=True)])


_NEED = f"(case when tokens >= {LONG_TOKENS} then {LONG_DOCS} else {MIN_DOCS} end)"
ORACLE = f"""
with rows_ as (select doc_id, text, string_split(text, chr(10)) as cut from documents where text is not null),
lines as (select doc_id, text, unnest(cut) as line, unnest(range(len(cut))) as place from rows_),
shaped as (select doc_id, text, place, line, length(line) - length(replace(line, ' ', '')) + 1 as tokens,
  regexp_replace(array_to_string(string_split(line, ' ')[1:{DEPTH}], ' '), '{_VARIABLE}', '\\1<*>', 'g') as lead_ from lines),
able as (select * from shaped where tokens >= {MIN_TOKENS} and trim(line, ' ') <> ''),
hot as (select tokens, lead_ from able group by all having count(distinct text) >= {_NEED}),
hot_lines as (select a.*, regexp_replace(a.line, '{_VARIABLE}', '\\1<*>', 'g') as masked from able a join hot h on a.tokens = h.tokens and a.lead_ = h.lead_),
forms as (select tokens, lead_, masked, count(distinct text) as texts from hot_lines group by all),
places as (select tokens, lead_, masked, texts, unnest(string_split(masked, ' ')) as token, unnest(range(tokens)) as at_ from forms),
often as (select tokens, lead_, at_, token from places group by all having sum(texts) >= {_NEED}),
named as (select p.tokens, p.lead_, p.masked, p.at_, case when o.token is null then '<*>' else p.token end as token
  from places p left join often o on p.tokens = o.tokens and p.lead_ = o.lead_ and p.at_ = o.at_ and p.token = o.token),
templates as (select tokens, lead_, masked, string_agg(token, ' ' order by at_) as template from named
  group by tokens, lead_, masked having count(*) filter (token <> '<*>') >= (case when tokens >= {LONG_TOKENS} then {LONG_STEADY} else {STEADY} end) * count(*)),
marked as (select h.doc_id, h.text, h.place, t.tokens, t.lead_, t.template from hot_lines h
  join templates t on h.tokens = t.tokens and h.lead_ = t.lead_ and h.masked = t.masked),
known as (select tokens, lead_, template, min(struct_pack(d := doc_id, p := place)) as first_ from marked group by tokens, lead_, template having count(distinct text) >= {_NEED}),
gone as (select distinct m.doc_id, m.text, m.place from marked m join known k on m.tokens = k.tokens and m.lead_ = k.lead_ and m.template = k.template
  where struct_pack(d := m.doc_id, p := m.place) <> k.first_),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.place) as text from lines l anti join gone g on l.doc_id = g.doc_id and l.text = g.text and l.place = g.place group by l.doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  (case when d.text is null then 0 else len(string_split(d.text, chr(10))) end)::int as n_lines, coalesce(n.n, 0)::int as n_dropped
from documents d left join kept k on d.doc_id = k.doc_id left join (select doc_id, count(*) as n from gone group by 1) n on d.doc_id = n.doc_id
"""


__all__ = ["dedup_lines", "dropped_places", "recurring_lines", "ORACLE"]

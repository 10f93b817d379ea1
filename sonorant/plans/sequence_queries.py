"""Registered queries of the sequence operators: event types per user, roles per conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as seq
from ..registry import query, table

#: The same long form in SQL; ctx is the part of the day.
T = "t as (select user_id as seq, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type as token, hour(ts) // 6 as ctx from events)"
#: A larger vocabulary: token = event_id % 23.
T23 = "t as (select user_id as seq, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, (event_id % 23)::varchar as token from events)"
B = "b as (select * from (select seq, pos, ctx, token as src, lead(token) over (partition by seq order by pos) as dst from t) where dst is not null)"
B23 = B.replace("ctx, ", "")
M = "m as (select src, dst, count(*) as n, count(*) / sum(count(*)) over (partition by src) as q from b group by src, dst)"


def grams(n: int, cols: str = "seq, pos") -> str:
    """SQL of the n-grams of one size, as table g{n}."""
    leads = ", ".join(f"lead(token, {k}) over (partition by seq order by pos) as t{k}" for k in range(1, n))
    text = " || ' ' || ".join(["token", *[f"t{k}" for k in range(1, n)]])
    last = f"t{n - 1}" if n > 1 else "token"
    return f"g{n} as (select {cols}, {n} as n, {text} as ngram from (select *{', ' + leads if leads else ''} from t) where {last} is not null)"


def all_grams(sizes, cols: str = "seq, pos") -> str:
    return ", ".join(grams(n, cols) for n in sizes) + ", g as (" + " union all ".join(f"select * from g{n}" for n in sizes) + ")"


C = "c as (select n, ngram, count(*) as occurrences, count(distinct seq) as sequences from g group by n, ngram)"


def events(spark, d):
    df = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.floor(F.hour("ts") / 6).cast("long").alias("ctx"))
    return seq.tokens(df, "user_id", ["ts", "event_id"], "event_type", "ctx")


def numbers(spark, d):
    df = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_id") % 23).alias("k"))
    return seq.tokens(df, "user_id", ["ts", "event_id"], "k")


def talks(spark, d):
    return seq.tokens(table(spark, d, "conversations"), "conv_id", ["turn"], "role")


TALK = "t as (select conv_id as seq, row_number() over (partition by conv_id order by turn) - 1 as pos, role as token from conversations)"


def _add(name, function, sql, rows=events):
    query(name, sql)(lambda spark, d: function(rows(spark, d)))


_add("w01_ngram_counts", lambda t: seq.ngram_counts(t, range(1, 6)), f"with {T}, {all_grams(range(1, 6))}, {C} select * from c")
_add("w02_top_ngrams", lambda t: seq.top_ngrams(t, 15, 3), f"with {T}, {all_grams([3])}, {C} select ngram, occurrences from c order by occurrences desc, ngram limit 15")
_add("w03_top_segments", lambda t: seq.top_ngrams(t, 10, 1), f"with {T23}, {all_grams([1])}, {C} select ngram, occurrences from c order by occurrences desc, ngram limit 10", numbers)
_add("w04_unique_patterns", lambda t: seq.unique_patterns(t, [2, 3]), f"with {T23}, {all_grams([2, 3])}, {C} select n, ngram from c where occurrences = 1", numbers)
_RUN = "s as (select n from c group by n having max(occurrences) >= {0}), r as (select n, n - 1 = row_number() over (order by n) as ok from s), x as (select coalesce(max(n) filter (ok), 1) as max_n from r)"
_add("w05_max_ngram_length", lambda t: seq.max_ngram_length(t, 40, 6), f"with {T}, {all_grams(range(2, 7))}, {C}, {_RUN.format(40)} select max_n::int as max_n from x")
_add("w06_longest_repeated", lambda t: seq.longest_repeated(t, 40, 6), f"with {T}, {all_grams(range(2, 7))}, {C}, {_RUN.format(40)} select n, ngram, occurrences from c, x where n = max_n order by occurrences desc, ngram limit 1")
_add("w07_analyze_pattern", lambda t: seq.analyze_pattern(t, "click view"), f"with {T}, {grams(2, 'seq, pos, ctx')} select ctx, count(*) as occurrences, count(distinct seq) as sequences, round(count(*) / sum(count(*)) over (), 6) as share from g2 where ngram = 'click view' group by ctx")
_add("w08_query_ngrams", lambda t: seq.query_ngrams(t, [2, 3], 5, 400, 1, 50), f"with {T}, {all_grams([2, 3], 'seq, pos').replace('from t)', 'from t where ctx = 1)')}, {C} select n, ngram, occurrences from c where occurrences between 5 and 400 order by occurrences desc, n, ngram limit 50")
_K = "k as (select unnest([3, 5, 7, 11]) as k), h as (select k, a, b, count(distinct seq) as s from (select seq, k, src::bigint % k as a, dst::bigint % k as b from b, k) group by k, a, b), sc as (select k, count(*) filter (s >= 20) as score from h group by k)"
_add("w09_shared_bigrams", lambda t: seq.shared_bigrams(t, [3, 5, 7, 11], 20), f"with {T23}, {B23}, {_K} select * from sc", numbers)
_add("w10_optimal_k", lambda t: seq.optimal_k(t, [3, 5, 7, 11], 20), f"with {T23}, {B23}, {_K} select * from sc order by score desc, k limit 1", numbers)
_add("w11_summary", lambda t: seq.summary(t, [2, 3]), f"with {T}, {all_grams([1, 2, 3])}, {C} select sum(occurrences) filter (n = 1) as tokens, count(*) filter (n = 1) as types, count(*) filter (n > 1) as ngrams, count(*) filter (n > 1 and occurrences = 1) as once from c")
_add("w12_count_ngrams", lambda t: seq.ngram_counts(t, [2]), f"with {T23}, {all_grams([2])}, {C} select * from c", numbers)
_PMI = "u as (select token, count(*) / sum(count(*)) over () as p from t group by token), bi as (select src, dst, count(*) as n, count(*) / sum(count(*)) over () as pb from b group by src, dst), pm as (select src, dst, n, round(ln(pb / (x.p * y.p)), 6) as pmi from bi join u x on x.token = src join u y on y.token = dst)"
_add("w13_pmi", seq.pmi, f"with {T}, {B}, {_PMI} select * from pm")
_AVG = "gg as (select distinct ngram, t1, t2, t3 from (select token as t1, lead(token, 1) over (partition by seq order by pos) as t2, lead(token, 2) over (partition by seq order by pos) as t3 from t), lateral (select t1 || ' ' || t2 || ' ' || t3 as ngram) where t3 is not null), av as (select ngram, round((x.pmi + y.pmi) / 2, 6) as avg_pmi from gg join pm x on x.src = t1 and x.dst = t2 join pm y on y.src = t2 and y.dst = t3)"
_add("w14_average_pmi", lambda t: seq.average_pmi(t, 3), f"with {T}, {B}, {_PMI}, {_AVG} select * from av")
_SUF = "nx as (select g3.ngram, t.token, count(*) as c from g3 left join t on t.seq = g3.seq and t.pos = g3.pos + 3 group by 1, 2), pr as (select *, c / sum(c) over (partition by ngram) as p from nx), se as (select ngram, round(coalesce(-sum(p * ln(p)) filter (token is not null), 0), 6) as entropy from pr group by ngram)"
_add("w15_suffix_entropy", lambda t: seq.suffix_entropy(t, 3), f"with {T}, {grams(3)}, {_SUF} select * from se")
_add("w16_discover", lambda t: seq.discover(t, 3, 20), f"with {T}, {B}, {_PMI}, {_AVG}, {grams(3)}, {_SUF}, o as (select ngram, count(*) as occurrences from g3 group by 1 having count(*) >= 20) select o.ngram, occurrences, avg_pmi, entropy, round(avg_pmi + entropy, 6) as score from o join av on o.ngram = av.ngram join se on o.ngram = se.ngram")
_add("w17_context_windows", lambda t: seq.context_windows(t, "click view"), f"with {T}, {grams(2)}, w as (select seq, pos, string_agg(token, ' ') over (partition by seq order by pos rows between 2 preceding and 3 following) as \"window\" from t) select w.* from w join g2 on w.seq = g2.seq and w.pos = g2.pos where ngram = 'click view'")
_add("w18_motifs", lambda t: seq.motifs(t, 4, 5), f"with {T}, {all_grams([2, 3, 4])}, s as (select seq, count(*) as size from t group by seq having count(*) >= 4) select g.seq, n, ngram, count(*) as occurrences, min(pos) as first from g join s on g.seq = s.seq where n <= size // 2 group by g.seq, n, ngram having count(*) >= 5")
_add("w19_ngram_stats", seq.ngram_stats, f"with {T}, {all_grams([2, 3])}, x as (select seq, n, ngram, count(*) as c from g group by all), p as (select *, c / sum(c) over (partition by seq, n) as p from x) select seq, n, count(*) as different, round(-sum(p * log2(p)), 6) as entropy from p group by seq, n")
_add("w20_perplexity", seq.unigram_perplexity, f"with {T}, x as (select seq, token, count(*) / sum(count(*)) over (partition by seq) as p from t group by seq, token) select seq, round(pow(2, -sum(p * log2(p))), 6) as perplexity from x group by seq")
_add("w21_transition_matrix", seq.transition_matrix, f"with {T}, {B}, {M} select src, dst, n, round(q, 6) as p from m")
_PP = "x as (select regexp_replace(ngram, ' [^ ]*$', '') as head, count(*) as c from g2 group by ngram), y as (select *, sum(c) over (partition by head) as k from x), v as (select count(distinct token) as v from t), pp as (select round(exp(-sum(c * ln(c / k + 1 / (v + 1))) / sum(c)), 6) as perplexity from y, v)"
_add("w22_smoothed_perplexity", lambda t: seq.smoothed_perplexity(t, 2), f"with {T}, {grams(2)}, {_PP} select * from pp")
_ARR = "a as (select user_id, string_agg(substr(event_type, 1, 1), '' order by ts, event_id) as x from events group by user_id)"


def _arrays(spark, d):
    t = events(spark, d).groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: F.substring(x["token"], 1, 1)).alias("a"))
    other = t.select((F.col("seq") - 1).alias("seq"), F.col("a").alias("b"))
    return t.join(other, "seq")


_PAIR = f"with {_ARR}, j as (select p.user_id as seq, p.x as a, q.x as b from a p join a q on q.user_id = p.user_id + 1)"
query("w23_levenshtein", f"{_PAIR} select seq, levenshtein(a, b)::int as distance from j")(lambda s, d: seq.edit_distance(_arrays(s, d), "a", "b").select("seq", "distance"))
query("w24_sequence_similarity", f"{_PAIR} select seq, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) as similarity from j")(lambda s, d: seq.edit_distance(_arrays(s, d), "a", "b").select("seq", "similarity"))
query("w25_jaccard", f"{_PAIR}, s as (select seq, list_distinct(string_split(a, '')) as x, list_distinct(string_split(b, '')) as y from j) select seq, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard from s")(lambda s, d: _arrays(s, d).select("seq", seq.jaccard(F.col("a"), F.col("b")).alias("jaccard")))
_SHUF = "sh as (select a.seq, a.pos, b.token from (select seq, pos, row_number() over (order by seq, pos) as k from t) a join (select token, row_number() over (order by md5(seq || '-' || pos), seq, pos) as k from t) b on a.k = b.k)"
_ZIPF = "zc as (select token, count(*) as c from t group by token), zr as (select c, ln(row_number() over (order by c desc, token)) as x, ln(c) as y from zc)"
_add("w26_linguistic_structure", lambda t: seq.linguistic_structure(t, seq.shuffled(t)), f"""with {T23}, {grams(2)}, {_PP}, {_ZIPF}, {_SHUF},
 g2s as (select regexp_replace(ngram, ' [^ ]*$', '') as head, count(*) as c from (select token || ' ' || t1 as ngram from (select *, lead(token) over (partition by seq order by pos) as t1 from sh) where t1 is not null) group by ngram),
 ps as (select round(exp(-sum(c * ln(c / k + 1 / (v + 1))) / sum(c)), 6) as shuffled_perplexity from (select *, sum(c) over (partition by head) as k from g2s), v),
 z as (select round(abs(corr(x, y)), 6) as correlation, round(avg(case when c = 1 then 1.0 else 0.0 end), 6) as singleton_rate, round(sum(c) / count(*), 6) as reuse_ratio from zr)
 select *, 0.25::double * ((correlation >= 0.9)::int + (singleton_rate >= 0.1)::int + (perplexity < shuffled_perplexity)::int + (reuse_ratio >= 2)::int) as score from z, pp, ps""", numbers)


@query("w27_compare_configurations")
def w27(spark, d):
    """W26 of two configurations (vocabularies) and the winner by score; ties: a."""
    a, b = (seq.linguistic_structure(t, seq.shuffled(t)).select(F.col("score").alias(n)) for t, n in ((events(spark, d), "score_a"), (numbers(spark, d), "score_b")))
    return a.crossJoin(b).withColumn("winner", F.when(F.col("score_a") >= F.col("score_b"), "a").otherwise("b"))


_add("w28_turn_taking", seq.turn_taking, f"""with {TALK}, m as (select *, lag(token) over (partition by seq order by pos) as b1, lag(token, 2) over (partition by seq order by pos) as b2 from t),
 r as (select *, sum(coalesce((b1 <> token)::int, 0)) over (partition by seq order by pos) as run from m), l as (select seq, max(k) as longest_run from (select seq, run, count(*) as k from r group by all) group by seq)
 select m.seq, count(*) as turns, coalesce(sum((b1 <> token)::int), 0)::bigint as switches, count(distinct token) as speakers, count(*) filter (b2 = token and b1 <> token) as returns, any_value(longest_run) as longest_run,
 round(case when count(*) > 1 then coalesce(sum((b1 <> token)::int), 0) / (count(*) - 1) else 0 end, 6) as switch_rate from m join l on m.seq = l.seq group by m.seq""", talks)
_add("w29_phonotactics", lambda t: seq.phonotactics(t, 0.04), f"with {T23}, {B23}, {M} select src, dst, n, round(q, 6) as p from m where round(q, 6) < 0.04", numbers)
_SEC = "e as (select user_id, epoch(ts) as time, event_id, value, event_type from events)"


def _seconds(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "value", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"))


query("w30_gap_sessions", f"with {_SEC}, m as (select *, coalesce((time - lag(time) over (partition by user_id order by time) > 20000)::int, 0) as b from e), s as (select *, sum(b) over (partition by user_id order by time rows unbounded preceding) as session from m) select user_id, session::bigint as session, count(*) as size, min(time) as start, max(time) as stop from s group by user_id, session having count(*) >= 2")(lambda s, d: seq.gap_sessions(_seconds(s, d), "user_id", "time", 20000, 2))
query("w31_anchored_windows", f"with recursive {_SEC}, n as (select user_id, time, row_number() over (partition by user_id order by time) as k from e), w as (select user_id, k, time, time as anchor from n where k = 1 union all select n.user_id, n.k, n.time, case when n.time - w.anchor > 40000 then n.time else w.anchor end from w join n on n.user_id = w.user_id and n.k = w.k + 1) select user_id, anchor, count(*) as size, max(time) as stop from w group by user_id, anchor")(lambda s, d: seq.anchored_windows(_seconds(s, d), "user_id", "time", 40000))
_add("w32_bigram_frequencies", lambda t: seq.bigrams(t).groupBy("src", "dst").agg(F.count("*").alias("n")), f"with {T23}, {B23} select src, dst, count(*) as n from b group by all", numbers)
_add("w33_response_rate", lambda t: seq.response_rate(t, "user", "assistant"), f"with {TALK}, x as (select token, lead(token) over (partition by seq order by pos) as nx from t) select count(*) as said, count(*) filter (nx = 'assistant') as answered, round(coalesce(avg((coalesce(nx = 'assistant', false))::int), 0), 6) as ras from x where token = 'user'", talks)
_add("w34_laplace_matrix", seq.laplace_matrix, f"with {T}, {B}, v as (select distinct token from t), c as (select src, dst, count(*) as n from b group by all), f as (select x.token as src, y.token as dst, coalesce(n, 0) as n from v x, v y left join c on c.src = x.token and c.dst = y.token) select *, round((n + 1) / (sum(n) over (partition by src) + count(*) over (partition by src)), 6) as p from f")
_add("w35_next_tokens", lambda t: seq.next_tokens(t, 3), f"with {T23}, {B23}, {M}, r as (select src, dst, n, round(q, 6) as p, row_number() over (partition by src order by n desc, dst) as rank from m) select * from r where rank <= 3", numbers)
_add("w36_row_entropy", seq.row_entropy, f"with {T}, {B}, {M} select src, round(-sum(q * ln(q)), 6) as entropy from m group by src")
_PAD = "pd as (select src, dst from b union all select '<s>', arg_min(token, pos) from t group by seq union all select arg_max(token, pos), '</s>' from t group by seq), pc as (select src, dst, count(*) as n from pd group by all)"
_add("w37_padded_bigrams", seq.padded_bigrams, f"with {T}, {B}, {_PAD} select * from pc")
_LP = "md as (select src, dst, n / sum(n) over (partition by src) as p from pc where dst <> '</s>'), st as (select seq, coalesce(lag(token) over (partition by seq order by pos), '<s>') as src, token as dst from t), lp as (select seq, round(sum(ln(p)), 6) as log_prob, round(exp(-avg(ln(p))), 6) as perplexity from st join md on st.src = md.src and st.dst = md.dst group by seq)"
_add("w38_bigram_perplexity", lambda t: seq.sequence_log_prob(t).select("seq", "perplexity"), f"with {T}, {B}, {_PAD}, {_LP} select seq, perplexity from lp")
_add("w39_sequence_log_prob", lambda t: seq.sequence_log_prob(t).select("seq", "log_prob"), f"with {T}, {B}, {_PAD}, {_LP} select seq, log_prob from lp")
_add("w40_conditional_rules", lambda t: seq.conditional_rules(t, 3), f"with {T}, {grams(3)}, c as (select ngram, count(*) as n from g3 group by 1), s as (select regexp_replace(ngram, ' [^ ]*$', '') as prefix, regexp_extract(ngram, '[^ ]*$') as next, n from c) select *, round(n / sum(n) over (partition by prefix), 6) as p from s")
query("w41_both_orders", "with t as (select l_orderkey as seq, l_returnflag as token, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem), two as (select seq, count(*) as size, arg_min(token, pos) as a, arg_max(token, pos) as b from t group by seq having count(*) = 2), c as (select a, b, count(*) as n from two group by a, b) select x.a, x.b, x.n, y.n as reverse_n from c x join c y on x.a = y.b and x.b = y.a where x.a < x.b")(lambda s, d: seq.both_orders(seq.tokens(table(s, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag")))
_SUR = "mr as (select *, row_number() over (partition by src order by n desc, dst) as rank from m), su as (select seq, pos, b.src, b.dst, round(-log2(q + 1e-10), 6) as surprise, rank from b join mr on b.src = mr.src and b.dst = mr.dst)"
_add("w42_surprise", seq.surprise, f"with {T}, {B}, {M}, {_SUR} select * from su")
_add("w43_surprise_profile", seq.surprise_profile, f"with {T}, {B}, {M}, {_SUR}, z as (select seq, surprise, round((surprise - avg(surprise) over (partition by seq)) / nullif(stddev_pop(surprise) over (partition by seq), 0), 6) as z from su) select seq, round(avg(surprise), 6) as mean, round(stddev_pop(surprise), 6) as std, count(*) filter (z > 2) as high, count(*) filter (z < -2) as low from z group by seq")
_add("w44_surprise_over_time", lambda t: seq.surprise_over_time(t, 5), f"with {T}, {B}, {M}, {_SUR} select seq, pos, round(avg(surprise) over (partition by seq order by pos range between 4 preceding and current row), 6) as running from su")
_JP = "jc as (select ngram, count(*) as c from g2 group by 1), jp as (select c, (c + 1) / (sum(c) over () + count(*) over ()) as p from jc), jw as (select round(exp(-sum(c * ln(p)) / sum(c)), 6) as perplexity from jp)"
_add("w45_joint_perplexity", lambda t: seq.joint_perplexity(t, 2), f"with {T}, {grams(2)}, {_JP} select * from jw")
_add("w46_context_perplexity", lambda t: seq.context_perplexity(t, 2), f"with {T}, {grams(2, 'seq, pos, ctx')}, {_JP}, cc as (select ctx, ngram, count(*) as c from g2 group by all), cp as (select ctx, c, (c + 1) / (sum(c) over (partition by ctx) + count(*) over (partition by ctx)) as p from cc), x as (select ctx, exp(-sum(c * ln(p)) / sum(c)) as x from cp group by ctx) select ctx, round(x, 6) as perplexity, round(x / jw.perplexity, 6) as relative from x, jw")
_add("w47_edge_motifs", lambda t: seq.edge_motifs(t, 2, 10), f"with {T}, {grams(3)}, c as (select ngram, count(*) as occurrences from g3 group by 1 having count(*) >= 10), tt as (select count(*) as total from t), u as (select token, ln(count(*) / any_value(total)) as lp, any_value(total) as total from t, tt group by token), p as (select ngram, occurrences, unnest(string_split(ngram, ' ')) as token from c), e as (select ngram, occurrences, exp(sum(lp)) * max(total) as expected from p join u on p.token = u.token group by all) select ngram, occurrences, round((occurrences - expected) / sqrt(expected), 6) as z from e")
_add("w49_word_pair_pmi", lambda t: seq.pmi(t).where("pmi > 0.2"), f"with {T23}, {B23}, {_PMI} select * from pm where pmi > 0.2", numbers)
_add("w50_find_patterns", lambda t: seq.ngram_counts(t, [2, 3, 4]).select("n", "ngram", "occurrences"), f"with {T}, {all_grams([2, 3, 4])}, {C} select n, ngram, occurrences from c")
_add("w51_discover_rules", lambda t: seq.discover_rules(t, 0.1), f"with {T23}, {B23}, {_PMI} select * from pm where pmi >= 0.1", numbers)
_add("w51_modal_tokens", seq.modal_tokens, f"with {T}, c as (select pos, token, count(*) as n from t group by all) select pos, token, n from (select *, row_number() over (partition by pos order by n desc, token) as k from c) where k = 1")
_add("w52_context_transitions", lambda t: seq.context_transitions(t, 10), f"with {T}, {B}, c as (select ctx, src, dst, count(*) as n from b group by all), r as (select *, row_number() over (partition by ctx order by n desc, src, dst) as rank from c) select * from r where rank <= 10")
_add("w53_segment_roles", seq.segment_roles, f"with {T23}, {B23}, s as (select src as token, 1 as o, dst as succ from b union all select dst, 0, null from b), a as (select token, round(avg(o), 6) as open_share, count(distinct succ) as successors from s group by token) select *, case when open_share > 0.7 then 'opener' when open_share < 1 - 0.7::double then 'closer' when successors > 5 then 'function' else 'content' end as role from a", numbers)
query("w54_dyads", "select o_custkey, o_orderpriority, count(*) as calls, arg_min(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) as opener, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) as closer from orders where o_custkey <> 0 group by all")(lambda s, d: seq.dyads(table(s, d, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"], "o_orderstatus"))
_add("w55_find_pattern", lambda t: seq.find_pattern(t, ["click", "view", "click"]), f"with {T}, {grams(3)} select seq, pos from g3 where ngram = 'click view click'")
query("w56_quantize", "select vec_id, list_reduce(list_prepend(0::bigint, list_transform(embedding, lambda x: floor(x::double * 8)::bigint)), lambda a, x: ((a * 31 + x) % 1020 + 1020) % 1020) as token from embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", seq.quantized(F.col("embedding"), 8).alias("token")))
_add("w58_runs", seq.runs, f"with {T}, m as (select *, coalesce((lag(token) over (partition by seq order by pos) <> token)::int, 1) as nw from t), r as (select *, sum(nw) over (partition by seq order by pos) as run from m) select seq, run::bigint as run, any_value(token) as token, count(*) as length from r group by seq, run")
_add("w58_alternation", seq.alternation, f"with {T}, m as (select *, coalesce((lag(token) over (partition by seq order by pos) <> token)::int, 1) as nw from t) select seq, sum(nw)::bigint as runs, round(count(*) / sum(nw), 6) as mean_run, round(case when count(*) > 1 then (sum(nw) - 1) / (count(*) - 1) else 0 end, 6) as alternation from m group by seq")
_add("w59_common_patterns", lambda t: seq.common_patterns(t, 2, 10), f"with {T}, {all_grams([2, 3, 4, 5])}, s as (select seq, count(*) as size from t group by seq) select n, ngram, count(*) as occurrences from g join s on g.seq = s.seq where n < size group by n, ngram having count(*) >= 10 order by occurrences desc, n, ngram limit 20")
_FD = "w as (select user_id, event_id, value, lead(value) over o - value as f, value - lag(value) over o as b from events window o as (partition by user_id order by event_id))"
query("w61_finite_differences", f"with {_FD} select user_id, event_id, round(coalesce(f, b, 0), 6) as n1, round(case when f is not null and b is not null then (f + b) / 2 else coalesce(f, b, 0) end, 6) as n2 from w")(lambda s, d: seq.finite_differences(table(s, d, "events"), "user_id", "event_id", "value"))


def _chain_entries(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.filter(F.array(F.floor(F.col("event_id") / 2), F.floor(F.col("event_id") / 3)), lambda x: x != F.col("event_id")).alias("parents"))


query("w62_causal_chain", "with recursive e as (select event_id as id, unnest([event_id // 2, event_id // 3]) as parent from events), w as (select 901::bigint as id, 0 as depth union select e.parent, w.depth + 1 from w join e on e.id = w.id and e.parent <> e.id where w.depth < 32) select id, min(depth)::int as depth from w group by id")(lambda s, d: seq.causal_chain(_chain_entries(s, d), 901))
_add("a12_zipf", lambda t: seq.zipf(t.groupBy("token").agg(F.count("*").alias("c"))).select("slope", "r2"), f"with {T23}, {_ZIPF} select round(regr_slope(y, x), 6) as slope, round(regr_r2(y, x), 6) as r2 from zr", numbers)
_add("a13_zipf_correlation", lambda t: seq.zipf(t.groupBy("token").agg(F.count("*").alias("c"))).select("correlation"), f"with {T}, {_ZIPF} select round(abs(corr(x, y)), 6) as correlation from zr")

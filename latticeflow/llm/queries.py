"""The queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, packing, phrase_index, preference, quality_fm, repetition, simhash, site_tree, suffix_dedup, toxicity
from .common import cut, held_out, remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), learnable=remainder(F.col("key"), 4) != 2)
    out = toxicity.score(docs, model, keep=[F.col("doc_id"), held_out(F.col("doc_id"), 4, 2).alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(simhash.fingerprints(table(spark, sf_dir, "documents")), "prints")
    grouped = simhash.near_groups(prints)
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def tokenizer_path() -> str:
    """The public byte-level vocabulary of this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Vocabulary.load(tokenizer_path()))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preference.swapped_replies(preference.conversations(table(spark, sf_dir, "conversations")))
    out = preference.preference_pairs(pairs)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("chosen_spans", shown("chosen_spans")).withColumn("rejected_spans", shown("rejected_spans"))


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.learn(docs, table(spark, sf_dir, "labels"), learnable=remainder(F.col("key"), 5) != 0)
    out = quality_fm.score(docs, model, keep=[F.col("doc_id"), held_out(F.col("doc_id"), 5, 0).alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, learnable=remainder(F.col("doc_id"), 5) != 0)
    return language_id.predict(docs, model, keep=[held_out(F.col("doc_id"), 5, 0).alias("held_out")])


def queries() -> dict[str, Query]:
    return {
        "op1_counterfactual_toxicity": toxicity_scores,
        "op2_suffix_array_repetition": repetition_rules,
        "op3_positional_index_decontamination": benchmark_hits,
        "op4_multi_index_simhash": near_duplicates,
        "op5_factorisation_machine_quality": quality_scores,
        "op6_pattern_packing": packed_pieces,
        "op7_site_style_tree": main_texts,
        "op8_radix_suffix_dedup": repeated_bytes,
        "op9_preference_formatting": preferences,
        "op10_ppm_language_id": language_predictions,
    }


#: Words of both sides; every window of an item against every window of a document, through the window's words. Near: of a window's
#: different terms (pt), as many as it has (pn) stand around a place of its rarest one (pr).
OP3_SQL = r"""
with d as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select uid, i, n, array_to_string(w[i : i + n - 1], ' ') as g from (select uid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select dw.uid, dw.i, dw.n, bw.item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select uid, count(distinct p) as n_hit from (select uid, unnest(range(i, i + n)) as p from hits) group by uid),
items as (select uid, count(*) as n_items, string_agg(item, ',' order by item) as l from (select distinct uid, cast(item_id as varchar) as item from hits) group by uid),
o as (select uid, unnest(w) as x, generate_subscripts(w, 1) as pos from d),
cnt as (select x, count(*) as c from o group by x),
ph as (select row_number() over () as p, item_id, string_split(g, ' ') as w from (select distinct item_id, g from bw)),
pt as (select p, unnest(w) as x, generate_subscripts(w, 1) as off from ph),
pr as (select p, arg_min(pt.x, c * 1000 + off) as x from pt left join cnt using (x) group by p having count(c) = count(*)),
pn as (select p, count(distinct x) as n from pt group by p),
st as (select pr.p, o.uid, o.pos as at from pr join o using (x)),
nr as (select st.p, st.uid, st.at from st join pn on pn.p = st.p join (select distinct p, x from pt) t on t.p = st.p join o on o.uid = st.uid and o.x = t.x and abs(o.pos - st.at) <= 15 group by st.p, st.uid, st.at, pn.n having count(distinct o.x) = pn.n),
near as (select uid, count(distinct item_id) as n_near from (select distinct p, uid from nr) join ph using (p) group by uid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(words.n_hit, 0) as bigint) as n_hit, cast(coalesce(items.n_items, 0) as bigint) as n_items,
  sha256(coalesce(items.l, '')) as items_sha256, words.n_hit is not null as contaminated, cast(coalesce(near.n_near, 0) as bigint) as n_near
from d left join words using (uid) left join items using (uid) left join near using (uid)
"""


#: The turns in order; the first differing place of chosen and rejected; renderings and character ranges by running sums.
OP9_SQL = """
with c as (select conv_id, list(struct_pack(role := coalesce(role, ''), t := coalesce(text, '')) order by turn, role, text) as w from conversations where conv_id is not null group by conv_id),
l as (select conv_id, w[1 : list_max(list_filter(range(1, len(w) + 1), lambda i: w[i].role = 'assistant'))] as w from c where len(list_filter(w, lambda x: x.role = 'assistant')) > 0),
p as (select a.conv_id as pair_id, a.w as a, list_concat(a.w[1 : len(a.w) - 1], [struct_pack(role := 'assistant', t := b.w[len(b.w)].t)]) as b from l a join l b on b.conv_id = a.conv_id + 1),
k as (select *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])) - 1, len(a)) as n from p),
e as (select pair_id, n, side, i - n as i, case side when 'a' then a[i] else b[i] end as x from (select *, unnest(range(1, greatest(len(a), len(b)) + 1)) as i from k), (values ('a'), ('b')) s(side) where i <= case side when 'a' then len(a) else len(b) end),
r as (select pair_id, n, side, i, x.role as role, '<|turn|>' || x.role || chr(10) || x.t || '<|end|>' as s, sum(case when i > 0 then length('<|turn|>' || x.role || chr(10) || x.t || '<|end|>') else 0 end) over (partition by pair_id, side order by i) as z, length(x.t) + 7 as y from e),
o as (select pair_id, side, any_value(n) as n, coalesce(string_agg(s, '' order by i) filter (i <= 0), '') as prompt, coalesce(string_agg(s, '' order by i) filter (i > 0), '') as done,
  coalesce(string_agg(cast(z - y as bigint) || '-' || cast(z as bigint), ',' order by i) filter (i > 0 and role = 'assistant'), '') as spans from r group by pair_id, side)
select x.pair_id, cast(x.n as integer) as prompt_turns, x.prompt, x.done as chosen, x.spans as chosen_spans, y.done as rejected, y.spans as rejected_spans
from o x join o y on x.pair_id = y.pair_id and x.side = 'a' and y.side = 'b'
"""


#: Repeats of k words or more cover what windows of k words found twice cover. The longest repeat: places of equal windows of three
#: words at equal distances one after the other; without such windows, whether two or one words are found twice.
OP2_SQL = r"""
with d as (select row_number() over () as uid, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select uid, k, i, md5(array_to_string(w[i : i + k - 1], ' ')) as s from (select uid, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) as i from d, (values (1), (2), (3), (8)) v(k))),
r as (select uid, k, i, s from (select uid, k, i, s, count(*) over (partition by uid, k, s) as n from g) where n > 1),
c as (select uid, k, count(distinct p) as n from (select uid, k, unnest(range(i, i + k)) as p from r) group by uid, k),
e as (select a.uid, a.i, b.i - a.i as gap from r a join r b on a.uid = b.uid and a.s = b.s and a.k = 3 and b.k = 3 and a.i < b.i),
f as (select uid, gap, i - row_number() over (partition by uid, gap order by i) as island from e),
x as (select uid, max(n) + 2 as n from (select uid, gap, island, count(*) as n from f group by uid, gap, island) group by uid),
y as (select uid, max(k) as n from r where k < 3 group by uid),
l as (select uid, count(*) - count(distinct x) as n from (select uid, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by uid),
m as (select d.doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(c3.n, 0) as n_repeat_words, coalesce(c8.n, 0) as covered_words, coalesce(x.n, y.n, 0) as longest_repeat
  from d left join l using (uid) left join c c3 on c3.uid = d.uid and c3.k = 3 left join c c8 on c8.uid = d.uid and c8.k = 8 left join x on x.uid = d.uid left join y on y.uid = d.uid)
select doc_id, cast(n_words as bigint) as n_words, word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, cast(covered_words as bigint) as covered_words, cast(longest_repeat as bigint) as longest_repeat,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and covered_words <= 0.25 * n_words and longest_repeat <= 50 as kept from m
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_array_repetition": OP2_SQL, "op3_positional_index_decontamination": OP3_SQL, "op9_preference_formatting": OP9_SQL}

"""The registered queries of the training-text operators, next to the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import lm_score, pii, toxicity
from folioscope.llm.decontaminate import benchmark_hits, judged
from folioscope.llm.exact_dedup import exact_dedup
from folioscope.llm.jaccard_join import jaccard_components
from folioscope.llm.packing import pack, piece_digests
from folioscope.llm.periodic_runs import periodic_runs, run_digests, with_planted_tails
from folioscope.llm.piece_merges import encode_pieces
from folioscope.llm.piece_merges import piece_digests as coded_digests
from folioscope.llm.prefix_trie import conversation_trie
from folioscope.llm.token_files import read_tokens, write_tokens
from folioscope.llm.unit_dedup import dedup_passages, passage_digests
from folioscope.llm.url_templates import url_verdicts, verdict_sql
from folioscope.session import read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_exact_dedup", """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""")
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf, "documents"))


#: A-Z lower-cased without touching other letters, for SQL engines whose lower() goes further.
def ascii_lower_sql(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_decontaminate", f"""
with words_of as (
  select doc_id, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
items as (
  select cast(item_id as varchar) as item_id, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")},
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from items where len(w) > 0)),
hits as (
  select d.doc_id, d.i, g.n, g.item_id
  from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
        from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
              from words_of, (select distinct n from windows) where len(w) >= n)) d
  join windows g on g.n = d.n and g.win = d.win),
covered as (select doc_id, count(*) as n_hit
  from (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items,
       sha256(coalesce(m.ids, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from words_of d left join covered c using (doc_id) left join named m using (doc_id)""")
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return judged(benchmark_hits(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))).drop("spans")


@query("op7_passage_dedup", f"""
with cut as (
  select doc_id, unnest(u) as unit, generate_subscripts(u, 1) - 1 as pos
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') as u from documents)),
units as (
  select *, trim(regexp_replace({ascii_lower_sql("unit")}, '[\x20\x09-\x0D]+', ' ', 'g')) as norm,
         cast(sum(length(unit)) over (partition by doc_id order by pos) as bigint) as last
  from cut),
repeats as (
  select *, case when norm = '' then 0 else len(string_split(norm, ' ')) end as words, last - length(unit) as first,
         pos - row_number() over (partition by doc_id order by pos) as island
  from units qualify row_number() over (partition by norm order by doc_id, pos) > 1),
islands as (
  select doc_id, min(first) as first, max(last) as last
  from (select doc_id, words, first, last, pos - row_number() over (partition by doc_id order by pos) as island from repeats)
  group by doc_id, island having sum(words) >= 20),
gone as (
  select doc_id, count(*) as n_removed, cast(sum(last - first) as bigint) as chars_removed,
         string_agg(first || ':' || last, ',' order by first) as spans, list(first order by first) as firsts, list(last order by first) as lasts
  from islands group by doc_id)
select doc_id, coalesce(n_removed, 0) as n_removed, coalesce(chars_removed, 0) as chars_removed, coalesce(spans, '') as spans,
       sha256(case when spans is null then coalesce(text, '') else array_to_string(list_transform(generate_series(0, len(firsts)),
         lambda i: substring(text, coalesce(lasts[i], 0) + 1, coalesce(firsts[i + 1], length(text)) - coalesce(lasts[i], 0))), '') end) as text_sha256
from documents left join gone using (doc_id)""")
def op7_passage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return passage_digests(dedup_passages(read_table(spark, sf, "documents")))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return piece_digests(pack(read_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return toxicity.judged(toxicity.score(docs, toxicity.train(docs, read_table(spark, sf, "labels"))))


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(toxicity.fold_of(5) == 1, F.lit(False))
    scored = lm_score.score(read_table(spark, sf, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block")]


@query("op3_url_templates", verdict_sql(URL_RULES))
def op3_url_templates(spark: SparkSession, sf: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf, "pages"), URL_RULES).drop("share")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return pii.span_digests(pii.find_pii(docs, pii.train(docs)))


@query("op6_jaccard_join", f"""
with recursive words_of as (
  select doc_id, regexp_extract_all({ascii_lower_sql("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from words_of where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id
from words_of d left join sizes using (doc_id) left join (select a as doc_id, min(b) as m from reach group by a) using (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf, "documents"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_sql(column: str) -> str:
    """The unsigned checksum of a number's decimal digits, bit by bit."""
    return (f"xor(list_reduce(list_transform(string_split(cast({column} as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda crc, byte: "
            "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, step: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295), 4294967295)")


@query("op11_periodic_runs", f"""
with words_of as (
  select doc_id, w, len(w) as n, {crc32_sql("doc_id")} as h, {crc32_sql("doc_id")} // 10 as g
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents)),
tails as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from words_of),
periods as (select *, 1 + (n - a) // (3 + g % 8) as p from tails),
planted as (
  select doc_id, n, list_transform(generate_series(0, n - 1), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) as w
  from periods),
places as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from planted),
pairs as (select x.doc_id, y.i - x.i as q, x.i from places x join places y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i),
islands as (
  select doc_id, q, min(i) as start, count(*) + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs)
  group by doc_id, q, island having count(*) >= q and count(*) + q >= 12),
runs as (select doc_id, start, length, min(q) as period from islands group by doc_id, start, length),
per_doc as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed,
         first(struct_pack(s := start, l := length, p := period) order by length desc, start, period) as best
  from runs group by doc_id),
dropped as (select distinct doc_id, unnest(generate_series(start + period, start + length - 1)) as i from runs),
kept as (
  select doc_id, string_agg(word, ' ' order by i) as collapsed
  from places anti join dropped using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.p as period,
       (1000 * best.l) // best.p as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256,
       sha256(coalesce(collapsed, '')) as collapsed_sha256
from documents d left join per_doc using (doc_id) left join kept using (doc_id)""")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_tails(read_table(spark, sf, "documents"))))


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return coded_digests(encode_pieces(read_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True))


@query("op12_conversation_trie", f"""
with convs as (
  select conv_id, {crc32_sql("conv_id")} % 6 as h, conv_id - conv_id % 100 as base,
         list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
  from conversations where conv_id is not null group by conv_id),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) as seq
  from convs c left join convs b on b.conv_id = c.base),
paths as (select conv_id, d, seq[1:d] as seq, len(seq) = d as ends from (select *, unnest(generate_series(0, len(seq))) as d from rebuilt)),
nodes as (
  select d, seq, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from paths group by d, seq),
children as (select d - 1 as d, seq[1:d - 1] as seq, count(*) as n_children from nodes where d > 0 group by all),
own as (
  select n.*, coalesce(k.n_children, 0) as n_children, p.conv_id as parent_conv_id,
         case when n.d = 0 then 0 else (n.n_convs - 1) * length(struct_extract(n.seq[n.d], 't')) end as saved
  from nodes n left join children k on k.d = n.d and k.seq = n.seq left join nodes p on p.d = n.d - 1 and p.seq = n.seq[1:n.d - 1]),
totals as (
  select d, seq, cast(count(*) filter (where n_children = 0) as bigint) as n_leaves, cast(sum(saved) as bigint) as saved_tokens
  from (select up as d, seq[1:up] as seq, n_children, saved from (select *, unnest(generate_series(0, d)) as up from own)) group by d, seq)
select o.conv_id, o.d as depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
from own o join totals t on t.d = o.d and t.seq = o.seq""")
def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf, "conversations"), shared=True)

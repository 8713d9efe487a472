"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, minhash, packing, pii, quality, suffixes, tokencount, toxicity, url_filters
from ._shared import once, table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
HAND_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, blocked of the pages whose url names a labelled document: the first number that is a path part."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/]*(?:/[^/?#]*)*?/([0-9]+)(?:[./?#]|$)', 1) as bigint)")
    known = labels.select("doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked"))
    return pages.select("url", number.alias("doc_id")).filter("doc_id is not null").join(known, "doc_id").select("url", "blocked")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    return once(lambda: url_filters.judge(pages, labelled_urls(pages, labels), HAND_RULES).select("page_id", "host", "path", "rule", "verdict"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(lambda: minhash.groups(table(spark, sf_dir, "documents")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return once(lambda: quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(*columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(lambda: fingerprints.compare(table(spark, sf_dir, "documents")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(lambda: suffixes.digests(table(spark, sf_dir, "documents")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(lambda: packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(lambda: pii.digests(table(spark, sf_dir, "documents")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1,
        "op2_minhash_dedup": op2,
        "op3_quality_rules": op3,
        "op4_fingerprints": op4,
        "op5_suffix_dedup": op5,
        "op6_packing": op6,
        "op7_bpe": op7,
        "op8_toxicity": op8,
        "op9_pii": op9,
        "op10_token_counts": op10,
        "pipeline": pipeline,
    }


#: Measures of op3 and the hosts' shrunk rates. k: the prior's weight of a rule.
OP3_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select doc_id, unnest(generate_series(1, len(w) - 7)) as i, w from d where len(w) >= 8
), keyed as (
  select doc_id, i, array_to_string(w[i:i+7], ' ') as g from grams
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from keyed) where n > 1
), covered as (
  select doc_id, count(distinct p)::bigint as n from (select doc_id, unnest(generate_series(i, i + 7)) as p from twice) group by doc_id
), m as (
  select d.doc_id, source, len(w)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(lines)::bigint as n_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from d left join covered using (doc_id)
), r as (
  select *, n_words < 20 as r1, 100 * n_repeat_words > 30 * n_words as r2, 10 * n_symbols > n_words as r3, 10 * n_dup_lines > 3 * n_lines as r4 from m
), h as (
  select source, count(*)::double as n, sum(r1::int)::double as f1, sum(r2::int)::double as f2, sum(r3::int)::double as f3, sum(r4::int)::double as f4 from r group by source
), p as (
  select avg(f1/n) as m1, var_pop(f1/n) as v1, avg(f2/n) as m2, var_pop(f2/n) as v2, avg(f3/n) as m3, var_pop(f3/n) as v3, avg(f4/n) as m4, var_pop(f4/n) as v4 from h
), k as (
  select *, case when v1 <= 1e-12 then 10000.0::double else least(10000.0::double, greatest(1.0::double, m1*(1-m1)/greatest(v1, 1e-12::double) - 1)) end as k1,
            case when v2 <= 1e-12 then 10000.0::double else least(10000.0::double, greatest(1.0::double, m2*(1-m2)/greatest(v2, 1e-12::double) - 1)) end as k2,
            case when v3 <= 1e-12 then 10000.0::double else least(10000.0::double, greatest(1.0::double, m3*(1-m3)/greatest(v3, 1e-12::double) - 1)) end as k3,
            case when v4 <= 1e-12 then 10000.0::double else least(10000.0::double, greatest(1.0::double, m4*(1-m4)/greatest(v4, 1e-12::double) - 1)) end as k4
  from p
), verdict as (
  select source, greatest((f1+m1*k1)/(n+k1), (f2+m2*k2)/(n+k2), (f3+m3*k3)/(n+k3), (f4+m4*k4)/(n+k4)) <= 0.5 as host_kept from h, k
)
select r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (r1 or r2) as base_failed, (not (r1 or r2) and host_kept) as kept
from r join verdict on r.source is not distinct from verdict.source
"""


#: Links by shared shingles of all pairs, and the smallest id that links reach.
OP2_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d
), n as (
  select doc_id, count(*)::bigint as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)
), both_ways as (
  select a, b from l union all select b, a from l
), reach(a, b) as (
  select doc_id, doc_id from d union select r.a, e.b from reach r join both_ways e on r.b = e.a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, m.component_id = d.doc_id as kept
from d join (select a, min(b) as component_id from reach group by a) m on m.a = d.doc_id left join n on n.doc_id = d.doc_id
"""

#: Every 50-byte string with the smallest id that has it, as hexadecimal digits.
OP5_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), s as (
  select doc_id, unnest(generate_series(0, length(h) // 2 - 50)) as i, h from d where length(h) >= 100
), w as (
  select doc_id, i, substr(h, 2 * i + 1, 100) as g from s
), first as (
  select g, min(doc_id) as least from w group by g
), hit as (
  select w.doc_id, i, lag(i) over (partition by w.doc_id order by i) as before, lead(i) over (partition by w.doc_id order by i) as after
  from w join first using (g) where least < w.doc_id
), r as (
  select hit.doc_id, sum(least(50, coalesce(after - i, 50)))::bigint as n_removed,
         count_if(before is null or i > before + 50)::bigint as n_spans,
         string_agg(case when before is null then substr(h, 1, 2 * i) when i > before + 50 then substr(h, 2 * (before + 50) + 1, 2 * (i - before - 50)) else '' end, '' order by i)
           || substr(any_value(h), 2 * (max(i) + 50) + 1) as kept
  from hit join d using (doc_id) group by hit.doc_id
)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join r using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": OP2_SQL, "op3_quality_rules": OP3_SQL, "op5_suffix_dedup": OP5_SQL}

"""SQL for DuckDB of the registered queries: name -> (views it needs, recursive or not, query).

Views: F findings, customers and flags; T turns; A turns and audit; FA all. A query that begins
with `+` first adds common table expressions of its own.
"""

from __future__ import annotations

from .config import STOPWORDS

#: Letters and digits beyond ASCII count as word characters next to a border.
_ASCII = r"regexp_replace(regexp_replace(lower({0}), '[^\x00-\x7F\P{{L}}]', '_', 'g'), '[^\x00-\x7F\P{{N}}]', '_', 'g')"
_TOKEN = r"\b[A-Za-z][A-Za-z0-9'']*\b"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _wilson(k: str, n: str) -> tuple[str, str]:
    p = f"({k}::double / {n})"
    mid = f"(({p} + 1.96::double * 1.96::double / (2.0::double * {n})) / (1.0::double + 1.96::double * 1.96::double / {n}))"
    half = f"(1.96::double * sqrt({p} * (1.0::double - {p}) / {n} + 1.96::double * 1.96::double / (4.0::double * {n} * {n})) / (1.0::double + 1.96::double * 1.96::double / {n}))"
    return f"greatest(0.0::double, {mid} - {half})", f"least(1.0::double, {mid} + {half})"


_N = "(select count(distinct customer_id)::double from customers)"
_LOW, _HIGH = _wilson("customer_count", "n")
_CLOW, _CHIGH = _wilson("clean_customer_count", "n")

_GRID = """
per as (
  select t.theme_cluster, c.customer_id, coalesce(x, 0)::double as x
  from (select distinct theme_cluster from findings) t cross join (select distinct customer_id from customers) c
  left join (select theme_cluster, customer_id, count(*) as x from findings group by all) f on f.theme_cluster = t.theme_cluster and f.customer_id = c.customer_id
), dist as (
  select theme_cluster, round(avg(x), 3) as mentions_per_customer_mean, round(median(x), 3) as mentions_per_customer_median, round(stddev_samp(x), 3) as mentions_per_customer_sd,
    round(case when sum(x) > 0 then 2.0::double * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1)::double / count(*) else 0.0::double end, 3) as mentions_gini
  from (select *, row_number() over (partition by theme_cluster order by x) as i from per) group by theme_cluster
)"""

_QUOTES = """
best as (
  select theme_cluster, customer_quote as q, max((evidence_strength, confidence)) as m from findings where trim(customer_quote) <> '' group by all
), ranked as (
  select theme_cluster, q, row_number() over (partition by theme_cluster order by m desc, q) as i from best
), quotes as (
  select theme_cluster, string_agg(q, ' || ' order by i) as sample_customer_quotes from ranked where i <= 4 group by theme_cluster
)"""


def _first(column: str, k: int, out: str, sep: str, source: str = "findings") -> str:
    return f"""(select theme_cluster, string_agg(v, '{sep}' order by v) as {out} from (
      select theme_cluster, v, row_number() over (partition by theme_cluster order by v) as i from (select distinct theme_cluster, {column} as v from {source})) where i <= {k} group by theme_cluster)"""


def _mode(column: str, source: str = "findings") -> str:
    return f"(select theme_cluster, v, row_number() over (partition by theme_cluster order by n desc, v) as i from (select theme_cluster, {column} as v, count(*) as n from {source} group by all))"


_STATS = f"""
+{_GRID}, {_QUOTES}, agg as (
  select theme_cluster, count(distinct customer_id) as customer_count, count(distinct case when clean_signal then customer_id end) as clean_customer_count,
    count(distinct case when strong_signal then customer_id end) as strong_customer_count, count(*) as mention_count,
    avg(evidence_strength::double) as ev, avg(pain_severity::double) as pain, avg(urgency::double) as urg, avg(commercial_relevance::double) as comm,
    avg(leading_or_contaminated::int::double) as led, avg(has_workaround::int::double) as work, avg(has_consequence::int::double) as cons, {_N} as n
  from flags group by theme_cluster
), stats as (
  select a.theme_cluster, l.v as representative_theme_label, d.v as domain_area, customer_count, clean_customer_count, strong_customer_count, mention_count,
    round(customer_count::double / n, 4) as prevalence, round({_LOW}, 4) as prevalence_ci_low, round({_HIGH}, 4) as prevalence_ci_high, round({_HIGH} - {_LOW}, 4) as ci_width,
    round(clean_customer_count::double / n, 4) as clean_prevalence, round({_CLOW}, 4) as clean_prevalence_ci_low, round({_CHIGH}, 4) as clean_prevalence_ci_high,
    round(strong_customer_count::double / n, 4) as strong_prevalence,
    round(ev, 3) as avg_evidence_strength, round(pain, 3) as avg_pain_severity, round(urg, 3) as avg_urgency, round(comm, 3) as avg_commercial_relevance,
    round(led, 3) as led_or_contaminated_share, round(work, 3) as workaround_share, round(cons, 3) as consequence_share,
    round(cast(least(100.0::double, greatest(0.0::double, 100.0::double * (0.22::double * (customer_count::double / n) + 0.18::double * (clean_customer_count::double / n) + 0.16::double * (strong_customer_count::double / n)
      + 0.12::double * (pain / 5.0::double) + 0.1::double * (ev / 5.0::double) + 0.1::double * (urg / 5.0::double) + 0.07::double * (comm / 5.0::double) + 0.05::double * work)
      * greatest(0.0::double, 1.0::double - 0.35::double * led))) as decimal(18, 9)), 2)::double as opportunity_score
  from agg a join {_mode("theme_label")} l on l.theme_cluster = a.theme_cluster and l.i = 1 join {_mode("domain_area")} d on d.theme_cluster = a.theme_cluster and d.i = 1
)"""


def _terms(n: int) -> str:
    low, high = _wilson("unique_customer_count", "nc")
    grams = "toks" if n == 1 else f"list_transform(generate_series(1, greatest(len(toks) - {n - 1}, 0)), lambda i: array_to_string(toks[i:i+{n - 1}], ' '))"
    return f"""
+per_customer as (
  select customer_id, string_agg(coalesce(text, ''), ' ' order by call_id, turn_index) as t from turns where speaker_role = 'customer' group by customer_id
), tokens as (
  select customer_id, list_filter(regexp_extract_all({_ASCII.format("t")}, '{_TOKEN}'), lambda x: length(x) >= 3 and x not in ({_STOP})) as toks from per_customer
), terms as (
  select customer_id, unnest({grams}) as term from tokens
), counts as (
  select term, count(*)::bigint as total_count, count(distinct customer_id) as unique_customer_count from terms group by term having count(*) >= 2 order by total_count desc, term limit 75
)
select term, {n} as ngram_n, 'customer' as role, total_count, unique_customer_count, round(unique_customer_count::double / nc, 4) as customer_prevalence,
  round({low}, 4) as prevalence_ci_low, round({high}, 4) as prevalence_ci_high,
  round(1000.0::double * total_count / (select sum(len(toks)) from tokens)::double, 3) as count_per_1k_role_words
from counts, (select count(distinct customer_id)::double as nc from turns)"""


_LEX = {"articles": ("the", r"and\s+the"), "german": ("der", "die", "und"), "nouns": ("question", "please", "thanks"), "verbs": ("are", "was", "is")}
_LEX_BY = f"""
lex as (
  select c.customer_id, {", ".join(f"coalesce({k}, 0)::bigint as {k}" for k in _LEX)}
  from (select distinct customer_id from turns) c left join (
    select customer_id, {", ".join("sum(" + " + ".join(f"len(regexp_extract_all({_ASCII.format('text')}, '" + "\\b" + p + "\\b" + "'))" for p in v) + f")::bigint as {k}" for k, v in _LEX.items())} from turns where speaker_role = 'customer' group by customer_id
  ) s on s.customer_id = c.customer_id
)"""
_LLOW, _LHIGH = _wilson("unique_customer_count", "n")

#: Fixed values of the registered fixtures.
_RULES = ((r"\bthe\b", 1, "says the"), (r"\band\b", 2, "says and"), (r"\bwas\b", 2, "says was"), (r"\bof\b", 2, "says of"))
_HIT = [f"regexp_matches({_ASCII.format('text')}, '{p}')" for p, _, _ in _RULES]
_SCORE = "least(5, " + " + ".join(f"(case when {h} then {w} else 0 end)" for h, (_, w, _) in zip(_HIT, _RULES, strict=True)) + ")::int"
_WHY = "concat_ws('; ', " + ", ".join(f"case when {h} then '{r}' end" for h, (_, _, r) in zip(_HIT, _RULES, strict=True)) + ")"

_REDACT = "text"
for _label, _pattern in (
    ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[EMAIL]", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("[PHONE]", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("[RECORD_ID]", r"(?i)\b(?:MRN|medical record|record number|account number)\s*[:#]?\s*[A-Z0-9-]+\b"),
    ("[ROOM]", r"(?i)\b(?:room|rm)\s*#?\s*[A-Z]?\d{1,4}[A-Z]?\b"),
    ("[DATE]", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("[DATE]", r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}\b"),
    ("[ZIP]", r"\b\d{5}-\d{4}\b"),
):
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '{_label}', 'g')"


def _stamp(x: str) -> str:
    return f"printf('%02d:%02d:%02d', (floor({x})::bigint // 3600), (floor({x})::bigint % 3600) // 60, floor({x})::bigint % 60)"


_LINE = f"'[' || {_stamp('\"start\"')} || '-' || {_stamp('\"end\"')} || '] ' || upper(speaker_role) || ' | ' || speaker || ': ' || text"
#: The character references that the pages have, `&amp;` last and with or without its semicolon.
_UNESCAPE = "html"
for _reference, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_reference}', '{_char}')"
_UNESCAPE = f"regexp_replace({_UNESCAPE}, '&amp;?', '&', 'g')"
#: White space as Unicode has it.
_UWS = r"[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z}]+"


def _packet(where: str, n: int) -> str:
    return f"select finding_id, finding_type, theme_cluster, evidence_strength, confidence, customer_quote from findings where {where} order by evidence_strength desc, confidence desc, finding_id limit {n}"


def _chunks(budget: int) -> str:
    return f"""
+lines as (
  select call_id, customer_id, file_name, turn_index, row_number() over (partition by call_id order by turn_index) - 1 as i, count(*) over (partition by call_id) as n,
    sum(length({_LINE})) over (partition by call_id order by turn_index) as upto, length({_LINE}) as own from turns
), ends as (
  select a.call_id, a.i, a.n, greatest(a.i + 1, max(case when b.upto - (a.upto - a.own) <= {budget} then b.i + 1 else 0 end)) as en
  from lines a join lines b on a.call_id = b.call_id and b.i >= a.i group by a.call_id, a.i, a.n
)"""


ORACLES: dict[str, tuple[str, bool, str]] = {
    "theme_statistics": ("F", False, f"""{_STATS}
select s.*, mentions_per_customer_mean, mentions_per_customer_median, mentions_per_customer_sd, mentions_gini, sample_customer_ids, sample_customer_quotes
from stats s join dist using (theme_cluster) join quotes using (theme_cluster) join {_first("customer_id", 8, "sample_customer_ids", "; ")} using (theme_cluster)"""),
    "theme_summary": ("F", False, f"""
+{_QUOTES}, mixes as (
  select theme_cluster, string_agg(v || ':' || n::varchar, '; ' order by n desc, v) as finding_type_mix from (select theme_cluster, finding_type as v, count(*) as n from findings group by all) group by theme_cluster
), origins as (
  select theme_cluster, string_agg(v || ':' || n::varchar, '; ' order by n desc, v) as origin_mix from (select theme_cluster, customer_origin as v, count(*) as n from findings group by all) group by theme_cluster
), roles as (
  select theme_cluster, unnest(string_split(roles_text, ';')) as role from findings
), agg as (
  select theme_cluster, count(*) as mention_count, count(distinct customer_id) as unique_customer_count, round(avg(evidence_strength::double), 2) as avg_evidence_strength, round(avg(pain_severity::double), 2) as avg_pain_severity,
    round(avg(urgency::double), 2) as avg_urgency, round(avg(commercial_relevance::double), 2) as avg_commercial_relevance, round(avg(leading_or_contaminated::int::double), 2) as led_or_contaminated_share, {_N} as n
  from findings group by theme_cluster
)
select a.theme_cluster, mention_count, unique_customer_count, avg_evidence_strength, avg_pain_severity, avg_urgency, avg_commercial_relevance, led_or_contaminated_share, l.v as representative_theme_label, d.v as domain_area,
  case when unique_customer_count <= 1 then '1 customer' when unique_customer_count >= greatest(2, ceil(n * 0.6::double)) then 'most' else 'several' end as widespread,
  finding_type_mix, origin_mix, sample_customer_quotes, top_descriptions, customer_ids, roles_affected
from agg a join {_mode("theme_label")} l on l.theme_cluster = a.theme_cluster and l.i = 1 join {_mode("domain_area")} d on d.theme_cluster = a.theme_cluster and d.i = 1
join mixes m on m.theme_cluster = a.theme_cluster join origins o on o.theme_cluster = a.theme_cluster join quotes q on q.theme_cluster = a.theme_cluster
join {_first("one_sentence_description", 3, "top_descriptions", " || ")} x on x.theme_cluster = a.theme_cluster join {_first("customer_id", 1000000, "customer_ids", "; ")} y on y.theme_cluster = a.theme_cluster
join {_first("role", 1000000, "roles_affected", "; ", "roles")} z on z.theme_cluster = a.theme_cluster"""),
    "origin_mix": ("F", False, "select theme_cluster, string_agg(v || ':' || n::varchar, '; ' order by n desc, v) as origin_mix from (select theme_cluster, customer_origin as v, count(*) as n from findings group by all) group by theme_cluster"),
    "theme_quotes": ("F", False, f"+{_QUOTES} select * from quotes"),
    "finding_flags": ("F", False, "select finding_id, leading_or_contaminated as leading_or_contaminated_bool, has_workaround, has_consequence, clean_customer_origin, clean_signal, strong_signal, stated_want_signal, revealed_pain_signal from flags"),
    "mention_distribution": ("F", False, f"+{_GRID} select * from dist"),
    "mentions_gini": ("F", False, f"+{_GRID} select theme_cluster, mentions_gini from dist"),
    "customer_theme_rollup": ("F", False, """select customer_id, theme_cluster, bool_or(clean_signal) as any_clean, bool_or(strong_signal) as any_strong, round(avg(evidence_strength::double), 4) as evidence, round(avg(pain_severity::double), 4) as pain,
  round(avg(urgency::double), 4) as urgency, round(avg(commercial_relevance::double), 4) as commercial, round(avg(has_workaround::int::double), 4) as workaround, round(avg(leading_or_contaminated::int::double), 4) as led from flags group by all"""),
    "theme_customer_matrix": ("F", False, f"+{_GRID} select customer_id, theme_cluster, (x > 0)::int as present from per"),
    "theme_cooccurrence": ("F", False, "+d as (select distinct call_id, theme_cluster from findings) select a.theme_cluster as theme_a, b.theme_cluster as theme_b, count(*) as cooccurrence_count from d a join d b on a.call_id = b.call_id and a.theme_cluster < b.theme_cluster group by all"),
    "theme_association": ("F", False, f"""
+d as (select distinct customer_id, theme_cluster from findings), mg as (select theme_cluster, count(*) as c from d group by all), pr as (
  select a.theme_cluster as theme_a, b.theme_cluster as theme_b, count(*) as n11 from d a join d b on a.customer_id = b.customer_id and a.theme_cluster < b.theme_cluster group by all
), t as (
  select theme_a, theme_b, n11, ma.c - n11 as n10, mb.c - n11 as n01, {_N}::bigint - ma.c - mb.c + n11 as n00 from pr join mg ma on ma.theme_cluster = theme_a join mg mb on mb.theme_cluster = theme_b
), u as (select *, n11 + n10 as r1, n11 + n01 as c1, n11 + n10 + n01 + n00 as n from t
), cells as (select distinct n11, r1, c1, n from u
), pts as (
  select n11, r1, c1, n, x, exp(lgamma(r1+1) + lgamma(n-r1+1) + lgamma(c1+1) + lgamma(n-c1+1) - lgamma(n+1) - lgamma(x+1) - lgamma(r1-x+1) - lgamma(c1-x+1) - lgamma(n-r1-c1+x+1)) as p
  from (select *, unnest(generate_series(greatest(0, r1 + c1 - n), least(r1, c1))) as x from cells)
), mine as (select n11, r1, c1, n, p as p0 from pts where x = n11
), fish as (
  select n11, r1, c1, n, least(1.0::double, sum(case when p <= p0 * (1 + 1e-7::double) then p else 0.0::double end)) as pv from pts join mine using (n11, r1, c1, n) group by all
), v as (select u.*, pv from u join fish using (n11, r1, c1, n)
), rk as (
  select *, count(*) over (order by round(pv, 12) range unbounded preceding) as rank_, count(*) over () as m from v
), q as (select *, least(1.0::double, min(pv * m / rank_) over (order by round(pv, 12) desc range unbounded preceding)) as qv from rk)
select theme_a, theme_b, n11 as n11_both, n10 as n10_a_only, n01 as n01_b_only, n00 as n00_neither,
  round(n11::double / (n11 + n10 + n01), 4) as jaccard, round(n11::double * n / (r1::double * c1), 4) as lift,
  round(case when r1::double * (n - r1) * c1 * (n - c1) > 0 then (n11::double * n00 - n10::double * n01) / sqrt(r1::double * (n - r1) * c1 * (n - c1)) else 0.0::double end, 4) as phi,
  round((n11 + 0.5::double) * (n00 + 0.5::double) / ((n10 + 0.5::double) * (n01 + 0.5::double)), 4) as odds_ratio_haldane, round(pv, 6) as fisher_p_value, round(qv, 6) as fisher_fdr_q_value from q"""),
    "want_gap": ("F", False, f"""{_STATS}, g as (
  select theme_cluster, count(distinct customer_id) as all_customer_count, count(distinct case when stated_want_signal then customer_id end) as s, count(distinct case when revealed_pain_signal then customer_id end) as r,
    avg(leading_or_contaminated::int::double) as led, {_N} as n from flags group by theme_cluster
), st as (select * from flags where stated_want_signal), rv as (select * from flags where revealed_pain_signal)
select g.theme_cluster, representative_theme_label, all_customer_count, s as stated_want_customer_count, r as revealed_pain_customer_count, round(s::double / n, 4) as stated_want_prevalence, round(r::double / n, 4) as revealed_pain_prevalence,
  round(r::double / n - s::double / n, 4) as revealed_minus_stated_prevalence, case when s > 0 then round(r::double / s, 3) end as revealed_to_stated_ratio, round(led, 3) as led_or_contaminated_share,
  case when r >= 2 and r::double / n >= s::double / n and led < 0.5 then 'validated revealed pain' when s > 0 and r = 0 then 'mostly stated or hypothetical; do not trust yet' when led >= 0.5 then 'high contamination risk'
    when all_customer_count <= 1 then 'single-customer watchlist' else 'mixed evidence; needs targeted follow-up' end as classification,
  coalesce(stated_customers, '') as stated_customers, coalesce(revealed_customers, '') as revealed_customers, opportunity_score
from g join stats using (theme_cluster) left join {_first("customer_id", 1000000, "stated_customers", "; ", "st")} using (theme_cluster) left join {_first("customer_id", 1000000, "revealed_customers", "; ", "rv")} using (theme_cluster)"""),
    "sample_size": ("F", False, f"""{_STATS}, p as (select *, case when prevalence > 0 and prevalence < 1 then prevalence else 0.5::double end as pp, {_N}::bigint as n from stats)
select theme_cluster, representative_theme_label, n as current_customer_n, prevalence as current_prevalence, ci_width as current_ci_width,
  {", ".join(f"ceil(1.96::double * 1.96::double * pp * (1.0::double - pp) / ({m}::double * {m}::double))::bigint as target_n_for_plus_minus_{k}pp, greatest(0, ceil(1.96::double * 1.96::double * pp * (1.0::double - pp) / ({m}::double * {m}::double))::bigint - n) as additional_customers_for_plus_minus_{k}pp" for k, m in ((20, 0.20), (15, 0.15), (10, 0.10)))} from p"""),
    "bootstrap_ci": ("F", False, f"""
+roll as (
  select customer_id, theme_cluster, bool_or(clean_signal)::int::double as cl, bool_or(strong_signal)::int::double as sg, avg(evidence_strength::double) as ev, avg(pain_severity::double) as pain, avg(urgency::double) as urg,
    avg(commercial_relevance::double) as comm, avg(has_workaround::int::double) as work, avg(leading_or_contaminated::int::double) as led from flags group by all
), ids as (select customer_id, row_number() over (order by customer_id) - 1 as i from (select distinct customer_id from customers)
), draw as (
  select rep, ('0x' || substr(md5('42|' || rep::varchar || '|' || slot::varchar), 1, 8))::bigint % (select count(*) from ids) as i
  from (select unnest(generate_series(0, 199)) as rep), (select i as slot from ids)
), w as (select rep, customer_id, count(*)::double as w from draw join ids using (i) group by all
), sums as (
  select theme_cluster, rep, sum(w) as k, sum(cl * w) as cl, sum(sg * w) as sg, sum(ev * w) as ev, sum(pain * w) as pain, sum(urg * w) as urg, sum(comm * w) as comm, sum(work * w) as work, sum(led * w) as led from roll join w using (customer_id) group by all
), t as (
  select x.theme_cluster, coalesce(k / n, 0.0::double) as p, coalesce(round(cast(least(100.0::double, greatest(0.0::double, 100.0::double * (0.22::double * (k / n) + 0.18::double * (cl / n) + 0.16::double * (sg / n) + 0.12::double * (pain / k / 5.0::double)
    + 0.1::double * (ev / k / 5.0::double) + 0.1::double * (urg / k / 5.0::double) + 0.07::double * (comm / k / 5.0::double) + 0.05::double * (work / k)) * greatest(0.0::double, 1.0::double - 0.35::double * (led / k)))) as decimal(18, 9)), 2)::double, 0.0::double) as s
  from (select distinct theme_cluster from findings) x cross join (select unnest(generate_series(0, 199)) as rep) r left join sums on sums.theme_cluster = x.theme_cluster and sums.rep = r.rep, (select {_N} as n)
)
select theme_cluster, 200 as bootstrap_reps, round(cast(quantile_cont(s, 0.5) as decimal(18, 7)), 3)::double as opportunity_score_bootstrap_median, round(cast(quantile_cont(s, 0.025) as decimal(18, 7)), 3)::double as opportunity_score_ci_low, round(cast(quantile_cont(s, 0.975) as decimal(18, 7)), 3)::double as opportunity_score_ci_high,
  round(cast(quantile_cont(p, 0.5) as decimal(18, 7)), 4)::double as prevalence_bootstrap_median, round(cast(quantile_cont(p, 0.025) as decimal(18, 7)), 4)::double as prevalence_bootstrap_ci_low, round(cast(quantile_cont(p, 0.975) as decimal(18, 7)), 4)::double as prevalence_bootstrap_ci_high from t group by theme_cluster"""),
    "call_metrics": ("FA", False, f"""
+tw as (select *, len(regexp_extract_all({_ASCII.format("text")}, '{_TOKEN}'))::bigint as w from turns
), tm as (
  select call_id, customer_id, count(*) as turns_total, count(*) filter (speaker_role = 'customer') as customer_turns, count(*) filter (speaker_role = 'interviewer') as interviewer_turns,
    coalesce(sum(w) filter (speaker_role = 'customer'), 0)::bigint as customer_words, coalesce(sum(w) filter (speaker_role = 'interviewer'), 0)::bigint as interviewer_words,
    count(*) filter (speaker_role = 'interviewer' and contains(text, '?')) as interviewer_questions, max("end") - min("start") as span from tw group by all
), fm as (
  select call_id, customer_id, count(*) as findings_count, count(distinct theme_cluster) as unique_theme_count, count(*) filter (strong_signal) as strong_clean_findings_count, count(*) filter (leading_or_contaminated) as contaminated_findings_count,
    avg(evidence_strength::double) as ev, avg(pain_severity::double) as pain from flags group by all
), am as (select call_id, customer_id, count(*) as audit_flags_count, sum(leading_score)::bigint as audit_leading_score_sum from audit group by all)
select call_id, customer_id, turns_total, customer_turns, interviewer_turns, customer_words, interviewer_words, round(case when customer_words + interviewer_words > 0 then customer_words::double / (customer_words + interviewer_words) else 0.0::double end, 4) as customer_word_share,
  round(case when span <> 0 then span / 60.0::double else 0.0::double end, 2) as duration_minutes, interviewer_questions, coalesce(findings_count, 0)::bigint as findings_count, coalesce(unique_theme_count, 0)::bigint as unique_theme_count,
  coalesce(strong_clean_findings_count, 0)::bigint as strong_clean_findings_count, coalesce(contaminated_findings_count, 0)::bigint as contaminated_findings_count, round(coalesce(ev, 0.0::double), 3) as avg_evidence_strength, round(coalesce(pain, 0.0::double), 3) as avg_pain_severity,
  coalesce(audit_flags_count, 0)::bigint as audit_flags_count, coalesce(audit_leading_score_sum, 0)::bigint as audit_leading_score_sum,
  round(case when interviewer_words > 0 then 1000.0::double * coalesce(audit_leading_score_sum, 0) / interviewer_words else 0.0::double end, 3) as leading_score_per_1k_interviewer_words
from tm left join fm using (call_id, customer_id) left join am using (call_id, customer_id)"""),
    "talk_share_histogram": ("T", False, f"""
+tw as (select call_id, customer_id, speaker_role, len(regexp_extract_all({_ASCII.format("text")}, '{_TOKEN}'))::bigint as w from turns
), sh as (
  select call_id, customer_id, coalesce(sum(w) filter (speaker_role = 'customer'), 0)::double as c, coalesce(sum(w) filter (speaker_role in ('customer', 'interviewer')), 0)::double as a from tw group by all
), r as (select round(case when a > 0 then c / a else 0.0::double end, 4) as s from sh)
select least(20, floor(s * 20.0::double) + 1)::bigint as bin, count(*) as calls from r group by 1"""),
    "prompt_type_counts": ("A", False, "select coalesce(prompt_type, 'unknown') as prompt_type, count(*) as flags from audit group by 1"),
    "leading_score_hist": ("A", False, "select leading_score, count(*) as flags from audit group by 1"),
    "role_theme_counts": ("F", False, "select theme_cluster, role, count(*) as mention_count from (select theme_cluster, unnest(string_split(roles_text, ';')) as role from findings) group by all"),
    "role_theme_pivot": ("F", False, "select theme_cluster, " + ", ".join(f"count(*) filter (role = 'role{i}') as role{i}" for i in range(4)) + " from (select theme_cluster, unnest(string_split(roles_text, ';')) as role from findings) group by all"),
    "word_freq": ("T", False, _terms(1)),
    "bigram_freq": ("T", False, _terms(2)),
    "trigram_freq": ("T", False, _terms(3)),
    "customer_tokens": ("T", False, f"""+per_customer as (select customer_id, string_agg(coalesce(text, ''), ' ' order by call_id, turn_index) as t from turns where speaker_role = 'customer' group by customer_id
), tokens as (select customer_id, list_filter(regexp_extract_all({_ASCII.format("t")}, '{_TOKEN}'), lambda x: length(x) >= 3 and x not in ({_STOP})) as toks from per_customer)
select customer_id, len(toks)::bigint as tokens, len(list_distinct(toks))::bigint as distinct_tokens from tokens"""),
    "role_contrast": ("T", False, f"""
+terms as (
  select speaker_role as r, unnest(list_filter(regexp_extract_all({_ASCII.format("text")}, '{_TOKEN}'), lambda x: length(x) >= 3 and x not in ({_STOP}))) as term from turns where speaker_role in ('customer', 'interviewer')
), counts as (select term, count(*) filter (r = 'customer') as cc, count(*) filter (r = 'interviewer') as ci from terms group by term
), tot as (select sum(cc)::double as tc, sum(ci)::double as ti, count(*)::double as v from counts
), o as (select *, case when tc > 0 and ti > 0 then ln(((cc + 0.5::double) / (tc + 0.5::double * v)) / ((ci + 0.5::double) / (ti + 0.5::double * v))) else 0.0::double end as lo from counts, tot where cc + ci >= 3)
select term, cc as customer_count, ci as interviewer_count, round(1000.0::double * cc / tc, 3) as customer_per_1k_words, round(1000.0::double * ci / ti, 3) as interviewer_per_1k_words, round(lo, 4) as log_odds_customer_vs_interviewer,
  case when lo > 0 then 'customer' else 'interviewer' end as more_characteristic_of from o order by abs(round(lo, 4)) desc, term limit 200"""),
    "lexicon_by_customer": ("T", False, f"+{_LEX_BY} select * from lex"),
    "lexicon_summary": ("T", False, f"""+{_LEX_BY}, long as (unpivot lex on {", ".join(_LEX)} into name domain_category value x
), ranked as (select *, row_number() over (partition by domain_category order by x) as i from long
), g as (select domain_category, sum(x)::bigint as total_mentions, count(*) filter (x > 0) as unique_customer_count, count(*)::double as n, median(x) as md, sum(i * x)::double as r from ranked group by domain_category)
select domain_category, total_mentions, unique_customer_count, round(unique_customer_count / n, 4) as prevalence, round({_LLOW}, 4) as prevalence_ci_low, round({_LHIGH}, 4) as prevalence_ci_high, round(total_mentions / n, 3) as mean_mentions_per_customer,
  round(md, 3) as median_mentions_per_customer, round(case when total_mentions > 0 then 2.0::double * r / (n * total_mentions) - (n + 1.0::double) / n else 0.0::double end, 3) as mentions_gini from g"""),
    "redact_basic": ("", False, f"select doc_id, {_REDACT} as text from documents"),
    "word_counts": ("", False, f"select doc_id, len(regexp_extract_all({_ASCII.format('text')}, '{_TOKEN}'))::bigint as words from documents"),
    "clean_text": ("", False, rf"select page_id, trim(regexp_replace(regexp_replace({_UNESCAPE}, '<[^>]+>', ' ', 'g'), '{_UWS}', ' ', 'g')) as text from pages"),
    "normalize_label": ("", False, r"select page_id, regexp_replace(regexp_replace(trim(lower(url)), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g') as label from pages"),
    "normalize_for_matching": ("", False, rf"select doc_id, trim(regexp_replace(lower(text), '{_UWS}', ' ', 'g')) as text from documents"),
    "semicolon_split": ("F", False, "select finding_id, array_to_string(p, '|') as parts, len(p)::bigint as n from (select finding_id, list_filter(list_transform(string_split(' ; ' || roles_text || ' ;; x ', ';'), lambda x: trim(x)), lambda x: x <> '') as p from findings)"),
    "time_stamp": ("T", False, f"""select call_id, turn_index, {_stamp('("start" + turn_index * 4000.25)')} as stamp, floor("start" + turn_index * 4000.25)::double + 0.5::double as seconds from turns"""),
    "format_turns": ("T", False, f"select call_id, turn_index, '[' || {_stamp('\"start\"')} || '-' || {_stamp('\"end\"')} || '] ' || upper(speaker_role) || ' | ' || speaker || ': ' || {_REDACT} as line from turns"),
    "interviewer_flags": ("T", False, f"select call_id, turn_index, {_SCORE} as leading_score, {_WHY} as why_flagged from turns"),
    "audit_union": ("A", False, f"""select call_id, question_or_statement, 'fixture' as chunk_id, leading_score, '' as why_flagged from audit
union all select call_id, text, 'heuristic', {_SCORE}, {_WHY} from turns where speaker_role = 'interviewer' and {_SCORE} > 0"""),
    "turn_merge": ("T", True, """
+b as (
  select call_id, row_number() over (partition by call_id order by turn_index) as i, 26.0::double * turn_index as s, 26.0::double * turn_index + 25.0::double as e, 'S' || ((turn_index // 2) % 2)::varchar as sp, text as t from turns
), w as (
  select call_id, i, s, e, sp, t, 0 as g from b where i = 1
  union all
  select b.call_id, b.i, case when j then w.s else b.s end, case when j then greatest(w.e, b.e) else b.e end, b.sp, case when j then w.t || ' ' || b.t else b.t end, case when j then w.g else w.g + 1 end
  from (select b.*, w.call_id as wc, w.s as ws, w.e as we, w.t as wt, w.g as wg, (w.sp = b.sp and b.s - w.e <= 2.0 and length(w.t) + length(b.t) <= 1200) as j from w join b on b.call_id = w.call_id and b.i = w.i + 1) b,
    lateral (select b.ws as s, b.we as e, b.wt as t, b.wg as g) w
)
select call_id, g::int as turn_index, arg_max(s, i) as "start", arg_max(e, i) as "end", arg_max(sp, i) as speaker, arg_max(t, i) as text from w group by call_id, g"""),
    "chunk_manifest": ("T", True, f"""{_chunks(1200)}, walk as (
  select call_id, 0::bigint as i, 1 as no from ends where i = 0
  union all select e.call_id, e.en, walk.no + 1 from walk join ends e on e.call_id = walk.call_id and e.i = walk.i where e.en < e.n
)
select w.call_id || '__chunk_' || lpad(w.no::varchar, 3, '0') as chunk_id, w.call_id, a.customer_id, a.file_name, a.turn_index as start_turn_index, z.turn_index as end_turn_index
from walk w join ends e on e.call_id = w.call_id and e.i = w.i join lines a on a.call_id = w.call_id and a.i = w.i join lines z on z.call_id = w.call_id and z.i = e.en - 1"""),
    "chunk_overlap": ("T", True, f"""{_chunks(2500)}, walk as (
  select call_id, 0::bigint as i, 1 as no from ends where i = 0
  union all select e.call_id, greatest(e.en - 2, e.i + 1), walk.no + 1 from walk join ends e on e.call_id = walk.call_id and e.i = walk.i where e.en < e.n
)
select w.call_id || '__chunk_' || lpad(w.no::varchar, 3, '0') as chunk_id, a.turn_index as start_turn_index, z.turn_index as end_turn_index, (e.en - w.i)::bigint as n_turns
from walk w join ends e on e.call_id = w.call_id and e.i = w.i join lines a on a.call_id = w.call_id and a.i = w.i join lines z on z.call_id = w.call_id and z.i = e.en - 1"""),
    "packet_strongest": ("F", False, _packet("true", 60)),
    "packet_workflow": ("F", False, _packet("finding_type like '%workflow%'", 40)),
    "packet_surprise": ("F", False, _packet("finding_type like '%surprise%' or finding_type like '%contradiction%'", 30)),
    "packet_skeptical": ("F", False, _packet("finding_type like '%skeptical%' or leading_or_contaminated or evidence_strength <= 2", 40)),
    "packet_audit": ("A", False, "select call_id, turn_index, leading_score, prompt_type from audit order by leading_score desc, call_id, turn_index limit 40"),
    "packet_json": ("F", False, """select finding_id, '{"theme_cluster":"' || theme_cluster || '","evidence_strength":' || evidence_strength::varchar || '}' as doc from (""" + "select * from findings order by evidence_strength desc, confidence desc, finding_id limit 60)"),
    "dataset_totals": ("FA", False, "select (select count(distinct customer_id) from customers) as customer_count, (select count(*) from findings) as finding_count, (select count(*) from audit) as audit_flag_count"),
    "customer_dim": ("F", False, "select distinct customer_id from findings"),
    "metadata_join": ("T", False, """
+meta as (
  select 'conv_' || conv_id::varchar || '.vtt' as file_name, case when conv_id % 2 = 0 then 'call ' || conv_id::varchar else 'conv_' || conv_id::varchar end as call_id, 'cust ' || (conv_id % 7)::varchar as customer_id, conv_id % 3 = 0 as listed
  from (select distinct conv_id from conversations where conv_id % 3 <> 1)
)
select file_name, meta.call_id, meta.customer_id, turn_index, speaker, case when listed and speaker = 'assistant' then 'interviewer' when listed and speaker in ('user', 'guest') then 'customer' when listed then 'unknown' else 'customer' end as speaker_role
from turns join meta using (file_name)"""),
    "metadata_unmatched": ("T", False, """
+listed as (select 'conv_' || conv_id::varchar || '.vtt' as file_name from (select distinct conv_id from conversations where conv_id % 3 <> 1) union all select 'conv_none.vtt')
select file_name from listed where file_name not in (select file_name from turns)"""),
}

_BI, _TRI = _terms(2).strip()[1:], _terms(3).strip()[1:]
ORACLES["phrase_freq"] = ("T", False, f"select * from (with {_BI}) union all select * from (with {_TRI})")

_ONE = _terms(1).strip()[1:]
ORACLES["term_introduction"] = ("T", False, rf"""
+best_phrases as (select term from ({ORACLES["phrase_freq"][2]}) order by unique_customer_count desc, total_count desc, term limit 75
), best_words as (select term from (with {_ONE}) order by unique_customer_count desc, total_count desc, term limit 75
), given as (select unnest(['the', 'and', 'that', 'was the', 'of the', 'and the', 'is']) as term, generate_subscripts(['the', 'and', 'that', 'was the', 'of the', 'and the', 'is'], 1) as i
), listed as (select term from best_phrases union select term from best_words
), more as (select term, row_number() over (order by i) as i from given where term not in (select term from listed) and length(term) >= 3
), terms as (select term from listed union all select term from more where i <= 150 - (select count(*) from listed)
), said as (
  select call_id, turn_index, speaker_role as role, speaker, {_ASCII.format("text")} as t from turns
), m as (select term, call_id, turn_index, role, speaker from said, terms where regexp_matches(t, '\b' || replace(term, ' ', '\s+') || '\b')
), f as (select term, call_id, min((turn_index, role, speaker)) as f, max(case when role = 'customer' then (turn_index, speaker) end) as c from m group by all
), k as (select term, call_id, f[2] as role, f[3] as fs, c[2] as cs, coalesce(f[2] = 'interviewer' and c[1] > f[1], false) as inj from f
), e as (select *, row_number() over (partition by term, inj order by call_id) as i from k)
select term, count(*) as calls_seen, count(*) filter (role = 'customer') as customer_first_calls, count(*) filter (role = 'interviewer') as interviewer_first_calls, count(*) filter (inj) as interviewer_first_then_customer_later_calls,
  round(count(*) filter (inj)::double / count(*), 4) as possible_term_injection_rate, round(count(*) filter (role = 'customer')::double / count(*), 4) as customer_origin_rate,
  coalesce(string_agg(call_id || ': ' || fs || ' then ' || cs, ' | ' order by call_id || ': ' || fs || ' then ' || cs) filter (inj and i <= 3), '') as examples from e group by term""")

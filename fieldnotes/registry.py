"""All registered queries of the engine over the driver's tables, and their SQL for DuckDB.

Fixture rules for the views that they use are in plans/fixtures.py.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, FlagRule
from .functions import text as tx
from .operators import calls, clusters, language, themes
from .operators import findings as fd
from .plans import fixtures as fx
from .plans.fixtures import SQL_AUDIT, SQL_FINDINGS, SQL_TURNS
from .registry_sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: The fixtures' own settings: a lexicon of words that occur there, rules without question marks, fewer repetitions.
LEXICON = {"articles": ("the", "and the"), "verbs": ("is", "are", "was"), "nouns": ("please", "thanks", "question"), "german": ("der", "die", "und")}
RULES = (FlagRule(r"(?i)\bthe\b", 1, "says the"), FlagRule(r"(?i)\band\b", 2, "says and"), FlagRule(r"(?i)\bwas\b", 2, "says was"), FlagRule(r"(?i)\bof\b", 2, "says of"))
FIXTURE = replace(DEFAULT, lexicon=LEXICON, flag_rules=RULES, bootstrap_reps=200, bootstrap_seed=42, max_chars=1200, overlap_turns=0)
#: Besides the terms that the turns themselves suggest.
TERMS = ("the", "and", "that", "was the", "of the", "and the", "is")


def _fc(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.findings(s, d), fx.customers(s, d)


def _turn_customers(s: SparkSession, d: str) -> DataFrame:
    return fd.customer_dimension(fx.turns(s, d))


def theme_statistics(s: SparkSession, d: str) -> DataFrame:
    return themes.statistics(*_fc(s, d))


def theme_summary(s: SparkSession, d: str) -> DataFrame:
    f, c = _fc(s, d)
    return themes.summary(f.withColumn("roles_affected", tx.parse_roles(F.col("roles_text"))), c)


def finding_flags(s: SparkSession, d: str) -> DataFrame:
    f = fd.flags(fx.findings(s, d))
    return f.select("finding_id", "leading_or_contaminated_bool", "has_workaround", "has_consequence", "clean_customer_origin", "clean_signal", "strong_signal", "stated_want_signal", "revealed_pain_signal")


def want_gap(s: SparkSession, d: str) -> DataFrame:
    f, c = _fc(s, d)
    return themes.want_gap(f, themes.prevalence(f, c), c)


def sample_size(s: SparkSession, d: str) -> DataFrame:
    f, c = _fc(s, d)
    return themes.sample_size(themes.prevalence(f, c), c)


def theme_association(s: SparkSession, d: str) -> DataFrame:
    a = themes.association(*_fc(s, d))
    return a.withColumns({"fisher_p_value": F.round("fisher_p_value", 6), "fisher_fdr_q_value": F.round("fisher_fdr_q_value", 6)})


def customer_theme_rollup(s: SparkSession, d: str) -> DataFrame:
    r = themes.customer_rollup(fx.findings(s, d))
    return r.select("customer_id", "theme_cluster", "any_clean", "any_strong", *[F.round(c, 4).alias(c) for c in ("evidence", "pain", "urgency", "commercial", "workaround", "led")])


def call_metrics(s: SparkSession, d: str) -> DataFrame:
    return calls.metrics(fx.turns(s, d), fx.findings(s, d), fx.audit(s, d))


def talk_share_histogram(s: SparkSession, d: str) -> DataFrame:
    return calls.talk_share_histogram(call_metrics(s, d)).select(F.col("bin").cast("long"), "calls")


def prompt_type_counts(s: SparkSession, d: str) -> DataFrame:
    return fd.prompt_types(fx.audit(s, d))


def leading_score_hist(s: SparkSession, d: str) -> DataFrame:
    return fd.leading_scores(fx.audit(s, d))


def _with_roles(s: SparkSession, d: str) -> DataFrame:
    return fx.findings(s, d).withColumn("roles_affected", tx.parse_roles(F.col("roles_text")))


def term_freq(n: int) -> Query:
    return lambda s, d: language.term_frequencies(fx.turns(s, d), _turn_customers(s, d), n=n)


def audit_union(s: SparkSession, d: str) -> DataFrame:
    a = fx.audit(s, d).drop("turn_index")
    return fd.heuristic_audit(fx.turns(s, d), a, FIXTURE).select("call_id", "question_or_statement", "chunk_id", "leading_score", "why_flagged")


def interviewer_flags(s: SparkSession, d: str) -> DataFrame:
    t = fx.turns(s, d).select("call_id", "turn_index", tx.interviewer_flags(F.col("text"), RULES).alias("f"))
    return t.select("call_id", "turn_index", "f.leading_score", "f.why_flagged")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "documents").select("doc_id", "text")


def word_counts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.count_words(F.col("text")).alias("words"))


def redact_basic(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.redact(F.col("text")).alias("text"))


def clean_text(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))


def normalize_label(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "pages").select("page_id", tx.normalize_label(F.col("url")).alias("label"))


def normalize_for_matching(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.normalize_for_matching(F.col("text")).alias("text"))


def semicolon_split(s: SparkSession, d: str) -> DataFrame:
    p = fx.findings(s, d).select("finding_id", tx.split_semicolons(F.concat(F.lit(" ; "), F.col("roles_text"), F.lit(" ;; x "))).alias("p"))
    return p.select("finding_id", F.array_join("p", "|").alias("parts"), F.size("p").cast("long").alias("n"))


def time_stamp(s: SparkSession, d: str) -> DataFrame:
    at = F.col("start") + F.col("turn_index") * 4000.25
    t = fx.turns(s, d).select("call_id", "turn_index", tx.seconds_to_stamp(at).alias("stamp"))
    return t.withColumn("seconds", tx.time_to_seconds(F.concat(F.col("stamp"), F.lit(",500"))))


def format_turns(s: SparkSession, d: str) -> DataFrame:
    t = fx.turns(s, d)
    return t.select("call_id", "turn_index", tx.format_turn(F.col("start"), F.col("end"), F.col("speaker_role"), F.col("speaker"), F.col("text")).alias("line"))


def turn_merge(s: SparkSession, d: str) -> DataFrame:
    i = F.col("turn_index")
    t = fx.turns(s, d).withColumns({"start": 26.0 * i, "end": 26.0 * i + 25.0, "speaker": F.concat(F.lit("S"), (F.floor(i / 2) % 2).cast("string"))})
    return calls.merge_nearby(t).select("call_id", "turn_index", "start", "end", "speaker", "text")


def chunk_manifest(s: SparkSession, d: str) -> DataFrame:
    return calls.manifest(calls.chunks(fx.turns(s, d), FIXTURE))


def chunk_overlap(s: SparkSession, d: str) -> DataFrame:
    c = calls.chunks(fx.turns(s, d), replace(FIXTURE, overlap_turns=2, max_chars=2500))
    return c.select("chunk_id", "start_turn_index", "end_turn_index", F.size("turns").cast("long").alias("n_turns"))


def packet(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        return fd.slices(fx.findings(s, d))[name].select("finding_id", "finding_type", "theme_cluster", "evidence_strength", "confidence", "customer_quote")

    return query


def packet_audit(s: SparkSession, d: str) -> DataFrame:
    return fd.top_audit(fx.audit(s, d)).select("call_id", "turn_index", "leading_score", "prompt_type")


def packet_json(s: SparkSession, d: str) -> DataFrame:
    """The strongest findings as one JSON document per row."""
    return fd.slices(fx.findings(s, d))["strongest_findings"].select("finding_id", F.to_json(F.struct("theme_cluster", "evidence_strength")).alias("doc"))


def dataset_totals(s: SparkSession, d: str) -> DataFrame:
    f, c = _fc(s, d)
    return fd.totals(f, fx.audit(s, d), c)


def _metadata(s: SparkSession, d: str) -> DataFrame:
    """A metadata row for every third conversation, some of which list nobody, and one for a file that isn't there."""
    conv = fx.table(s, d, "conversations").select("conv_id").distinct().filter("conv_id % 3 <> 1")
    n = F.col("conv_id")
    listed = n % 3 == 0
    rows = conv.select(
        F.concat(F.lit("conv_"), n.cast("string"), F.lit(".vtt")).alias("file_name"),
        F.when(n % 2 == 0, F.concat(F.lit("call "), n.cast("string"))).otherwise(" ").alias("call_id"),
        F.concat(F.lit("cust "), (n % 7).cast("string")).alias("customer_id"),
        F.when(listed, "user; guest").otherwise("").alias("customer_speakers"),
        F.when(listed, " assistant ;").otherwise("").alias("interviewer_speakers"),
    )
    lost = s.createDataFrame([("conv_none.vtt", "x", "y", "", "")], rows.schema)
    return rows.unionByName(lost)


def metadata_join(s: SparkSession, d: str) -> DataFrame:
    t = calls.assign_roles(fx.turns(s, d), _metadata(s, d))
    return t.select("file_name", "call_id", "customer_id", "turn_index", "speaker", "speaker_role")


def metadata_unmatched(s: SparkSession, d: str) -> DataFrame:
    return calls.unmatched(_metadata(s, d), fx.turns(s, d)).select("file_name")


def theme_clusters(s: SparkSession, d: str) -> DataFrame:
    """Average linkage of all embeddings."""
    return clusters.cluster_vectors(fx.table(s, d, "embeddings"), "vec_id", "embedding", DEFAULT.cluster_distance)


def term_introduction(s: SparkSession, d: str) -> DataFrame:
    """The terms that the turns' own phrases and words suggest, then those of the fixture."""
    t, c = fx.turns(s, d), _turn_customers(s, d)
    return language.term_introduction(t, language.candidate_terms(language.phrase_frequencies(t, c), language.term_frequencies(t, c), TERMS))


def customer_tokens(s: SparkSession, d: str) -> DataFrame:
    t = language.customer_tokens(language.of_role(fx.turns(s, d), "customer"))
    return t.select("customer_id", F.size("tokens").cast("long").alias("tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("distinct_tokens"))


def queries() -> dict[str, Query]:
    c = _turn_customers
    t = fx.turns
    return {
        "theme_statistics": theme_statistics,
        "theme_summary": theme_summary,
        "origin_mix": lambda s, d: themes.mix(fx.findings(s, d), "customer_origin", "origin_mix"),
        "theme_quotes": lambda s, d: themes.quotes(fx.findings(s, d)),
        "finding_flags": finding_flags,
        "mention_distribution": lambda s, d: themes.mention_distribution(*_fc(s, d)),
        "mentions_gini": lambda s, d: themes.mention_distribution(*_fc(s, d)).select("theme_cluster", "mentions_gini"),
        "customer_theme_rollup": customer_theme_rollup,
        "theme_customer_matrix": lambda s, d: themes.customer_matrix(*_fc(s, d)),
        "theme_cooccurrence": lambda s, d: themes.cooccurrence(fx.findings(s, d)),
        "theme_association": theme_association,
        "want_gap": want_gap,
        "sample_size": sample_size,
        "bootstrap_ci": lambda s, d: themes.bootstrap(*_fc(s, d), FIXTURE),
        "call_metrics": call_metrics,
        "talk_share_histogram": talk_share_histogram,
        "prompt_type_counts": prompt_type_counts,
        "leading_score_hist": leading_score_hist,
        "role_theme_counts": lambda s, d: themes.role_counts(_with_roles(s, d)),
        "role_theme_pivot": lambda s, d: themes.role_pivot(_with_roles(s, d), ["role0", "role1", "role2", "role3"]),
        "word_freq": term_freq(1),
        "bigram_freq": term_freq(2),
        "trigram_freq": term_freq(3),
        "phrase_freq": lambda s, d: language.phrase_frequencies(t(s, d), c(s, d)),
        "customer_tokens": customer_tokens,
        "role_contrast": lambda s, d: language.role_contrast(t(s, d)),
        "lexicon_by_customer": lambda s, d: language.lexicon_by_customer(t(s, d), c(s, d), FIXTURE),
        "lexicon_summary": lambda s, d: language.lexicon_summary(t(s, d), c(s, d), FIXTURE),
        "term_introduction": term_introduction,
        "redact_basic": redact_basic,
        "word_counts": word_counts,
        "clean_text": clean_text,
        "normalize_label": normalize_label,
        "normalize_for_matching": normalize_for_matching,
        "semicolon_split": semicolon_split,
        "time_stamp": time_stamp,
        "format_turns": format_turns,
        "interviewer_flags": interviewer_flags,
        "audit_union": audit_union,
        "turn_merge": turn_merge,
        "chunk_manifest": chunk_manifest,
        "chunk_overlap": chunk_overlap,
        "packet_strongest": packet("strongest_findings"),
        "packet_workflow": packet("workflow_friction_findings"),
        "packet_surprise": packet("surprise_or_contradiction_findings"),
        "packet_skeptical": packet("skeptical_signals"),
        "packet_audit": packet_audit,
        "packet_json": packet_json,
        "dataset_totals": dataset_totals,
        "customer_dim": lambda s, d: fd.customer_dimension(fx.turns(s, d).limit(0), fx.findings(s, d)),
        "metadata_join": metadata_join,
        "metadata_unmatched": metadata_unmatched,
        "theme_clusters": theme_clusters,
    }


def oracle_sql() -> dict[str, str]:
    ctes = {"F": SQL_FINDINGS, "T": SQL_TURNS, "A": SQL_TURNS + "," + SQL_AUDIT, "FA": SQL_FINDINGS + "," + SQL_TURNS + "," + SQL_AUDIT, "": ""}
    out = {}
    for name, (kind, recursive, body) in ORACLES.items():
        head = ctes[kind]
        with_ = ("with recursive " if recursive else "with ") if head or body.lstrip().startswith("+") else ""
        body = body.strip()
        if body.startswith("+"):  # more common table expressions, then the query
            body = (", " if head else "") + body[1:]
        out[name] = with_ + head + "\n" + body
    return out

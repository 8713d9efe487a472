"""Findings: derived flags, the extractor's replies, and slices for an evidence packet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..schemas import REPLY, project

#: What counts as an unprompted origin, as a stated wish's prompt and as a revealed problem's type.
CLEAN_ORIGINS = ("spontaneous", "lightly_prompted")
WANT_PROMPTS = "feature|solution|validation"
PAIN_TYPES = "pain|workflow"


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _number(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def flags(findings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add the eight derived flags. Missing columns count as empty text, 0 or false; adding twice changes nothing."""
    origin = F.lower(F.trim(_text(findings, "customer_origin")))
    led = tx.safe_bool(F.col("leading_or_contaminated")) if "leading_or_contaminated" in findings.columns else F.lit(False)
    workaround = tx.is_nonempty(_text(findings, "current_coping_or_workaround"), config.empty_words)
    consequence = tx.is_nonempty(_text(findings, "consequence"), config.empty_words)
    clean_origin = origin.isin(*CLEAN_ORIGINS)
    clean = clean_origin & ~led
    strong = clean & (_number(findings, "evidence_strength") >= 4)
    wants = F.lower(_text(findings, "customer_quote")).rlike("|".join(config.want_patterns)) if config.want_patterns else F.lit(False)
    stated = led | F.lower(_text(findings, "interviewer_prompt_type")).rlike(WANT_PROMPTS) | wants
    revealed = strong & F.lower(_text(findings, "finding_type")).rlike(PAIN_TYPES) & (workaround | consequence)
    return findings.withColumns(
        {
            "leading_or_contaminated_bool": led,
            "has_workaround": workaround,
            "has_consequence": consequence,
            "clean_customer_origin": clean_origin,
            "clean_signal": clean,
            "strong_signal": strong,
            "stated_want_signal": stated,
            "revealed_pain_signal": revealed,
        }
    )


def within(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """Findings of known customers only, so that no count passes its denominator."""
    return findings.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")


def customer_dimension(*sources: DataFrame) -> DataFrame:
    """Distinct customer ids, as text, of the first source that has any: metadata, else turns, else findings."""
    for df in sources:
        ids = df.select(F.trim(F.col("customer_id").cast("string")).alias("customer_id")).filter("customer_id <> ''").distinct()
        if not ids.isEmpty():
            return ids
    return sources[-1].select(F.col("customer_id").cast("string")).limit(0)


def from_replies(replies: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Findings and audit rows of model replies (JSON text), with the other columns as lineage. A reply without an object gives none."""
    rest = [c for c in replies.columns if c != reply]
    parsed = replies.select(*rest, F.from_json(tx.json_object(F.col(reply)), REPLY, {"mode": "PERMISSIVE"}).alias("_r"))
    return parsed.select(F.inline("_r.findings"), *rest), parsed.select(F.inline("_r.interviewer_audit"), *rest)


def heuristic_audit(turns: DataFrame, audit: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The audit with rows for interviewer turns that a rule flags."""
    own = (
        turns.filter("speaker_role = 'interviewer'")
        .withColumn("_f", tx.interviewer_flags(F.col("text"), config.flag_rules))
        .filter("_f.leading_score > 0")
        .select(
            F.col("speaker").alias("interviewer_speaker"),
            F.col("text").alias("question_or_statement"),
            F.lit("heuristic").alias("prompt_type"),
            F.col("_f.leading_score"),
            F.col("_f.why_flagged"),
            F.lit("").alias("better_neutral_rewrite"),
            F.lit("heuristic").alias("chunk_id"),
            "call_id",
            "customer_id",
            "file_name",
        )
    )
    return own if audit is None else audit.unionByName(own, allowMissingColumns=True)


def prompt_types(audit: DataFrame) -> DataFrame:
    """prompt_type (unknown for null), flags; most first."""
    return audit.groupBy(F.coalesce("prompt_type", F.lit("unknown")).alias("prompt_type")).agg(F.count(F.lit(1)).alias("flags")).orderBy(F.desc("flags"), "prompt_type")


def leading_scores(audit: DataFrame) -> DataFrame:
    """leading_score, flags: the distribution of the audit's scores."""
    return audit.groupBy("leading_score").agg(F.count(F.lit(1)).alias("flags")).orderBy("leading_score")


PACKET_COLUMNS = (
    "finding_id finding_type domain_area theme_label theme_cluster one_sentence_description customer_quote customer_speaker roles_affected workflow_step current_coping_or_workaround "
    "consequence evidence_strength pain_severity urgency commercial_relevance customer_origin leading_or_contaminated confidence call_id customer_id"
).split()


def top_findings(findings: DataFrame, keep: Column | None, n: int, tie: str = "finding_id") -> DataFrame:
    """The n best findings by evidence and confidence, with the packet's columns."""
    rows = findings if keep is None else findings.filter(F.coalesce(keep, F.lit(False)))
    order = [F.desc("evidence_strength"), F.desc("confidence"), *([F.asc(tie)] if tie in findings.columns else [F.asc("customer_id"), F.asc("call_id"), F.asc("customer_quote")])]
    return project(rows.orderBy(*order).limit(n), PACKET_COLUMNS)


def _typed(word: str) -> Column:
    return F.lower("finding_type").rlike(word)


def slices(findings: DataFrame) -> dict[str, DataFrame]:
    """The packet's four lists of findings."""
    led = tx.safe_bool(F.col("leading_or_contaminated"))
    return {
        "strongest_findings": top_findings(findings, None, 60),
        "workflow_friction_findings": top_findings(findings, _typed("workflow"), 40),
        "surprise_or_contradiction_findings": top_findings(findings, _typed("surprise|contradiction"), 30),
        "skeptical_signals": top_findings(findings, _typed("skeptical") | led | (F.col("evidence_strength") <= 2), 40),
    }


def top_audit(audit: DataFrame, n: int = 40) -> DataFrame:
    names = "interviewer_speaker question_or_statement prompt_type leading_score why_flagged better_neutral_rewrite call_id turn_index".split()
    ties = [c for c in ("call_id", "turn_index", "question_or_statement") if c in audit.columns]
    return project(audit.orderBy(F.desc("leading_score"), *ties).limit(n), names)


def totals(findings: DataFrame, audit: DataFrame, customers: DataFrame) -> DataFrame:
    """One row: numbers of customers, findings and audit flags."""
    counts = [customers.agg(F.count_distinct("customer_id").alias("customer_count")), findings.agg(F.count(F.lit(1)).alias("finding_count")), audit.agg(F.count(F.lit(1)).alias("audit_flag_count"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), counts)  # one row each

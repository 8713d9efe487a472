"""Declared schemas of the engine's tables. Every source and sink uses them; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TURN = "call_id string, file_name string, customer_id string, start double, end double, speaker string, speaker_role string, text string, turn_index int"
METADATA = "file_name string, call_id string, customer_id string, facility_type string, customer_segment string, primary_role string, customer_speakers string, interviewer_speakers string, notes string"
CHUNK_MANIFEST = "chunk_id string, call_id string, customer_id string, file_name string, start_turn_index int, end_turn_index int"
FINDING_EXTRACTED = (
    "finding_type string, domain_area string, theme_label string, one_sentence_description string, customer_quote string, customer_speaker string, "
    "roles_affected array<string>, workflow_step string, current_coping_or_workaround string, consequence string, "
    "evidence_strength int, pain_severity int, urgency int, commercial_relevance int, customer_origin string, interviewer_prompt_type string, "
    "leading_or_contaminated boolean, contamination_notes string, confidence double"
)
FINDING_LINEAGE = "chunk_id string, call_id string, customer_id string, file_name string, start_turn_index int, end_turn_index int"
FINDING = f"{FINDING_EXTRACTED}, {FINDING_LINEAGE}, theme_cluster string"
AUDIT_EXTRACTED = "interviewer_speaker string, question_or_statement string, prompt_type string, leading_score int, why_flagged string, better_neutral_rewrite string"
AUDIT = f"{AUDIT_EXTRACTED}, chunk_id string, call_id string, customer_id string, file_name string"
#: A model's reply: one JSON object with two arrays.
REPLY = f"findings array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in FINDING_EXTRACTED.split(', '))}>>, interviewer_audit array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in AUDIT_EXTRACTED.split(', '))}>>"

#: Values of the enumerated columns.
FINDING_TYPES = ("pain_theme", "workflow_friction", "surprise_or_contradiction", "skeptical_signal", "other")
ORIGINS = ("spontaneous", "lightly_prompted", "directly_prompted", "led_or_contaminated", "unclear")
ROLES = ("customer", "interviewer", "unknown")


def columns(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema)]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the schema's columns, cast without failing; missing ones are null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in StructType.fromDDL(schema):
        if f.name.lower() in have:
            c = F.col(f"`{have[f.name.lower()]}`")
            same = df.schema[have[f.name.lower()]].dataType == f.dataType
            out.append((c if same else c.try_cast(f.dataType)).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that the table has, in the order named."""
    return df.select(*[c for c in names if c in df.columns])

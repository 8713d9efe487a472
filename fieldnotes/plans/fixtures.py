"""Views of the driver's tables in the shape of the engine's own, and the same views as SQL for DuckDB.

Each view exists twice, as a DataFrame plan and as a common table expression, both from the
same rules (FIXTURES.md, section B).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Customers without findings, who stay in every denominator.
SILENT = ("C99990", "C99991", "C99992", "C99993", "C99994")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer(n: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(n.cast("string"), 5, "0"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    i, u = F.col("event_id"), F.col("user_id")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumns({"b": F.col("k") % 4, "solo": i % 997 == 5})
    k, b, solo = F.col("k"), F.col("b"), F.col("solo")
    clean = solo | (b == 0)
    even = i % 2 == 0
    five = ["pain_theme", "workflow_friction", "surprise_or_contradiction", "skeptical_signal", "other"]
    by_type = {"click": "spontaneous", "view": "lightly_prompted", "signup": "directly_prompted", "error": "led_or_contaminated", "purchase": "unclear"}
    typed = F.lit("other")
    for n, name in enumerate(five[:4]):
        typed = F.when(i % 5 == n, name).otherwise(typed)
    origin3 = F.lit("unclear")
    for name, value in by_type.items():
        origin3 = F.when(F.col("event_type") == name, value).otherwise(origin3)
    return e.select(
        i.alias("finding_id"),
        customer(u).alias("customer_id"),
        F.concat(customer(u), F.lit("-"), (i % 3).cast("string")).alias("call_id"),
        F.when(solo, F.concat(F.lit("solo_"), i.cast("string"))).otherwise(F.concat(F.lit("theme_"), F.lpad(k.cast("string"), 3, "0"))).alias("theme_cluster"),
        F.concat(F.lit("label "), k.cast("string"), F.lit(" v"), (i % 3).cast("string")).alias("theme_label"),
        F.concat(F.lit("domain "), (k % 12).cast("string")).alias("domain_area"),
        F.concat(F.lit("description "), (i % 23).cast("string")).alias("one_sentence_description"),
        F.when(clean, F.when(even, "pain_theme").otherwise("workflow_friction")).otherwise(typed).alias("finding_type"),
        F.when(clean, 4 + i % 2).when(b == 2, 1 + i % 3).otherwise(1 + (7 * i + u) % 5).cast("int").alias("evidence_strength"),
        (1 + (3 * i + k) % 5).cast("int").alias("pain_severity"),
        (1 + (i + k) % 5).cast("int").alias("urgency"),
        (1 + (u + k) % 5).cast("int").alias("commercial_relevance"),
        F.when(clean, F.when(even, "spontaneous").otherwise("lightly_prompted"))
        .when(b == 1, F.when(i % 3 != 0, "led_or_contaminated").otherwise("spontaneous"))
        .when(b == 2, "directly_prompted")
        .otherwise(origin3)
        .alias("customer_origin"),
        F.when(clean, F.lit(False)).when(b == 1, i % 3 != 0).when(b == 2, i % 4 == 0).otherwise(F.col("event_type") == "error").alias("leading_or_contaminated"),
        F.when(clean, "open_discovery_question").otherwise(F.when(even, "feature_leading_question").otherwise("neutral_follow_up")).alias("interviewer_prompt_type"),
        F.when(i % 3 == 0, "none").otherwise(F.concat(F.lit("workaround "), (i % 17).cast("string"))).alias("current_coping_or_workaround"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("consequence "), (i % 19).cast("string"))).alias("consequence"),
        F.when(~clean & (i % 13 == 0), F.concat(F.lit("i wish "), (i % 50).cast("string"))).otherwise(F.concat(F.lit("quote "), (i % 50).cast("string"))).alias("customer_quote"),
        F.concat_ws(";", F.concat(F.lit("role"), (i % 4).cast("string")), F.when(i % 2 == 0, F.concat(F.lit("role"), (k % 4).cast("string")))).alias("roles_text"),
        ((i % 101).cast("double") / 100).alias("confidence"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension of the findings: theirs, and those without findings."""
    own = table(spark, sf_dir, "events").select(customer(F.col("user_id")).alias("customer_id")).distinct()
    return own.unionByName(spark.createDataFrame([(c,) for c in SILENT], "customer_id string"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    who = customer(F.col("conv_id") % 15)
    role = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "interviewer").otherwise("unknown")
    return c.select(
        F.concat(who, F.lit("-"), F.floor(F.col("conv_id") / 15).cast("string")).alias("call_id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".vtt")).alias("file_name"),
        who.alias("customer_id"),
        (F.lit(30.0) * F.col("turn")).alias("start"),
        (F.lit(30.0) * F.col("turn") + 25.0).alias("end"),
        F.col("role").alias("speaker"),
        role.alias("speaker_role"),
        F.col("text"),
        F.col("turn").cast("int").alias("turn_index"),
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    kind = F.when(n % 7 == 0, None).when(n % 3 == 0, "open_discovery_question").when(n % 3 == 1, "neutral_follow_up").otherwise("feature_leading_question")
    return turns(spark, sf_dir).filter("speaker_role = 'interviewer'").select(
        F.col("speaker").alias("interviewer_speaker"),
        F.col("text").alias("question_or_statement"),
        kind.alias("prompt_type"),
        (n % 6).cast("int").alias("leading_score"),
        F.lit("").alias("why_flagged"),
        F.lit("").alias("better_neutral_rewrite"),
        F.lit("fixture").alias("chunk_id"),
        "call_id",
        "customer_id",
        "file_name",
        "turn_index",
    )


#: The same views for DuckDB, to be put before a query.
SQL_FINDINGS = """
base as (
  select event_id as i, user_id as u, event_type as et, cast(json_extract_string(props, '$.k') as integer) as k from events
), base2 as (
  select *, k % 4 as b, (i % 997 = 5) as solo, (i % 997 = 5 or k % 4 = 0) as clean_, 'C' || lpad(cast(u as varchar), 5, '0') as cust from base
), findings as (
  select i as finding_id, cust as customer_id, cust || '-' || cast(i % 3 as varchar) as call_id,
    case when solo then 'solo_' || cast(i as varchar) else 'theme_' || lpad(cast(k as varchar), 3, '0') end as theme_cluster,
    'label ' || cast(k as varchar) || ' v' || cast(i % 3 as varchar) as theme_label,
    'domain ' || cast(k % 12 as varchar) as domain_area,
    'description ' || cast(i % 23 as varchar) as one_sentence_description,
    case when clean_ then case when i % 2 = 0 then 'pain_theme' else 'workflow_friction' end
      else case i % 5 when 0 then 'pain_theme' when 1 then 'workflow_friction' when 2 then 'surprise_or_contradiction' when 3 then 'skeptical_signal' else 'other' end end as finding_type,
    cast(case when clean_ then 4 + i % 2 when b = 2 then 1 + i % 3 else 1 + (7 * i + u) % 5 end as integer) as evidence_strength,
    cast(1 + (3 * i + k) % 5 as integer) as pain_severity, cast(1 + (i + k) % 5 as integer) as urgency, cast(1 + (u + k) % 5 as integer) as commercial_relevance,
    case when clean_ then case when i % 2 = 0 then 'spontaneous' else 'lightly_prompted' end
      when b = 1 then case when i % 3 <> 0 then 'led_or_contaminated' else 'spontaneous' end
      when b = 2 then 'directly_prompted'
      else case et when 'click' then 'spontaneous' when 'view' then 'lightly_prompted' when 'signup' then 'directly_prompted' when 'error' then 'led_or_contaminated' else 'unclear' end end as customer_origin,
    case when clean_ then false when b = 1 then i % 3 <> 0 when b = 2 then i % 4 = 0 else et = 'error' end as leading_or_contaminated,
    case when clean_ then 'open_discovery_question' when i % 2 = 0 then 'feature_leading_question' else 'neutral_follow_up' end as interviewer_prompt_type,
    case when i % 3 = 0 then 'none' else 'workaround ' || cast(i % 17 as varchar) end as current_coping_or_workaround,
    case when i % 4 = 0 then '' else 'consequence ' || cast(i % 19 as varchar) end as consequence,
    case when not clean_ and i % 13 = 0 then 'i wish ' || cast(i % 50 as varchar) else 'quote ' || cast(i % 50 as varchar) end as customer_quote,
    'role' || cast(i % 4 as varchar) || case when i % 2 = 0 then ';role' || cast(k % 4 as varchar) else '' end as roles_text,
    cast(i % 101 as double) / 100 as confidence
  from base2
), customers as (
  select distinct customer_id from findings union all select unnest(['C99990', 'C99991', 'C99992', 'C99993', 'C99994'])
), flags as (
  select *, lower(trim(current_coping_or_workaround)) not in ('', 'none', 'n/a', 'na', 'unknown', 'not stated', 'not mentioned', 'unclear', 'null', 'no') as has_workaround, lower(trim(consequence)) not in ('', 'none', 'n/a', 'na', 'unknown', 'not stated', 'not mentioned', 'unclear', 'null', 'no') as has_consequence,
    customer_origin in ('spontaneous', 'lightly_prompted') as clean_customer_origin,
    customer_origin in ('spontaneous', 'lightly_prompted') and not leading_or_contaminated as clean_signal,
    customer_origin in ('spontaneous', 'lightly_prompted') and not leading_or_contaminated and evidence_strength >= 4 as strong_signal,
    leading_or_contaminated or interviewer_prompt_type like '%feature%' or customer_quote like 'i wish %' as stated_want_signal,
    customer_origin in ('spontaneous', 'lightly_prompted') and not leading_or_contaminated and evidence_strength >= 4
      and (finding_type like '%pain%' or finding_type like '%workflow%')
      and (lower(trim(current_coping_or_workaround)) not in ('', 'none', 'n/a', 'na', 'unknown', 'not stated', 'not mentioned', 'unclear', 'null', 'no') or lower(trim(consequence)) not in ('', 'none', 'n/a', 'na', 'unknown', 'not stated', 'not mentioned', 'unclear', 'null', 'no')) as revealed_pain_signal
  from findings
)"""

SQL_TURNS = """
turns as (
  select 'C' || lpad(cast(conv_id % 15 as varchar), 5, '0') || '-' || cast(conv_id // 15 as varchar) as call_id,
    'conv_' || cast(conv_id as varchar) || '.vtt' as file_name,
    'C' || lpad(cast(conv_id % 15 as varchar), 5, '0') as customer_id,
    cast(30.0 * turn as double) as "start", cast(30.0 * turn + 25.0 as double) as "end",
    role as speaker, case role when 'user' then 'customer' when 'assistant' then 'interviewer' else 'unknown' end as speaker_role,
    text, cast(turn as integer) as turn_index
  from conversations
)"""

SQL_AUDIT = """
audit as (
  select speaker as interviewer_speaker, text as question_or_statement,
    case when length(text) % 7 = 0 then null when length(text) % 3 = 0 then 'open_discovery_question' when length(text) % 3 = 1 then 'neutral_follow_up' else 'feature_leading_question' end as prompt_type,
    cast(length(text) % 6 as integer) as leading_score, call_id, customer_id, file_name, turn_index
  from turns where speaker_role = 'interviewer'
)"""

"""Sinks: tables as Parquet and CSV, replies as JSON, templates, packet and report."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators import calls, themes
from ..operators import findings as fd
from .transcripts import _exists


def flat(df: DataFrame) -> DataFrame:
    """Columns that CSV can hold: arrays of text joined by `; `, other nested ones as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType) and f.dataType.elementType.typeName() == "string":
            c = F.array_join(c, "; ")
        elif isinstance(f.dataType, (ArrayType, StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_tables(tables: dict[str, DataFrame], folder: str, csv: bool = True) -> None:
    """Each table as Parquet under its name and, if asked for, as CSV under `csv/`."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        if csv:
            flat(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")).write.mode("overwrite").option("escape", '"').csv(f"{folder}/csv/{name}", header=True)


REPLIES = "chunk_id string, call_id string, customer_id string, file_name string, start_turn_index int, end_turn_index int, prompt_key string, reply string, error string"


def keyed(prompts: DataFrame) -> DataFrame:
    """Add prompt_key, the SHA-256 of the prompt: a reply belongs to what was asked, not just to a chunk's name."""
    return prompts.withColumn("prompt_key", F.sha2("prompt", 256))


def write_replies(replies: DataFrame, folder: str) -> None:
    """Add raw replies as JSON lines, a folder per call, to those of earlier runs."""
    replies.write.mode("append").partitionBy("call_id").json(f"{folder}/raw_replies")


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    if not _exists(spark, f"{folder}/raw_replies"):
        return spark.createDataFrame([], REPLIES)
    return spark.read.schema(REPLIES).json(f"{folder}/raw_replies")


def pending(prompts: DataFrame, folder: str) -> DataFrame:
    """Prompts (prompt_key, ...) without a usable reply in the folder yet."""
    done = read_replies(prompts.sparkSession, folder).filter("error is null").select("prompt_key").distinct()
    return prompts.join(done, "prompt_key", "left_anti")


def usable(prompts: DataFrame, folder: str) -> DataFrame:
    """One usable reply of this or an earlier run for each of the prompts that has one, with the chunk's own lineage."""
    got = read_replies(prompts.sparkSession, folder).filter("error is null").groupBy("prompt_key").agg(F.min("reply").alias("reply"))
    return prompts.drop("prompt").join(got, "prompt_key").drop("prompt_key")


def write_template(template: DataFrame, path: str, overwrite: bool = False) -> bool:
    """Write the metadata template unless there is one already."""
    if not overwrite and _exists(template.sparkSession, path):
        return False
    template.write.mode("overwrite").option("escape", '"').csv(path, header=True)
    return True


def packet(findings: DataFrame, audit: DataFrame, customers: DataFrame, summary: DataFrame) -> dict:
    """The evidence packet: totals, the ids of all customers, and slices of at most 60 rows each."""
    rows = lambda df: [json.loads(x[0]) for x in df.select(F.to_json(F.struct("*"))).collect()]
    t = fd.totals(findings, audit, customers).first().asDict()
    t["customer_ids"] = [r[0] for r in customers.select("customer_id").distinct().orderBy("customer_id").collect()]
    out = {"dataset": t, "theme_summary_top": rows(summary.limit(25))}
    out |= {k: rows(v) for k, v in fd.slices(findings).items()}
    out["interviewer_audit_top"] = rows(fd.top_audit(audit))
    return out


def report(tables: dict[str, DataFrame]) -> str:
    """A Markdown report of the statistics: the first rows of each table, and the mean share of customers' words."""
    parts = ["# Interview evidence", ""]

    def section(title: str, name: str, k: int, columns: list[str]) -> None:
        if name not in tables:
            return
        shown = [c for c in columns if c in tables[name].columns]
        rows = tables[name].select(*shown).limit(k).collect()
        parts.extend([f"## {title}", "", "| " + " | ".join(shown) + " |", "|" + " --- |" * len(shown)])
        parts.extend("| " + " | ".join("" if v is None else str(v).replace("|", "/") for v in r) + " |" for r in rows)
        parts.append("")

    section("Themes", "theme_statistics", 10, ["theme_cluster", "customer_count", "prevalence", "prevalence_ci_low", "prevalence_ci_high", "opportunity_score"])
    section("Stated wishes and revealed problems", "want_gap", 10, ["theme_cluster", "classification", "stated_want_prevalence", "revealed_pain_prevalence"])
    section("Themes that go together", "theme_association", 10, ["theme_a", "theme_b", "n11_both", "lift", "fisher_fdr_q_value"])
    if "call_metrics" in tables:
        mean = tables["call_metrics"].agg(F.avg("customer_word_share")).first()[0]
        parts.extend(["## Calls", "", f"Customers have {mean:.1%} of the words on average." if mean is not None else "There are no calls.", ""])
    section("Terms that interviewers bring in", "term_introduction", 5, ["term", "calls_seen", "possible_term_injection_rate"])
    return "\n".join(parts)


def chart_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What the charts show, a small table each: the core ones of a run's tables, the statistical ones of the analytics."""
    out: dict[str, DataFrame] = {}

    def add(name: str, source: str, make: Callable[[DataFrame], DataFrame]) -> None:
        if source in tables:
            out[name] = make(tables[source])

    def bars(df: DataFrame) -> DataFrame:
        return df.limit(25).withColumns({"error_plus": F.col("prevalence_ci_high") - F.col("prevalence"), "error_minus": F.col("prevalence") - F.col("prevalence_ci_low")})

    roles = lambda df: themes.role_counts(df.withColumn("roles_affected", F.coalesce("roles_affected", F.expr("cast(array() as array<string>)"))))
    add("theme_frequency", "theme_summary", lambda df: df.limit(20).select("representative_theme_label", "unique_customer_count", "mention_count", "widespread", "avg_evidence_strength", "led_or_contaminated_share"))
    add("theme_spread_vs_severity", "theme_summary", lambda df: df.limit(20).select("representative_theme_label", "unique_customer_count", "avg_pain_severity", "mention_count", "avg_evidence_strength", "avg_urgency", "led_or_contaminated_share", "widespread"))
    add("leading_contamination_by_theme", "theme_summary", lambda df: df.limit(20).select("representative_theme_label", "led_or_contaminated_share", "unique_customer_count", "mention_count", "origin_mix").orderBy(F.desc("led_or_contaminated_share"), "representative_theme_label"))
    add("role_by_theme_heatmap", "extracted_findings", roles)
    add("interviewer_leading_score_distribution", "interviewer_audit", fd.leading_scores)
    add("interviewer_prompt_types", "interviewer_audit", fd.prompt_types)
    add("theme_cooccurrence_network", "theme_cooccurrence", lambda df: df.limit(50))
    add("analytics_theme_prevalence_ci", "theme_statistics", lambda df: bars(df).select("representative_theme_label", "prevalence", "error_plus", "error_minus", "customer_count", "mention_count", "clean_prevalence", "strong_prevalence", "led_or_contaminated_share", "opportunity_score"))
    add("analytics_opportunity_score", "theme_statistics", lambda df: df.limit(25).select("representative_theme_label", "opportunity_score", "prevalence", "clean_prevalence", "strong_prevalence", "avg_pain_severity", "avg_evidence_strength", "led_or_contaminated_share"))
    for name, source in (("word", "customer_word_frequencies"), ("phrase", "customer_phrase_frequencies")):
        add(f"analytics_customer_{name}_frequency", source, lambda df: df.limit(30).select("term", "unique_customer_count", "total_count", "customer_prevalence", "count_per_1k_role_words"))
    add("analytics_stated_vs_revealed", "want_gap", lambda df: df.select("representative_theme_label", "stated_want_prevalence", "revealed_pain_prevalence", "all_customer_count", "classification", "led_or_contaminated_share", "opportunity_score"))
    add("analytics_theme_association_tests", "theme_association", lambda df: df.limit(50).select("theme_a", "theme_b", "lift", "phi", "n11_both", "jaccard", "odds_ratio_haldane", "fisher_p_value", "fisher_fdr_q_value"))
    add("analytics_customer_talk_share_distribution", "call_metrics", calls.talk_share_histogram)
    add("analytics_domain_lexicon_prevalence", "lexicon_summary", lambda df: df.limit(20).select("domain_category", "unique_customer_count", "total_mentions", "prevalence", "prevalence_ci_low", "prevalence_ci_high"))
    return out


def synthesis(packet_: dict, write: Callable[[str], str] | None) -> str | None:
    """A text about the packet by a plug-in that writes text; None without one."""
    return None if write is None else write(json.dumps(packet_, ensure_ascii=False))


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()

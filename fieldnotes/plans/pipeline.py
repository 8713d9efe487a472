"""The engine's entry points: init, inspect, run and stats over a project folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import calls, clusters, language, themes
from ..operators import findings as fd
from ..schemas import AUDIT, FINDING, METADATA, TURN, conform
from ..sources import extractor, sinks, transcripts


@dataclass
class Plugins:
    extractor: Callable | None = None
    redactor: Callable | None = None
    embedder: Callable | None = None
    writer: Callable[[str], str] | None = None


@dataclass
class Result:
    tables: dict[str, DataFrame]
    errors: DataFrame | None = None
    packet: dict = field(default_factory=dict)
    report: str = ""


def init(spark: SparkSession, project: str, overwrite: bool = False, config: Config = DEFAULT) -> bool:
    """Write metadata.csv with every file's speakers; an existing one stays."""
    turns, _ = transcripts.read_turns(spark, project, config)
    return sinks.write_template(transcripts.metadata_template(turns, config), f"{project}/metadata.csv", overwrite)


def inspect(spark: SparkSession, project: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Speakers per file, and files that could not be read."""
    turns, errors = transcripts.read_turns(spark, project, config)
    return transcripts.speakers(turns), errors


def statistics(turns: DataFrame, findings: DataFrame, audit: DataFrame, metadata: DataFrame | None = None, config: Config = DEFAULT, reps: bool = True) -> dict[str, DataFrame]:
    """All statistical tables, lazily."""
    sources = [metadata] if metadata is not None else []
    customers = fd.customer_dimension(*sources, turns, findings)
    stats = themes.statistics(findings, customers, config)
    words = language.term_frequencies(turns, customers, n=1, config=config)
    phrases = language.phrase_frequencies(turns, customers, config=config)
    terms = language.candidate_terms(phrases, words, [language.entry_term(t) for v in config.lexicon.values() for t in v], config.top_terms)
    out = {
        "theme_statistics": stats.join(themes.bootstrap(findings, customers, config), themes.THEME, "left") if reps else stats,
        "theme_customer_matrix": themes.customer_matrix(findings, customers),
        "theme_cooccurrence": themes.cooccurrence(findings),
        "theme_association": themes.association(findings, customers),
        "sample_size": themes.sample_size(stats, customers),
        "call_metrics": calls.metrics(turns, findings, audit, config),
        "customer_word_frequencies": words,
        "customer_phrase_frequencies": phrases,
        "role_contrast": language.role_contrast(turns, config=config),
        "lexicon_by_customer": language.lexicon_by_customer(turns, customers, config),
        "lexicon_summary": language.lexicon_summary(turns, customers, config),
        "term_introduction": language.term_introduction(turns, terms, config),
        "want_gap": themes.want_gap(findings, stats, customers, config),
    }
    return out


def stats(spark: SparkSession, project: str, outputs: str | None = None, config: Config = DEFAULT, charts: bool = True) -> Result:
    """Statistics over the tables that an earlier run wrote, as Parquet or CSV."""
    folder = transcripts.find_outputs(spark, project, outputs)
    if folder is None:
        raise FileNotFoundError(f"no outputs of an earlier run in {project}")
    turns = transcripts.read_saved(spark, f"{folder}/parsed_turns", TURN)
    findings = transcripts.read_saved(spark, f"{folder}/extracted_findings", FINDING)
    audit = transcripts.read_saved(spark, f"{folder}/interviewer_audit", AUDIT)
    tables = statistics(turns, findings, audit, None, config)
    sinks.write_tables(tables, f"{folder}/analytics")
    if charts:
        sinks.write_tables(sinks.chart_tables(tables), f"{folder}/charts")
    text = sinks.report(tables)
    sinks.save_text(spark, text, f"{folder}/analytics/report.md")
    return Result(tables, report=text)


def run(spark: SparkSession, project: str, outputs: str | None = None, config: Config = DEFAULT, plugins: Plugins | None = None, parse_only: bool = False, limit: int | None = None, redact: bool = True, with_stats: bool = True, charts: bool = True) -> Result:
    """Parse, chunk, extract, audit, cluster, summarise, and compute statistics; every table is written below the outputs folder.

    Prompts that have a usable reply from an earlier run aren't asked again.
    """
    plugins = plugins or Plugins()
    folder = outputs or f"{project}/outputs"
    metadata_path = f"{project}/metadata.csv"
    if not transcripts._exists(spark, metadata_path):
        init(spark, project, config=config)
        raise FileNotFoundError(f"{metadata_path} was missing; a template is there now, to be filled in")
    metadata = transcripts.read_metadata(spark, metadata_path)
    raw, errors = transcripts.read_turns(spark, project, config)
    turns = conform(calls.assign_roles(raw, metadata, config), TURN)
    chunked = calls.limit_chunks(calls.chunks(turns, config), limit)
    tables = {"parsed_turns": turns, "chunk_manifest": calls.manifest(chunked)}
    sinks.write_tables(tables, folder)
    turns = spark.read.schema(turns.schema).parquet(f"{folder}/parsed_turns")
    if turns.isEmpty():
        raise ValueError("no turns: no transcript matches the metadata")
    if parse_only:
        return Result(tables | {"parsed_turns": turns}, errors)
    shown = calls.chunks(transcripts.redact_with(turns, plugins.redactor) if redact and plugins.redactor else turns, config)
    prompts = sinks.keyed(calls.prompts(calls.limit_chunks(shown, limit), redact))
    # replies cost most and differ between runs, so they are written once and read back
    replies = extractor.extract(sinks.pending(prompts, folder), plugins.extractor or (lambda: extractor.rule_based(config)))
    sinks.write_replies(replies.drop("prompt"), folder)
    found, audit = fd.from_replies(sinks.usable(prompts, folder))
    audit = conform(fd.heuristic_audit(turns, audit, config), AUDIT)
    found = found.withColumn("finding_id", F.xxhash64(*[c for c in found.columns if c != "roles_affected"]))
    found = conform(clusters.cluster_themes(found, plugins.embedder, "finding_id", config), f"finding_id long, {FINDING}")
    sinks.write_tables({"extracted_findings": found, "interviewer_audit": audit}, folder)
    found = spark.read.schema(found.schema).parquet(f"{folder}/extracted_findings")
    audit = spark.read.schema(audit.schema).parquet(f"{folder}/interviewer_audit")
    customers = fd.customer_dimension(metadata, turns, found)
    summary = themes.summary(found, customers)
    tables |= {"parsed_turns": turns, "extracted_findings": found, "interviewer_audit": audit, "theme_summary": summary}
    sinks.write_tables({"theme_summary": summary}, folder)
    packet = sinks.packet(found, audit, customers, summary)
    sinks.save_text(spark, json.dumps(packet, ensure_ascii=False, indent=1), f"{folder}/evidence_packet.json")
    text = ""
    if with_stats:
        analytics = statistics(turns, found, audit, conform(metadata, METADATA), config)
        sinks.write_tables(analytics, f"{folder}/analytics")
        tables |= analytics
        text = sinks.report(analytics)
        sinks.save_text(spark, text, f"{folder}/analytics/report.md")
    if charts:
        sinks.write_tables(sinks.chart_tables(tables), f"{folder}/charts")
    if (said := sinks.synthesis(packet, plugins.writer)) is not None:
        sinks.save_text(spark, said, f"{folder}/synthesis.md")
    return Result(tables, errors, packet, text)

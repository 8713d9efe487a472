"""Calls and turns: roles, metrics, merging of nearby turns, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import stats as st
from ..functions import text as tx
from .findings import flags


def assign_roles(turns: DataFrame, metadata: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Join turns (file_name, speaker, ...) with their file's metadata and set call_id, customer_id and speaker_role.

    Interviewers listed or matching the pattern come first, then listed customers; in a file that
    lists anyone, others are unknown; in one that lists nobody, everyone is a customer. Files
    without metadata are dropped, as are metadata without a file (see unmatched).
    """
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    m = metadata.select(
        "file_name",
        F.coalesce(F.nullif(F.trim("call_id"), F.lit("")), stem).alias("_call"),
        F.coalesce(F.nullif(F.trim("customer_id"), F.lit("")), stem).alias("_customer"),
        tx.split_semicolons(F.col("interviewer_speakers")).alias("_i"),
        tx.split_semicolons(F.col("customer_speakers")).alias("_c"),
    )
    t = turns.drop("call_id", "customer_id", "speaker_role").join(m, "file_name")
    named = F.col("speaker").rlike(config.interviewer_pattern) if config.interviewer_pattern else F.lit(False)
    role = (
        F.when(F.array_contains("_i", F.col("speaker")) | named, "interviewer")
        .when(F.array_contains("_c", F.col("speaker")), "customer")
        .when(F.size("_i") + F.size("_c") > 0, "unknown")
        .otherwise("customer")
    )
    return t.select(F.col("_call").alias("call_id"), "file_name", F.col("_customer").alias("customer_id"), "start", "end", "speaker", role.alias("speaker_role"), "text", "turn_index")


def unmatched(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows whose file is missing: a diagnostic."""
    return metadata.join(files.select("file_name").distinct(), "file_name", "left_anti")


def metrics(turns: DataFrame, findings: DataFrame, audit: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per call and customer. Findings and audit are aggregated before they are joined."""
    role = F.lower(F.trim(F.col("speaker_role")))
    words = tx.count_words(F.col("text"))
    rows = turns.select("call_id", "customer_id", role.alias("r"), words.alias("w"), F.col("text").contains("?").alias("q"), "start", "end")
    key = ["call_id", "customer_id"]
    t = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("turns_total"),
        F.count_if(F.col("r") == "customer").alias("customer_turns"),
        F.count_if(F.col("r") == "interviewer").alias("interviewer_turns"),
        F.sum(F.when(F.col("r") == "customer", F.col("w")).otherwise(0)).alias("customer_words"),
        F.sum(F.when(F.col("r") == "interviewer", F.col("w")).otherwise(0)).alias("interviewer_words"),
        F.count_if((F.col("r") == "interviewer") & F.col("q")).alias("interviewer_questions"),
        (F.max("end") - F.min("start")).alias("_span"),
    )
    f = flags(findings, config)
    g = f.groupBy(*key).agg(
        F.count(F.lit(1)).alias("findings_count"),
        F.count_distinct("theme_cluster").alias("unique_theme_count"),
        F.count_if("strong_signal").alias("strong_clean_findings_count"),
        F.count_if("leading_or_contaminated_bool").alias("contaminated_findings_count"),
        F.avg(F.col("evidence_strength").cast("double")).alias("_ev"),
        F.avg(F.col("pain_severity").cast("double")).alias("_pain"),
    )
    a = audit.groupBy(*key).agg(F.count(F.lit(1)).alias("audit_flags_count"), F.sum("leading_score").cast("long").alias("audit_leading_score_sum"))
    counts = ["findings_count", "unique_theme_count", "strong_clean_findings_count", "contaminated_findings_count", "audit_flags_count", "audit_leading_score_sum"]
    out = t.join(g, key, "left").join(a, key, "left").na.fill(0, counts)
    share = F.round(st.ratio(F.col("customer_words"), F.col("customer_words") + F.col("interviewer_words")), 4)
    return out.select(
        *key,
        "turns_total",
        "customer_turns",
        "interviewer_turns",
        "customer_words",
        "interviewer_words",
        share.alias("customer_word_share"),
        F.round(F.coalesce(F.when(F.col("_span") != 0, F.col("_span") / 60), F.lit(0.0)), 2).alias("duration_minutes"),
        "interviewer_questions",
        *counts[:4],
        F.round(F.coalesce("_ev", F.lit(0.0)), 3).alias("avg_evidence_strength"),
        F.round(F.coalesce("_pain", F.lit(0.0)), 3).alias("avg_pain_severity"),
        *counts[4:],
        F.round(st.ratio(F.col("audit_leading_score_sum") * 1000, F.col("interviewer_words")), 3).alias("leading_score_per_1k_interviewer_words"),
    ).orderBy(F.desc("customer_word_share"), F.desc("strong_clean_findings_count"), "call_id", "customer_id")


def talk_share_histogram(call_metrics: DataFrame, bins: int = 20) -> DataFrame:
    """bin (1 to bins) and calls of the customers' share of words."""
    b = F.least(F.lit(bins).cast("long"), F.width_bucket("customer_word_share", F.lit(0.0), F.lit(1.0), F.lit(bins)))
    return call_metrics.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("calls")).orderBy("bin")


def merge_nearby(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Join a turn to the one before it if the speaker is the same, the gap small and both texts together short; per call, in order.

    The length test uses the text gathered so far, so this is an ordered fold, within one row
    per call. A merged turn keeps the first start and the latest end; indexes count from 0.
    """
    keep = [c for c in ("call_id", "file_name", "customer_id", "speaker_role") if c in turns.columns]
    item = F.struct("turn_index", "start", "end", "speaker", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c) for c in keep if c != "call_id"])
    calls = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    gap, most = config.merge_gap_seconds, config.merge_max_chars

    def step(out, x):
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (last["speaker"] == x["speaker"]) & (x["start"] - last["end"] <= gap) & (F.length(last["text"]) + F.length(x["text"]) <= most)
        both = last.withField("text", F.concat(last["text"], F.lit(" "), x["text"])).withField("end", F.greatest(last["end"], x["end"]))
        return F.when(F.coalesce(joins, F.lit(False)), F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), both)).otherwise(F.array_append(out, x))

    def safe(out, x):
        return F.when(F.size(out) == 0, F.array(x)).otherwise(step(out, x))

    empty = F.filter("t", lambda x: F.lit(False))
    merged = calls.select("call_id", F.posexplode(F.aggregate("t", empty, safe)).alias("i", "x"))
    return merged.select("call_id", *[F.col(f"x.{c}") for c in keep if c != "call_id"], "x.start", "x.end", "x.speaker", "x.text", F.col("i").cast("int").alias("turn_index"))


def chunks(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks of consecutive turns of a call within a budget of characters, each starting overlap turns before the last one's end.

    One row per chunk: the manifest's columns and the turns. A call's turns are in one row;
    starts and ends are found by folds over its prefix sums of line lengths.
    """
    line = tx.format_turn(F.col("start"), F.col("end"), F.col("speaker_role"), F.col("speaker"), F.coalesce("text", F.lit("")), redacted=False)
    item = F.struct("turn_index", "start", "end", "speaker", "speaker_role", "text", F.length(line).cast("long").alias("n"), "customer_id", "file_name")
    calls = turns.groupBy("call_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    budget, overlap = config.max_chars, config.overlap_turns
    sums = F.aggregate("t", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["n"]))
    calls = calls.withColumn("ps", sums)
    # for each start (0-based), the end (exclusive): the last place within the budget, one turn at least
    at = lambda i: F.get("ps", i)
    ends = F.transform(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: F.greatest(i + 1, F.size(F.filter("ps", lambda p: p <= at(i) + budget)) - 1),
    )
    calls = calls.withColumn("en", ends)
    start = F.struct(F.lit(0).alias("i"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc, _):
        end = F.get("en", acc["i"])
        following = F.when(end >= F.size("t"), F.lit(-1)).otherwise(F.greatest(end - overlap, acc["i"] + 1))
        return F.when(acc["i"] < 0, acc).otherwise(F.struct(following.alias("i"), F.array_append(acc["out"], acc["i"]).alias("out")))

    starts = F.aggregate(F.sequence(F.lit(1), F.size("t")), start, step, lambda acc: acc["out"])
    rows = calls.select("call_id", "t", "en", F.posexplode(starts).alias("no", "i"))
    part = F.slice("t", F.col("i") + 1, F.get("en", F.col("i")) - F.col("i"))
    return rows.select("call_id", "no", part.alias("p")).select(
        F.format_string("%s__chunk_%03d", "call_id", F.col("no") + 1).alias("chunk_id"),
        "call_id",
        F.get("p", F.lit(0))["customer_id"].alias("customer_id"),
        F.get("p", F.lit(0))["file_name"].alias("file_name"),
        F.get("p", F.lit(0))["turn_index"].alias("start_turn_index"),
        F.element_at("p", -1)["turn_index"].alias("end_turn_index"),
        F.col("p").alias("turns"),
    )


def manifest(chunked: DataFrame) -> DataFrame:
    return chunked.drop("turns")


def prompts(chunked: DataFrame, redacted: bool = True) -> DataFrame:
    """chunk_id, lineage and prompt: a JSON line about the chunk, then its formatted turns."""
    about = F.to_json(F.struct("chunk_id", "call_id", "customer_id", "file_name", "start_turn_index", "end_turn_index"))
    lines = F.transform("turns", lambda x: tx.format_turn(x["start"], x["end"], x["speaker_role"], x["speaker"], F.coalesce(x["text"], F.lit("")), redacted))
    return chunked.select("chunk_id", "call_id", "customer_id", "file_name", "start_turn_index", "end_turn_index", F.concat(about, F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"))


def limit_chunks(chunked: DataFrame, n: int | None) -> DataFrame:
    """The first n chunks in order of call and start; 0 or None means all."""
    return chunked.orderBy("call_id", "start_turn_index").limit(n) if n else chunked


def number_turns(rows: DataFrame, call: str, order: str) -> DataFrame:
    """turn_index from 0 in each call."""
    return rows.withColumn("turn_index", (F.row_number().over(Window.partitionBy(call).orderBy(order)) - 1).cast("int"))

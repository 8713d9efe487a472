"""Transcript files: listing, WebVTT, plain text, Markdown and DOCX, metadata and earlier outputs.

Files are read by Spark's own readers, so any store that Spark knows will do. A file that can't
be parsed gives an error row instead of failing the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

from ..config import DEFAULT, Config
from ..functions import text as tx
from ..operators.calls import merge_nearby, number_turns
from ..schemas import METADATA, conform, empty

EXTENSIONS = ("vtt", "txt", "md", "docx")
#: Files that stand next to transcripts but are none, as a pattern on the lower-case name.
NOT_TRANSCRIPTS = r"^(?:requirements.*|readme\.md|license\.md)$"
SPEAKER_LINE = r"^([A-Z][A-Za-z .,'\-]{1,60}):\s*(.*)$"
UNKNOWN = "Unknown"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, project: str, not_transcripts: str = NOT_TRANSCRIPTS) -> DataFrame:
    """path, file_name, extension of the transcripts in the project's folder and in its `transcripts` folder, not deeper."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(project).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [p for p in (project, f"{project}/transcripts") if fs.exists(fs_path(p))]
    # names of one project's files; contents stay unread
    found = [(str(f.getPath()),) for p in folders for f in fs.listStatus(fs_path(p)) if f.isFile()]
    name = F.element_at(F.split("path", "/"), -1)
    named = spark.createDataFrame(found, "path string").select("path", name.alias("file_name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("extension"))
    return named.filter(F.col("extension").isin(*EXTENSIONS) & ~F.lower("file_name").rlike(not_transcripts)).distinct().orderBy("path")


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_name, raw: whole text files."""
    raw = spark.read.text(paths, wholetext=True)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace(F.col("value"), "\r\n?", "\n").alias("raw"))


def parse_vtt(files: DataFrame, config: Config = DEFAULT, merge: bool = True) -> DataFrame:
    """Turns of WebVTT texts (file_name, raw).

    Blocks are parted by blank lines; headers and notes are skipped; in a block, the first line
    with an arrow has the times and what follows is the text. Voice spans give a turn each, with
    the cue's times, and drop what stands outside them; without any the speaker is Unknown.
    """
    blocks = files.select("file_name", F.posexplode(F.split(F.regexp_replace("raw", "^﻿", ""), r"\n\s*\n")).alias("b", "block"))
    blocks = blocks.withColumn("block", F.trim(F.regexp_replace("block", r"^\s+", ""))).filter(~F.col("block").rlike("^(?:WEBVTT|NOTE)"))
    stamp = r"((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"
    arrow = rf"(?m)^.*?{stamp}\s*-->\s*{stamp}"
    cues = blocks.filter(F.col("block").rlike(arrow)).select(
        "file_name",
        "b",
        tx.time_to_seconds(F.regexp_extract("block", arrow, 1)).alias("start"),
        tx.time_to_seconds(F.regexp_extract("block", arrow, 2)).alias("end"),
        F.regexp_extract("block", rf"(?s)^.*?{stamp}\s*-->\s*{stamp}[^\n]*\n?(.*)$", 3).alias("body"),
    )
    voice = r"(?s)<v(?:\.[^\s>]*)?\s+([^>]+)>(.*?)(?:</v>|(?=<v[\s.])|$)"
    names = F.regexp_extract_all("body", F.lit(voice), F.lit(1))
    texts = F.regexp_extract_all("body", F.lit(voice), F.lit(2))
    spans = F.when(F.size(names) > 0, F.arrays_zip(names.alias("speaker"), texts.alias("text"))).otherwise(F.array(F.struct(F.lit(UNKNOWN).alias("speaker"), F.col("body").alias("text"))))
    rows = cues.select("file_name", "b", "start", "end", F.posexplode(spans).alias("s", "x"))
    rows = rows.select("file_name", "start", "end", F.trim("x.speaker").alias("speaker"), tx.clean_text(F.col("x.text")).alias("text"), F.struct("b", "s").alias("_at")).filter("text <> ''")
    turns = number_turns(rows, "file_name", "_at").drop("_at")
    if not merge:
        return turns
    return merge_nearby(turns.withColumn("call_id", F.col("file_name")), config).drop("call_id")


def parse_text(files: DataFrame) -> DataFrame:
    """Turns of plain or Markdown texts (file_name, raw): a line `Name: words` starts a turn, other lines go on with it.

    Names have no digits. What comes before the first name is Unknown's. Times are the turn's index.
    """
    lines = files.select("file_name", F.posexplode(F.split("raw", "\n")).alias("i", "line")).withColumn("line", tx.strip(F.col("line")))
    lines = lines.filter("line <> ''").withColumn("name", F.regexp_extract("line", SPEAKER_LINE, 1))
    w = Window.partitionBy("file_name").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"g": F.sum(F.when(F.col("name") != "", 1).otherwise(0)).over(w), "said": F.when(F.col("name") != "", F.regexp_extract("line", SPEAKER_LINE, 2)).otherwise(F.col("line"))})
    groups = lines.groupBy("file_name", "g").agg(F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("i", "said"))).alias("l"))
    joined = tx.clean_text(F.array_join(F.transform("l", lambda x: x["said"]), " "))
    rows = groups.select("file_name", "g", F.when(F.col("name") == "", UNKNOWN).otherwise(F.trim("name")).alias("speaker"), joined.alias("text")).filter("text <> ''")
    turns = number_turns(rows, "file_name", "g")
    index = F.col("turn_index").cast("double")
    return turns.select("file_name", index.alias("start"), index.alias("end"), "speaker", "text", "turn_index")


def _docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
        if (t := "".join(parts)).strip():
            found.append(t)
    return "\n".join(found)


def read_docx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_name, raw, error: the non-blank paragraphs of each document, a line each."""
    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for name, content in zip(pdf["file_name"], pdf["content"], strict=True):
                try:
                    out.append((name, _docx_text(content), None))
                except Exception as e:  # a broken file is a row, not a failed job
                    out.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["file_name", "raw", "error"])

    return files.mapInPandas(run, "file_name string, raw string, error string")


def read_turns(spark: SparkSession, project: str, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Turns (file_name, start, end, speaker, text, turn_index) of all transcripts, and errors (file_name, error)."""
    listed: dict[str, list[str]] = {}
    for r in list_files(spark, project).collect():  # file names of one project
        listed.setdefault(r["extension"], []).append(r["path"])
    parts, errors = [], empty(spark, "file_name string, error string")
    if listed.get("vtt"):
        parts.append(parse_vtt(read_texts(spark, listed["vtt"]), config))
    if plain := listed.get("txt", []) + listed.get("md", []):
        parts.append(parse_text(read_texts(spark, plain)))
    if listed.get("docx"):
        docs = read_docx(spark, listed["docx"])
        parts.append(parse_text(docs.filter("error is null").select("file_name", "raw")))
        errors = docs.filter("error is not null").select("file_name", "error")
    names = ["file_name", "start", "end", "speaker", "text", "turn_index"]
    if not parts:
        return empty(spark, "file_name string, start double, end double, speaker string, text string, turn_index int"), errors
    out = parts[0].select(*names)
    for p in parts[1:]:
        out = out.unionByName(p.select(*names))
    return out, errors


def speakers(turns: DataFrame) -> DataFrame:
    """file_name, speaker: everyone who is named."""
    return turns.filter((F.col("speaker") != "") & (F.col("speaker") != UNKNOWN)).select("file_name", "speaker").distinct().orderBy("file_name", "speaker")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata table; nulls are empty text."""
    return spark.read.schema(METADATA).option("escape", '"').csv(path, header=True).na.fill("")


def read_saved(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that an earlier run wrote as Parquet, else a CSV file of that name with a header (of this or another program); an empty one of the schema if there is neither.

    In CSV, lists of text are JSON arrays or parted by semicolons, and empty text is no null.
    """
    if _exists(spark, path):
        return conform(spark.read.parquet(path), schema)
    if not _exists(spark, f"{path}.csv"):
        return empty(spark, schema)
    raw = spark.read.option("escape", '"').option("multiLine", True).csv(f"{path}.csv", header=True)
    of = lambda kind: [f.name for f in StructType.fromDDL(schema) if isinstance(f.dataType, kind) and f.name in raw.columns]
    parsed = {c: tx.parse_roles(F.col(c)) for c in of(ArrayType)} | {c: tx.safe_bool(F.col(c)) for c in of(BooleanType)}
    return conform(raw.na.fill("").withColumns(parsed), schema)


def find_outputs(spark: SparkSession, project: str, given: str | None = None) -> str | None:
    """The folder of an earlier run: the given one, else `outputs`, else the newest `outputs_big_run_*`, else the newest `outputs_*`; it must hold turns or findings."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(project)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = lambda glob: [str(s.getPath()) for s in sorted(fs.globStatus(fs_path(f"{project}/{glob}")) or [], key=lambda s: -s.getModificationTime())]
    for p in [given] if given else [f"{project}/outputs", *newest("outputs_big_run_*"), *newest("outputs_*")]:
        if any(fs.exists(fs_path(f"{p}/{t}{end}")) for t in ("parsed_turns", "extracted_findings") for end in ("", ".csv")):
            return p
    return None


#: A plug-in that redacts texts: a list of texts to a list of texts. It is built once per task.
Redactor = Callable[[list[str]], list[str]]


def redact_with(turns: DataFrame, make: Callable[[], Redactor] | None, column: str = "text") -> DataFrame:
    """Redact by a plug-in, then by the built-in patterns; a plug-in that can't be built or fails leaves the patterns."""
    if make is not None:

        def run(it):
            try:
                plug = make()
            except Exception:
                plug = None
            for pdf in it:
                if plug is not None:
                    try:
                        pdf[column] = plug(pdf[column].tolist())
                    except Exception:
                        plug = None
                yield pdf

        turns = turns.mapInPandas(run, turns.schema)
    return turns.withColumn(column, tx.redact(F.col(column)))


def metadata_template(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A metadata row per file: named speakers, those matching the interviewer pattern apart."""
    named = speakers(turns).groupBy("file_name").agg(F.array_sort(F.collect_set("speaker")).alias("s"))
    likely = F.filter("s", lambda x: x.rlike(config.interviewer_pattern)) if config.interviewer_pattern else F.expr("cast(array() as array<string>)")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    rows = named.select("file_name", stem.alias("call_id"), stem.alias("customer_id"), F.array_join(F.array_except("s", likely), "; ").alias("customer_speakers"), F.array_join(likely, "; ").alias("interviewer_speakers"))
    return conform(rows, METADATA).na.fill("")

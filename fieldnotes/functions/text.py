"""Scalar text, time and logic functions, Column to Column."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..config import DEFAULT, FlagRule

#: A token: an ASCII letter, then ASCII letters, digits or apostrophes, between word borders.
TOKEN = r"\b[A-Za-z][A-Za-z0-9']*\b"
#: White space of any script, and the four separators of ASCII.
SPACES = r"(?U)[\s\x1C-\x1F]+"
#: A character reference of HTML, by number or name, with or without its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _decoded(found: pd.Series) -> pd.Series:
    return found.map(lambda x: None if x is None else [html.unescape(r) for r in x])


def unescape(c: Column) -> Column:
    """Decode every character reference of HTML, none twice. Only the references themselves go to Python, whose table of names is complete."""
    between = F.split(c, REFERENCE, -1)
    decoded = _decoded(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)))
    return F.array_join(F.zip_with(between, decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def clean_text(c: Column) -> Column:
    """References decoded, tags and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(c), "<[^>]+>", " "), SPACES, " "))


def normalize_label(c: Column) -> Column:
    """Lower case; only a-z, digits, spaces and hyphens; edges are trimmed before symbols go, so a space next to one can stay."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"(?U)[^a-z0-9\s-]", ""), SPACES, " ")


def normalize_for_matching(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), SPACES, " "))


def split_semicolons(c: Column) -> Column:
    """Trimmed, non-empty parts; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip), lambda x: x != "")


def tokens(c: Column, stopwords: Sequence[str] | None = DEFAULT.stopwords) -> Column:
    """Lower-case tokens of three characters or more that aren't stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else None
    return F.filter(found, lambda x: (F.length(x) >= 3) & (~F.array_contains(stop, x) if stop is not None else F.lit(True)))


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN)).cast("long")


def ngrams(tokens_: Column, n: int) -> Column:
    """Space-joined runs of n tokens; none if there are fewer."""
    if n == 1:
        return tokens_
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens_) - (n - 1)), lambda i: F.array_join(F.slice(tokens_, i, n), " "))
    return F.when(F.size(tokens_) >= n, runs).otherwise(F.expr("cast(array() as array<string>)"))


def quote_pattern(c: Column) -> Column:
    """A regular expression's special characters escaped."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def term_pattern(c: Column) -> Column:
    """Whole words of any script, any white space between them, any case."""
    return F.concat(F.lit(r"(?iU)\b"), F.array_join(F.transform(F.split(F.trim(c), r"\s+"), quote_pattern), r"\s+"), F.lit(r"\b"))


#: Redaction classes in their order, which matters; letters count in either case.
REDACTIONS = (
    ("[SSN]", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("[EMAIL]", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("[PHONE]", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("[RECORD_ID]", r"(?i)\b(?:MRN|medical record|record number|account number)\s*[:#]?\s*[A-Z0-9-]+\b"),
    ("[ROOM]", r"(?i)\b(?:room|rm)\s*#?\s*[A-Z]?\d{1,4}[A-Z]?\b"),
    ("[DATE]", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    ("[DATE]", r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}\b"),
    ("[ZIP]", r"\b\d{5}-\d{4}\b"),
)


def redact(c: Column) -> Column:
    for label, pattern in REDACTIONS:
        c = F.regexp_replace(c, pattern, label)
    return c


def interviewer_flags(c: Column, rules: Sequence[FlagRule] = DEFAULT.flag_rules, most: int = 5) -> Column:
    """struct(leading_score int, why_flagged string): the weights of the rules that match, at most `most`, and their reasons."""
    asks = c.contains("?")
    hits = [F.coalesce(c.rlike(r.pattern) & (asks if r.question else F.lit(True)), F.lit(False)) for r in rules]
    score = sum((F.when(h, r.weight).otherwise(0) for h, r in zip(hits, rules, strict=True)), F.lit(0))
    reasons = F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(r.reason)) for h, r in zip(hits, rules, strict=True)])), "; ") if rules else F.lit("")
    return F.struct(F.least(F.lit(most), score).cast("int").alias("leading_score"), reasons.alias("why_flagged"))


def time_to_seconds(c: Column) -> Column:
    """HH:MM:SS.mmm or MM:SS.mmm, comma or point; anything else is 0."""
    parts = F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    seconds = F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(parts) == 2, at(0) * 60 + at(1))
    return F.coalesce(seconds, F.lit(0.0))


def seconds_to_stamp(c: Column) -> Column:
    """HH:MM:SS of whole seconds; negative is 0."""
    s = F.floor(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def is_nonempty(c: Column, empty_words: Sequence[str] = DEFAULT.empty_words) -> Column:
    return c.isNotNull() & ~F.lower(strip(c)).isin(*empty_words)


def safe_bool(c: Column) -> Column:
    """True for true, 1, yes, y in any case and type; else false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "y"), F.lit(False))


def format_turn(start: Column, end: Column, role: Column, speaker: Column, text: Column, redacted: bool = True) -> Column:
    """[HH:MM:SS-HH:MM:SS] ROLE | speaker: text"""
    return F.format_string("[%s-%s] %s | %s: %s", seconds_to_stamp(start), seconds_to_stamp(end), F.upper(role), speaker, redact(text) if redacted else text)


def parse_roles(c: Column) -> Column:
    """Roles as a JSON array of strings, or else as a list with semicolons."""
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), split_semicolons(c))


def json_object(c: Column) -> Column:
    """The text of a reply's JSON object: all of it if it is one, else from the first `{` to the last `}`; null if there is none."""
    trimmed = F.trim(c)
    found = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), trimmed).when(found != "", found)

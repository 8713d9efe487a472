"""Host-level quality rules, in DataFrame functions only.

Each document is measured by rules of its own text. The failures are counted by host
(`source`), each host's failure rate is shrunk with a beta prior whose parameters come from
the rates of all hosts (method of moments), and hosts whose shrunk rate of any rule passes
`host_limit` are rejected as a whole; the verdict is joined back to the documents.

Defined cases: a null text counts as empty (no words, base_failed); null hosts are one host
of their own; repeated rows and rows without a key are judged each; an empty table gives an
empty result; in `judge` a column named like an added one is replaced, `passing` returns all
columns as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WS_CHARS, WS_CLASS, let, packed, save, unpacked, without, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
RULES = ("few_words", "repeats", "symbols", "dup_lines")
#: A shrunk failure rate above it rejects the host.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)


def _chars_of(text: Column, chars: str) -> Column:
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest)).cast("long")


def _repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words covered by a window whose words occur twice or more; hashes pick the windows whose words are compared."""

    def twins(s: Column, field: str) -> Column:
        same = lambda x, j, d: F.coalesce(F.get(s, j + d)[field] == x[field], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j, -1) | same(x, j, 1))

    def compared(s: Column) -> Column:
        with_words = F.transform(twins(s, "h"), lambda x: F.struct(x["h"].alias("h"), F.slice(tokens, x["i"] + 1, window).alias("w"), x["i"].alias("i")))
        return let(F.sort_array(with_words), covered)

    def covered(s: Column) -> Column:
        starts = F.sort_array(F.transform(twins(s, "w"), lambda x: x["i"]))
        return let(
            starts,
            lambda d: F.aggregate(
                F.transform(d, lambda p, j: F.when(F.get(d, j + 1).isNull(), F.lit(window)).otherwise(F.least(F.lit(window), F.get(d, j + 1) - p)).cast("long")),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, compared))

    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window)))
    return F.when(F.size(tokens) < window, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and rule_<name>."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]"))
    m = let(
        words(F.col(text)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    out = without(docs, "_m", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", *(f"rule_{r}" for r in RULES))
    out = out.withColumns(
        {
            "_m": m,
            "word_chars": F.length(t).cast("long") - _chars_of(t, WS_CHARS),
            "n_symbols": _chars_of(t, SYMBOLS),
            "_l": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))),
        }
    )
    out = out.withColumns({"n_words": F.col("_m.n_words"), "n_repeat_words": F.col("_m.n_repeat_words"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.d")}).drop("_m", "_l")
    few, rep = F.col("n_words") < 20, 100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    return out.withColumns(
        {
            "base_failed": few | rep,
            "rule_few_words": few,
            "rule_repeats": rep,
            "rule_symbols": 10 * F.col("n_symbols") > F.col("n_words"),
            "rule_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        }
    )


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, host_kept.

    A rate's prior is Beta(m*k, (1-m)*k): m and v are mean and variance of the hosts' rates,
    k = m(1-m)/v - 1 within PRIOR_WEIGHT (its upper bound if all rates are equal).
    """
    n = F.count(F.lit(1)).cast("double")
    hosts = measured.groupBy(F.col(host).alias("host")).agg(n.alias("n_docs"), *[F.sum(F.col(f"rule_{r}").cast("double")).alias(f"f_{r}") for r in RULES])
    rate = lambda r: F.col(f"f_{r}") / F.col("n_docs")
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(rate(r)).alias(f"m_{r}"), F.coalesce(F.var_pop(rate(r)), F.lit(0.0)).alias(f"v_{r}"))])
    low, high = PRIOR_WEIGHT

    def shrunk(r: str) -> Column:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        k = F.when(v <= 1e-12, F.lit(high)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), m * (1 - m) / F.greatest(v, F.lit(1e-12)) - 1)))
        return (F.col(f"f_{r}") + m * k) / (F.col("n_docs") + k)

    joined = hosts.join(F.broadcast(prior))  # one row
    out = joined.select("host", "n_docs", *[shrunk(r).alias(f"rate_{r}") for r in RULES])
    return out.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= limit)


def _judged(docs: DataFrame, host: str, text: str, limit: float, carry: list[str]) -> DataFrame:
    """row (the carried columns, packed), the measures, host_kept and kept."""
    rows = docs.select(packed(carry).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    measured = save(measure(rows).drop("text"))
    hosts = save(host_verdicts(measured, "host", limit).select(F.col("host").alias("_host"), "host_kept"))
    out = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host", "host")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True)))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """The columns of carry (all, if None), the measures, host_kept and kept; a carried column named like an added one is replaced."""
    carry = docs.columns if carry is None else carry
    judged = _judged(docs, host, text, limit, carry)
    added = [c for c in judged.columns if c != "row" and not c.startswith("rule_")]
    held = [(i, c) for i, c in enumerate(carry) if c.lower() not in added]
    return judged.select(*[F.col(f"row.c{i}").alias(c) for i, c in held], *added)


def passing(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that are kept, with their own columns, whatever those are named."""
    return _judged(docs, host, text, limit, docs.columns).filter("kept").select(*unpacked("row", docs.columns))

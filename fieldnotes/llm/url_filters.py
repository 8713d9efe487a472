"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

Labelled urls become transactions of tokens plus a label item. Tokens that are too rare for a
rule go first, and of tokens that occur in just the same urls one stays. FP-growth mines the
frequent item sets; rules `tokens -> label:block` stay if their support, confidence and lift pass, and
if no part of their tokens has a rule as confident. Rules are matched by an inverted index:
each is listed under its rarest token, so a url meets only rules whose rarest token it has.

Hand-written host/path rules come first: the longest fitting one wins over the mined verdict.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is
judged by its (empty) tokens, so it is allowed; without labelled urls no rules are mined and
every verdict of the method is allow, and so with fewer than min_rows; repeated rows and rows
without a key are judged each; columns of pages named like an added one are replaced; rules of
more than max_tokens tokens are not used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import save, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.002
    #: Labelled urls that a rule rests on at least, whatever their share.
    min_rows: int = 20
    min_confidence: float = 0.6
    min_lift: float = 1.5
    #: Tokens in a rule's left side.
    max_tokens: int = 4


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, the host's last two labels, path parts without digits, names of query parameters."""
    parts = lambda prefix, c, sep: F.transform(F.filter(F.split(c, sep), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    one = lambda prefix, c: F.when(c != "", F.array(F.concat(F.lit(prefix), c))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(one("s:", scheme), parts("h:", host, "[.]"), one("d:", domain), parts("p:", path, "[/.]"), names))


def _without_twins(rows: DataFrame, least: int) -> DataFrame:
    """rows (id, tokens, blocked) with frequent tokens only, and one of those that occur in just the same rows.

    Such tokens are interchangeable in every rule, but n of them would make 2^n item sets.
    """
    each = rows.select("id", F.explode("tokens").alias("token"))
    where = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter(F.col("n") >= least)
    chosen = where.groupBy("n", "x", "y").agg(F.min("token").alias("token"))
    few = each.join(chosen.select("token"), "token").groupBy("id").agg(F.collect_list("token").alias("tokens"))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("id", "blocked").join(few, "id", "left").select("blocked", F.coalesce("tokens", none).alias("tokens"))


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """labelled: tokens array<string>, blocked boolean. Rules: rule_tokens, confidence, support, key (the rarest token)."""
    rows = save(labelled.filter("tokens is not null and blocked is not null and size(tokens) > 0").select("tokens", "blocked").withColumn("id", F.monotonically_increasing_id()))
    schema = "rule_tokens array<string>, confidence double, support double, key string"
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    support = max(how.min_support, how.min_rows / total)
    if support > 1:
        return rows.sparkSession.createDataFrame([], schema)
    rows = save(_without_twins(rows, math.ceil(support * total)).select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=how.min_confidence).fit(rows)
    rules = model.associationRules.filter((F.get("consequent", F.lit(0)) == BLOCK) & (F.size("antecedent") <= how.max_tokens) & (F.col("lift") >= how.min_lift))
    rules = save(rules.select(F.sort_array("antecedent").alias("rule_tokens"), "confidence", "support"))
    seen = save(model.freqItemsets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), "freq"))
    each = rules.select("rule_tokens", "confidence", "support", F.explode("rule_tokens").alias("token")).join(seen, "token")
    keyed = save(each.groupBy("rule_tokens", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("key")))
    # a rule is needless if part of its tokens, which then holds or lacks the key, is as confident
    part = keyed.select(F.col("rule_tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.col("key").alias("token"))
    worse = (
        keyed.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("token"))
        .join(part, "token")
        .filter((F.size("part") < F.size("rule_tokens")) & (F.size(F.array_except("part", "rule_tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
        .select("rule_tokens")
        .distinct()
    )
    return save(keyed.join(worse, "rule_tokens", "left_anti").select("rule_tokens", "confidence", "support", "key"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: url, tokens (one row per url). The urls that any rule fits, with the best rule's tokens and confidence."""
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    fits = looked_up.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = fits.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule_tokens")).alias("b"))
    return best.select("url", F.col("b.confidence").alias("confidence"), F.col("b.rule_tokens").alias("mined_rule"))


def hand_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """rules: (verdict, rule string host/path...). The struct (rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # later ones are outermost, so the longest wins
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, hand_rules: list[tuple[str, str]], how: Mining = Mining()) -> DataFrame:
    """Add host, path, rule, verdict, mined_verdict, mined_rule and mined_confidence to pages (url). labelled: url, blocked boolean."""
    parsed = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rules = mine(parsed(labelled.select("url", "blocked")).select(tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "blocked"), how)
    urls = parsed(pages.select("url").filter("url is not null").distinct()).select("url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    matched = save(match(urls, rules)).select(F.col("url").alias("_url"), F.col("confidence").alias("mined_confidence"), "mined_rule")
    base = parsed(without(pages, "host", "path", "rule", "verdict", "mined_verdict", "mined_rule", "mined_confidence", "_url", "_hand"))
    out = base.join(matched, F.col("url") == F.col("_url"), "left").drop("_url")
    mined = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumns({"_hand": hand_rule(F.col("host"), F.col("path"), hand_rules), "mined_verdict": mined})
    return out.withColumns({"rule": F.col("_hand.rule"), "verdict": F.coalesce(F.col("_hand.verdict"), F.col("mined_verdict"))}).drop("_hand")

"""What speakers say: term frequencies, role contrast, lexicon counts, who brought a term in."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config, Pattern
from ..functions import stats as st
from ..functions import text as tx
from .themes import with_size


def of_role(turns: DataFrame, role: str) -> DataFrame:
    """Role filter, in any case."""
    return turns.filter(F.lower(F.trim(F.col("speaker_role"))) == role.lower())


def customer_tokens(turns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """customer_id, tokens: a customer's filtered tokens over all turns, in order of call and turn, so phrases can cross turns."""
    texts = turns.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "turn_index", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return texts.select("customer_id", tx.tokens(joined, config.stopwords).alias("tokens"))


def term_frequencies(turns: DataFrame, customers: DataFrame, role: str = "customer", n: int = 1, top: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """The most frequent terms of n words that a role says twice or more.

    Rates are per thousand single tokens of the role; prevalence is over all customers.
    """
    top = config.top_terms if top is None else top
    own = of_role(turns, role)
    # single words need no more than their turn; longer terms can cross turns
    toks = own.select("customer_id", tx.tokens(F.col("text"), config.stopwords).alias("tokens")) if n == 1 else customer_tokens(own, config)
    total = toks.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("_total"))
    terms = toks.select("customer_id", F.explode(tx.ngrams(F.col("tokens"), n)).alias("term"))
    per = terms.groupBy("term", "customer_id").agg(F.count(F.lit(1)).alias("c"))
    counts = per.groupBy("term").agg(F.sum("c").alias("total_count"), F.count(F.lit(1)).alias("unique_customer_count")).filter("total_count >= 2")
    best = counts.orderBy(F.desc("total_count"), "term").limit(top)
    best = with_size(best, customers).join(F.broadcast(total))
    low, high = st.wilson(F.col("unique_customer_count"), F.col("_n"))
    return best.select(
        "term",
        F.lit(n).alias("ngram_n"),
        F.lit(role).alias("role"),
        "total_count",
        "unique_customer_count",
        F.round(st.ratio(F.col("unique_customer_count"), F.col("_n")), 4).alias("customer_prevalence"),
        F.round(low, 4).alias("prevalence_ci_low"),
        F.round(high, 4).alias("prevalence_ci_high"),
        F.round(st.ratio(F.col("total_count") * 1000, F.col("_total")), 3).alias("count_per_1k_role_words"),
    ).orderBy(F.desc("total_count"), "term")


def phrase_frequencies(turns: DataFrame, customers: DataFrame, role: str = "customer", top: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Two- and three-word terms together."""
    return term_frequencies(turns, customers, role, 2, top, config).unionByName(term_frequencies(turns, customers, role, 3, top, config))


def role_contrast(turns: DataFrame, top: int = 200, config: Config = DEFAULT) -> DataFrame:
    """Terms by smoothed log-odds of customers against interviewers; those said less than three times in all are left out after smoothing."""
    rows = turns.withColumn("r", F.lower(F.trim(F.col("speaker_role")))).filter(F.col("r").isin("customer", "interviewer"))
    terms = rows.select("r", F.explode(tx.tokens(F.col("text"), config.stopwords)).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("r") == "customer").alias("customer_count"), F.count_if(F.col("r") == "interviewer").alias("interviewer_count"))
    whole = counts.agg(F.coalesce(F.sum("customer_count"), F.lit(0)).alias("tc"), F.coalesce(F.sum("interviewer_count"), F.lit(0)).alias("ti"), F.count(F.lit(1)).alias("v"))
    t = counts.join(F.broadcast(whole))  # one row
    rate = lambda c, n: (F.col(c) + 0.5) / (F.col(n) + 0.5 * F.col("v"))
    odds = F.when((F.col("tc") > 0) & (F.col("ti") > 0), F.log(rate("customer_count", "tc") / rate("interviewer_count", "ti"))).otherwise(F.lit(0.0))
    t = t.filter(F.col("customer_count") + F.col("interviewer_count") >= 3).withColumn("_odds", odds)
    return (
        t.select(
            "term",
            "customer_count",
            "interviewer_count",
            F.round(st.ratio(F.col("customer_count") * 1000, F.col("tc")), 3).alias("customer_per_1k_words"),
            F.round(st.ratio(F.col("interviewer_count") * 1000, F.col("ti")), 3).alias("interviewer_per_1k_words"),
            F.round("_odds", 4).alias("log_odds_customer_vs_interviewer"),
            F.when(F.col("_odds") > 0, "customer").otherwise("interviewer").alias("more_characteristic_of"),
        )
        .orderBy(F.desc(F.abs("log_odds_customer_vs_interviewer")), "term")
        .limit(top)
    )


def entry_pattern(entry: str | Pattern) -> str:
    """A lexicon entry as a regular expression: a pattern as it is, plain words as whole words with any white space between them; in any case."""
    if isinstance(entry, Pattern):
        return f"(?iU){entry.regex}"
    return r"(?iU)\b" + r"\s+".join(re.escape(w) for w in entry.split()) + r"\b"


def entry_term(entry: str | Pattern) -> str:
    """The plain words of a lexicon entry, in lower case: of a pattern, what is left without optional parts, with the first of alternatives."""
    if not isinstance(entry, Pattern):
        return " ".join(entry.lower().split())
    t = re.sub(r"\\[bB]|[\^$]", "", entry.regex)
    t = re.sub(r"\\s[+*?]?|\[[^\]]*\\s[^\]]*\][+*?]?", " ", t)
    while (less := re.sub(r"\((?:\?:)?[^()]*\)[?*]", "", t)) != t:
        t = less
    while (less := re.sub(r"\((?:\?:)?([^()|]*)[^()]*\)", r"\1", t)) != t:
        t = less
    t = re.sub(r".[?*]", "", t)
    return " ".join(re.sub(r"[^\w' ]", " ", t).lower().split())


def lexicon_by_customer(turns: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """customer_id and one count per category: all matches of all its entries in the customer's own words; customers who say nothing have zeros.

    Matches don't span turns, so turns are counted one by one and added up before any shuffle.
    """
    own = of_role(turns, "customer")
    names = sorted(config.lexicon)
    text = F.coalesce("text", F.lit(""))
    of = lambda c: sum((F.regexp_count(text, F.lit(entry_pattern(e))) for e in config.lexicon[c]), F.lit(0))
    counts = own.select("customer_id", *[of(c).alias(c) for c in names])
    sums = counts.groupBy("customer_id").agg(*[F.sum(c).cast("long").alias(c) for c in names])
    return customers.select("customer_id").distinct().join(sums, "customer_id", "left").na.fill(0, names)


def lexicon_summary(turns: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per category: mentions, customers, prevalence with interval, mean, median and Gini coefficient over customers."""
    names = sorted(config.lexicon)
    long = lexicon_by_customer(turns, customers, config).unpivot(["customer_id"], names, "domain_category", "x")
    values = long.groupBy("domain_category", "x").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy("domain_category").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = values.withColumns({"upto": upto, "n": F.sum("m").over(Window.partitionBy("domain_category"))})
    ranks = F.col("m") * (2 * F.col("upto") - F.col("m") + 1) / 2
    at = lambda k: F.when((F.col("upto") >= k) & (F.col("upto") - F.col("m") < k), F.col("x"))
    g = v.groupBy("domain_category").agg(
        F.sum(F.col("x") * F.col("m")).alias("total_mentions"),
        F.sum(F.when(F.col("x") > 0, F.col("m")).otherwise(0)).alias("unique_customer_count"),
        F.first("n").alias("n"),
        F.sum(ranks * F.col("x")).cast("double").alias("r"),
        F.max(at(F.floor((F.col("n") + 1) / 2))).alias("a"),
        F.max(at(F.floor((F.col("n") + 2) / 2))).alias("b"),
    )
    low, high = st.wilson(F.col("unique_customer_count"), F.col("n"))
    n, s = F.col("n").cast("double"), F.col("total_mentions").cast("double")
    return g.select(
        "domain_category",
        "total_mentions",
        "unique_customer_count",
        F.round(st.ratio(F.col("unique_customer_count"), F.col("n")), 4).alias("prevalence"),
        F.round(low, 4).alias("prevalence_ci_low"),
        F.round(high, 4).alias("prevalence_ci_high"),
        F.round(s / n, 3).alias("mean_mentions_per_customer"),
        F.round((F.col("a") + F.col("b")).cast("double") / 2, 3).alias("median_mentions_per_customer"),
        F.round(F.when(s > 0, 2 * F.col("r") / (n * s) - (n + 1) / n).otherwise(0.0), 3).alias("mentions_gini"),
    ).orderBy(F.desc("unique_customer_count"), F.desc("total_mentions"), "domain_category")


def candidate_terms(phrases: DataFrame, words: DataFrame, lexicon: list[str] | tuple[str, ...] = (), top: int = 75, most: int | None = None) -> list[str]:
    """Phrases, then words, each by customers and count, then lexicon terms; each once, of three characters or more. At most `most` (bounded by the arguments)."""
    best = lambda df: [r["term"] for r in df.orderBy(F.desc("unique_customer_count"), F.desc("total_count"), "term").limit(top).select("term").collect()]
    found = dict.fromkeys(t.lower().strip() for t in [*best(phrases), *best(words), *lexicon])
    return [t for t in found if len(t) >= 3][: most or max(150, 2 * top)]


def _mentions(turns: DataFrame, terms: list[str]) -> DataFrame:
    """call_id, turn_index, role, speaker, term: turns in which a term occurs as whole words.

    An equal join of the runs of words of a turn with those of the terms picks the pairs that
    the whole-word pattern then confirms, so a turn costs its words, not the number of terms. A
    term without a letter or digit has none and is found nowhere.
    """
    spark = turns.sparkSession
    words = {t: re.findall(r"\w+", t.lower()) for t in terms}
    listed = spark.createDataFrame([(t, " ".join(w)) for t, w in words.items() if w], "term string, key string")
    text = tx.normalize_for_matching(F.coalesce("text", F.lit("")))
    base = turns.select("call_id", "turn_index", F.lower(F.trim(F.col("speaker_role"))).alias("role"), "speaker", text.alias("t")).withColumn("w", F.regexp_extract_all("t", F.lit(r"(?U)\w+"), F.lit(0)))
    sizes = sorted({len(w) for w in words.values() if w})
    runs = F.array_distinct(F.concat(*[tx.ngrams(F.col("w"), n) for n in sizes])) if sizes else F.expr("cast(array() as array<string>)")
    picked = base.select("call_id", "turn_index", "role", "speaker", "t", F.explode(runs).alias("key")).join(F.broadcast(listed), "key")  # the list of terms
    return picked.filter(matches(F.col("t"), F.col("term"))).drop("key", "t")


def term_introduction(turns: DataFrame, terms: list[str], config: Config = DEFAULT) -> DataFrame:
    """Per term: in how many calls it occurs, whose turn had it first, and how often a customer took it up after an interviewer.

    terms: a list from the caller, of bounded length.
    """
    del config
    m = _mentions(turns, terms)
    call = m.groupBy("term", "call_id").agg(
        F.min(F.struct("turn_index", "role", "speaker")).alias("f"),
        F.max(F.when(F.col("role") == "customer", F.struct("turn_index", "speaker"))).alias("c"),
    )
    first = F.col("f.role")
    injected = (first == "interviewer") & (F.col("c.turn_index") > F.col("f.turn_index"))
    example = F.concat(F.col("call_id"), F.lit(": "), F.col("f.speaker"), F.lit(" then "), F.col("c.speaker"))
    call = call.withColumns({"inj": F.coalesce(injected, F.lit(False)), "ex": F.when(injected, example)})
    ranked = call.withColumn("i", F.when(F.col("inj"), F.row_number().over(Window.partitionBy("term", "inj").orderBy("call_id"))))
    g = ranked.groupBy("term").agg(
        F.count(F.lit(1)).alias("calls_seen"),
        F.count_if(first == "customer").alias("customer_first_calls"),
        F.count_if(first == "interviewer").alias("interviewer_first_calls"),
        F.count_if("inj").alias("interviewer_first_then_customer_later_calls"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") <= 3, F.col("ex")))), " | ").alias("examples"),
    )
    n = F.col("calls_seen")
    rate = F.round(st.ratio(F.col("interviewer_first_then_customer_later_calls"), n), 4)
    out = g.select("term", n, "customer_first_calls", "interviewer_first_calls", "interviewer_first_then_customer_later_calls", rate.alias("possible_term_injection_rate"), F.round(st.ratio(F.col("customer_first_calls"), n), 4).alias("customer_origin_rate"), "examples")
    return out.orderBy(F.desc("possible_term_injection_rate"), F.desc("interviewer_first_then_customer_later_calls"), F.desc("calls_seen"), "term")


def matches(text: Column, term: Column) -> Column:
    """Whole-word, case-insensitive match of a term column; for single checks."""
    return F.regexp_like(text, tx.term_pattern(term))

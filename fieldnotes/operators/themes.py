"""Themes: summaries, prevalence statistics, co-occurrence, association tests, gaps, sample sizes, bootstrap intervals."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import stats as st
from ..functions import text as tx
from .findings import flags, within

THEME = "theme_cluster"
#: The classes of stated wishes against revealed problems, in the order they are asked for.
GAPS = (
    "validated revealed pain",
    "mostly stated or hypothetical; do not trust yet",
    "high contamination risk",
    "single-customer watchlist",
    "mixed evidence; needs targeted follow-up",
)


def _share(c: str) -> Column:
    return F.avg(F.col(c).cast("double"))


def _mode(c: str) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(c, True)


def size(customers: DataFrame) -> DataFrame:
    """One row: n, the number of customers."""
    return customers.agg(F.count_distinct("customer_id").alias("_n"))


def with_size(df: DataFrame, customers: DataFrame) -> DataFrame:
    return df.join(F.broadcast(size(customers)))  # one row


def mix(findings: DataFrame, column: str, out: str) -> DataFrame:
    """theme, `value:count` parts by falling count, then value."""
    counts = findings.groupBy(THEME, F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("v")))), lambda x: F.concat(x["v"], F.lit(":"), (-x["n"]).cast("string")))
    return counts.groupBy(THEME).agg(F.array_join(parts, "; ").alias(out))


def quotes(findings: DataFrame, k: int = 4, column: str = "customer_quote", out: str = "sample_customer_quotes") -> DataFrame:
    """theme, its k best distinct quotes by evidence, confidence and text, joined by ` || `.

    Distinct quotes are ranked in a window with a limit, so no theme's quotes meet in one row.
    """
    best = findings.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").groupBy(THEME, F.col(column).alias("q")).agg(F.max(F.struct("evidence_strength", "confidence")).alias("m"))
    w = Window.partitionBy(THEME).orderBy(F.desc("m.evidence_strength"), F.desc("m.confidence"), "q")
    top = best.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    return top.groupBy(THEME).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "q"))), lambda x: x["q"]), " || ").alias(out))


def first_distinct(findings: DataFrame, column: str, k: int | None, out: str, sep: str) -> DataFrame:
    """theme, the k smallest distinct values of a column; all of them if k is None."""
    top = findings.filter(F.col(column).isNotNull()).select(THEME, F.col(column).cast("string").alias("v")).distinct()
    if k is not None:
        top = top.withColumn("_i", F.row_number().over(Window.partitionBy(THEME).orderBy("v"))).filter(F.col("_i") <= k)
    return top.groupBy(THEME).agg(F.array_join(F.array_sort(F.collect_list("v")), sep).alias(out))


def summary(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per theme: counts, labels, means, samples, and all its customers' ids; most customers first."""
    f = findings.withColumn("_led", tx.safe_bool(F.col("leading_or_contaminated")))
    base = f.groupBy(THEME).agg(
        _mode("theme_label").alias("representative_theme_label"),
        _mode("domain_area").alias("domain_area"),
        F.count(F.lit(1)).alias("mention_count"),
        F.count_distinct("customer_id").alias("unique_customer_count"),
        *[F.round(F.avg(c), 2).alias(f"avg_{c}") for c in ("evidence_strength", "pain_severity", "urgency", "commercial_relevance")],
        F.round(_share("_led"), 2).alias("led_or_contaminated_share"),
    )
    base = with_size(base, customers).withColumn("widespread", st.widespread(F.col("unique_customer_count"), F.col("_n"))).drop("_n")
    parts = [
        mix(findings, "finding_type", "finding_type_mix"),
        mix(findings, "customer_origin", "origin_mix"),
        quotes(findings),
        first_distinct(findings, "one_sentence_description", 3, "top_descriptions", " || "),
        first_distinct(findings, "customer_id", None, "customer_ids", "; "),
    ]
    if "roles_affected" in findings.columns:
        parts.append(first_distinct(findings.select(THEME, F.explode("roles_affected").alias("role")), "role", None, "roles_affected", "; "))
    for p in parts:
        base = base.join(p, THEME, "left")
    return base.orderBy(F.desc("unique_customer_count"), F.desc("avg_evidence_strength"), F.desc("mention_count"), THEME)


def mention_distribution(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """Per theme over all customers, those without mentions included: mean, median, sample deviation and Gini coefficient of mentions.

    Zeros enter in closed form instead of by a join of all customers with all themes. Counts are
    grouped by value first, so a theme's rows are its distinct counts, not its customers.
    """
    per = findings.groupBy(THEME, "customer_id").agg(F.count(F.lit(1)).alias("x"))
    values = with_size(per.groupBy(THEME, "x").agg(F.count(F.lit(1)).alias("m")), customers)
    w = Window.partitionBy(THEME).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = F.sum("m").over(Window.partitionBy(THEME))
    v = values.withColumns({"upto": F.sum("m").over(w), "some": some}).withColumn("zeros", F.col("_n") - F.col("some"))
    # ranks of the customers with this count run from zeros + upto - m + 1 to zeros + upto
    ranks = F.col("m") * (2 * (F.col("zeros") + F.col("upto")) - F.col("m") + 1) / 2
    # the middle places of n sorted values, 1-based
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    at = lambda k: F.when((F.col("zeros") + F.col("upto") >= k) & (F.col("zeros") + F.col("upto") - F.col("m") < k), F.col("x"))
    agg = v.groupBy(THEME).agg(
        F.first("_n").alias("n"),
        F.sum(F.col("x") * F.col("m")).cast("double").alias("s"),
        F.sum(F.col("x") * F.col("x") * F.col("m")).cast("double").alias("q"),
        F.sum(ranks * F.col("x")).cast("double").alias("r"),
        F.coalesce(F.max(at(lo)), F.lit(0)).alias("a"),
        F.coalesce(F.max(at(hi)), F.lit(0)).alias("b"),
    )
    n, s, q = F.col("n").cast("double"), F.col("s"), F.col("q")
    mean = s / n
    return agg.select(
        THEME,
        F.round(mean, 3).alias("mentions_per_customer_mean"),
        F.round((F.col("a") + F.col("b")).cast("double") / 2, 3).alias("mentions_per_customer_median"),
        F.round(F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), q - n * mean * mean) / F.when(n > 1, n - 1))).otherwise(0.0), 3).alias("mentions_per_customer_sd"),
        F.round(F.when(s > 0, 2 * F.col("r") / (n * s) - (n + 1) / n).otherwise(0.0), 3).alias("mentions_gini"),
    )


MEANS = ("evidence_strength", "pain_severity", "urgency", "commercial_relevance")


def _by_customer(flagged: DataFrame, means: tuple[str, ...] = ()) -> DataFrame:
    """One row per theme and customer, from which a theme's counts and means follow without distinct counts over findings."""
    total = lambda c: F.sum(F.col(c).cast("double"))
    signals = ("clean_signal", "strong_signal", "stated_want_signal", "revealed_pain_signal")
    shares = ("leading_or_contaminated_bool", "has_workaround", "has_consequence")
    return flagged.groupBy(THEME, "customer_id").agg(
        F.count(F.lit(1)).alias("mentions"), *[F.bool_or(c).alias(c) for c in signals], *[total(c).alias(c) for c in (*means, *shares)], *[F.count(c).alias(f"n_{c}") for c in means]
    )


def _customers_with(c: str) -> Column:
    return F.count(F.when(F.col(c), F.col("customer_id")))


def _mean(c: str, n: str) -> Column:
    return F.sum(c) / F.sum(n)


def prevalence(findings: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per theme: prevalences with Wilson intervals, means, shares and the opportunity score."""
    f = flags(within(findings, customers), config)
    base = _by_customer(f, MEANS).groupBy(THEME).agg(
        F.count("customer_id").alias("customer_count"),
        _customers_with("clean_signal").alias("clean_customer_count"),
        _customers_with("strong_signal").alias("strong_customer_count"),
        F.sum("mentions").alias("mention_count"),
        *[_mean(c, f"n_{c}").alias(f"_{c}") for c in MEANS],
        _mean("leading_or_contaminated_bool", "mentions").alias("_led"),
        _mean("has_workaround", "mentions").alias("_work"),
        _mean("has_consequence", "mentions").alias("_cons"),
    )
    labels = f.groupBy(THEME).agg(_mode("theme_label").alias("representative_theme_label"), _mode("domain_area").alias("domain_area"))
    base = base.join(labels, THEME)
    base = with_size(base, customers)
    n = F.col("_n")
    low, high = st.wilson(F.col("customer_count"), n)
    clow, chigh = st.wilson(F.col("clean_customer_count"), n)
    prev, clean, strong = (st.ratio(F.col(c), n) for c in ("customer_count", "clean_customer_count", "strong_customer_count"))
    score = st.opportunity_score(prev, clean, strong, F.col("_pain_severity"), F.col("_evidence_strength"), F.col("_urgency"), F.col("_commercial_relevance"), F.col("_work"), F.col("_led"))
    return base.select(
        THEME,
        "representative_theme_label",
        "domain_area",
        "customer_count",
        "clean_customer_count",
        "strong_customer_count",
        "mention_count",
        F.round(prev, 4).alias("prevalence"),
        F.round(low, 4).alias("prevalence_ci_low"),
        F.round(high, 4).alias("prevalence_ci_high"),
        F.round(high - low, 4).alias("ci_width"),
        F.round(clean, 4).alias("clean_prevalence"),
        F.round(clow, 4).alias("clean_prevalence_ci_low"),
        F.round(chigh, 4).alias("clean_prevalence_ci_high"),
        F.round(strong, 4).alias("strong_prevalence"),
        *[F.round(f"_{c}", 3).alias(f"avg_{c}") for c in ("evidence_strength", "pain_severity", "urgency", "commercial_relevance")],
        F.round("_led", 3).alias("led_or_contaminated_share"),
        F.round("_work", 3).alias("workaround_share"),
        F.round("_cons", 3).alias("consequence_share"),
        score.alias("opportunity_score"),
    )


def statistics(findings: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """prevalence, with the distribution of mentions and samples of customers and quotes; best score first."""
    f = within(findings, customers)
    out = prevalence(findings, customers, config).join(mention_distribution(f, customers), THEME).join(first_distinct(f, "customer_id", 8, "sample_customer_ids", "; "), THEME, "left").join(quotes(f), THEME, "left")
    return out.orderBy(F.desc("opportunity_score"), F.desc("customer_count"), F.desc("avg_evidence_strength"), THEME)


def customer_rollup(findings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row per customer and theme: whether any mention is clean or strong, and means."""
    return (
        flags(findings, config)
        .groupBy("customer_id", THEME)
        .agg(
            F.bool_or("clean_signal").alias("any_clean"),
            F.bool_or("strong_signal").alias("any_strong"),
            *[F.avg(F.col(c).cast("double")).alias(a) for c, a in (("evidence_strength", "evidence"), ("pain_severity", "pain"), ("urgency", "urgency"), ("commercial_relevance", "commercial"))],
            _share("has_workaround").alias("workaround"),
            _share("leading_or_contaminated_bool").alias("led"),
        )
    )


def customer_matrix(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """customer_id, theme, present (0 or 1), dense. It has customers times themes rows by definition; the sparse form is customer_rollup."""
    here = within(findings, customers).select("customer_id", THEME).distinct().withColumn("present", F.lit(1))
    grid = customers.select("customer_id").distinct().crossJoin(findings.select(THEME).distinct())
    return grid.join(here, ["customer_id", THEME], "left").na.fill(0, ["present"])


def pairs(findings: DataFrame, by: str, out: str) -> DataFrame:
    """theme_a < theme_b and in how many calls or customers both occur."""
    d = findings.select(by, THEME).distinct()
    a, b = d.select(by, F.col(THEME).alias("theme_a")), d.select(by, F.col(THEME).alias("theme_b"))
    return a.join(b, by).filter("theme_a < theme_b").groupBy("theme_a", "theme_b").agg(F.count(F.lit(1)).alias(out))


def cooccurrence(findings: DataFrame) -> DataFrame:
    return pairs(findings, "call_id", "cooccurrence_count").orderBy(F.desc("cooccurrence_count"), "theme_a", "theme_b")


def association(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """Tests of every pair of themes that shares a customer: contingency table, four measures, Fisher's p and q."""
    f = within(findings, customers)
    marginal = f.groupBy(THEME).agg(F.count_distinct("customer_id").alias("c"))
    both = pairs(f, "customer_id", "n11_both")
    t = both.join(marginal.select(F.col(THEME).alias("theme_a"), F.col("c").alias("ca")), "theme_a").join(marginal.select(F.col(THEME).alias("theme_b"), F.col("c").alias("cb")), "theme_b")
    t = with_size(t, customers)
    n11 = F.col("n11_both")
    t = t.select(
        "theme_a",
        "theme_b",
        n11,
        (F.col("ca") - n11).alias("n10_a_only"),
        (F.col("cb") - n11).alias("n01_b_only"),
        (F.col("_n") - F.col("ca") - F.col("cb") + n11).alias("n00_neither"),
    )
    cells = [F.col(c) for c in ("n11_both", "n10_a_only", "n01_b_only", "n00_neither")]
    measures = st.association(*cells)
    t = t.withColumn("fisher_p_value", st.fisher_two_sided(*cells))
    t = t.withColumns({k: F.round(v, 4) for k, v in measures.items()})
    out = st.false_discovery(t, "fisher_p_value", "fisher_fdr_q_value")
    return out.orderBy(F.desc("n11_both"), F.desc("lift"), F.desc("phi"), "theme_a", "theme_b")


def want_gap(findings: DataFrame, theme_scores: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Stated wishes against revealed problems per theme, with a class and the ids of all customers on either side."""
    f = flags(within(findings, customers), config)
    g = _by_customer(f).groupBy(THEME).agg(
        F.count("customer_id").alias("all_customer_count"),
        _customers_with("stated_want_signal").alias("stated_want_customer_count"),
        _customers_with("revealed_pain_signal").alias("revealed_pain_customer_count"),
        _mean("leading_or_contaminated_bool", "mentions").alias("_led"),
    )
    g = g.join(f.groupBy(THEME).agg(_mode("theme_label").alias("representative_theme_label")), THEME)
    g = with_size(g, customers)
    s, r, led = F.col("stated_want_customer_count"), F.col("revealed_pain_customer_count"), F.col("_led")
    sp, rp = st.ratio(s, F.col("_n")), st.ratio(r, F.col("_n"))
    kind = (
        F.when((r >= 2) & (rp >= sp) & (led < 0.5), GAPS[0]).when((s > 0) & (r == 0), GAPS[1]).when(led >= 0.5, GAPS[2]).when(F.col("all_customer_count") <= 1, GAPS[3]).otherwise(GAPS[4])
    )
    out = g.select(
        THEME,
        "representative_theme_label",
        "all_customer_count",
        s,
        r,
        F.round(sp, 4).alias("stated_want_prevalence"),
        F.round(rp, 4).alias("revealed_pain_prevalence"),
        F.round(rp - sp, 4).alias("revealed_minus_stated_prevalence"),
        F.round(st.ratio(r, s, None), 3).alias("revealed_to_stated_ratio"),
        F.round(led, 3).alias("led_or_contaminated_share"),
        kind.alias("classification"),
    )
    for flag, name in (("stated_want_signal", "stated_customers"), ("revealed_pain_signal", "revealed_customers")):
        out = out.join(first_distinct(f.filter(flag), "customer_id", None, name, "; "), THEME, "left").withColumn(name, F.coalesce(name, F.lit("")))
    out = out.join(theme_scores.select(THEME, "opportunity_score"), THEME, "left").na.fill(0.0, ["opportunity_score"])
    return out.orderBy(F.desc("opportunity_score"), F.desc("revealed_pain_customer_count"), F.desc("all_customer_count"), THEME)


def sample_size(theme_statistics: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers needed for margins of 20, 15 and 10 points at each theme's rounded prevalence, and how many more than now."""
    p, n = F.col("prevalence"), F.col("_n")
    t = with_size(theme_statistics, customers)
    margins = {20: 0.20, 15: 0.15, 10: 0.10}
    out = t.select(
        THEME,
        "representative_theme_label",
        n.alias("current_customer_n"),
        p.alias("current_prevalence"),
        F.col("ci_width").alias("current_ci_width"),
        *[st.needed_sample(p, m).alias(f"target_n_for_plus_minus_{k}pp") for k, m in margins.items()],
        *[F.greatest(F.lit(0).cast("long"), st.needed_sample(p, m) - n).alias(f"additional_customers_for_plus_minus_{k}pp") for k, m in margins.items()],
    )
    return out.orderBy(F.desc("additional_customers_for_plus_minus_15pp"), THEME)


def role_counts(findings: DataFrame, roles: str = "roles_affected") -> DataFrame:
    """theme, role, mentions; findings without roles have none."""
    return findings.select(THEME, F.explode(roles).alias("role")).groupBy(THEME, "role").agg(F.count(F.lit(1)).alias("mention_count")).orderBy(F.desc("mention_count"), THEME, "role")


def role_pivot(findings: DataFrame, values: list[str], roles: str = "roles_affected") -> DataFrame:
    """One column per role named in values; naming them keeps the plan to one pass."""
    return findings.select(THEME, F.explode(roles).alias("role")).groupBy(THEME).pivot("role", values).count().na.fill(0)


def draws(customers: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, customer_id, weight: every repetition draws as many customers as there are, with replacement.

    A draw is the first 32 bits of md5(seed|rep|slot) modulo the number of customers in id order,
    so any engine can repeat it. All themes use the same draws.
    """
    ids = customers.select("customer_id").distinct()
    # places in id order: ids are counted by the characters after the beginning that all share,
    # and a group's place comes from the counts of those before it, so no task numbers all customers
    n, first, last = ids.agg(F.count("customer_id"), F.min("customer_id"), F.max("customer_id")).first()  # one row
    shared = len(os.path.commonprefix([first or "", last or ""]))
    part = ids.filter("customer_id is not null").withColumn("_g", F.substring("customer_id", shared + 1, 4))
    upto = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    before = part.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).select("_g", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_g").orderBy("customer_id"))
    numbered = part.withColumn("_local", local).join(before, "_g").select("customer_id", (F.col("_before") + F.col("_local") - 1).alias("_i"))
    each = customers.sparkSession.range(reps * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("slot"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    counted = each.groupBy("rep", pick.alias("_i")).agg(F.count(F.lit(1)).alias("weight"))
    return counted.join(numbered, "_i").select("rep", "customer_id", "weight")


def bootstrap(findings: DataFrame, customers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Percentile intervals of prevalence and opportunity score per theme, from resampled customers."""
    reps = config.bootstrap_reps
    rollup = customer_rollup(within(findings, customers), config)
    w = draws(customers, reps, config.bootstrap_seed)
    x = lambda c: F.sum(F.col(c).cast("double") * F.col("weight")).alias(c)
    sums = rollup.join(w, "customer_id").groupBy(THEME, "rep").agg(F.sum("weight").cast("double").alias("k"), *[x(c) for c in ("any_clean", "any_strong", "evidence", "pain", "urgency", "commercial", "workaround", "led")])
    spine = rollup.select(THEME).distinct().crossJoin(findings.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    t = with_size(spine.join(sums, [THEME, "rep"], "left"), customers)
    k, n = F.col("k"), F.col("_n")
    m = lambda c: F.col(c) / k
    score = st.opportunity_score(k / n, F.col("any_clean") / n, F.col("any_strong") / n, m("pain"), m("evidence"), m("urgency"), m("commercial"), m("workaround"), m("led"))
    t = t.select(THEME, F.coalesce(score, F.lit(0.0)).alias("s"), F.coalesce(k / n, F.lit(0.0)).alias("p"))
    q = lambda c, at: F.round(F.percentile(c, F.lit(at)), 7)
    out = t.groupBy(THEME).agg(
        F.lit(reps).alias("bootstrap_reps"),
        F.round(q("s", 0.5), 3).alias("opportunity_score_bootstrap_median"),
        F.round(q("s", 0.025), 3).alias("opportunity_score_ci_low"),
        F.round(q("s", 0.975), 3).alias("opportunity_score_ci_high"),
        F.round(q("p", 0.5), 4).alias("prevalence_bootstrap_median"),
        F.round(q("p", 0.025), 4).alias("prevalence_bootstrap_ci_low"),
        F.round(q("p", 0.975), 4).alias("prevalence_bootstrap_ci_high"),
    )
    return out.orderBy(F.desc("opportunity_score_bootstrap_median"), THEME)

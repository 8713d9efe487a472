"""Statistical functions, Column to Column, and two that need rows (Fisher's test, false discovery rates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LED_PENALTY, SCORE_WEIGHTS, Z


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom, or `otherwise` where bottom is not positive."""
    bottom = _d(bottom)
    return F.when(bottom > 0, _d(top) / F.when(bottom > 0, bottom)).otherwise(F.lit(otherwise).cast("double"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval of k out of n, within [0, 1]; (0, 0) without trials."""
    k, n = _d(k), _d(n)
    trials = F.when(n > 0, n)
    p = k / trials
    d = 1 + z * z / trials
    mid = (p + z * z / (2 * trials)) / d
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / d
    zero = F.lit(0.0)
    return F.when(n > 0, F.greatest(zero, mid - half)).otherwise(zero), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(zero)


def opportunity_score(prevalence, clean, strong, pain, evidence, urgency, commercial, workaround, led) -> Column:
    """0 to 100, two decimals: weighted prevalences and five-point means, less up to LED_PENALTY for led evidence."""
    w = SCORE_WEIGHTS
    total = (
        w["prevalence"] * _d(prevalence)
        + w["clean_prevalence"] * _d(clean)
        + w["strong_prevalence"] * _d(strong)
        + w["pain"] * (_d(pain) / 5)
        + w["evidence"] * (_d(evidence) / 5)
        + w["urgency"] * (_d(urgency) / 5)
        + w["commercial"] * (_d(commercial) / 5)
        + w["workaround"] * _d(workaround)
    )
    penalty = F.greatest(F.lit(0.0), 1 - LED_PENALTY * _d(led))
    # sums differ in their last digits by their order; the first rounding takes that away, so that a tie is a tie
    return F.round(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * total * penalty)), 9), 2)


def widespread(k: Column, n: Column) -> Column:
    """The three answers to how many of n customers k are."""
    return F.when(k <= 1, "1 customer").when((n > 0) & (k >= F.greatest(F.lit(2), F.ceil(_d(n) * 0.6))), "most").otherwise("several")


def association(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """Jaccard, lift, phi and Haldane's odds ratio of a two-by-two table."""
    a, b, c, d = map(_d, (n11, n10, n01, n00))
    n = a + b + c + d
    root = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return {
        "jaccard": ratio(a, a + b + c),
        "lift": ratio(a * n, (a + b) * (a + c)),
        "phi": F.when(root > 0, (a * d - b * c) / F.when(root > 0, root)).otherwise(0.0),
        "odds_ratio_haldane": (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)),
    }


def needed_sample(p: Column, margin: float, z: float = Z) -> Column:
    """Customers needed for a margin of error; a prevalence outside (0, 1) counts as one half."""
    p = F.when((p > 0) & (p < 1), p).otherwise(0.5)
    return F.ceil(z * z * p * (1 - p) / (margin * margin)).cast("long")


def fisher_two_sided(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Fisher's exact test: the probability of all tables with these margins that are no likelier than this one (ties within 1e-7).

    Neighbouring tables' probabilities have a simple ratio. So the sums walk up and down from
    the table itself, whose probability is their unit, and no factorial is needed.
    """
    r1, c1, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    low, high = F.greatest(F.lit(0).cast("long"), r1 + c1 - n), F.least(r1, c1)
    up = lambda x: (r1 - x).cast("double") * (c1 - x) / ((x + 1).cast("double") * (n - r1 - c1 + x + 1))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("less"), F.lit(0.0).alias("all"))

    def step(acc: Column, ratio: Column) -> Column:
        p = acc["p"] * ratio
        return F.struct(p.alias("p"), (acc["less"] + F.when(p <= 1 + 1e-7, p).otherwise(0.0)).alias("less"), (acc["all"] + p).alias("all"))

    none = F.expr("cast(array() as array<bigint>)")
    above = F.aggregate(F.when(high > n11, F.sequence(n11, high - 1)).otherwise(none), start, lambda acc, x: step(acc, up(x)))
    below = F.aggregate(F.when(low < n11, F.sequence(n11 - 1, low, F.lit(-1).cast("long"))).otherwise(none), start, lambda acc, x: step(acc, 1 / up(x)))
    whole = 1 + above["all"] + below["all"]
    return F.least(F.lit(1.0), (1 + above["less"] + below["less"]) / whole)


def false_discovery(df: DataFrame, p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg q-values of one family of tests, the table; a null p has a null q.

    A row's rank needs all smaller p-values, its q the least of those at larger ones. Distinct
    values are dealt into ranges (4096 equal ones, below them one per power of two); ranks and
    least values are found within each range and carried over the ranges, whose number is fixed.
    """
    value = F.col("_p")
    counts = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    tiny = F.when(value > 0, -F.least(F.ceil(-F.log2(F.when(value > 0, value))), F.lit(1100))).otherwise(F.lit(-1200))
    counts = counts.withColumn("_g", F.when(value >= 1 / 4096, F.floor(value * 4096)).otherwise(tiny).cast("int"))
    up, down = Window.partitionBy("_g").orderBy("_p"), Window.partitionBy("_g").orderBy(F.desc("_p"))
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_gn"))
    before = F.sum("_gn").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("_gn").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = counts.join(F.broadcast(groups.select("_g", F.coalesce(before, F.lit(0)).alias("_before"), total.alias("_m"))), "_g")  # a row per range
    rank = F.col("_before") + F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    raw = placed.select("_g", "_p", (value * F.col("_m") / rank).alias("_raw"))
    later = F.min("_least").over(Window.orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, -1))
    beyond = raw.groupBy("_g").agg(F.min("_raw").alias("_least")).select("_g", later.alias("_later"))
    own = F.min("_raw").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = raw.withColumn("_own", own).join(F.broadcast(beyond), "_g").select("_p", F.least(F.lit(1.0), "_own", "_later").alias(out))
    return df.join(q, df[p] == q["_p"], "left").drop("_p")

"""Paired significance of two methods."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark import schemas

#: Fixed value: from so many discordant pairs on, the chi-square approximation is used.
ASYMPTOTIC_FROM = 25


def discordant(pairs: DataFrame, *by: str, a: str = "hit_a", b: str = "hit_b") -> DataFrame:
    """n_both, n_a_only, n_b_only, n_neither per group of paired boolean outcomes."""
    x, y = F.col(a), F.col(b)
    return pairs.groupBy(*by).agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_a_only"), F.count_if(~x & y).alias("n_b_only"), F.count_if(~x & ~y).alias("n_neither"))


def statistic(b: Column, c: Column) -> Column:
    """min(b, c) below 25 discordant pairs, else the continuity-corrected chi-square."""
    n = b + c
    return F.when(n < ASYMPTOTIC_FROM, F.least(b, c).cast("double")).otherwise((F.abs(b - c) - 1) * (F.abs(b - c) - 1) / n)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series at x + 10, less the logarithms of the ten factors."""
    y = x.cast("double") + 10
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.log(x + i))
    return (y - 0.5) * F.log(y) - y + math.log(2 * math.pi) / 2 + series - shift


def exact_p(b: Column, c: Column) -> Column:
    """Two-sided binomial p at 1/2: twice the lower tail, 1 at most; for counts of any size.

    The tail's greatest term is taken in logarithms.  The others follow by ratios below 1, whose product falls below any double's
    precision within seven deviations, so the sum ends there.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    log_last = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    terms = F.least(k, F.ceil(7 * F.sqrt(n)) + 1).cast("int")
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * F.greatest(k - i, F.lit(0.0)) / (n - k + 1 + i)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    series = F.aggregate(F.sequence(F.lit(0), terms), start, step, lambda acc: acc["sum"])
    return F.least(F.lit(1.0), 2 * F.exp(log_last) * series)


def erfc(z: Column) -> Column:
    """1 - erf(z) for z >= 0: below 2 by erf's series of positive terms, above by a continued fraction from its end."""
    square = F.exp(-z * z)
    start = F.struct(z.alias("sum"), z.alias("term"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * 2 * z * z / (2 * i + 1)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    low = 1 - 2 / math.sqrt(math.pi) * square * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda acc: acc["sum"])
    fraction = F.aggregate(F.sequence(F.lit(100), F.lit(1)), z, lambda t, i: z + i / 2 / t)
    return F.when(z < 2, low).otherwise(square / (math.sqrt(math.pi) * fraction))


def asymptotic_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def with_mcnemar(counts: DataFrame) -> DataFrame:
    b, c = F.col("n_a_only"), F.col("n_b_only")
    rows = counts.withColumn("statistic", statistic(b, c))
    return rows.withColumn("p_value", F.when(b + c < ASYMPTOTIC_FROM, exact_p(b, c)).otherwise(asymptotic_p(F.col("statistic"))))


def compare(rows: DataFrame, method_a: str, method_b: str) -> DataFrame:
    """McNemar's test of strict recall per tier and element type; columns as in schemas.MCNEMAR.

    rows: the per-query table of several methods.  Questions that one side lacks are dropped, and so is a tier that one side
    lacks altogether; repeated questions multiply.
    """
    side = lambda m, suffix: rows.where(F.col("method") == m).select("tier", "question_id", F.col("table_srr_hit").alias(f"t_{suffix}"), F.col("column_srr_hit").alias(f"c_{suffix}"))
    pairs = side(method_a, "a").join(side(method_b, "b"), ["tier", "question_id"])
    long = pairs.select("tier", F.explode(F.array(*[F.struct(F.lit(level).alias("element_type"), F.col(f"{x}_a").alias("hit_a"), F.col(f"{x}_b").alias("hit_b")) for level, x in (("table", "t"), ("column", "c"))])).alias("e")).select("tier", "e.*")
    return with_mcnemar(discordant(long, "tier", "element_type")).select(F.lit(method_a).alias("method_a"), F.lit(method_b).alias("method_b"), *[c for c in schemas.MCNEMAR if not c.startswith("method_")])


def verdict(p: Column, b: Column, c: Column, a_name: Column, b_name: Column) -> Column:
    """The winner where p < .05, by the larger discordant side."""
    return F.when((p < 0.05) & (b > c), a_name).when((p < 0.05) & (c > b), b_name).otherwise("no difference")

"""Call ledger: cost, cap, report, projection and run statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.scale import running_sum

#: USD per million tokens (input, output, cache write, cache read).
PRICES = {"claude-haiku-4-5": (1.00, 5.00, 1.25, 0.10)}
REPORT = ("phase", "cost_usd", "calls", "avg_input_tokens", "avg_output_tokens", "cache_hit_rate")


def prices(spark: SparkSession, table: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    rows = [(m, *p) for m, p in (table or PRICES).items()]
    return spark.createDataFrame(rows, "model string, p_in double, p_out double, p_write double, p_read double")


def half_even(usd: Column) -> Column:
    """Six digits, half to even by the shortest decimal of the double: 0.0157555 is a tie."""
    return F.bround(usd, 6)


def half_even_binary(usd: Column) -> Column:
    """Six digits, half to even of the double's product with 10^6, as SQL engines round doubles: 0.0157555 is 15755.499999999998 millionths, no tie."""
    return F.rint(usd * 1e6) / 1e6


def with_cost(calls: DataFrame, price: DataFrame, rounded: Callable[[Column], Column] = half_even) -> DataFrame:
    """Adds cost_usd, rounded to six digits; a model without a price raises."""
    millions = F.col("input_tokens") * F.col("p_in") + F.col("output_tokens") * F.col("p_out") + F.coalesce("cache_creation_input_tokens", F.lit(0)) * F.col("p_write") + F.coalesce("cache_read_input_tokens", F.lit(0)) * F.col("p_read")
    rows = calls.drop("cost_usd").join(F.broadcast(price), "model", "left")
    return rows.withColumn("cost_usd", F.when(F.col("p_in").isNull(), F.raise_error(F.concat(F.lit("no price for model "), "model")).cast("double")).otherwise(rounded(millions / 1e6))).drop("p_in", "p_out", "p_write", "p_read")


def total_cost(calls: DataFrame) -> DataFrame:
    return calls.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def raised_cap(calls: DataFrame, headroom: float = 3.0) -> DataFrame:
    """A cap of what has been spent and ``headroom`` on top."""
    return total_cost(calls).select((F.col("cost_usd") + headroom).alias("cap_usd"))


def phase_of(calls: DataFrame) -> Column:
    return F.try_element_at("metadata", F.lit("phase"))


def report(calls: DataFrame, phases: Sequence[str] | None = None) -> DataFrame:
    """Per phase and total: see REPORT.  Averages and the hit rate come from summed tokens; phases without calls have no row.

    calls: phase, cost_usd, input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens.  The hit rate is
    cache reads over all input (plain, read and written).
    """
    rows = calls if phases is None else calls.where(F.col("phase").isin(*phases))
    read, made = F.coalesce(F.sum("cache_read_input_tokens"), F.lit(0)), F.coalesce(F.sum("cache_creation_input_tokens"), F.lit(0))
    g = rows.rollup("phase").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), read.alias("r"), made.alias("w"), F.grouping("phase").alias("is_total"))
    return g.where("calls > 0 and (is_total = 1 or phase is not null)").select(
        F.when(F.col("is_total") == 1, "total").otherwise(F.col("phase")).alias("phase"), "cost_usd", "calls",
        (F.col("i") / F.col("calls")).alias("avg_input_tokens"), (F.col("o") / F.col("calls")).alias("avg_output_tokens"),
        F.coalesce(F.try_divide(F.col("r"), F.col("r") + F.col("w") + F.col("i")), F.lit(0.0)).alias("cache_hit_rate"),
    )


def projected(calls: DataFrame, full_size: int) -> DataFrame:
    """n, mean and projected cost of a full run from a dry run; 0 without calls."""
    return calls.agg(F.count("*").alias("n"), F.coalesce(F.avg("cost_usd"), F.lit(0.0)).alias("mean_usd")).withColumn("projected_usd", F.col("mean_usd") * full_size)


def running(calls: DataFrame, cap: float, *order: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Adds prior_usd and cap_state: blocked (prior total at the cap), exceeded (the call passes it, and is logged), or ok.

    Without ``by`` one total runs over all calls, as a prefix scan (``order`` should tell calls apart); with it, one in each group.
    Costs have six digits, so sums are exact.  With ``exact`` false they are sums of doubles, call by call, as a meter adds them up
    (0.002541 + 0.017459 is below 0.02 then); only with ``by``.
    """
    if not (exact or by):
        raise ValueError("sums of doubles depend on the ranges of a prefix scan")
    cost = F.col("cost_usd").cast("decimal(18,6)") if exact else F.col("cost_usd")
    if by:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = calls.withColumn("prior_usd", F.coalesce(F.sum(cost).over(w), F.lit(0)).cast("double"))
    else:
        rows = running_sum(calls, cost, *(F.col(c) for c in order), name="prior_usd").withColumn("prior_usd", F.col("prior_usd").cast("double"))
    return rows.withColumn("cap_state", F.when(F.col("prior_usd") >= cap, "blocked").when(F.col("prior_usd") + F.col("cost_usd") > cap, "exceeded").otherwise("ok"))


def run_statistics(predictions: DataFrame) -> DataFrame:
    """Averages of predicted tables and columns, and the failure rate against its target.  predictions: tables, columns, failed (0 to 1)."""
    from linkspark.config import FAILURE_TARGET

    g = predictions.agg(F.count("*").alias("n"), F.avg(F.size("tables")).alias("avg_tables"), F.avg(F.size("columns")).alias("avg_columns"), F.avg(F.col("failed").cast("double")).alias("failure_rate"))
    return g.withColumn("within_target", F.col("failure_rate") <= FAILURE_TARGET)

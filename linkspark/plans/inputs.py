"""The driver's tables as inputs of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexical_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions written around a part's name; elements are all names and types of parts."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.expr("left(p_name, length(p_name) - 1)")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(" and ")))
    questions = part.select(F.col("p_partkey").alias("question_id"), F.lit("part").alias("db_id"), F.concat(F.lit("Which "), name, F.lit(" by "), "p_brand", F.lit(" is cheapest?")).alias("question"))
    element = lambda level, column: part.select(F.lit("part").alias("db_id"), F.lit(level).alias("level"), F.lit(0).alias("ord"), F.col(column).alias("t"), (F.lit(None).cast("string") if level == "table" else F.col(column)).alias("c"), F.col(column).alias("name")).distinct()
    return questions, element("table", "p_name").unionByName(element("column", "p_type"))


def calls(spark: SparkSession, sf_dir: str, rounded: Callable[[Column], Column] = ledger.half_even) -> DataFrame:
    """An event is a call, its type the phase, its value the tokens."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", F.col("event_type").alias("phase"), F.lit("claude-haiku-4-5").alias("model"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"), (F.col("event_id") % 7 * 10).alias("cache_read_input_tokens"), (F.col("event_id") % 5 * 10).alias("cache_creation_input_tokens"))
    return ledger.with_cost(rows, ledger.prices(spark), rounded)

"""Extension: the call ledger as a stream.  Batch operators cover the ledger in full; this keeps totals while calls come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkspark import schemas
from linkspark.sources.sinks import append_results


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.LEDGER).json(folder)


def windowed_cost(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Cost and calls per phase and window of event time; rows later than ``late`` are dropped by the watermark."""
    phase = F.coalesce(F.try_element_at("metadata", F.lit("phase")), F.lit("none"))
    g = calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), phase.alias("phase")).agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    return g.select(F.col("window.start").alias("start"), "phase", "cost_usd", "calls")


def keep_totals(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Totals per phase in a Parquet table, replaced by key with each batch; a batch that comes again gives the same table."""
    phase = F.coalesce(F.try_element_at("metadata", F.lit("phase")), F.lit("none"))
    totals = calls.groupBy(phase.alias("phase")).agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("calls"))
    return totals.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: append_results(rows, path, ["phase"])).start()

"""Sharding by rendezvous hashing: every shard bids for a record by a hash of the record's key and the shard's number.

The highest of ``weight / -ln(u)`` wins, u in (0, 1) being 52 bits of md5("key:shard").  A bid does not depend on how many
shards there are, so one more shard can only win records for itself.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import checkpoint, short

#: Fixed value: bits of the digest that make u.
BITS = 52
#: A shard's rows are numbered in parts of about so many.
PART_ROWS = 100_000


def bid(key: Column, shard: Column | int, weight: float = 1.0) -> Column:
    shard = F.lit(shard) if isinstance(shard, int) else shard
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")))
    u = (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(bid, shard): the winner among shards 0 to len(weights) - 1; of equal bids the lower shard wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one a shard")
    bids = [F.struct(bid(key, s, w).alias("bid"), F.lit(-s).alias("back")) for s, w in enumerate(weights)]
    best = F.array_max(F.array(*bids))
    return F.struct(best["bid"].alias("bid"), (-best["back"]).alias("shard"))


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row.

    ``parts``: a shard's rows are numbered in so many parts (by hash of key and text), whose offsets come from their counts, so
    no task holds a shard; by default parts of PART_ROWS on average.  The table of counts has a row a part.
    A null doc_id has the key "null", a null text has no bytes.  Repeated rows get slots of their own.  Rows that agree in
    doc_id, checksum and size may swap slots.  Other columns are not read; an empty table gives an empty result.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"))
    rows = rows.withColumn("won", rendezvous(F.col("key"), weights)).withColumn("spread", F.xxhash64("key", "text_crc32", "size"))
    grown = bid(F.col("key"), len(weights), sum(weights) / len(weights))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("won.shard").alias("shard"), "spread", F.when(grown > F.col("won.bid"), len(weights)).otherwise(F.col("won.shard")).cast("int").alias("grown_shard"))
    rows = checkpoint(rows)
    parts = parts or 1 + rows.count() // (len(weights) * PART_ROWS)
    rows = rows.withColumn("part", F.pmod("spread", F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inside))
    return numbered.join(short(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank") - 1).alias("slot"), "grown_shard",
    )

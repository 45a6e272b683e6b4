"""JSON of any shape as VARIANT, walked level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.scale import checkpoint

#: What a JSON value can be.
KINDS = ("object", "array", "string", "number", "boolean", "null")


def kind(value: Column) -> Column:
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name.isin("VOID", "NULL"), "null").otherwise("number")
    )


def members(rows: DataFrame, *names: str) -> DataFrame:
    """``names``, key (null for an array's), pos, v: the members of the objects and arrays in column v; other values have none."""
    exploded = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("m"))
    return exploded.select(*names, F.col("m.key").alias("key"), F.col("m.pos").alias("pos"), F.col("m.value").alias("v"))


def walk(rows: DataFrame, *names: str, most: int = 64) -> DataFrame:
    """``names``, depth, key, kind, v of all values of the JSON in column v (VARIANT), the whole one at depth 0.

    One lateral explode a level; only objects and arrays go on to the next, and a walk ends with the deepest one.  Null rows (no JSON)
    have no values.  JSON deeper than ``most`` raises.
    """
    level = checkpoint(rows.where("v is not null").select(*names, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), kind(F.col("v")).alias("kind"), "v"))
    seen = level
    for depth in range(1, most + 1):
        level = members(level.where("kind in ('object', 'array')"), *names)
        level = checkpoint(level.select(*names, F.lit(depth).alias("depth"), "key", kind(F.col("v")).alias("kind"), "v"))
        if not level.limit(1).count():
            return seen
        seen = seen.unionByName(level)
    raise ValueError(f"JSON is deeper than {most} levels")


def shape(rows: DataFrame) -> DataFrame:
    """depth, key, kind, n: how often a key has a kind of value at a depth, over all rows."""
    return walk(rows).groupBy("depth", "key", "kind").agg(F.count("*").alias("n"))

"""Mechanisms for tables of any size: joins with hot keys, ranks and running sums over a whole table, exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.recovery import shared_folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Keys with more than this share of all rows are hot.  There are fewer of them than this, at any size of the input.
HOT_KEYS = 4096
HOT_ROWS = 1000


def hot_bound(total: int) -> int:
    """Rows from which on a key is hot: fewer than HOT_KEYS keys can have more than ``total`` / HOT_KEYS rows."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, holders: str = "holders") -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key, ``holders`` rows of which ``rows`` has) without a hot task.

    What hot keys need is broadcast, fewer than HOT_KEYS rows; the other keys are joined by a shuffle.
    """
    bound = hot_bound(total)
    hot = keyed.where(F.col(holders) > bound)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(holders) <= bound), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


#: A table is broadcast only after a count of its rows: up to so many.
BROADCAST_ROWS = 500_000


def short(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast join, if a count finds that it has BROADCAST_ROWS rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, with __part (the range's number) and __place (the place within it); computed once."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    return placed.withColumns({"__part": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")


def _before(parts: DataFrame, *sums: str) -> DataFrame:
    """Sums over all parts before each; ``parts`` has a row a partition."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums))


def numbered(df: DataFrame, *order: Column, name: str = "__rank") -> DataFrame:
    """``df`` with ranks 0, 1, 2, ... in ``order``, which should tell rows apart.

    Rows are dealt by ranges of ``order`` and sorted there; a row's rank is its place in its range after all rows of the ranges
    before, whose counts are a row a partition.
    """
    placed = _placed(df, order)
    offsets = _before(placed.groupBy("__part").agg(F.count("*").alias("n")), "n")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before_n") + F.col("__place")).drop("__part", "__place", "__before_n")


def running_sum(df: DataFrame, value: Column, *order: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before it in ``order`` (0 for the first one; exact for exact types).

    A prefix scan in two passes: sums by range, prefix sums over the ranges (a row a partition), and running sums within a
    range that begin with its offset.  No task has more than a range.
    """
    placed = _placed(df.withColumn("__value", value), order)
    offsets = _before(placed.groupBy("__part").agg(F.sum("__value").alias("sum")), "sum")
    own = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("__own", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(F.broadcast(offsets), "__part")
    return rows.withColumn(name, F.col("__before_sum") + F.col("__own")).drop("__part", "__place", "__value", "__own", "__before_sum")


#: Buckets into which a pass of ``order_statistics`` cuts what is left of a value's range.
CUTS = 1024


def order_statistics(rows: DataFrame, value: str, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, rank, value: the value of each wanted rank (0: the least) of a group, by radix selection.

    ranks: ``by`` (one column at least, no nulls) and rank.  A pass cuts the range in which a rank lies into CUTS buckets, counts them, and goes on
    with the bucket that has the rank, from its least to its greatest value; the search of a rank ends when these are equal.  Counts are
    summed before they are dealt, so a pass ships CUTS rows a task and rank at most, and no task ever holds a group's values.
    """
    by = list(by)
    held = checkpoint(rows.select(*by, F.col(value).alias("__v")).where("__v is not null"))
    ends = held.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    state = checkpoint(ranks.join(ends, by).withColumn("__less", F.lit(0).cast("long")))
    done = state.where("__low = __high")
    state = state.where("__low < __high")
    while state.limit(1).count():
        met = held.join(short(state), by).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        share = (F.col("__v").cast("double") - F.col("__low")) / (F.col("__high").cast("double") - F.col("__low"))
        cut = F.least(F.floor(share * CUTS), F.lit(CUTS - 1)).cast("int")
        key = [*by, "rank", "__less"]
        buckets = met.groupBy(*key, cut.alias("__cut")).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        # CUTS rows a rank
        upto = Window.partitionBy(*by, "rank").orderBy("__cut")
        buckets = buckets.withColumn("__upto", F.col("__less") + F.sum("__n").over(upto))
        found = buckets.where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__n")))
        found = checkpoint(found.select(*by, "rank", "__low", "__high", (F.col("__upto") - F.col("__n")).alias("__less")))
        done, state = done.unionByName(found.where("__low = __high")), found.where("__low < __high")
    return done.select(*by, "rank", F.col("__low").alias(value))


def quantiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``by`` and quantiles (an array in the order of ``shares``): exact, with linear interpolation between neighbouring ranks.

    Nulls of ``value`` are left out, and so are groups without a value or with a null key.
    """
    by = list(by)
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("__size"))
    for c in by:
        sizes = sizes.where(F.col(c).isNotNull())
    at = F.col("share") * (F.col("__size") - 1)
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).select(*by, "share", F.floor(at).alias("lower"), F.ceil(at).alias("upper"), (at - F.floor(at)).alias("part"))
    wanted = checkpoint(wanted)
    ranks = wanted.select(*by, F.explode(F.array("lower", "upper")).alias("rank")).distinct()
    found = checkpoint(order_statistics(rows, value, ranks, by))
    side = lambda name: found.select(*by, F.col("rank").alias(name), F.col(value).cast("double").alias(f"{name}_value"))
    both = wanted.join(side("lower"), [*by, "lower"]).join(side("upper"), [*by, "upper"])
    both = both.withColumn("q", F.col("lower_value") + F.col("part") * (F.col("upper_value") - F.col("lower_value")))
    return both.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("share", "q"))).alias("pairs")).select(*by, F.transform("pairs", lambda p: p["q"]).alias("quantiles"))

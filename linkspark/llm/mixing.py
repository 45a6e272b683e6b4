"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, u a hash of its id: the order of such keys is that of weighted sampling without
replacement.  A source first gives its whole epochs; the rest of its target is filled in the order of keys by prefix sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.common import WORD, checkpoint, short

#: Marks that junk lines are full of.
JUNK = "#$%&*!|"
#: A source is sorted in ranges of its keys, so many for each doubling of a key: one for so many rows of the table, and LEAST_RANGES
#: at least.  Keys are exponential, so 0.37 of a source's rows at most lie in one doubling, whatever its size and quality.
RANGE_ROWS = 1 << 18
LEAST_RANGES = 16


def n_words(text: Column) -> Column:
    """Number of maximal runs without white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Quality weight in [0.05, 1]: falls with the share of junk marks."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.round(1 - 4 * marks / F.nullif(n, F.lit(0)), 3)), F.lit(0.05))


def unit(key: Column) -> Column:
    """A double in (0, 1) from 52 bits of md5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes: source, source_size.  Adds target: ``share`` of all sizes by weight, filled up to ``most`` times a source's size.

    Resharing what is above the limit until none is amounts to one level: target = min(most * size, weight * level).  With
    the sources sorted by most * size / weight, the level if the first k stop at their limits rises with k as long as the next
    one is above its limit, and falls afterwards: it is the greatest of these values.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    limit = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = F.max("level").over(every)
    return limit.withColumn("level", level).select("source", "source_size", F.least(F.col("limit"), F.col("weight") * found).alias("target"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __id, __source, __size and __key, the sampling key; a row without a doc_id is named by its text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    key = F.greatest(F.round(-F.log(unit(name)) / quality(F.col("text")), 9), F.lit(1e-9))
    own = {"__id": F.col("doc_id").cast("long"), "__source": F.col("source").cast("string"), "__size": n_words(F.col("text")), "__key": key}
    return docs.select("*", *(value.alias(column) for column, value in own.items()))


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, ranges: int | None = None, cut: bool = True) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the sampling key: one row per input row.

    Sources, by code point and null last, weigh ``weights`` in turn and share ``share`` of all sizes.  ``ranges``: a source is
    sorted in ranges of its keys, so many a doubling, which prefix sums of their sizes join, so no task holds a source.
    ``cut``: the document that crosses the target gives only the words that are missing; else it is taken whole or not at all,
    whichever comes nearer.  Documents without words take nothing.  Repeated rows count each; of equal keys the order is by
    doc_id, then size.  A row without a doc_id is named by its text.  Other columns are not read; an empty table gives an empty
    result.
    """
    names = {"__id": "doc_id", "__source": "source", "__size": "size", "__key": "key"}
    rows = keyed(docs.select("doc_id", "source", "text")).select(*(F.col(a).alias(b) for a, b in names.items()))
    # rows that agree in all of these follow each other and are placed as one
    rows = checkpoint(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")))
    ranges = ranges or max(LEAST_RANGES, rows.count() // RANGE_ROWS)
    rows = rows.withColumn("bin", F.floor(F.log2("key") * ranges).cast("int"))
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "bin").agg(F.sum(words).alias("bin_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.coalesce(F.sum("bin_size").over(running), F.lit(0)).alias("base"))
    bases = bases.join(targets, bases["s"].eqNullSafe(targets["source"])).drop("source")
    inside = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_bin", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    joined = placed.join(bases, placed["source"].eqNullSafe(bases["s"]) & (placed["bin"] == bases["b"]))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size")
    before = F.col("base") + F.col("in_bin") + F.col("copy") * F.col("size")
    part = F.least(F.greatest(rest - before, F.lit(0)), F.col("size")) if cut else F.when(before + F.col("size") / 2 <= rest, F.col("size")).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "key")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its whole copies; all columns stay.

    The boundary document is taken whole or not at all.  Documents without words are in no mix and go.  Of rows that agree in
    doc_id, source, size and key, as many are taken once more as the mix takes, in the order of their texts.  Columns of ``docs``
    may have any names but those that begin with two underscores.
    """
    same = ["__id", "__source", "__size", "__key"]
    named = [F.col(a).alias(f"__of{b}") for a, b in zip(("doc_id", "source", "size", "key"), same, strict=True)]
    taken = mix(docs, cut=False, **options).where("size > 0")
    copies = (F.col("taken") / F.col("size")).cast("int")
    times = checkpoint(taken.groupBy(*named).agg(F.min(copies).alias("__low"), F.max(copies).alias("__high"), F.count("*").alias("__rows"), F.sum(copies).alias("__all")))
    # equal rows follow each other in the mix and get one more copy up to the target, so they differ only where the target lies:
    # once a source
    partly = times.where("__low < __high").withColumn("__more", F.col("__all") - F.col("__rows") * F.col("__low"))
    rows = keyed(docs)
    on = lambda side: [rows[a].eqNullSafe(side[f"__of{a}"]) for a in same]
    whole = times.where("__low = __high and __low > 0")
    kept = rows.join(whole, on(whole)).withColumn("__n", F.col("__low")).select(*docs.columns, "__n")
    if partly.limit(1).count():
        ranked = rows.join(short(partly), on(partly)).withColumn("__rank", F.row_number().over(Window.partitionBy(*same).orderBy("text")))
        ranked = ranked.withColumn("__n", F.col("__low") + (F.col("__rank") <= F.col("__more")).cast("int")).where("__n > 0")
        kept = kept.unionByName(ranked.select(*docs.columns, "__n"))
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)

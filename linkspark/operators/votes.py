"""Votes over samples, and the union of two methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("union", "majority", "intersection")


def needed(rule: str, k: int) -> int:
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; have {RULES}")
    return {"union": 1, "majority": (k + 1) // 2, "intersection": k}[rule]


def tally(samples: DataFrame, *element: str) -> DataFrame:
    """votes, first and bits of each element.  samples: question_id, sample_idx, pos and the element's columns.

    The samples that have an element are a set of bits (words of 64), united by or, so an element counts once a sample and its rows are
    merged before they are dealt.  votes: the number of bits; first: the lowest one's sample, and the element's first place there.
    """
    word = F.expr("cast(sample_idx div 64 as int)")
    bit = F.expr("shiftleft(1L, cast(sample_idx % 64 as int))")
    words = samples.groupBy("question_id", *element, word.alias("word")).agg(F.bit_or(bit).alias("bits"), F.min(F.struct("sample_idx", "pos")).alias("first"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return words.groupBy("question_id", *element).agg(F.sum(F.bit_count("bits")).alias("votes"), F.min("first").alias("first"), lists.alias("bits"))


def vote(samples: DataFrame, k: int, rule: str, *element: str) -> DataFrame:
    """Elements with enough votes of ``k`` samples (samples that failed are empty votes), as an array in first-seen order."""
    kept = tally(samples, *element).where(F.col("votes") >= needed(rule, k))
    item = F.struct(F.col("first"), (F.struct(*element) if len(element) > 1 else F.col(element[0])).alias("item"))
    return kept.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))


def voted_links(samples: DataFrame, k: int, rule: str) -> DataFrame:
    """question_id, tables, columns from samples (question_id, sample_idx, tables, columns)."""
    t = vote(samples.select("question_id", "sample_idx", F.posexplode("tables").alias("pos", "t")), k, rule, "t").withColumnRenamed("items", "tables")
    c = samples.select("question_id", "sample_idx", F.posexplode("columns").alias("pos", "p")).select("question_id", "sample_idx", "pos", "p.t", "p.c")
    c = vote(c, k, rule, "t", "c").withColumnRenamed("items", "columns")
    ids = samples.select("question_id").distinct()
    return ids.join(t, "question_id", "left").join(c, "question_id", "left").select("question_id", F.coalesce("tables", F.array().cast("array<string>")).alias("tables"), F.coalesce("columns", F.array().cast("array<struct<t:string,c:string>>")).alias("columns"))


def ablation(samples: DataFrame, k: int) -> DataFrame:
    """strategy, question_id, tables, columns: the first sample alone, and all k by each rule."""
    first = samples.where("sample_idx = 0").select(F.lit("k=1").alias("strategy"), "question_id", "tables", "columns")
    for rule in RULES:
        first = first.unionByName(voted_links(samples, k, rule).select(F.lit(f"k={k} {rule}").alias("strategy"), "question_id", "tables", "columns"))
    return first


def union(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Links of both methods, sorted, and what each contributes; a side that lacks the question counts as empty.

    Both: question_id, db_id, tables, columns.
    """
    a = forward.select("question_id", F.col("db_id").alias("fd"), F.col("tables").alias("ft"), F.col("columns").alias("fc"))
    b = backward.select("question_id", F.col("db_id").alias("bd"), F.col("tables").alias("bt"), F.col("columns").alias("bc"))
    empty = {"t": F.array().cast("array<string>"), "c": F.array().cast("array<struct<t:string,c:string>>")}
    rows = a.join(b, "question_id", "full_outer").select(
        "question_id", F.coalesce("fd", "bd").alias("db_id"), F.col("ft").isNotNull().alias("has_forward"), F.col("bt").isNotNull().alias("has_backward"),
        *[F.coalesce(x, empty[x[1]]).alias(x) for x in ("ft", "fc", "bt", "bc")],
    )
    out = ["question_id", "db_id", "has_forward", "has_backward"]
    for name, x in (("tables", "t"), ("columns", "c")):
        f, g = F.col(f"f{x}"), F.col(f"b{x}")
        out += [F.array_sort(F.array_union(f, g)).alias(name), F.size(F.array_intersect(f, g)).cast("long").alias(f"{name}_both"), F.size(F.array_except(f, g)).cast("long").alias(f"{name}_forward_only"), F.size(F.array_except(g, f)).cast("long").alias(f"{name}_backward_only")]
    return rows.select(*out)

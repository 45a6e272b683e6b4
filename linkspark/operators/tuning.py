"""Tuning: a sweep of fuzzy thresholds, a grid of vector settings, and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.functions import metrics as M
from linkspark.operators.vector import ranked

#: The default grids.
FUZZY = (70, 75, 80, 85, 90, 95)
TOP_K = {"table": (1, 2, 3, 5), "column": (3, 5, 10, 15)}
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)


def values(frame: DataFrame, name: str, items: Sequence) -> DataFrame:
    """Adds a row per item: the cross product with a short literal list."""
    return frame.withColumn(name, F.explode(F.array(*[F.lit(x) for x in items])))


def _per_question(hits: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """Counts per setting and question from flagged candidates (is_hit, is_gold) and gold sizes (question_id, n_gold)."""
    g = hits.groupBy("question_id", *by).agg(F.count_if(F.col("is_hit") & F.col("is_gold")).alias("tp"), F.count_if(F.col("is_hit") & ~F.col("is_gold")).alias("fp"))
    return g.join(gold, "question_id").withColumn("fn", F.col("n_gold") - F.col("tp"))


def _macro(rows: DataFrame, *by: str) -> DataFrame:
    m = M.from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.groupBy(*by).agg(*[F.avg(m[k]).alias(k) for k in ("precision", "recall", "f1")])


def sweep_fuzzy(scored: DataFrame, gold: DataFrame, thresholds: Sequence[int] = FUZZY) -> DataFrame:
    """fuzzy_threshold and macro metrics per level.

    scored: lexical scores with is_gold; every question of ``gold`` (question_id, level, n_gold) counts, also those without a
    hit.  Strategies and scores are computed once; exact hits pass every threshold.
    """
    flagged = values(scored.select("question_id", "level", "strategy", "score", "is_gold"), "fuzzy_threshold", thresholds)
    hit = (F.col("strategy") != "fuzzy") | (F.col("score") >= F.col("fuzzy_threshold"))
    g = flagged.withColumn("is_hit", hit).groupBy("question_id", "level", "fuzzy_threshold").agg(F.count_if(F.col("is_hit") & F.col("is_gold")).alias("tp"), F.count_if(F.col("is_hit") & ~F.col("is_gold")).alias("fp"))
    every = values(gold, "fuzzy_threshold", thresholds)
    rows = every.join(g, ["question_id", "level", "fuzzy_threshold"], "left").select("level", "fuzzy_threshold", "n_gold", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))
    rows = rows.withColumn("fn", F.col("n_gold") - F.col("tp"))
    m = M.from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    wide = rows.groupBy("fuzzy_threshold").agg(*[F.avg(F.when(F.col("level") == level, m[k])).alias(f"{level}_{k}") for level in ("table", "column") for k in ("precision", "recall", "f1")])
    return wide


def pick_fuzzy(sweep: DataFrame, element: str = "table") -> DataFrame:
    """The best threshold: by the element's F1, then the other's, then the lowest."""
    other = "column" if element == "table" else "table"
    return sweep.orderBy(F.desc(f"{element}_f1"), F.desc(f"{other}_f1"), "fuzzy_threshold").limit(1)


def level_grid(scores: DataFrame, gold: DataFrame, level: str, top_k: Sequence[int], thresholds: Sequence[float]) -> DataFrame:
    """Macro metrics of one level for all of its settings: ranks are computed once, then each setting is a filter.

    scores: question_id, level, ord, score, is_gold; gold: question_id, level, n_gold.
    """
    r = ranked(scores.where(F.col("level") == level), "question_id").where(F.col("rank") <= max(top_k)).select("question_id", "rank", "score", "is_gold")
    flagged = values(values(r, "k", top_k), "threshold", thresholds).withColumn("is_hit", (F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("threshold")))
    g = flagged.groupBy("question_id", "k", "threshold").agg(F.count_if(F.col("is_hit") & F.col("is_gold")).alias("tp"), F.count_if(F.col("is_hit") & ~F.col("is_gold")).alias("fp"))
    every = values(values(gold.where(F.col("level") == level).select("question_id", "n_gold"), "k", top_k), "threshold", thresholds)
    rows = every.join(g, ["question_id", "k", "threshold"], "left").select("k", "threshold", "n_gold", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"))
    return _macro(rows.withColumn("fn", F.col("n_gold") - F.col("tp")), "k", "threshold")


def grid(scores: DataFrame, gold: DataFrame, top_k: dict[str, Sequence[int]] | None = None, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """All settings of both levels.  Tables and columns do not depend on each other, so 20 + 20 evaluations give the 400 rows."""
    k = top_k or TOP_K
    sides = [level_grid(scores, gold, level, k[level], thresholds).select(F.col("k").alias(f"{level}_top_k"), F.col("threshold").alias(f"{level}_threshold"), *[F.col(m).alias(f"{level}_{m}") for m in ("precision", "recall", "f1")]) for level in ("table", "column")]
    both = sides[0].crossJoin(F.broadcast(sides[1]))  # two short lists of settings
    return both.select("table_top_k", "table_threshold", "column_top_k", "column_threshold", *[f"{level}_{m}" for level in ("table", "column") for m in ("precision", "recall", "f1")], ((F.col("table_f1") + F.col("column_f1")) / 2).alias("mean_f1"), ((F.col("table_recall") + F.col("column_recall")) / 2).alias("mean_recall"))


def pick_grid(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("mean_f1"), F.desc("mean_recall"), "table_top_k", "table_threshold", "column_top_k", "column_threshold").limit(1)


def heat_map(table: DataFrame, row: str, column: str, value: str, items: Sequence) -> DataFrame:
    return table.groupBy(row).pivot(column, list(items)).agg(F.max(value))


def beta_sweep(rows: DataFrame, betas: Sequence[float]) -> DataFrame:
    """F-beta of each row's precision and recall for every beta."""
    wide = values(rows, "beta", [float(b) for b in betas])
    return wide.withColumn("f_beta", M.f_beta(F.col("precision"), F.col("recall"), F.col("beta")))

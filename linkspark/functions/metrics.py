"""Set metrics as expressions over arrays or counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f_beta(p: Column, r: Column, beta: float | Column) -> Column:
    """(1 + b^2) P R / (b^2 P + R); 0 where that has no value."""
    square = (F.lit(float(beta)) if isinstance(beta, (int, float)) else beta) ** 2
    below = square * p + r
    return F.when(below == 0, 0.0).otherwise((1 + square) * p * r / F.nullif(below, F.lit(0.0)))


def from_counts(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall, f1: precision without predictions and recall without gold are 1, and so is F1 where there is nothing at all."""
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / F.nullif(tp + fn, F.lit(0)))
    f1 = F.when(tp + fp + fn == 0, 1.0).when(tp == 0, 0.0).otherwise(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))
    return {"precision": p.cast("double"), "recall": r.cast("double"), "f1": f1.cast("double")}


def set_counts(predicted: Column, gold: Column) -> dict[str, Column]:
    """tp, fp, fn and srr_hit of two sets given as arrays without nulls; srr_hit: all of gold is predicted."""
    return {
        "tp": F.size(F.array_intersect(predicted, gold)).cast("long"),
        "fp": F.size(F.array_except(predicted, gold)).cast("long"),
        "fn": F.size(F.array_except(gold, predicted)).cast("long"),
        "srr_hit": F.size(F.array_except(gold, predicted)) == 0,
    }


def per_query(predicted: Column, gold: Column) -> dict[str, Column]:
    counts = set_counts(predicted, gold)
    return {**counts, **from_counts(counts["tp"], counts["fp"], counts["fn"])}


def p_band(p: Column) -> Column:
    return F.when(p < 0.001, "p < .001").when(p < 0.05, "p < .05").otherwise("n.s.")


def bridge_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(F.greatest(n, F.lit(0)).cast("string"))

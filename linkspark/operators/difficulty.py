"""Query hardness from parsed SQL: three counts, four labels."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: the number of LIKE among the operators of a condition.
LIKE = 9


def counts(sql: dict) -> tuple[int, int, int]:
    """(clauses and joins, nested queries, extras) of a parsed query.

    Two habits of the usual scorer are kept: in WHERE, a condition's first place is its negation, so NOT counts as an
    aggregate; in HAVING, the connectors count with the conditions, any non-empty string being "not 0".
    """
    part = lambda name: sql.get(name) or []
    source = sql.get("from") or {}
    joined = source.get("conds") or []
    lists = (joined, part("where"), part("having"))
    words = [w for x in lists for w in x[1::2]]
    conditions = [c for x in lists for c in x[::2] if isinstance(c, list)]

    clauses = sum(bool(part(name)) for name in ("where", "groupBy", "orderBy")) + (sql.get("limit") is not None)
    clauses += max(0, len(source.get("table_units") or []) - 1)
    clauses += words.count("or") + sum(len(c) > 1 and c[1] == LIKE for c in conditions)

    nested = sum(isinstance(v, dict) for c in conditions for v in c[3:5])
    nested += sum(sql.get(name) is not None for name in ("intersect", "union", "except"))

    selected = (sql.get("select") or [None, []])[1] or []
    ordered = part("orderBy")
    units = [*selected, *part("where")[::2], *part("groupBy"), *part("having")]
    units += [u for v in (ordered[1] if ordered else []) for u in (v[1], v[2]) if u]
    aggregates = sum(bool(u) and u[0] != 0 for u in units)
    extras = (aggregates > 1) + (len(selected) > 1) + (len(part("where")) > 1) + (len(part("groupBy")) > 1)
    return clauses, nested, extras


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("clauses", "nested", "extras")]))
def _counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([counts(json.loads(x)) for x in part], columns=["clauses", "nested", "extras"])


def label(clauses: Column, nested: Column, extras: Column) -> Column:
    flat = nested == 0
    return (
        F.when(flat & (clauses <= 1) & (extras == 0), "easy")
        .when(flat & (((extras <= 2) & (clauses <= 1)) | ((clauses <= 2) & (extras < 2))), "medium")
        .when((flat & (((extras > 2) & (clauses <= 2)) | ((clauses == 3) & (extras <= 2)))) | ((clauses <= 1) & (extras == 0) & (nested <= 1)), "hard")
        .otherwise("extra")
    )


def with_hardness(questions: DataFrame) -> DataFrame:
    """Adds hardness to questions with the JSON column sql."""
    rows = questions.withColumn("k", _counts("sql"))
    return rows.withColumn("hardness", label(F.col("k.clauses"), F.col("k.nested"), F.col("k.extras"))).drop("k")


def clause_presence(questions: DataFrame, *names: str) -> DataFrame:
    """Adds has_<clause>: the parsed query has it, and not empty."""
    v = F.parse_json("sql")
    text = lambda n: F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))
    return questions.select("*", *[(~F.coalesce(text(n), F.lit("null")).isin("null", "[]", "{}", "false")).alias(f"has_{n}") for n in names])

"""Few-shot examples: one simple and one multi-table question of different databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = ("simple", "multi_table")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get(F.parse_json("sql"), path, kind)


def is_flat() -> Column:
    """No set operation, no query in FROM, none as a value in WHERE."""
    null = lambda n: F.coalesce(F.to_json(_get(f"$.{n}", "variant")), F.lit("null")).isin("null", "{}")
    units = F.coalesce(_get("$.from.table_units", "array<variant>"), F.array().cast("array<variant>"))
    plain_from = F.forall(units, lambda u: F.coalesce(F.try_variant_get(u, "$[0]", "string"), F.lit("")) == "table_unit")
    where = F.coalesce(_get("$.where", "array<variant>"), F.array().cast("array<variant>"))
    plain_where = F.forall(where, lambda c: ~F.startswith(F.coalesce(F.to_json(F.try_variant_get(c, "$[3]", "variant")), F.lit("")), F.lit("{")))
    return null("intersect") & null("union") & null("except") & plain_from & plain_where


def n_tables() -> Column:
    return F.size(F.coalesce(_get("$.from.table_units", "array<variant>"), F.array().cast("array<variant>")))


def is_simple() -> Column:
    """One table, no join condition, an aggregate among the selected."""
    selected = F.coalesce(_get("$.select[1]", "array<variant>"), F.array().cast("array<variant>"))
    conds = F.size(F.coalesce(_get("$.from.conds", "array<variant>"), F.array().cast("array<variant>")))
    return is_flat() & (n_tables() == 1) & (conds == 0) & F.exists(selected, lambda s: F.coalesce(F.try_variant_get(s, "$[0]", "int"), F.lit(0)) != 0)


def is_multi_table() -> Column:
    """Two tables or more, and gold columns of two or more."""
    return is_flat() & (n_tables() >= 2) & (F.size(F.array_distinct(F.transform("columns", lambda p: p["t"]))) >= 2)


def candidates(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, db_id, question, query, tables, columns, pattern of questions with gold that fit a pattern."""
    rows = questions.join(gold.select("question_id", "tables", "columns"), "question_id")
    fits = F.array_compact(F.array(F.when(is_simple(), "simple"), F.when(is_multi_table(), "multi_table")))
    return rows.select("question_id", "db_id", "question", "query", "tables", "columns", F.explode(fits).alias("pattern"))


def pick(pool: DataFrame, known: DataFrame, seed: int = 42, n: int = 2) -> DataFrame:
    """One candidate of each pattern, of different databases, first in the order of a seeded hash.

    Gold that names what the schema lacks raises, and so does a pattern without candidates.  known: as
    evaluation.known_elements, for names compared as written in canonical form.
    """
    if n != 2:
        raise ValueError("there are two patterns: n must be 2")
    from linkspark.functions.text import canonical_list, canonical_pairs

    key = F.xxhash64(F.lit(seed), "question_id")
    best = lambda rows: rows.orderBy(key, "question_id").limit(1)
    first = best(pool.where(F.col("pattern") == "simple"))
    second = best(pool.where(F.col("pattern") == "multi_table").join(first.select("db_id"), "db_id", "left_anti"))
    rows = first.unionByName(second.select(*first.columns)).join(known, "db_id", "left")
    bad = (F.size(F.array_except(canonical_list(F.col("tables")), F.coalesce("known_tables", F.array().cast("array<string>")))) > 0) | (F.size(F.array_except(canonical_pairs(F.col("columns")), F.coalesce("known_columns", F.array().cast("array<struct<t:string,c:string>>")))) > 0)
    rows = rows.withColumn("question_id", F.when(bad, F.raise_error(F.concat(F.lit("unknown table or column in example "), F.col("question_id").cast("string")))).otherwise(F.col("question_id")))
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # two rows
    return rows.withColumn("n", n).withColumn("db_id", F.when(F.col("n") == 2, F.col("db_id")).otherwise(F.raise_error(F.lit("a pattern has no candidate")))).select("question_id", "db_id", "question", "pattern", "tables", "columns")


def to_backward(examples: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds gold_sql, the question's query; an example without one raises."""
    q = questions.select("question_id", F.col("query").alias("gold_sql"))
    rows = examples.join(q, "question_id", "left")
    return rows.withColumn("gold_sql", F.coalesce("gold_sql", F.raise_error(F.concat(F.lit("no query for example "), F.col("question_id").cast("string")))))


def to_graph(examples: DataFrame) -> DataFrame:
    """core_tables instead of tables: one to three, and every column inside them, else it raises."""
    inside = F.forall("columns", lambda p: F.array_contains("tables", p["t"]))
    ok = F.size("tables").between(1, 3) & inside
    return examples.withColumn("core_tables", F.when(ok, F.col("tables")).otherwise(F.raise_error(F.concat(F.lit("no graph example: "), F.col("question_id").cast("string"))))).drop("tables")

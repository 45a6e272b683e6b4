"""Evaluation of predicted links against gold: per query, macro and micro, by hardness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.functions import metrics as M
from linkspark.functions import text as X

def known_elements(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """db_id, known_tables, known_columns: canonical names of the catalog, a row a schema (tables: db_id, original; columns: table_original, col_original)."""
    t = tables.groupBy("db_id").agg(F.collect_set(X.canonical(F.col("original"))).alias("known_tables"))
    c = columns.groupBy("db_id").agg(F.collect_set(F.struct(X.canonical(F.col("table_original")).alias("t"), X.canonical(F.col("col_original")).alias("c"))).alias("known_columns"))
    return t.join(c, "db_id", "left").select("db_id", "known_tables", F.coalesce("known_columns", F.array().cast(f"array<{schemas.PAIR}>")).alias("known_columns"))


def known_rows(known: DataFrame) -> DataFrame:
    """db_id, level, kt, kc: the elements of ``known_elements``, a row each."""
    t = known.select("db_id", F.lit("table").alias("level"), F.explode("known_tables").alias("kt"), F.lit("").alias("kc"))
    return t.unionByName(known.select("db_id", F.lit("column").alias("level"), F.explode("known_columns").alias("p")).select("db_id", "level", F.col("p.t").alias("kt"), F.col("p.c").alias("kc")))


def link_elements(links: DataFrame) -> DataFrame:
    """question_id, level, pos, raw, kt, kc: the elements of links (question_id, tables, columns), as written and canonical, a row each."""
    t = links.select("question_id", F.lit("table").alias("level"), F.posexplode("tables").alias("pos", "raw"))
    c = links.select("question_id", F.lit("column").alias("level"), F.posexplode("columns").alias("pos", "p"))
    t = t.select("*", X.canonical(F.col("raw")).alias("kt"), F.lit("").alias("kc"))
    return t.unionByName(c.select("question_id", "level", "pos", F.concat_ws(".", "p.t", "p.c").alias("raw"), X.canonical(F.col("p.t")).alias("kt"), X.canonical(F.col("p.c")).alias("kc")))


def counted(flags: DataFrame, *by: str) -> DataFrame:
    """``by`` and, for each level, tp, fp, fn, predicted_count, gold_count and hallucinated; and raw, the predictions as written.

    flags: level, is_gold, is_predicted, is_known, a row an element; times, how often it was predicted (1 if there is no such column).  Predicted elements that
    are not known are hallucinated and count in no other way.  One pass, whose counts are summed before they are dealt.
    """
    times = F.col("times") if "times" in flags.columns else F.lit(1)
    predicted, gold = F.col("is_predicted") & F.col("is_known"), F.col("is_gold")
    out = []
    for level in schemas.LEVELS:
        here = F.col("level") == level
        n = lambda x: F.count_if(here & x)  # noqa: B023, E731
        out += [n(predicted & gold).alias(f"{level}_tp"), n(predicted & ~gold).alias(f"{level}_fp"), n(gold & ~predicted).alias(f"{level}_fn"), n(predicted).alias(f"{level}_predicted_count"), n(gold).alias(f"{level}_gold_count")]
        out.append(F.coalesce(F.sum(F.when(here & F.col("is_predicted") & ~F.col("is_known"), times)), F.lit(0)).cast("long").alias(f"{level}_hallucinated"))
    return flags.groupBy(*by).agg(*out, F.coalesce(F.sum(F.when(F.col("is_predicted"), times)), F.lit(0)).cast("long").alias("raw"))


def measured(counts: DataFrame, method: str = "", tier: str = "") -> DataFrame:
    """The columns of schemas.PER_QUERY but the lists of names, from ``counted`` by question_id, db_id and hardness."""
    out = [F.col("question_id"), F.col("db_id"), F.lit(method).alias("method"), F.lit(tier).alias("tier"), F.col("hardness")]
    for level in schemas.LEVELS:
        m = M.from_counts(*(F.col(f"{level}_{n}") for n in ("tp", "fp", "fn"))) | {"srr_hit": F.col(f"{level}_fn") == 0}
        out += [m.get(name, F.col(f"{level}_{name}")).alias(f"{level}_{name}") for name in schemas.PER_LEVEL]
    wrong = F.col("table_hallucinated") + F.col("column_hallucinated")
    return counts.select(*out, F.when(F.col("raw") == 0, 0.0).otherwise(wrong / F.nullif(F.col("raw"), F.lit(0))).alias("hallucination_rate"))


def from_flags(flags: DataFrame, method: str = "", tier: str = "") -> DataFrame:
    """Per-query metrics of elements with question_id, db_id, hardness and the flags of ``counted``."""
    return measured(counted(flags, "question_id", "db_id", "hardness"), method, tier)


def lacking_schema(gold: DataFrame, known: DataFrame) -> DataFrame:
    """db_id, questions: gold questions whose schema is not known.  ``per_query`` leaves them out; a runner reports their number."""
    return gold.join(known, "db_id", "left_anti").groupBy("db_id").agg(F.count("*").alias("questions"))


def per_query(gold: DataFrame, predictions: DataFrame, known: DataFrame, hardness: DataFrame | None = None, method: str = "", tier: str = "") -> DataFrame:
    """One row per gold question whose schema is known (see ``lacking_schema``), columns as in schemas.PER_QUERY.

    gold, predictions: question_id, db_id, tables, columns; known: as ``known_elements``.  A question without prediction counts as
    an empty one; predictions without gold are left out.  Predicted elements that the schema lacks are hallucinated: they count in the
    rate, whose denominator is the raw lists' length, and are removed before the metrics.  hardness: question_id, hardness.

    Elements are rows with flags until they are counted; only the names of hallucinated ones come together in a question's row.
    """
    asked = gold.select("question_id", "db_id").join(known, "db_id", "left_semi")
    label = hardness.select("question_id", F.col("hardness").alias("label")) if hardness is not None else asked.select("question_id", F.lit(None).cast("string").alias("label"))
    asked = asked.join(label, "question_id", "left").select("question_id", "db_id", F.coalesce("label", F.lit("unknown")).alias("hardness"))
    own = link_elements(gold).select("question_id", "level", "kt", "kc", F.lit(True).alias("is_gold"), F.lit(0).alias("times"), F.lit(None).cast("struct<pos:int,raw:string>").alias("as_written"))
    given = link_elements(predictions).select("question_id", "level", "kt", "kc", F.lit(False).alias("is_gold"), F.lit(1).alias("times"), F.struct("pos", "raw").alias("as_written"))
    flags = own.unionByName(given).groupBy("question_id", "level", "kt", "kc").agg(F.max("is_gold").alias("is_gold"), F.sum("times").alias("times"), F.collect_list("as_written").alias("as_written"))
    flags = flags.withColumn("is_predicted", F.col("times") > 0).join(asked, "question_id", "right")
    have = known_rows(known).distinct().withColumn("is_known", F.lit(True))
    flags = flags.join(have, ["db_id", "level", "kt", "kc"], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    flags = flags.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_gold", "is_predicted")})
    wrong = flags.where("is_predicted and not is_known").select("question_id", "level", F.explode("as_written").alias("w"))
    names = lambda level: F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.col("w")))), lambda w: w["raw"])
    lists = wrong.groupBy("question_id").agg(*[F.array_join(names(level), ",").alias(f"hallucinated_{level}s_list") for level in schemas.LEVELS])
    rows = from_flags(flags, method, tier).join(lists, "question_id", "left")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c.endswith("_list") else F.col(c) for c in schemas.PER_QUERY])


def unpaired(gold: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions without prediction, predictions without gold)."""
    return gold.join(predictions, "question_id", "left_anti"), predictions.join(gold, "question_id", "left_anti")


def aggregate(rows: DataFrame) -> DataFrame:
    """Per (method, tier), for all questions and by hardness, levels and both ways to average: columns as in schemas.AGGREGATED.

    One pass: each row counts for its own label and for "all", and partial sums meet in one shuffle.  A label outside
    schemas.HARDNESS counts in "all" only.
    """
    level = F.explode(F.array(*[F.struct(F.lit(f"{x}s").alias("level"), *[F.col(f"{x}_{n}").alias(n) for n in ("tp", "fp", "fn", "precision", "recall", "f1", "srr_hit")]) for x in schemas.LEVELS]))
    long = rows.select("method", "tier", "hardness", "hallucination_rate", level.alias("m")).select("method", "tier", "hardness", "hallucination_rate", "m.*")
    long = long.withColumn("hardness", F.explode(F.array(F.lit("all"), F.when(F.col("hardness").isin(*schemas.HARDNESS), F.col("hardness"))))).where("hardness is not null")
    g = long.groupBy("method", "tier", "level", "hardness").agg(
        F.count("*").alias("n_queries"), F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg(F.col("srr_hit").cast("double")).alias("srr"), F.avg("hallucination_rate").alias("hallucination_rate"),
    )
    micro = M.from_counts(F.col("tp"), F.col("fp"), F.col("fn"))
    both = F.explode(F.array(
        F.struct(F.lit("macro").alias("aggregation"), F.col("p").alias("precision"), F.col("r").alias("recall"), F.col("f").alias("f1")),
        F.struct(F.lit("micro").alias("aggregation"), *[micro[n].alias(n) for n in ("precision", "recall", "f1")]),
    ))
    rows = g.select("method", "tier", "level", "hardness", "n_queries", "srr", "hallucination_rate", both.alias("a")).select("*", "a.*")
    return rows.withColumn("f6", M.f_beta(F.col("precision"), F.col("recall"), 6.0)).select(*schemas.AGGREGATED)


def headline(aggregated: DataFrame) -> DataFrame:
    return aggregated.where("aggregation = 'macro' and hardness = 'all'")


def pooled(gold: DataFrame, predictions: DataFrame, kind: str) -> DataFrame:
    """Validation of one source of gold by another: pooled counts over questions that both have, F1 0 without any agreement.

    ``kind``: tables or columns.  The strict-recall denominator keeps the questions that have no prediction.
    """
    p = predictions.select(F.col("question_id").alias("pid"), F.col(kind).alias("p"))
    rows = gold.join(p, gold["question_id"] == p["pid"], "left")
    counts = M.set_counts(F.col("p"), F.col(kind))
    tp, fp, fn = (F.coalesce(F.sum(counts[n]), F.lit(0)).alias(n) for n in ("tp", "fp", "fn"))
    sums = rows.agg(tp, fp, fn, F.avg(F.coalesce(counts["srr_hit"], F.lit(False)).cast("double")).alias("srr"))
    prec, rec = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    zero = F.lit(0.0)
    return sums.select(F.lit(kind).alias("level"), F.coalesce(prec, zero).alias("precision"), F.coalesce(rec, zero).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"), "srr", "tp", "fp", "fn")

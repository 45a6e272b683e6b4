"""Analyses of results: comparisons, profiles, failures, distributions, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.scale import quantiles


def describe(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear interpolation) and max.

    Quartiles come from radix selection, so no task holds a group's values.  Groups with a null key are one group.  A table without
    rows has no groups.
    """
    named = rows.withColumns({f"__by_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by})
    named, keys = (named, [f"__by_{c}" for c in by]) if by else (named.withColumn("__every", F.lit("")), ["__every"])
    g = named.groupBy(*by, *keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(named, value, (0.25, 0.5, 0.75), keys)
    return g.join(q, keys, "left").select(*by, "count", "mean", "std", "min", *[F.get("quantiles", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def value_counts(rows: DataFrame, value: str, domain: Sequence[str] | None = None) -> DataFrame:
    """value, n; with a domain in its order and 0 for what does not occur."""
    g = rows.groupBy(value).agg(F.count("*").alias("n"))
    if domain is None:
        return g
    listed = rows.sparkSession.createDataFrame([(i, d) for i, d in enumerate(domain)], f"ord int, {value} string")
    return F.broadcast(listed).join(g, value, "left").select("ord", value, F.coalesce("n", F.lit(0)).alias("n"))


def most_frequent(rows: DataFrame, by: Sequence[str], n: int = 10) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


def quadrants(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a, "a_only").when(b, "b_only").otherwise("neither")


def win_loss(rows: DataFrame, method_a: str, method_b: str, tier: str) -> DataFrame:
    """question_id, quadrant for full strict recall (tables and columns) of two methods."""
    hit = F.col("table_srr_hit") & F.col("column_srr_hit")
    side = lambda m, name: rows.where((F.col("method") == m) & (F.col("tier") == tier)).select("question_id", hit.alias(name))
    return side(method_a, "a").join(side(method_b, "b"), "question_id").select("question_id", quadrants(F.col("a"), F.col("b")).alias("quadrant"))


def crosstab(rows: DataFrame, a: str, b: str, domain: Sequence) -> DataFrame:
    return rows.groupBy(a).pivot(b, list(domain)).agg(F.count(F.lit(1))).na.fill(0)


def bucket_means(rows: DataFrame, by: str, bucket: str, domain: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(by).pivot(bucket, list(domain)).agg(F.avg(value))


def compare_wide(aggregated: DataFrame, methods: Sequence[str], metrics: Sequence[str] = ("precision", "recall", "f1", "srr")) -> DataFrame:
    """One row per (tier, level); a column per method and metric."""
    return aggregated.groupBy("tier", "level").pivot("method", list(methods)).agg(*[F.first(m).alias(m) for m in metrics])


def tier_asymmetry(aggregated: DataFrame) -> DataFrame:
    """F1 of tier 2 less tier 1, per method and level."""
    f1 = lambda t: F.max(F.when(F.col("tier") == t, F.col("f1")))
    return aggregated.groupBy("method", "level").agg(f1("tier1").alias("tier1_f1"), f1("tier2").alias("tier2_f1")).withColumn("gap", F.col("tier2_f1") - F.col("tier1_f1"))


def asymmetry_ratio(gaps: DataFrame, above: str, below: str) -> DataFrame:
    """gap of one method over that of another, per level."""
    g = lambda m: F.max(F.when(F.col("method") == m, F.col("gap")))
    return gaps.groupBy("level").agg(F.try_divide(g(above), g(below)).alias("ratio"))


def union_against_parts(aggregated: DataFrame, parts: Sequence[str], union: str) -> DataFrame:
    """Whether the union beats its better part in F1 and F6, and what precision it costs."""
    value = lambda m, k: F.max(F.when(F.col("method") == m, F.col(k)))
    out = []
    for k in ("f1", "f6"):
        best = F.greatest(*[value(p, k) for p in parts])
        out += [best.alias(f"best_part_{k}"), value(union, k).alias(f"union_{k}"), (value(union, k) > best).alias(f"union_wins_{k}")]
    out += [(value(p, "precision") - value(union, "precision")).alias(f"precision_cost_{p}") for p in parts]
    return aggregated.groupBy("tier", "level").agg(*out)


def per_dollar(aggregated: DataFrame, costs: DataFrame, n_questions: int) -> DataFrame:
    """F1, cost per question and F1 per dollar of methods; costs: method, cost_usd."""
    rows = aggregated.join(costs, "method").withColumn("cost_per_question", F.col("cost_usd") / n_questions)
    return rows.withColumn("f1_per_dollar", F.try_divide("f1", "cost_per_question"))


def gain_per_dollar(a: DataFrame, b: DataFrame) -> DataFrame:
    """What b gains over a, per added dollar; both as ``per_dollar``."""
    x = a.select("tier", "level", F.col("f1").alias("a_f1"), F.col("cost_per_question").alias("a_cost"))
    rows = x.join(b, ["tier", "level"]).select("tier", "level", (F.col("f1") - F.col("a_f1")).alias("gain"), (F.col("cost_per_question") - F.col("a_cost")).alias("extra"))
    return rows.withColumn("gain_per_dollar", F.try_divide("gain", "extra"))


def hallucination_profile(rows: DataFrame, *by: str) -> DataFrame:
    n = F.col("table_hallucinated") + F.col("column_hallucinated")
    return rows.groupBy(*by).agg(F.sum("table_hallucinated").alias("tables"), F.sum("column_hallucinated").alias("columns"), F.count_if(F.col("hallucination_rate") > 0).alias("questions"), F.avg("hallucination_rate").alias("mean_rate"), F.max(n).alias("most"))


def hallucination_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy((F.col("table_hallucinated") + F.col("column_hallucinated")).alias("elements")).agg(F.count("*").alias("questions"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """bin (1 to bins), n; the last bin takes its right end; values outside are left out."""
    v = F.col(value)
    b = F.when(v == high, bins).otherwise(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)))
    return rows.where(v.between(low, high)).groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def calibration(scored: DataFrame, *by: str) -> DataFrame:
    """Means and population deviations of true and false positives' scores, their gap and a verdict.  scored: score, is_gold."""
    hit, miss = F.when(F.col("is_gold"), F.col("score")), F.when(~F.col("is_gold"), F.col("score"))
    g = scored.groupBy(*by).agg(F.avg(hit).alias("tp_mean"), F.stddev_pop(hit).alias("tp_std"), F.avg(miss).alias("fp_mean"), F.stddev_pop(miss).alias("fp_std"))
    gap = F.col("tp_mean") - F.col("fp_mean")
    return g.withColumn("gap", gap).withColumn("verdict", F.when(gap >= 0.20, "well separated").when(gap >= 0.10, "partly separated").otherwise("overlapping"))


def calibration_of_sums(sums: DataFrame) -> DataFrame:
    """As ``calibration``, from counts and sums of scores.  sums: is_gold, n, total, square."""
    side = lambda c, gold: F.sum(F.when(F.col("is_gold") == gold, F.col(c)))
    mean = {g: side("total", g) / side("n", g) for g in (True, False)}
    deviation = {g: F.sqrt(F.greatest(side("square", g) / side("n", g) - mean[g] * mean[g], F.lit(0.0))) for g in (True, False)}
    g = sums.agg(mean[True].alias("tp_mean"), deviation[True].alias("tp_std"), mean[False].alias("fp_mean"), deviation[False].alias("fp_std"))
    gap = F.col("tp_mean") - F.col("fp_mean")
    return g.withColumn("gap", gap).withColumn("verdict", F.when(gap >= 0.20, "well separated").when(gap >= 0.10, "partly separated").otherwise("overlapping"))


def issue_counts(refs: DataFrame) -> DataFrame:
    return refs.select(F.explode("issues").alias("i")).groupBy(F.col("i.kind").alias("kind")).agg(F.count("*").alias("n"))


def clean_or_flawed(refs: DataFrame) -> DataFrame:
    return refs.groupBy((F.size("issues") == 0).alias("clean")).agg(F.count("*").alias("n"))


def link_summary(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("n"), F.avg(F.size("tables")).alias("mean_tables"), F.avg(F.size("columns")).alias("mean_columns"))


def contributions(united: DataFrame) -> DataFrame:
    """Totals and means of what each method of a union gives; united: as votes.union."""
    out = []
    for level in ("tables", "columns"):
        for part in ("both", "forward_only", "backward_only"):
            out += [F.sum(f"{level}_{part}").alias(f"{level}_{part}_total"), F.avg(f"{level}_{part}").alias(f"{level}_{part}_mean")]
    return united.agg(*out)


def endpoint_quality(rows: DataFrame) -> DataFrame:
    """Shares of questions whose endpoints are among, and equal, the gold tables.  rows: endpoints, gold arrays."""
    inside = F.size(F.array_except("endpoints", "gold")) == 0
    equal = inside & (F.size(F.array_except("gold", "endpoints")) == 0)
    return rows.agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("subset_share"), F.avg(equal.cast("double")).alias("equal_share"))


def endpoint_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id, intersects, n_both, n_a_only, n_b_only: the tables of two methods, for the questions that both have."""
    other = b.select("question_id", F.array_distinct("tables").alias("__other"))
    rows = a.select("question_id", F.array_distinct("tables").alias("tables")).join(other, "question_id")
    n = {"n_both": F.array_intersect("tables", "__other"), "n_a_only": F.array_except("tables", "__other"), "n_b_only": F.array_except("__other", "tables")}
    return rows.select("question_id", F.arrays_overlap("tables", "__other").alias("intersects"), *[F.size(x).cast("long").alias(k) for k, x in n.items()])


def pathology_and_rescue(rows: DataFrame) -> DataFrame:
    """Adds pathology (good endpoints, but the path adds tables beyond tier 2) and rescue (endpoints lack tables of tier 1, the path adds some of tier 2).

    rows: endpoints, path, tier1, tier2 arrays.
    """
    added = F.array_except("path", "endpoints")
    subset = lambda a, b: F.size(F.array_except(a, b)) == 0
    pathology = subset("endpoints", "tier2") & (F.size(F.array_except(added, "tier2")) > 0)
    rescue = subset("endpoints", "tier1") & (F.size(F.array_except("tier1", "endpoints")) > 0) & (F.size(F.array_intersect(added, "tier2")) > 0)
    return rows.withColumn("pathology", pathology).withColumn("rescue", rescue)


def failure_category(rows: DataFrame) -> DataFrame:
    """Adds category, the first that applies.  rows: issues, pt, pc (predicted), t1, c1, t2, c2 (tiers), bad_t, bad_c (not in the schema)."""
    some = lambda x: F.size(x) > 0
    return rows.withColumn(
        "category",
        F.when(F.exists("issues", lambda i: i["kind"] == "parse_error"), "parse")
        .when(some("bad_t"), "hallucinated table").when(some("bad_c"), "hallucinated column")
        .when(some(F.array_except("t1", "pt")), "missed table").when(some(F.array_except("c1", "pc")), "missed column")
        .when(some(F.array_except(F.array_intersect("pc", "c2"), "c1")), "excess join column").otherwise("other"),
    )


def dominant(rows: DataFrame, category: str, least: int = 3) -> DataFrame:
    """The most frequent category, if it occurs ``least`` times."""
    return rows.groupBy(category).agg(F.count("*").alias("n")).orderBy(F.desc("n"), category).limit(1).where(F.col("n") >= least)


def worst(rows: DataFrame, n: int = 5) -> DataFrame:
    mean = (F.col("table_f1") + F.col("column_f1")) / 2
    return rows.withColumn("mean_f1", mean).orderBy("mean_f1", "question_id").limit(n)


def extremes(rows: DataFrame, value: str, n: int = 5, smallest: bool = True) -> DataFrame:
    return rows.orderBy(F.asc(value) if smallest else F.desc(value)).limit(n)


def version_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Questions whose mean F1 differs between two versions of a prompt."""
    mean = (F.col("table_f1") + F.col("column_f1")) / 2
    a, b = old.select("question_id", mean.alias("old_f1")), new.select("question_id", mean.alias("new_f1"))
    return a.join(b, "question_id").withColumn("delta", F.col("new_f1") - F.col("old_f1")).where("delta <> 0")


def version_summary(rows: DataFrame, *by: str) -> DataFrame:
    mean = (F.col("table_f1") + F.col("column_f1")) / 2
    return rows.groupBy(*by).agg(F.avg("table_f1").alias("table_f1"), F.avg("column_f1").alias("column_f1"), F.avg(mean).alias("mean_f1"), F.count_if(mean < 1).alias("imperfect"))


def tier_gap(tier1: DataFrame, tier2: DataFrame) -> DataFrame:
    """question_id, gap_tables, gap_columns, join_complexity: what tier 2 has beyond tier 1."""
    a = tier1.select("question_id", F.col("tables").alias("t1"), F.col("columns").alias("c1"))
    return tier2.join(a, "question_id").select("question_id", F.array_except("tables", "t1").alias("gap_tables"), F.array_except("columns", "c1").alias("gap_columns"), (F.size("tables") - F.size("t1")).cast("long").alias("join_complexity"))


def disagreements(a: DataFrame, b: DataFrame, kind: str = "tables") -> DataFrame:
    """question_id, missing (in a only), extra (in b only) where two link sets differ."""
    x = a.select("question_id", F.col(kind).alias("x"))
    rows = x.join(b.select("question_id", F.col(kind).alias("y")), "question_id").select("question_id", F.array_except("x", "y").alias("missing"), F.array_except("y", "x").alias("extra"))
    return rows.where((F.size("missing") > 0) | (F.size("extra") > 0))


def stratified(rows: DataFrame, by: str, quotas: dict[str, int], key: Column, exclude: DataFrame | None = None) -> DataFrame:
    """The first rows of each stratum by ``key`` (a hash for a sample), without ids of ``exclude``."""
    pool = rows if exclude is None else rows.join(exclude, "question_id", "left_anti")
    quota = F.lit(0)
    for k, n in quotas.items():
        quota = F.when(F.col(by) == k, n).otherwise(quota)
    ranked = pool.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return ranked.where(F.col("__rank") <= quota).drop("__rank")


def sample(rows: DataFrame, n: int, id_column: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same on every run and layout."""
    return rows.orderBy(F.xxhash64(F.lit(seed), id_column), id_column).limit(n)


def split_sizes(questions: DataFrame) -> DataFrame:
    return questions.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("db_id").alias("databases"))


def schema_sizes(columns: DataFrame, tables: DataFrame) -> DataFrame:
    c = columns.groupBy("db_id").agg(F.count("*").alias("n_columns"))
    return tables.groupBy("db_id").agg(F.count("*").alias("n_tables")).join(c, "db_id", "left").na.fill(0, ["n_columns"])


def clause_shares(rows: DataFrame, names: Sequence[str], by: str = "split") -> DataFrame:
    """split, clause, n, percent from has_<clause> columns."""
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("clause"), F.col(f"has_{n}").alias("has")) for n in names]))
    return rows.select(by, stack.alias("x")).groupBy(by, F.col("x.clause").alias("clause")).agg(F.count_if("x.has").alias("n"), (100 * F.avg(F.col("x.has").cast("double"))).alias("percent"))


def failures_by_hardness(failures: DataFrame, rows: DataFrame) -> DataFrame:
    """hardness, reason, n of logged failures; rows: question_id, hardness, repeats allowed."""
    labels = rows.select("question_id", "hardness").dropDuplicates(["question_id"])
    return failures.join(labels, "question_id", "left").groupBy("hardness", "reason").agg(F.count("*").alias("n"))


def common_questions(*links: DataFrame) -> DataFrame:
    """question_id that all link sets have."""
    out = links[0].select("question_id").distinct()
    for other in links[1:]:
        out = out.join(other, "question_id", "left_semi")
    return out


def strategy_means(rows: DataFrame) -> DataFrame:
    """Mean F1 per strategy of the self-consistency ablation; rows: strategy and a per-query table's columns."""
    return rows.groupBy("strategy").agg(F.avg("table_f1").alias("table_f1"), F.avg("column_f1").alias("column_f1"))

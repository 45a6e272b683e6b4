"""Queries over small written-out tables, for operators that the driver's tables do not feed; the expected rows are worked out by hand."""

from __future__ import annotations

from collections.abc import Callable

import star
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import metrics as M
from linkspark.functions import text as X
from linkspark.operators import analytics, difficulty, evaluation, graph, ledger, sqlrefs, stats, tuning, votes
from linkspark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(names: str, *rows: tuple, **casts: str) -> Callable[[Query], Query]:
    """Registers a query with the rows it must give; casts: SQL types of columns."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        columns = ", ".join(f"{n}::{casts[n]} as {n}" if n in casts else n for n in names.split())
        ORACLES[f.__name__] = f"select {columns} from {star.values(list(rows), *names.split())}"
        return f

    return register


def _joined(c: str):
    return F.array_join(F.array_sort(c), ",").alias(c)


@case("id band", (1, "p < .001"), (2, "p < .05"), (3, "p < .05"), (4, "n.s."), (5, "n.s."), id="bigint")
def case_p_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 0.0009), (2, 0.001), (3, 0.0499), (4, 0.05), (5, 1.0)], "id bigint, p double")
    return rows.select("id", M.p_band(F.col("p")).alias("band"))


@case("id t c", (1, "town", "name"), (2, "town", None), (3, "a", "b.c"), id="bigint")
def case_label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = X.after_first_dot(F.col("x"))
    return spark.createDataFrame([(1, "town.name"), (2, "town"), (3, "a.b.c")], "id bigint, x string").select("id", t.alias("t"), c.alias("c"))


def _links(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "question_id bigint, tables array<string>, columns array<struct<t:string,c:string>>")


@case("side question_id", ("gold only", 2), ("prediction only", 5), question_id="bigint")
def case_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "question_id bigint")
    gold, predicted = evaluation.unpaired(ids(1, 2, 3), ids(1, 3, 5))
    return gold.select(F.lit("gold only").alias("side"), "question_id").unionByName(predicted.select(F.lit("prediction only").alias("side"), "question_id"))


@case("question_id", (3,), (4,), question_id="bigint")
def case_common_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "question_id bigint")
    return analytics.common_questions(ids(1, 3, 4, 4), ids(3, 4, 9), ids(4, 3))


@case("question_id missing extra", (2, "dock", ""), (3, "", "pier,quay"), question_id="bigint")
def case_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _links(spark, [(1, ["ship"], []), (2, ["dock", "ship"], []), (3, ["ship"], [])])
    b = _links(spark, [(1, ["ship"], []), (2, ["ship"], []), (3, ["pier", "quay", "ship"], [])])
    return analytics.disagreements(a, b).select("question_id", _joined("missing"), _joined("extra"))


@case("n mean_tables mean_columns", (4, 1.25, 0.5), n="bigint", mean_tables="double", mean_columns="double")
def case_link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.link_summary(_links(spark, [(1, ["a", "b"], [("a", "x")]), (2, ["a"], []), (3, [], []), (4, ["a", "c"], [("c", "z")])]))


@case("clean n", (True, 8), (False, 2), n="bigint")
def case_clean_or_flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.catalog(spark)
    return analytics.clean_or_flawed(sqlrefs.analyse(star.questions(spark), sqlrefs.catalogs(c.columns, c.tables), False))


@case("n_ok n_failed", (9, 1), n_ok="bigint", n_failed="bigint")
def case_extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.catalog(spark)
    return sqlrefs.extraction_counts(sqlrefs.analyse(star.questions(spark), sqlrefs.catalogs(c.columns, c.tables), False))


@case("db_id n_tables n_columns", ("star", 7, 33), n_tables="bigint", n_columns="bigint")
def case_schema_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star.catalog(spark)
    return analytics.schema_sizes(c.columns, c.tables)


@case("split n databases", ("dev", 3, 2), ("train", 2, 1), n="bigint", databases="bigint")
def case_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.split_sizes(spark.createDataFrame([("dev", "x"), ("dev", "y"), ("dev", "x"), ("train", "z"), ("train", "z")], "split string, db_id string"))


_AGGREGATED = [
    ("left", "tier1", "tables", 0.9, 0.6, 0.72, 0.5, 0.6), ("left", "tier2", "tables", 0.9, 0.5, 0.64, 0.4, 0.5),
    ("right", "tier1", "tables", 0.7, 0.8, 0.75, 0.7, 0.79), ("right", "tier2", "tables", 0.7, 0.75, 0.73, 0.6, 0.74),
    ("both", "tier1", "tables", 0.65, 0.95, 0.77, 0.9, 0.94), ("both", "tier2", "tables", 0.65, 0.7, 0.68, 0.6, 0.69),
]


def _aggregated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_AGGREGATED, "method string, tier string, level string, precision double, recall double, f1 double, srr double, f6 double")


@case("method tier1_f1 tier2_f1 gap", ("left", 0.72, 0.64, -0.08), ("right", 0.75, 0.73, -0.02), ("both", 0.77, 0.68, -0.09), tier1_f1="double", tier2_f1="double", gap="double")
def case_tier_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(analytics.tier_asymmetry(_aggregated(spark)).drop("level"))


@case("level ratio", ("tables", 4.0), ratio="double")
def case_asymmetry_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(analytics.asymmetry_ratio(analytics.tier_asymmetry(_aggregated(spark)), "left", "right"))


@case(
    "tier best_part_f1 union_f1 union_wins_f1 best_part_f6 union_f6 union_wins_f6 precision_cost_left precision_cost_right",
    ("tier1", 0.75, 0.77, True, 0.79, 0.94, True, 0.25, 0.05), ("tier2", 0.73, 0.68, False, 0.74, 0.69, False, 0.25, 0.05),
    best_part_f1="double", union_f1="double", best_part_f6="double", union_f6="double", precision_cost_left="double", precision_cost_right="double",
)
def case_union_against_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(analytics.union_against_parts(_aggregated(spark), ["left", "right"], "both").drop("level"))


@case("tier left_f1 right_f1", ("tier1", 0.72, 0.75), ("tier2", 0.64, 0.73), left_f1="double", right_f1="double")
def case_compare_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.compare_wide(_aggregated(spark), ["left", "right"]).select("tier", "left_f1", "right_f1")


@case("method tier f1_per_dollar", ("left", "tier1", 36.0), ("left", "tier2", 32.0), ("right", "tier1", 15.0), ("right", "tier2", 14.6), f1_per_dollar="double")
def case_f1_per_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = spark.createDataFrame([("left", 2.0), ("right", 5.0)], "method string, cost_usd double")
    return sinks.rounded(analytics.per_dollar(_aggregated(spark), costs, 100).select("method", "tier", "f1_per_dollar"))


@case("tier gain extra gain_per_dollar", ("tier1", 0.03, 0.03, 1.0), ("tier2", 0.09, 0.03, 3.0), gain="double", extra="double", gain_per_dollar="double")
def case_gain_per_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    costs = spark.createDataFrame([("left", 2.0), ("right", 5.0)], "method string, cost_usd double")
    rows = analytics.per_dollar(_aggregated(spark), costs, 100)
    return sinks.rounded(analytics.gain_per_dollar(rows.where("method = 'left'"), rows.where("method = 'right'")).drop("level"))


@case("cap_usd", (4.75,), cap_usd="double")
def case_raised_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.rounded(ledger.raised_cap(spark.createDataFrame([(1.25,), (0.5,)], "cost_usd double")))


@case("n avg_tables avg_columns failure_rate", (4, 1.0, 0.5, 0.25), n="bigint", avg_tables="double", avg_columns="double", failure_rate="double")
def case_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, [(1, ["a", "b"], [("a", "x")]), (2, ["a"], [("a", "y")]), (3, [], []), (4, ["b"], [])]).withColumn("failed", (F.col("question_id") == 3).cast("double"))
    return ledger.run_statistics(rows).drop("within_target")


@case("hardness reason n", ("easy", "empty", 2), ("hard", "prose", 1), (None, "prose", 1), n="bigint")
def case_failures_by_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    failures = spark.createDataFrame([(1, "empty"), (1, "empty"), (2, "prose"), (9, "prose")], "question_id bigint, reason string")
    rows = spark.createDataFrame([(1, "easy"), (1, "easy"), (2, "hard")], "question_id bigint, hardness string")
    return analytics.failures_by_hardness(failures, rows)


@case("question_id quadrant", (1, "both"), (2, "a_only"), (3, "b_only"), (4, "neither"), question_id="bigint")
def case_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = {"x": [(True, True), (True, True), (True, False), (False, False)], "y": [(True, True), (False, True), (True, True), (True, False)]}
    rows = [(m, "tier1", i + 1, t, c) for m, marks in hits.items() for i, (t, c) in enumerate(marks)]
    return analytics.win_loss(spark.createDataFrame(rows, "method string, tier string, question_id bigint, table_srr_hit boolean, column_srr_hit boolean"), "x", "y", "tier1")


@case(
    "element_type n_a_only n_b_only n_both n_neither statistic p_value", ("table", 3, 1, 2, 0, 1.0, 0.625), ("column", 0, 0, 6, 0, 0.0, 1.0),
    n_a_only="bigint", n_b_only="bigint", n_both="bigint", n_neither="bigint", statistic="double", p_value="double",
)
def case_compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = {"x": (True, True, True, True, True, False), "y": (True, True, False, False, False, True)}
    rows = [(m, "tier1", i, hit, True) for m, hits in marks.items() for i, hit in enumerate(hits)] + [("x", "tier1", 99, True, False)]
    return sinks.rounded(stats.compare(spark.createDataFrame(rows, "method string, tier string, question_id bigint, table_srr_hit boolean, column_srr_hit boolean"), "x", "y").drop("method_a", "method_b", "tier"))


@case("fuzzy_threshold", (75,), fuzzy_threshold="int")
def case_pick_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(70, 0.5, 0.9), (75, 0.6, 0.4), (80, 0.6, 0.4), (85, 0.6, 0.3)], "fuzzy_threshold int, table_f1 double, column_f1 double")
    return tuning.pick_fuzzy(rows).select("fuzzy_threshold")


@case("a b", ("harbour", "sea"), ("sea", "ship"))
def case_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = spark.createDataFrame([("d", "harbour", "sea"), ("d", "sea", "ship"), ("d", "crew", "ship"), ("e", "sea", "ship")], "db_id string, a string, b string")
    return graph.induced(links, spark.createDataFrame([("d", "harbour"), ("d", "sea"), ("d", "ship")], "db_id string, name string")).select("a", "b")


@case(
    "strategy tables", ("k=1", "ship"), ("k=3 union", "dock,quay,ship"), ("k=3 majority", "dock,ship"), ("k=3 intersection", "ship"),
)
def case_vote_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(7, 0, ["ship"], []), (7, 1, ["ship", "dock"], []), (7, 2, ["dock", "ship", "quay"], [])]
    samples = spark.createDataFrame(rows, "question_id bigint, sample_idx int, tables array<string>, columns array<struct<t:string,c:string>>")
    return votes.ablation(samples, 3).select("strategy", _joined("tables"))


@case("strategy table_f1 column_f1", ("one", 0.75, 0.5), ("all", 1.0, 0.25), table_f1="double", column_f1="double")
def case_strategy_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.strategy_means(spark.createDataFrame([("one", 0.5, 1.0), ("one", 1.0, 0.0), ("all", 1.0, 0.25)], "strategy string, table_f1 double, column_f1 double"))


@case("question_id old_f1 new_f1 delta", (2, 0.5, 0.75, 0.25), (3, 1.0, 0.5, -0.5), question_id="bigint", old_f1="double", new_f1="double", delta="double")
def case_version_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda x: spark.createDataFrame(x, "question_id bigint, table_f1 double, column_f1 double")
    return analytics.version_deltas(rows([(1, 1.0, 0.5), (2, 0.5, 0.5), (3, 1.0, 1.0)]), rows([(1, 0.5, 1.0), (2, 1.0, 0.5), (3, 0.5, 0.5)]))


@case("version table_f1 column_f1 mean_f1 imperfect", ("v1", 0.75, 0.5, 0.625, 2), ("v2", 1.0, 1.0, 1.0, 0), table_f1="double", column_f1="double", mean_f1="double", imperfect="bigint")
def case_version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.version_summary(spark.createDataFrame([("v1", 1.0, 0.5), ("v1", 0.5, 0.5), ("v2", 1.0, 1.0)], "version string, table_f1 double, column_f1 double"), "version")


_PARSED = [
    (1, '{"select": [false, [[0, [0, [0, 1, false], null]]]], "from": {"table_units": [["table_unit", 0]], "conds": []}, "where": [], "groupBy": [], "having": [], "orderBy": [], "limit": null, "intersect": null, "union": null, "except": null}'),
    (2, '{"select": [false, [[3, [0, [0, 2, false], null]]]], "from": {"table_units": [["table_unit", 0]], "conds": []}, "where": [[false, 2, [0, [0, 1, false], null], 5.0, null]], "groupBy": [[0, 3, false]], "having": [], "orderBy": [], "limit": null, "intersect": null, "union": null, "except": null}'),
    (3, '{"select": [false, [[0, [0, [0, 1, false], null]]]], "from": {"table_units": [["table_unit", 0]], "conds": []}, "where": [[false, 2, [0, [0, 1, false], null], 5.0, null]], "groupBy": [[0, 3, false]], "having": [], "orderBy": ["asc", [[0, [0, 1, false], null]]], "limit": null, "intersect": null, "union": null, "except": null}'),
    (4, '{"select": [false, [[0, [0, [0, 1, false], null]]]], "from": {"table_units": [["table_unit", 0]], "conds": []}, "where": [], "groupBy": [], "having": [], "orderBy": [], "limit": null, "intersect": {}, "union": {}, "except": null}'),
]


def _parsed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PARSED, "question_id bigint, sql string")


@case("question_id hardness", (1, "easy"), (2, "medium"), (3, "hard"), (4, "extra"), question_id="bigint")
def case_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return difficulty.with_hardness(_parsed(spark)).select("question_id", "hardness")


@case("clause n percent", ("where", 2, 50.0), ("orderBy", 1, 25.0), ("limit", 0, 0.0), n="bigint", percent="double")
def case_clause_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["where", "orderBy", "limit"]
    rows = difficulty.clause_presence(_parsed(spark).withColumn("split", F.lit("dev")), *names)
    return analytics.clause_shares(rows, names).drop("split")


@case("category n", ("missed table", 3), n="bigint")
def case_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["missed table", "other", "missed table", "parse", "missed table"]
    return analytics.dominant(spark.createDataFrame([(k,) for k in kinds], "category string"), "category")


@case(
    "id category", (1, "parse"), (2, "hallucinated table"), (3, "hallucinated column"), (4, "missed table"), (5, "missed column"), (6, "excess join column"), (7, "other"), id="bigint",
)
def case_failure_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship, crew, none = [("ship", "id")], [("ship", "id"), ("crew", "ship_id")], []
    rows = [
        (1, [("parse_error",)], none, none, ["ship"], none, ["ship"], none, ["fake"], none), (2, [], ["fake"], none, ["ship"], none, ["ship"], none, ["fake"], ship),
        (3, [], ["ship"], none, ["ship"], none, ["ship"], none, [], ship), (4, [], ["crew"], none, ["ship"], ship, ["ship"], ship, [], none),
        (5, [], ["ship"], none, ["ship"], ship, ["ship"], ship, [], none), (6, [], ["ship"], crew, ["ship"], ship, ["ship"], crew, [], none),
        (7, [], ["ship", "crew"], ship, ["ship"], ship, ["ship"], ship, [], none),
    ]
    pair = "array<struct<t:string,c:string>>"
    frame = spark.createDataFrame(rows, f"id bigint, issues array<struct<kind:string>>, pt array<string>, pc {pair}, t1 array<string>, c1 {pair}, t2 array<string>, c2 {pair}, bad_t array<string>, bad_c {pair}")
    return analytics.failure_category(frame).select("id", "category")


@case("id", (3,), (1,), id="bigint")
def case_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.extremes(spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.1), (4, 0.4)], "id bigint, f1 double"), "f1", 2).select("id")

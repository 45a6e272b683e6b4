"""Runners: a linker over a split, its files, its statistics, its evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.config import COST_CAPS, PHASES, TEMPERATURE
from linkspark.operators import difficulty, evaluation, ledger, linkers, providers, stats
from linkspark.sources import readers, sinks

#: Columns beyond the links that a method's trace keeps, where its predictions have them.
TRACES = {
    "forward": ("n_samples_parsed", "n_samples_valid"),
    "backward": ("raw_sql", "parse_issues"),
    "graph": ("llm_raw", "endpoints_resolved", "hallucinated_endpoints", "dropped_columns", "failure"),
    "bidirectional": ("has_forward", "has_backward", "tables_both", "tables_forward_only", "tables_backward_only", "columns_both", "columns_forward_only", "columns_backward_only"),
}


@dataclass(frozen=True)
class Data:
    """A split's questions and the catalog."""

    questions: DataFrame
    catalog: linkers.Catalog


def load(spark: SparkSession, folder: str, split: str) -> Data:
    entries = readers.catalog_entries(spark, f"{folder}/tables.json").persist()
    return Data(readers.questions(spark, folder, split), linkers.Catalog(readers.catalog_tables(entries), readers.catalog_columns(entries), readers.foreign_keys(entries)))


def failed_share(method: str, predictions: DataFrame, k: int = 3) -> DataFrame:
    """predictions with failed, a question's share of failed answers."""
    rule = {
        "forward": lambda: 1 - F.col("n_samples_parsed") / k,
        "backward": lambda: F.exists("parse_issues", lambda i: i["kind"] == "parse_error").cast("double"),
        "graph": lambda: F.col("failure").isNotNull().cast("double"),
    }
    return predictions.withColumn("failed", rule[method]() if method in rule else F.lit(0.0))


def run(method: str, linker: linkers.Linker, data: Data, folder: str) -> DataFrame:
    """Links every question and writes predictions.json, and a trace of JSON lines where the method has one; gives the statistics.

    Model-backed predictions are computed once, into Parquet, and everything else reads that.
    """
    spark = data.questions.sparkSession
    linker(data.questions, data.catalog).write.mode("overwrite").parquet(f"{folder}/{method}")
    out = spark.read.parquet(f"{folder}/{method}")
    sinks.export_links(out, f"{folder}/{method}_predictions.json")
    if "samples" in out.columns:
        total = lambda c: F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[c], F.lit(0))).alias(f"total_{c}")
        sinks.append_lines(out.select("question_id", "db_id", F.col("samples").alias("sample_predictions"), "n_samples_parsed", "n_samples_valid", total("input_tokens"), total("output_tokens")), f"{folder}/{method}_samples")
    if method in TRACES:
        sinks.append_lines(out.join(data.questions.select("question_id", "question"), "question_id").select("question_id", "db_id", "question", "tables", "columns", *TRACES[method]), f"{folder}/{method}_trace")
    return ledger.run_statistics(failed_share(method, out))


@dataclass(frozen=True)
class Meter:
    """What a model-backed run may spend, and where its calls are logged; by default the cap of the method."""

    path: str
    model: str
    phase: str
    cap: float | None = None
    temperature: float = TEMPERATURE
    most_output: int = 4096
    prices: dict[str, tuple[float, float, float, float]] | None = None


def run_model(method: str, make: Callable[[providers.Provider], linkers.Linker], provider: providers.Provider, meter: Meter, data: Data, folder: str) -> DataFrame:
    """``run`` with a linker that asks ``provider`` under a cap: every call is logged, none is made once the ledger's total is at the cap.

    Then providers.CapExceeded is raised: no predictions are written, and the ledger has all calls that were made.
    """
    price = ledger.prices(data.questions.sparkSession, meter.prices)
    cap = COST_CAPS[method] if meter.cap is None else meter.cap
    capped = providers.metered(provider, price, meter.model, meter.temperature, meter.phase, meter.path, cap, meter.most_output, stop=True)
    return run(method, make(capped), data, folder)


def run_vector_scores(scores: DataFrame, questions: DataFrame, folder: str) -> None:
    """The raw scores of every question as JSON lines."""
    sinks.append_lines(sinks.score_lines(scores.join(questions.select("question_id", "question"), "question_id")), f"{folder}/vector_scores")


def dry_run(linker_calls, data: Data, n: int, full_size: int, kind: str) -> DataFrame:
    """Projected cost of a full run from the first ``n`` questions, against the cap of its kind.  linker_calls: questions, catalog -> ledger rows."""
    cost = ledger.projected(linker_calls(linkers.first_questions(data.questions, n), data.catalog), full_size)
    return cost.withColumn("cap_usd", F.lit(COST_CAPS[kind])).withColumn("fits", F.col("projected_usd") <= F.col("cap_usd"))


def cost_report(spark: SparkSession, paths: Sequence[str], out: str, phases: Sequence[str] = PHASES) -> DataFrame:
    """The report over ledger files (those that exist), written as CSV."""
    calls = readers.ledger(spark, paths)
    rows = ledger.report(calls.withColumn("phase", ledger.phase_of(calls)), phases)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(out)
    return rows


def evaluate(method: str, predictions: DataFrame, gold: DataFrame, tier: str, data: Data, results: str) -> DataFrame:
    """Scores a method's links against a tier and replaces its rows in results/main (keyed by method, tier, level) and results/per_query.

    Questions whose schema the catalog lacks are left out and counted in results/lacking_schema (method, tier, db_id, questions).
    """
    hardness = difficulty.with_hardness(data.questions).select("question_id", "hardness")
    known = evaluation.known_elements(data.catalog.columns, data.catalog.tables)
    rows = evaluation.per_query(gold, predictions, known, hardness, method, tier).persist()
    lacking = evaluation.lacking_schema(gold, known).select(F.lit(method).alias("method"), F.lit(tier).alias("tier"), "db_id", "questions")
    sinks.append_results(lacking, f"{results}/lacking_schema", ["method", "tier", "db_id"])
    head = evaluation.headline(evaluation.aggregate(rows))
    sinks.append_results(head, f"{results}/main", ["method", "tier", "level"])
    sinks.append_results(rows, f"{results}/per_query", ["method", "tier", "question_id"])
    return head


def compare(spark: SparkSession, results: str, method_a: str, method_b: str) -> DataFrame:
    """McNemar's test over the per-query results of two methods, kept in results/mcnemar."""
    rows = stats.compare(spark.read.parquet(f"{results}/per_query"), method_a, method_b)
    sinks.append_results(rows, f"{results}/mcnemar", ["method_a", "method_b", "tier", "element_type"])
    return spark.read.parquet(f"{results}/mcnemar").where((F.col("method_a") == method_a) & (F.col("method_b") == method_b))

"""The linkers end to end: questions and a catalog in, predictions (question_id, db_id, tables, columns, and diagnostics) out.

Linkers that ask a model do so when they are called, once for each question and sample, and keep the answers in a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark import recovery
from linkspark.config import SAMPLES, TunedVector
from linkspark.functions import text as X
from linkspark.operators import graph, lexical, prompts, providers, sqlrefs, vector, votes

Linker = Callable[[DataFrame, "Catalog"], DataFrame]
_NAMES, _PAIRS = "array<string>", "array<struct<t:string,c:string>>"


@dataclass(frozen=True)
class Catalog:
    """tables, columns and keys as the readers give them."""

    tables: DataFrame
    columns: DataFrame
    keys: DataFrame

    def blocks(self) -> DataFrame:
        return prompts.schema_blocks(self.columns, self.tables, self.keys)


def lexical_linker(threshold: float = 80) -> Linker:
    return lambda questions, catalog: lexical.link(questions, lexical.elements(catalog.columns, catalog.tables), threshold)


def vector_linker(encoder: vector.Encoder, tuned: TunedVector) -> Linker:
    def link(questions: DataFrame, catalog: Catalog) -> DataFrame:
        names = lexical.elements(catalog.columns, catalog.tables).join(catalog.tables.select(F.col("db_id").alias("tdb"), F.col("original"), F.col("name").alias("table_name")), (F.col("db_id") == F.col("tdb")) & (F.col("t") == F.col("original")))
        questions = lexical.with_schema(questions, names)
        elements = vector.encoded(vector.element_texts(names), encoder)
        scores = vector.similarity(vector.encoded(questions.withColumn("text", F.col("question")), encoder), elements)
        hits = vector.top_k(scores, {"table": tuned.table_top_k, "column": tuned.column_top_k}, {"table": tuned.table_threshold, "column": tuned.column_threshold})
        return lexical.predictions(questions, hits)

    return link


def _asked(provider: providers.Provider, messages: DataFrame, k: int) -> DataFrame:
    """The provider's answers to k samples of each message, asked for once: all branches of a linker read the written rows."""
    return recovery.written(provider(providers.samples(prompts.ordered_for_cache(messages), k)))


def _links(value: Column, key: str = "tables", least: int = 0, most: int | None = None) -> tuple[Column, Column, Column]:
    ok = X.valid_links(value, key, least, most)
    t = F.when(ok, F.try_variant_get(value, f"$.{key}", _NAMES))
    c = F.when(ok, F.transform(F.try_variant_get(value, "$.columns", "array<array<string>>"), lambda p: F.struct(p[0].alias("t"), p[1].alias("c"))))
    return ok, F.coalesce(t, F.array().cast(_NAMES)), F.coalesce(c, F.array().cast(_PAIRS))


def parsed_samples(responses: DataFrame, key: str = "tables", least: int = 0, most: int | None = None) -> DataFrame:
    """question_id, db_id, sample_idx, response, is_parsed, is_valid, tables, columns; invalid answers have empty links."""
    rows = responses.withColumn("v", X.tolerant_json(F.col("response")))
    ok, t, c = _links(F.col("v"), key, least, most)
    return rows.select("question_id", "db_id", "sample_idx", "response", F.col("v").isNotNull().alias("is_parsed"), ok.alias("is_valid"), t.alias("tables"), c.alias("columns"))


def parse_failures(parsed: DataFrame) -> DataFrame:
    """The failure log: question_id, db_id, sample_index, reason, raw_text."""
    return parsed.where("not is_valid").select(F.current_timestamp().alias("timestamp"), "question_id", "db_id", F.col("sample_idx").alias("sample_index"), F.when(F.col("is_parsed"), "schema").otherwise("json").alias("reason"), F.col("response").alias("raw_text"))


def forward_linker(provider: providers.Provider, version: str = "forward_v1", k: int = SAMPLES, rule: str = "union", examples: DataFrame | None = None) -> Linker:
    """k samples, parsed, validated and put to the vote.  What the schema lacks is not filtered.

    samples: all k as answered (sample_idx, response, is_parsed, is_valid, tables, columns, input_tokens, output_tokens), in order.
    """

    def link(questions: DataFrame, catalog: Catalog) -> DataFrame:
        messages = prompts.user_messages(questions, catalog.blocks(), version, examples)
        answers = _asked(provider, messages, k)
        parsed = parsed_samples(answers)
        whole = parsed.join(answers.select("question_id", "sample_idx", "input_tokens", "output_tokens"), ["question_id", "sample_idx"])
        sample = F.struct("sample_idx", "response", "is_parsed", "is_valid", "tables", "columns", "input_tokens", "output_tokens")
        tally = whole.groupBy("question_id").agg(F.count_if("is_parsed").alias("n_samples_parsed"), F.count_if("is_valid").alias("n_samples_valid"), F.array_sort(F.collect_list(sample)).alias("samples"))  # k rows each
        found = votes.voted_links(parsed, k, rule).join(questions.select("question_id", "db_id"), "question_id").join(tally, "question_id")
        return found.select("question_id", "db_id", "tables", "columns", "n_samples_parsed", "n_samples_valid", "samples")

    return link


def backward_linker(provider: providers.Provider, version: str = "backward_v1", examples: DataFrame | None = None) -> Linker:
    """One written query each, unfenced, whose references (lenient) are the prediction; an unreadable one predicts nothing."""

    def link(questions: DataFrame, catalog: Catalog) -> DataFrame:
        messages = prompts.user_messages(questions, catalog.blocks(), version, examples)
        answers = _asked(provider, messages, 1).select("question_id", "db_id", X.without_fence(F.coalesce("response", F.lit(""))).alias("query"))
        refs = sqlrefs.analyse(answers, sqlrefs.catalogs(catalog.columns, catalog.tables))
        pairs = F.transform("columns", lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c")))
        return refs.select("question_id", "db_id", "tables", pairs.alias("columns"), F.col("issues").alias("parse_issues")).join(answers.select("question_id", F.col("query").alias("raw_sql")), "question_id")

    return link


def graph_linker(provider: providers.Provider, version: str = "graph_endpoint_v2", examples: DataFrame | None = None, with_keys: bool = False) -> Linker:
    """One answer with core tables, which foreign keys connect; columns stay if the schema has them and their table is on the way.

    ``with_keys`` adds the foreign-key columns of the way (an option, off by default).
    """

    def link(questions: DataFrame, catalog: Catalog) -> DataFrame:
        messages = prompts.user_messages(questions, catalog.blocks(), version, examples)
        parsed = parsed_samples(_asked(provider, messages, 1), "core_tables", 1, 3)
        edges = graph.edges(catalog.columns, catalog.keys)
        routes = graph.paths(catalog.tables.select("db_id", F.col("original").alias("name")), edges)
        named = parsed.select("question_id", "db_id", F.posexplode("tables").alias("pos", "name"))
        ends = graph.resolve(named, catalog.tables).groupBy("question_id", "db_id").agg(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("resolved").isNotNull(), F.struct("pos", "resolved")))), lambda x: x["resolved"])).alias("ends"),
            F.count_if(F.col("resolved").isNull()).alias("hallucinated_endpoints"),
        )
        joined = graph.connect(ends.where(F.size("ends") > 0), routes)
        wanted = parsed.select("question_id", "db_id", F.posexplode("columns").alias("pos", "p"))
        known = catalog.columns.select(F.col("db_id").alias("kdb"), F.col("table_original").alias("kt"), F.col("col_original").alias("kc"))
        found = wanted.join(known, (F.col("db_id") == F.col("kdb")) & (X.canonical(F.col("p.t")) == X.canonical(F.col("kt"))) & (X.canonical(F.col("p.c")) == X.canonical(F.col("kc"))), "left")
        found = found.join(joined.select("question_id", F.col("tables").alias("way")), "question_id", "left").withColumn("on_way", F.coalesce(F.array_contains("way", F.col("kt")), F.lit(False)))
        columns = found.groupBy("question_id").agg(F.array_sort(F.collect_set(F.when(F.col("on_way"), F.struct(F.col("kt").alias("t"), F.col("kc").alias("c"))))).alias("columns"), F.count_if(~F.col("on_way")).alias("dropped_columns"))
        rows = parsed.select("question_id", "db_id", "is_valid", F.col("response").alias("llm_raw")).join(ends.drop("db_id"), "question_id", "left").join(joined.drop("db_id"), "question_id", "left").join(columns, "question_id", "left")
        rows = rows.select(
            "question_id", "db_id", F.coalesce("tables", F.array().cast(_NAMES)).alias("tables"), F.coalesce("columns", F.array().cast(_PAIRS)).alias("columns"), F.coalesce("ends", F.array().cast(_NAMES)).alias("endpoints_resolved"),
            F.coalesce("hallucinated_endpoints", F.lit(0)).alias("hallucinated_endpoints"), F.coalesce("dropped_columns", F.lit(0)).alias("dropped_columns"), "llm_raw",
            F.when(~F.col("is_valid"), "parse").when(F.coalesce(F.size("ends"), F.lit(0)) == 0, "no_valid_endpoints").alias("failure"),
        )
        if with_keys:
            extra = graph.key_columns(edges, rows).withColumnRenamed("columns", "key_columns")
            rows = rows.join(extra, "question_id", "left").withColumn("columns", F.array_sort(F.array_union("columns", F.coalesce("key_columns", F.array().cast(_PAIRS))))).drop("key_columns")
        return rows

    return link


def bidirectional_linker(forward: DataFrame, backward: DataFrame) -> Linker:
    """The union of two finished predictions, for every question; one that neither has predicts nothing."""

    def link(questions: DataFrame, catalog: Catalog | None = None) -> DataFrame:
        both = votes.union(forward, backward).drop("db_id")
        rows = questions.select("question_id", "db_id").join(both, "question_id", "left")
        return rows.withColumn("tables", F.coalesce("tables", F.array().cast(_NAMES))).withColumn("columns", F.coalesce("columns", F.array().cast(_PAIRS)))

    return link


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    """A dry run's questions."""
    return questions.orderBy("question_id").limit(n)


def evaluate_method(questions_gold: DataFrame, predicted: DataFrame, catalog: Catalog, hardness: DataFrame, method: str, tier: str) -> tuple[DataFrame, DataFrame]:
    """(headline rows, per-query rows) of one method."""
    from linkspark.operators import evaluation as E

    rows = E.per_query(questions_gold, predicted, E.known_elements(catalog.columns, catalog.tables), hardness, method, tier)
    return E.headline(E.aggregate(rows)), rows

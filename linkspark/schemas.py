"""Row types of the data model, as DDL where readers and writers share them."""

from __future__ import annotations

from pyspark.sql import types as T

PAIR = "struct<t:string,c:string>"
LINKS = f"db_id string, tables array<string>, columns array<{PAIR}>"

QUESTION = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("question_id", T.LongType()), T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("query", T.StringType()), T.StructField("sql", T.StringType()),
])

#: Canonical link JSON: {"<qid>": {db_id, tables, columns: [[t, c]]}}.
LINK_JSON = "map<string,struct<db_id:string,tables:array<string>,columns:array<array<string>>>>"

#: One entry of the catalog file; names are [table index, name] pairs, which JSON coerces to strings.
CATALOG_JSON = (
    "array<struct<db_id:string,table_names:array<string>,table_names_original:array<string>,column_names:array<array<string>>,"
    "column_names_original:array<array<string>>,column_types:array<string>,primary_keys:array<string>,foreign_keys:array<array<int>>>>"
)

ANNOTATION_JSON = "id bigint, text string, meta map<string,string>, labels array<array<string>>"

LEDGER = (
    "timestamp timestamp, model string, temperature double, prompt_hash string, input_tokens bigint, output_tokens bigint, "
    "cache_creation_input_tokens bigint, cache_read_input_tokens bigint, cost_usd double, latency_ms bigint, stop_reason string, "
    "metadata map<string,string>, response_text_hash string"
)

#: Columns of the evaluation's tables, in file order.
LEVELS = ("table", "column")
PER_LEVEL = ("tp", "fp", "fn", "precision", "recall", "f1", "srr_hit", "predicted_count", "gold_count", "hallucinated")
PER_QUERY = (
    "question_id", "db_id", "method", "tier", "hardness",
    *(f"{level}_{name}" for level in LEVELS for name in PER_LEVEL),
    "hallucination_rate", "hallucinated_tables_list", "hallucinated_columns_list",
)
AGGREGATED = ("method", "tier", "level", "hardness", "aggregation", "n_queries", "precision", "recall", "f1", "f6", "srr", "hallucination_rate")
HARDNESS = ("easy", "medium", "hard", "extra", "unknown")
CLAUSES = ("SELECT", "WHERE", "GROUP_BY", "HAVING", "ORDER_BY", "JOIN_ON", "OTHER")
ISSUES = ("parse_error", "unknown_table", "unknown_column", "unresolved_alias", "other")

MCNEMAR = ("method_a", "method_b", "tier", "element_type", "n_a_only", "n_b_only", "n_both", "n_neither", "statistic", "p_value")

#: What an example of each kind answers with, in file order.
EXAMPLE_ANSWERS = {"forward": ("tables", "columns"), "backward": ("gold_sql",), "graph": ("core_tables", "columns")}

"""Prompts as text expressions: schema blocks, few-shot blocks, user messages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Catalog types as SQL types; others are TEXT.
SQL_TYPES = {"text": "TEXT", "number": "INT", "time": "DATE", "boolean": "BOOLEAN", "others": "TEXT"}


@dataclass(frozen=True)
class Template:
    version: str
    kind: str
    system: str
    instruction: str


_RULES = "Name only what the given schema contains, and answer with the asked form alone, without prose or code fences."
_FORWARD = f"Given a schema and a question, name the tables and columns that a query for the answer must mention. Columns that only join tables are left out. {_RULES}"
_GRAPH = f"Given a schema and a question, name one to three core tables that hold the answer and its conditions, and the columns to select, filter, group or order by. {_RULES}"
TEMPLATES = {
    t.version: t
    for t in (
        Template("forward_v1", "forward", _FORWARD, "Return the relevant tables and columns as JSON."),
        Template("forward_v2", "forward", f"{_FORWARD} Leave out a table of which no column is needed.", "Return the relevant tables and columns as JSON."),
        Template("backward_v1", "backward", f"Write one SQLite query that answers the question over the schema. {_RULES}", "SQL:"),
        Template("graph_endpoint_v1", "graph", _GRAPH, "Return the core tables and needed columns as JSON."),
        Template("graph_endpoint_v2", "graph", f"{_GRAPH} Tables on the way between core tables are found without you.", "Return the core tables and needed columns as JSON."),
    )
}


def template(version: str) -> Template:
    if version not in TEMPLATES:
        raise KeyError(f"no template {version!r}; have {sorted(TEMPLATES)}")
    return TEMPLATES[version]


def schema_blocks(columns: DataFrame, tables: DataFrame, keys: DataFrame) -> DataFrame:
    """db_id, schema_block: CREATE TABLE statements with types, primary keys and foreign keys, a blank line between tables.

    Foreign keys whose index names no column are left out.
    """
    sql_type = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SQL_TYPES.items() for x in kv]), "type"), F.lit("TEXT"))
    lines = columns.select("db_id", "table_ord", F.lit(0).alias("part"), F.col("global_idx").alias("ord"), F.concat(F.lit("  "), "col_original", F.lit(" "), sql_type, F.when(F.col("is_pk"), " PRIMARY KEY").otherwise("")).alias("line"))
    side = lambda p: columns.select(F.col("db_id").alias(f"{p}db"), F.col("global_idx").alias(f"{p}i"), F.col("table_ord").alias(f"{p}ord"), F.col("table_original").alias(f"{p}t"), F.col("col_original").alias(f"{p}c"))
    f, t = side("f"), side("t")
    fk = keys.join(f, (keys["db_id"] == F.col("fdb")) & (keys["from_idx"] == F.col("fi"))).join(t, (keys["db_id"] == F.col("tdb")) & (keys["to_idx"] == F.col("ti")))
    fk = fk.select(keys["db_id"], F.col("ford").alias("table_ord"), F.lit(1).alias("part"), F.col("fk_ord").alias("ord"), F.format_string("  FOREIGN KEY (%s) REFERENCES %s(%s)", "fc", "tt", "tc").alias("line"))
    bodies = lines.unionByName(fk).groupBy("db_id", "table_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))), lambda x: x["line"]), ",\n").alias("body"))
    whole = tables.join(bodies, ["db_id", "table_ord"], "left").select("db_id", "table_ord", F.concat(F.lit("CREATE TABLE "), "original", F.lit(" (\n"), F.coalesce("body", F.lit("")), F.lit("\n);")).alias("text"))
    return whole.groupBy("db_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "text"))), lambda x: x["text"]), "\n\n").alias("schema_block"))


def answer_json(tables: Column, columns: Column, key: str = "tables") -> Column:
    """{"tables": ["a"], "columns": [["a", "b"]]}, with a space after each comma and colon."""
    quote = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    pairs = F.transform(columns, lambda p: F.concat(F.lit("["), quote(p["t"]), F.lit(", "), quote(p["c"]), F.lit("]")))
    return F.concat(F.lit(f'{{"{key}": '), listed(F.transform(tables, quote)), F.lit(', "columns": '), listed(pairs), F.lit("}"))


def example_blocks(examples: DataFrame, kind: str) -> DataFrame:
    """examples_text: all examples, numbered from 1 in the order of question_id, as one row.

    examples: question_id, schema_block (of its own schema), question and tables, columns or gold_sql; a missing block raises.
    """
    answer = F.concat(F.lit("SQL: "), "gold_sql") if kind == "backward" else F.concat(F.lit("Output: "), answer_json(F.col("tables"), F.col("columns"), "core_tables" if kind == "graph" else "tables"))
    block = F.coalesce("schema_block", F.raise_error(F.lit("an example lacks its schema block")))
    row = F.struct("question_id", F.concat(F.lit("Schema: "), block, F.lit("\nQuestion: "), "question", F.lit("\n"), answer).alias("body"))
    listed = F.transform(F.array_sort(F.collect_list(row)), lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), x["body"]))
    return examples.agg(F.array_join(listed, "\n\n").alias("examples_text"))


def user_messages(questions: DataFrame, blocks: DataFrame, version: str, examples: DataFrame | None = None) -> DataFrame:
    """question_id, db_id, system, user and a rough token count; with examples they come first.

    questions: question_id, db_id, question; blocks: db_id, schema_block; examples: as ``example_blocks`` gives them, one row.
    """
    t = template(version)
    rows = questions.join(blocks, "db_id")
    gap = "\n\n" if t.kind == "backward" else "\n"
    task = F.concat(F.lit("Schema: "), "schema_block", F.lit(gap + "Question: "), "question", F.lit("\n\n" + t.instruction))
    if examples is None:
        user = task
    else:
        rows = rows.crossJoin(F.broadcast(examples))  # one row
        user = F.concat("examples_text", F.lit("\n\nNow the real task:\n"), task)
    from linkspark.functions.text import estimated_tokens

    return rows.select("question_id", "db_id", F.lit(t.system).alias("system"), user.alias("user")).withColumn("tokens", estimated_tokens(F.concat("system", "user")))


def prompt_hash(system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\x1e", system, user), 256)


def ordered_for_cache(messages: DataFrame) -> DataFrame:
    """One schema's questions in a row, so that a provider's prefix cache is hit."""
    return messages.repartition("db_id").sortWithinPartitions("db_id", "question_id")


def conversation_text(turns: DataFrame) -> DataFrame:
    """conv_id, first_role, prompt: turns in order, "role: text" a line, and an open answer."""
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    g = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select("conv_id", "first_role", F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\nassistant:")).alias("prompt"))


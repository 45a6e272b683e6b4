"""Readers of the project's files: JSON arrays and objects, JSON lines, CSV.

A whole-file JSON document is one row for ``from_json``; positions in its arrays are ids.  Faults raise inside the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark import schemas

SPLITS = {"train": "train_spider.json", "dev": "dev.json"}
#: Fixed value: annotations without a question of the same text belong to the question of this much lower id.
ANNOTATION_OFFSET = 3616


def _whole(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True)


def _need(ok: Column, value: Column, what: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(what))


def questions(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """split, question_id, db_id, question, query, sql: question_id is the position in the split's JSON array; sql stays JSON text."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; have {sorted(SPLITS)}")
    rows = _whole(spark, f"{folder}/{SPLITS[split]}").select(F.posexplode(F.from_json("value", "array<struct<db_id:string,question:string,query:string,sql:string>>", {"mode": "FAILFAST"})).alias("question_id", "r"))
    need = lambda name: _need(F.length(F.trim(F.coalesce(f"r.{name}", F.lit("")))) > 0, F.col(f"r.{name}"), F.concat(F.lit(f"empty {name} in row "), F.col("question_id").cast("string"))).alias(name)
    return rows.select(F.lit(split).alias("split"), F.col("question_id").cast("long").alias("question_id"), need("db_id"), need("question"), need("query"), F.col("r.sql").alias("sql"))


def catalog_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per db_id of the catalog file; of repeated ids the last counts."""
    rows = _whole(spark, path).select(F.posexplode(F.from_json("value", schemas.CATALOG_JSON)).alias("pos", "r"))
    return rows.groupBy("r.db_id").agg(F.max_by("r", "pos").alias("r"))


def catalog_tables(entries: DataFrame) -> DataFrame:
    """db_id, table_ord, name, original, also of tables without columns."""
    pairs = F.transform(F.col("r.table_names_original"), lambda x, i: F.struct(i.alias("table_ord"), F.get(F.col("r.table_names"), i).alias("name"), x.alias("original")))
    return entries.select("db_id", F.inline(pairs))


def catalog_columns(entries: DataFrame) -> DataFrame:
    """db_id, table_ord, table_name, table_original, col_ord, global_idx, col_name, col_original, type, is_pk; the star column is dropped.

    Lists of names and types must be equally long.
    """
    r = F.col("r")
    same = (F.size(r["column_names"]) == F.size(r["column_names_original"])) & (F.size(r["column_names"]) == F.size(r["column_types"]))
    zipped = F.transform(r["column_names"], lambda x, i: F.struct(i.alias("global_idx"), x[0].cast("int").alias("table_ord"), x[1].alias("col_name"), r["column_names_original"][i][1].alias("col_original"), r["column_types"][i].alias("type"), F.array_contains(r["primary_keys"], i.cast("string")).alias("is_pk"), F.get(r["table_names"], x[0].cast("int")).alias("table_name"), F.get(r["table_names_original"], x[0].cast("int")).alias("table_original")))
    rows = entries.select("db_id", F.inline(F.filter(_need(same, zipped, F.concat(F.lit("lists of unequal length in "), "db_id")), lambda c: c["table_ord"] >= 0)))
    from pyspark.sql import Window

    place = Window.partitionBy("db_id", "table_ord").orderBy("global_idx")
    return rows.select("db_id", "table_ord", "table_name", "table_original", (F.row_number().over(place) - 1).alias("col_ord"), "global_idx", "col_name", "col_original", "type", "is_pk")


def foreign_keys(entries: DataFrame) -> DataFrame:
    """db_id, fk_ord, from_idx, to_idx: pairs of global column indices."""
    return entries.select("db_id", F.posexplode("r.foreign_keys").alias("fk_ord", "p")).select("db_id", "fk_ord", F.col("p")[0].alias("from_idx"), F.col("p")[1].alias("to_idx"))


#: The files of a folder of annotations.
ANNOTATION_FILES = ("dev.jsonl", "test.jsonl")


def annotation_paths(spark: SparkSession, folder: str, paths: Sequence[str] | None = None) -> list[str]:
    """``paths``, or the default files of ``folder``; one that does not exist raises FileNotFoundError."""
    found = [f"{folder}/{name}" for name in ANNOTATION_FILES] if paths is None else list(paths)
    for path in found:
        if not exists(spark, path):
            raise FileNotFoundError(f"no annotations at {path}")
    return found


def annotations(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """id, text, sql, labels: JSON lines whose label keys are looked up in ``meta``; unknown keys and repeated ids raise."""
    raw = spark.read.schema(schemas.ANNOTATION_JSON).json(paths if isinstance(paths, str) else list(paths), mode="FAILFAST").where("id is not null")
    label = lambda x: F.struct(x[0].cast("int").alias("start"), x[1].cast("int").alias("end"), F.coalesce(F.try_element_at("meta", x[2]), F.raise_error(F.concat(F.lit("no meta entry "), x[2]))).alias("label"))
    rows = raw.select("id", "text", F.try_element_at("meta", F.lit("000_sql")).alias("sql"), F.transform("labels", label).alias("labels"))
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("id"))
    checked = rows.withColumn("n", n).select(_need(F.col("n") == 1, F.col("id"), F.concat(F.lit("repeated annotation id "), F.col("id").cast("string"))).alias("id"), "text", "sql", "labels")
    return checked


def links(spark: SparkSession, path: str) -> DataFrame:
    """question_id, db_id, tables, columns of a qid-keyed JSON object."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", schemas.LINK_JSON)).alias("k", "v"))
    pairs = F.transform("v.columns", lambda p: F.struct(p[0].alias("t"), p[1].alias("c")))
    return rows.select(F.col("k").cast("long").alias("question_id"), "v.db_id", F.coalesce("v.tables", F.array().cast("array<string>")).alias("tables"), F.coalesce(pairs, F.array().cast(f"array<{schemas.PAIR}>")).alias("columns"))


def examples(spark: SparkSession, path: str, blocks: DataFrame, kind: str = "forward") -> DataFrame:
    """question_id, db_id, question, pattern, the kind's answer (schemas.EXAMPLE_ANSWERS; core tables as tables) and schema_block.

    blocks: db_id, schema_block of all databases; an example whose database it lacks raises.
    """
    kinds = {"tables": "array<string>", "core_tables": "array<string>", "columns": "array<array<string>>", "gold_sql": "string"}
    names = schemas.EXAMPLE_ANSWERS[kind]
    fields = ",".join(["question_id:bigint,db_id:string,question:string,pattern:string", *(f"{n}:{kinds[n]}" for n in names)])
    rows = _whole(spark, path).select(F.inline(F.from_json("value", f"array<struct<{fields}>>", {"mode": "FAILFAST"})))
    if "columns" in names:
        rows = rows.withColumn("columns", F.transform("columns", lambda p: F.struct(p[0].alias("t"), p[1].alias("c"))))
    found = rows.withColumnRenamed("core_tables", "tables").join(blocks.select("db_id", "schema_block"), "db_id", "left")
    block = F.coalesce("schema_block", F.raise_error(F.concat(F.lit("no schema for example database "), "db_id")).cast("string"))
    return found.select("question_id", "db_id", "question", "pattern", *["tables" if n == "core_tables" else n for n in names], block.alias("schema_block"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """cache_key and vec of the encoder cache; an empty cache if there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "cache_key string, vec array<float>")
    return spark.read.parquet(path).select("cache_key", "vec")


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ledger(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of the call ledger; paths that do not exist are left out, blank lines too."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schemas.LEDGER)
    return spark.read.schema(schemas.LEDGER).json(found).where("model is not null or cost_usd is not null or metadata is not null")


def text_or_id(notes: DataFrame, examples: DataFrame) -> DataFrame:
    """id, question_id, by_id: each note's example by equal text (the last of several), else by id less ANNOTATION_OFFSET.

    notes: id, note; examples: doc_id, text.  Texts are compared themselves, not their hashes; notes that match none are left out.
    """
    by_text = examples.where("text is not null").groupBy("text").agg(F.max("doc_id").alias("q"))
    found = notes.join(by_text, notes["note"] == by_text["text"], "left").select("id", "q")
    found = found.join(examples.select(F.col("doc_id").alias("i")).distinct(), F.col("id") - ANNOTATION_OFFSET == F.col("i"), "left")
    return found.select("id", F.coalesce("q", "i").alias("question_id"), F.col("q").isNull().alias("by_id")).where("question_id is not null")


def annotation_links(notes: DataFrame, examples: DataFrame, columns: DataFrame, tables: DataFrame, most_bad: float = 0.01) -> DataFrame:
    """question_id, db_id, tables, columns from annotations: by equal question text, else by id less 3616.

    Of questions with one text the last counts; notes that match none are left out; several notes of a question are united.
    Labels are names compared with case; if more than ``most_bad`` of them name no table or column, the plan raises.
    """
    by_text = examples.groupBy(F.col("question").alias("q")).agg(F.max_by(F.struct("question_id", "db_id"), "question_id").alias("by_text"))
    by_id = examples.select(F.col("question_id").alias("i"), F.struct("question_id", "db_id").alias("by_id"))
    found = notes.join(by_text, notes["text"] == F.col("q"), "left").join(by_id, (notes["id"] - ANNOTATION_OFFSET == F.col("i")) & F.col("by_text").isNull(), "left")
    found = found.select(F.coalesce("by_text", "by_id").alias("m"), "labels").where("m is not null").select("m.question_id", "m.db_id", F.explode_outer("labels.label").alias("label"))
    parts = F.split("label", r"\.", 2)
    named = found.select("question_id", "db_id", "label", parts[0].alias("t"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).alias("c"))
    known_t = tables.select(F.col("db_id").alias("kd"), F.col("original").alias("kt")).distinct()
    known_c = columns.select(F.col("db_id").alias("cd"), F.col("table_original").alias("ct"), F.col("col_original").alias("cc")).distinct()
    checked = named.join(known_t, (named["db_id"] == F.col("kd")) & (named["t"] == F.col("kt")), "left").join(known_c, (named["db_id"] == F.col("cd")) & (named["t"] == F.col("ct")) & (named["c"] == F.col("cc")), "left")
    good = F.col("kt").isNotNull() & (F.col("c").isNull() | F.col("cc").isNotNull())
    checked = checked.withColumn("good", good | F.col("label").isNull())
    share = checked.agg(F.coalesce(F.avg(F.when(F.col("label").isNotNull(), (~F.col("good")).cast("double"))), F.lit(0.0)).alias("share"))
    guarded = checked.crossJoin(F.broadcast(share.select(F.assert_true(F.col("share") <= most_bad, F.lit("too many labels name nothing in the schema")).isNull().alias("passed"))))
    kept = guarded.where("passed").withColumn("use", F.col("good") & F.col("label").isNotNull())
    pair = F.struct("t", "c")
    return kept.groupBy("question_id", "db_id").agg(F.array_sort(F.collect_set(F.when(F.col("use"), F.col("t")))).alias("tables"), F.array_sort(F.collect_set(F.when(F.col("use") & F.col("c").isNotNull(), pair))).alias("columns"))

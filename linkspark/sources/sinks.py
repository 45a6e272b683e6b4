"""Writers: canonical link files, result tables, keyed upsert, JSON lines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.schemas import EXAMPLE_ANSWERS
from linkspark.sources.readers import exists


def canonical(predictions: DataFrame) -> DataFrame:
    """The columns of a link file; diagnostics are dropped."""
    return predictions.select("question_id", "db_id", "tables", "columns")


def export_links(links: DataFrame, path: str) -> None:
    """One JSON object keyed by question id in ascending order, on the driver's disk; rows are streamed, not collected."""
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    with out.open("w", encoding="utf-8") as file:
        file.write("{")
        for i, r in enumerate(canonical(links).orderBy("question_id").toLocalIterator()):
            body = {"db_id": r["db_id"], "tables": list(r["tables"]), "columns": [[p["t"], p["c"]] for p in r["columns"]]}
            file.write(("," if i else "") + f'\n  "{r["question_id"]}": ' + json.dumps(body, ensure_ascii=False, indent=2).replace("\n", "\n  "))
        file.write("\n}\n")


def export_examples(examples: DataFrame, path: str, kind: str = "forward") -> None:
    """The picked examples (one of each pattern, so few) as one JSON array on the driver's disk, for review.

    kind: forward (tables and columns), backward (gold_sql) or graph (core_tables and columns).
    """
    names = ["question_id", "db_id", "question", "pattern", *EXAMPLE_ANSWERS[kind]]
    plain = lambda r: {n: [list(p) for p in r[n]] if n == "columns" else r[n] for n in names}
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    rows = [plain(r) for r in examples.select(*names).toLocalIterator()]
    out.write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")


def write_tables(results: Sequence[tuple[DataFrame, DataFrame]], aggregated: str, per_query: str) -> None:
    """Both evaluation tables of all results, concatenated, as CSV with a header (an empty table too)."""
    for i, path in enumerate((aggregated, per_query)):
        reduce(DataFrame.unionByName, [r[i] for r in results]).write.mode("overwrite").option("header", True).csv(path)


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` without the rows whose keys ``new`` has (null keys are equal), and ``new``."""
    named = new.select(*[F.col(k).alias(f"__new_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [existing[k].eqNullSafe(named[f"__new_{k}"]) for k in keys])
    return existing.join(named, same, "left_anti").unionByName(new)


def append_results(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Keyed upsert into a Parquet table: written beside it, then swapped in.

    The old table is moved aside first and deleted last.  After a crash in between it is found there by the next call.
    """
    spark = new.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def move(a: str, b: str) -> None:
        if not files.rename(place(a), place(b)):
            raise OSError(f"cannot move {a} to {b}")

    side, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    if exists(spark, old):
        if exists(spark, path):
            files.delete(place(old), True)
        else:
            move(old, path)
    kept = exists(spark, path)
    rows = upserted(spark.read.parquet(path), new, keys) if kept else new
    rows.write.parquet(side)
    if kept:
        move(path, old)
    move(side, path)
    files.delete(place(old), True)


def append_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, appended: call ledger, failures, extraction errors, samples, traces."""
    rows.write.mode("append").json(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """question_id, db_id, question, table_scores, column_scores from long scores (question_id, db_id, question, level, t, c, score)."""
    name = F.when(F.col("level") == "table", F.col("t")).otherwise(F.concat_ws(".", "t", "c"))
    part = lambda level: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct(name.alias("k"), F.col("score").alias("v"))))))
    return scores.groupBy("question_id", "db_id", "question").agg(part("table").alias("table_scores"), part("column").alias("column_scores"))


def best_rows(sweep: DataFrame, by: Sequence[str], n: int = 20) -> DataFrame:
    return sweep.orderBy(*[F.desc(c) for c in by]).limit(n)


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    return table.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in table.dtypes])


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Encoder cache: Parquet by key prefix."""
    vectors.withColumn("prefix", F.substring("cache_key", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)

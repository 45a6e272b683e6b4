"""Vector linking: cosine of unit vectors, top k per question, threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Encoder = Callable[[Sequence[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """A deterministic stand-in for a language model: signed hashes of words and letter triples, unit norm (zero for no words)."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            for part in [*words, *(f"^{w}$"[j : j + 3] for w in words for j in range(len(w)))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(out[i])
            if norm:
                out[i] /= norm
        return out

    return encode


def element_texts(names: DataFrame) -> DataFrame:
    """Adds text: a table's name, or "column of table", in human names.  names: level, name, table_name."""
    return names.withColumn("text", F.when(F.col("level") == "table", F.col("name")).otherwise(F.concat("name", F.lit(" of "), "table_name")))


def encoded(rows: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds vec array<float>; texts are encoded in Arrow batches."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(encoder(part.tolist())) if len(part) else [], dtype=object)

    return rows.withColumn("vec", encode(F.col(text)))


def cache_key(model: str, revision: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(revision), F.lit("v1"), text), 256)


def with_cache(rows: DataFrame, cache: DataFrame, encoder: Encoder, model: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """(rows with vec, rows to add to the cache): only texts whose key is not cached are encoded, each once.  cache: cache_key, vec."""
    keyed = rows.withColumn("cache_key", cache_key(model, revision, F.col("text")))
    fresh = encoded(keyed.select("cache_key", "text").join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"]), encoder).select("cache_key", "vec")
    return keyed.join(cache.select("cache_key", "vec").unionByName(fresh), "cache_key").drop("cache_key"), fresh


def similarity(questions: DataFrame, elements: DataFrame) -> DataFrame:
    """Long scores: question_id, db_id, level, ord, t, c, score.  Both sides carry vec; only elements of the question's database meet it."""
    q = questions.select("question_id", "db_id", F.col("vec").alias("q_vec"))
    e = elements.select(F.col("db_id").alias("edb"), "level", "ord", "t", "c", F.col("vec").alias("e_vec"))
    return q.join(e, q["db_id"] == e["edb"]).select("question_id", "db_id", "level", "ord", "t", "c", dot(F.col("q_vec"), F.col("e_vec")).alias("score"))


#: Rows of a block, on average: a task multiplies one block of questions with one of elements.
BLOCK_ROWS = 2048


def in_blocks(questions: DataFrame, elements: DataFrame, step: Callable[[np.ndarray, pa.Table, pa.Table], dict[str, object]], schema: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``step`` of every block of questions with every block of elements.

    Both sides carry vec and any other columns; step(scores, questions, elements) gets the products of two blocks as one matrix.
    Blocks are dealt by hash, as many as the counts ask for, so a task has some ``rows`` of either side whatever the tables' sizes.
    """
    sides = []
    for df in (questions, elements):
        n = max(1, -(-df.count() // rows))
        own = F.pmod(F.xxhash64(*[c for c in df.columns if c != "vec"]), F.lit(n)).cast("int")
        sides.append((df, own, n))
    (q, q_block, q_blocks), (e, e_block, e_blocks) = sides
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # columns of their own: both sides may be read from one table, whose columns would count as one when unused ones are pruned
    own = lambda df: [F.col(c).alias(c) for c in df.columns]
    q = q.select(*own(q), q_block.alias("__q"), every(e_blocks).alias("__e"))
    e = e.select(*own(e), e_block.alias("__e"), every(q_blocks).alias("__q"))

    def matrix(table: pa.Table) -> np.ndarray:
        vectors = table.column("vec").combine_chunks()
        return vectors.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = pa.schema([(n, t) for n, t in zip(arrow.names, arrow.types, strict=True)])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        return pa.table(step(matrix(left) @ matrix(right).T, left, right), schema=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return q.groupBy("__q", "__e").cogroup(e.groupBy("__q", "__e")).applyInArrow(run, schema)


def best_products(questions: DataFrame, elements: DataFrame, k: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """question_id, ord, score: the k elements of the greatest products with each question, ties by ord; its own ord is left out.

    questions: question_id, vec; elements: ord, vec.  A block gives the k best of each of its questions, so k rows a block are
    dealt for a question, never a row a pair.
    """

    def step(scores: np.ndarray, q: pa.Table, e: pa.Table) -> dict[str, object]:
        ids, ords = q.column("question_id").to_numpy(), e.column("ord").to_numpy()
        order = np.argsort(ords, kind="stable")
        scores, ords = np.where(ids[:, None] == ords[None, order], -np.inf, scores[:, order]), ords[order]
        # a score that the k-th best has may occur beyond it: stable sorting keeps the least ords first
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        kept = np.take_along_axis(scores, best, 1)
        row, column = np.nonzero(kept > -np.inf)
        return {"question_id": ids[row], "ord": ords[best[row, column]], "score": kept[row, column]}

    found = in_blocks(questions.select("question_id", "vec"), elements.select("ord", "vec"), step, "question_id long, ord long, score double", rows)
    return ranked(found, "question_id").where(F.col("rank") <= k)


def product_sums(questions: DataFrame, elements: DataFrame, low: float, high: float, bins: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """is_gold, bin, n, total, square: counts and sums of the products of all pairs, by whether their labels agree and by bin.

    questions: question_id, vec, label; elements: ord, vec, label.  Bins are 1 to ``bins`` over [low, high], the last with its right
    end; 0 and bins + 1 are below and above.  A question's own ord is left out.  A block gives a row a bin.
    """

    def step(scores: np.ndarray, q: pa.Table, e: pa.Table) -> dict[str, object]:
        gold = q.column("label").to_numpy()[:, None] == e.column("label").to_numpy()[None, :]
        other = q.column("question_id").to_numpy()[:, None] != e.column("ord").to_numpy()[None, :]
        place = np.floor((scores - low) / (high - low) * bins).astype(np.int64) + 1
        place = np.where(scores == high, bins, np.clip(place, 0, bins + 1))
        cell = (gold * (bins + 2) + place)[other]
        flat = scores[other]
        sums = [np.bincount(cell, w, 2 * (bins + 2)) for w in (None, flat, flat * flat)]
        used = np.flatnonzero(sums[0])
        return {"is_gold": used >= bins + 2, "bin": (used % (bins + 2)).astype(np.int32), "n": sums[0][used].astype(np.int64), "total": sums[1][used], "square": sums[2][used]}

    kept = lambda df, name: df.select(name, "label", "vec")
    found = in_blocks(kept(questions, "question_id"), kept(elements, "ord"), step, "is_gold boolean, bin int, n long, total double, square double", rows)
    return found.groupBy("is_gold", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "total", "square")])


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """Adds rank by descending score; ties go by ord."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "ord")))


def top_k(scores: DataFrame, k: dict[str, int], threshold: dict[str, float]) -> DataFrame:
    """The k best of each question and level, of which those from the threshold on."""
    keep = [(F.col("level") == level) & (F.col("rank") <= k[level]) & (F.col("score") >= threshold[level]) for level in k]
    condition = keep[0]
    for c in keep[1:]:
        condition = condition | c
    return ranked(scores, "question_id", "level").where(condition)

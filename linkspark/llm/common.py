"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.recovery import shared_folder

#: White space of the word rule, as a Java/RE2 class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def id_text(docs: DataFrame, *, binary: bool = False) -> DataFrame:
    """Two columns only, whatever else ``docs`` carries: doc_id as long, text with null as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).hexdigest()


def arrow_map(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow for a generator of column dicts; ``schema`` is a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in rows(batches):
            arrays = [v.cast(f.type) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def pieces(columns: list, rows: int = 2000) -> Iterator[list]:
    """Slices of equally long lists, to keep batches small."""
    for a in range(0, len(columns[0]), rows):
        yield [c[a : a + rows] for c in columns]


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Keys with more than this share of all rows are hot.  There are fewer of them than this, at any size of the input.
HOT_KEYS = 4096
HOT_ROWS = 1000


def hot_bound(total: int) -> int:
    """Rows from which on a key is hot: fewer than HOT_KEYS keys can have more than ``total`` / HOT_KEYS rows."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, holders: str = "holders") -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key, ``holders`` rows of which ``rows`` has) without a hot task.

    What hot keys need is broadcast, fewer than HOT_KEYS rows; the other keys are joined by a shuffle.
    """
    bound = hot_bound(total)
    hot = keyed.where(F.col(holders) > bound)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(F.col(holders) <= bound), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


#: A table is broadcast only after a count of its rows: up to so many.
BROADCAST_ROWS = 500_000


def short(df: DataFrame) -> DataFrame:
    """``df`` for a broadcast join, if a count finds that it has BROADCAST_ROWS rows at most; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, *order: Column, name: str = "__rank") -> DataFrame:
    """``df`` with ranks 0, 1, 2, ... in ``order``, computed once.

    Rows are dealt by ranges of ``order`` and sorted there; a row's rank is its place in its partition after the rows of all
    partitions before.  Rows that agree in ``order`` lie in one partition, so it should tell rows apart.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = checkpoint(placed)
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + place).drop("__place", "__part", "__offset")

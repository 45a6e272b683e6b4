"""Importance resampling towards a target distribution: hashed n-grams, a gain for each bucket, Gumbel keys, the top share.

All runs of one to three words are features; a feature's bucket is its CRC-32 modulo a fixed number of buckets.  A bucket's gain
is the logarithm of how much likelier the target has it than the corpus, a document's weight the sum of its features' gains.
Adding Gumbel noise that the id fixes turns "the greatest scores" into a weighted sample without replacement.

The corpus is exploded twice, for the counts and for the weights, and neither shuffles features: counts are summed before they
are dealt (BUCKETS rows a task at most), the gains are a broadcast table of BUCKETS rows, and a document's features follow each
other, so that their sums leave each task as one row a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import checkpoint, numbered

#: Fixed values.
BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: What lies between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOC = ("doc_id", "h1", "h2", "n_words")


def words(text: Column) -> Column:
    """Words of letters and digits, A-Z lower-cased and no other letter; null: none."""
    ascii_only = lambda x: F.octet_length(x) == F.char_length(x)
    cut = lambda x: F.array_remove(F.split(x, GAP), "")
    lowered = lambda x: F.when(ascii_only(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))
    # A-Z are part of no gap once they are lower; before, the gap between upper and lower letters would take them
    whole = F.coalesce(text, F.lit(""))
    mixed = F.array_remove(F.split(whole, GAP.replace(r"\x60", r"\x40\x5B-\x60")), "")
    return F.when(ascii_only(whole), cut(F.lower(whole))).otherwise(F.transform(mixed, lowered))


def features(rows: DataFrame, *names: str) -> DataFrame:
    """``names``, at (word of the run's start), k (length - 1) and bucket, of column w: a row a feature; without words one row with nulls."""
    spots = rows.select(*names, "w", F.posexplode_outer("w").alias("at", "x0"))
    runs = [F.col("x0")]
    for k in range(1, LONGEST):
        runs.append(F.concat(*[y for j in range(k + 1) for y in ([F.lit(" ")] if j else []) + [F.get("w", F.col("at") + j) if j else F.col("x0")]]))
    buckets = F.array(*[(F.crc32(run.cast("binary")) % BUCKETS).cast("int") for run in runs])
    return spots.select(*names, "at", F.posexplode(buckets).alias("k", "bucket")).where("bucket is not null or k = 0")


def counts(texts: DataFrame, name: str) -> DataFrame:
    """bucket and ``name``, the number of features in it; of texts in column text."""
    found = features(texts.select(words(F.col("text").cast("string")).alias("w"))).where("bucket is not null")
    return found.groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """bucket, gain: a row for each bucket that the corpus has, BUCKETS at most."""
    both = checkpoint(counts(docs, "s").join(counts(target, "t"), "bucket", "full_outer").na.fill(0))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * (total.s + BUCKETS) / ((F.col("s") + 1).cast("double") * (total.t + BUCKETS))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(docs: DataFrame, table: DataFrame) -> DataFrame:
    """DOC, copies, n_features, weight: one row for each different (doc_id, text)."""
    text = F.col("text").cast("string")
    key = {"doc_id": F.col("doc_id").cast("long"), "h1": F.xxhash64(text), "h2": F.xxhash64(text, F.lit(1))}
    rows = docs.select(*(c.alias(n) for n, c in key.items()), words(text).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    found = features(rows, *DOC).join(F.broadcast(table), "bucket", "left")
    first = (F.coalesce("at", F.lit(0)) == 0) & (F.col("k") == 0)
    sums = found.groupBy(*DOC).agg(F.count_if(first).alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"))
    return sums.select(*DOC, "copies", F.expr("n div copies").alias("n_features"), F.expr("gains div copies").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that the id fixes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per input row; rank is null where a row isn't drawn.

    Of the N rows with ``least`` words, floor(percent * N / 100) are drawn, the highest scores first, then the smaller doc_id.
    A null text has no words, a null doc_id has the name "null" and follows all others of its score; texts of one doc_id follow
    each other by their hash, repeated rows count each.  Any table may be empty (an empty target makes all gains follow the
    corpus alone).  Other columns are not read.
    """
    scored = checkpoint(weighted(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= least)
    drawn = (able.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n * percent) // 100
    each = able.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    ranked = numbered(each, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("h1"), F.col("h2"), F.col("copy"))
    ranked = ranked.withColumn("rank", F.when(F.col("__rank") < drawn, F.col("__rank") + 1))
    rest = scored.where(F.col("n_words") < least).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out))

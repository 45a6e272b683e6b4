"""Quality rules: measures of each text, and the frequency of lines across the documents of a host.

A line that very many documents of one host have (navigation, notices, licences) says nothing about a document.  Lines are
compared in a normal form, by 128 bits of hash, and counted once for each different text of a host, so that exact copies of a
document don't make its lines common.  Lines above the limits are removed; a document of which too little is left is depleted.

DataFrame functions only.  A text is measured within its row: the hashes of its windows are sorted there only if one repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import SPACE, checkpoint, join_hot, short

#: A line is above the limits if more than LEAST_DOCS texts of its host have it, and more than SHARE of them.
LEAST_DOCS = 20
SHARE = 0.005
#: A document is depleted if fewer words than this remain, or less than this share of them.
LEAST_WORDS = 20
LEAST_LEFT = 0.3
#: Fixed values of the measures.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MOST_REPEATED = 30

TEXT = ("__host", "__t1", "__t2")
LINE = ("__host", "__h1", "__h2")


def normal(line: Column) -> Column:
    """Lower case, white space as single spaces, none at the ends, every number as 0."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE + "+", " "))


def window_hashes(w: Column) -> Column:
    """Hashes of all runs of WINDOW words; ``w``: hashes of words."""
    run = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) >= WINDOW, run).otherwise(F.array().cast("array<bigint>"))


def covered(sorted_windows: Column) -> Column:
    """Number of words in windows whose hash occurs again; struct(h, at) sorted, so that equal hashes are neighbours."""
    at = lambda i: F.get(sorted_windows, i)["h"]
    again = F.filter(sorted_windows, lambda x, i: x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1)))
    places = F.sort_array(F.transform(again, lambda x: x["at"]))
    # a window adds the words that lie behind the end of the one before it
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    step = lambda acc, a: F.struct((acc["n"] + a + WINDOW - F.greatest(a, acc["end"])).alias("n"), (a + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def keyed(docs: DataFrame, host: str) -> DataFrame:
    """``docs`` with __text and TEXT, by which rows of one host and text are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    return docs.select("*", text.alias("__text"), name.alias("__host"), F.xxhash64(text).alias("__t1"), F.xxhash64(text, F.lit(1)).alias("__t2"))


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` (with __text) and __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __base_failed."""
    text = F.col("__text")
    rows = rows.withColumn("__w", F.array_remove(F.split(text, SPACE + "+"), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = rows.withColumn("__lines", lines).withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("__h", window_hashes(F.col("__h")))
    placed = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    rows = rows.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    measures = {
        "__n_words": F.size("__w"), "__word_chars": F.char_length(F.array_join("__w", "")), "__n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "__n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")), "__n_repeat_words": F.when(F.col("__s").isNull(), 0).otherwise(covered(F.col("__s"))),
    }
    rows = rows.withColumns({name: value.cast("long") for name, value in measures.items()})
    failed = (F.col("__n_words") < LEAST_WORDS) | (100 * F.col("__n_repeat_words") > MOST_REPEATED * F.col("__n_words"))
    return rows.withColumn("__base_failed", failed).drop("__w", "__lines", "__h", "__s")


def lines(rows: DataFrame) -> DataFrame:
    """TEXT, __at, LINE and __line: all lines with a word, in their normal form."""
    each = rows.select(*TEXT, F.posexplode(F.split("__text", "\n")).alias("__at", "__line")).withColumn("__line", normal(F.col("__line")))
    return each.where("__line <> ''").withColumn("__h1", F.xxhash64("__line")).withColumn("__h2", F.xxhash64("__line", F.lit(1)))


def frequent(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """LINE, texts (different ones of the host that have the line), limit, holders: the lines above the limits."""
    rows = keyed(docs, host)
    hosts = checkpoint(rows.groupBy(*TEXT).agg(F.count("*").alias("n")).groupBy("__host").agg(F.count("*").alias("texts"), F.sum("n").alias("rows")))
    total = hosts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    limits = hosts.select("__host", F.greatest(F.lit(least), F.floor(F.col("texts") * share)).alias("limit"), "rows")
    held = lines(rows).groupBy(*LINE, "__t1", "__t2").agg(F.count("*").alias("n")).groupBy(*LINE).agg(F.count("*").alias("texts"), F.sum("n").alias("holders"))
    found = join_hot(held.where(F.col("texts") > least), limits, ["__host"], total, holders="rows")
    return checkpoint(found.where("texts > limit").select(*LINE, "texts", "limit", "holders"))


def removed_words(docs: DataFrame, common: DataFrame, host: str = "source") -> DataFrame:
    """TEXT, removed: the number of words in frequent lines, of all texts that have such lines."""
    total = common.agg(F.coalesce(F.sum("holders"), F.lit(0)).alias("n")).first().n
    marked = join_hot(lines(keyed(docs, host)), common, list(LINE), total)
    each = marked.groupBy(*TEXT, "__at").agg(F.max(F.size(F.split("__line", " "))).alias("n"))
    return each.groupBy(*TEXT).agg(F.sum("n").alias("__removed"))


def judged(docs: DataFrame, common: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` and the measures of ``measured``, __removed (words in frequent lines) and __kept."""
    gone = checkpoint(removed_words(docs, common, host))
    rows = measured(keyed(docs, host)).join(short(gone), list(TEXT), "left").withColumn("__removed", F.coalesce("__removed", F.lit(0)))
    left = F.col("__n_words") - F.col("__removed")
    return rows.withColumn("__kept", ~F.col("__base_failed") & (left >= LEAST_WORDS) & (left >= LEAST_LEFT * F.col("__n_words")))


def quality(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept: one row per input row.

    A line goes if more than ``least`` texts of its host have it and more than ``share`` of them.  A row is kept if it passes the
    base rules and at least LEAST_WORDS words and LEAST_LEFT of them are left.  A null text is empty and fails; a null host is a
    host of its own; rows that agree in host and text count once for the limits and are judged alike.  Other columns are not
    read; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).alias("host"), "text")
    rows = judged(own, frequent(own, "host", least, share), "host")
    return rows.select("doc_id", *(F.col(f"__{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("__removed").alias("removed_words"), F.col("__kept").alias("kept"))


def filtered(docs: DataFrame, host: str = "source", least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The kept rows of ``docs`` without their frequent lines; all columns stay.  Cases as ``quality``."""
    common = frequent(docs, host, least, share)
    gone = join_hot(lines(keyed(docs, host)), common, list(LINE), common.agg(F.coalesce(F.sum("holders"), F.lit(0)).alias("n")).first().n)
    gone = checkpoint(gone.groupBy(*TEXT).agg(F.collect_set("__at").alias("__gone")))
    rows = judged(docs, common, host).where("__kept").join(short(gone), list(TEXT), "left")
    left = F.array_join(F.filter(F.split("__text", "\n"), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return rows.select(*(F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left).alias(c) if c == "text" else F.col(c) for c in docs.columns))

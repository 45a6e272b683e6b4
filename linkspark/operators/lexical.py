"""Lexical linking: substring, then token subset, then fuzzy match of element names in a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.functions.fuzzy import levenshtein_ratio, partial_ratio_column, pieces
from linkspark.scale import checkpoint

STRATEGIES = ("substring", "token", "fuzzy")


def elements(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """db_id, level, ord, t, c, name: what a question can be linked to, in schema order."""
    t = tables.select("db_id", F.lit("table").alias("level"), F.col("table_ord").alias("ord"), F.col("original").alias("t"), F.lit(None).cast("string").alias("c"), "name")
    c = columns.select("db_id", F.lit("column").alias("level"), F.col("global_idx").alias("ord"), F.col("table_original").alias("t"), F.col("col_original").alias("c"), F.col("col_name").alias("name"))
    return t.unionByName(c)


GRAM = 2


def _grams(text: Column, n: int | Column) -> Column:
    """All substrings of length ``n``, at the places 1, 2, ..."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n) if isinstance(n, int) else n))).otherwise(F.array().cast("array<string>"))


def _lost(n: Column, least: float, fuzzy: str) -> Column:
    """The most bigrams of a name of ``n`` letters that a window of the score ``least`` may lack.

    levenshtein: an edit takes two.  partial_ratio: with d letters of the name missing and i others put in, d + i is
    (1 - t)(2n - d + i) at most; the d take two each, the i one; the most are lost where all are missing letters.
    """
    t = least / 100
    if fuzzy == "levenshtein":
        return 2 * F.floor(n * (1 - t) + 1e-9).cast("int")
    return F.floor(n * (4 * (1 - t) / (2 - t)) + 1e-9).cast("int")


def _profiled(names: DataFrame, least: float, fuzzy: str) -> DataFrame:
    """``names`` with grams (different bigrams), need (how many of them a window must have) and letters (each with its number)."""
    name = F.col("e_text")
    rows = names.withColumn("grams", F.array_distinct(_grams(name, GRAM))).withColumn("need", F.size("grams") - _lost(F.length(name), least, fuzzy))
    each = F.array_distinct(F.filter(F.split(name, ""), lambda c: c != ""))
    return rows.withColumn("letters", F.transform(each, lambda c: F.struct(c.alias("c"), (F.length(name) - F.length(F.replace(name, c, F.lit("")))).alias("n"))))


def _close(pairs: DataFrame, least: float, fuzzy: str) -> DataFrame:
    """``pairs`` (q_text and a name as ``_profiled``) of which some window has bigrams and letters enough: bounds that hold for all that reach the score."""
    text, n, t = F.col("q_text"), F.length("e_text"), least / 100
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.array_contains("grams", F.substr(text, i, F.lit(GRAM))))
    rows = pairs.withColumn("places", F.when(F.col("need") > 0, places))
    # of the places in order, ``need`` lie in one window if the last of so many does
    in_window = F.exists("places", lambda p: F.coalesce(F.get("places", F.array_position("places", p).cast("int") + F.col("need") - 2) <= p + n - GRAM, F.lit(False)))
    rows = rows.where((F.col("need") <= 0) | in_window)

    shared = lambda w: F.aggregate("letters", F.lit(0), lambda s, x: s + F.least(x["n"], F.length(w) - F.length(F.replace(w, x["c"], F.lit("")))))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    # letters in common: n - d, or, of a partial ratio, t n in a whole window and t n / (2 - t) in one that the text's end cuts off
    whole = n - F.floor(n * (1 - t) + 1e-9) if fuzzy == "levenshtein" else F.ceil(n * t - 1e-9)
    enough = F.exists(F.transform(starts, lambda i: F.substr(text, i, n)), lambda w: shared(w) >= whole)
    if fuzzy != "levenshtein":
        cut = F.ceil(n * (t / (2 - t)) - 1e-9)
        enough = enough | (shared(F.substr(text, F.lit(1), n - 1)) >= cut) | (shared(F.substr(text, F.greatest(F.length(text) - n + 2, F.lit(1)), n)) >= cut)
    return rows.where(enough).select("name_id", "db_id", "q_text")


def candidates(texts: DataFrame, names: DataFrame, fuzzy: str, least: float) -> DataFrame:
    """name_id, db_id, q_text: all pairs that may reach the score, or hold all of the name's words; found by inverted indexes.

    texts: db_id, q_text, q_tokens; names: name_id, edb, e_text, e_tokens.  Three indexes, none of which loses a hit:

    * Words: a name whose words the question has is listed under its rarest word.
    * levenshtein: d edits leave one of d + 1 pieces of the name as it is; questions meet names at equal pieces.
    * partial_ratio: a window that lacks few letters of the name has most of its bigrams, so it has one of the rarest few (prefix
      filter), and so many of them in a stretch of the name's length (count filter).  Where the bound asks for none (names of some four
      letters, or names longer than the question), all pairs of the database are tested: few rows, and the exact way for them.

    Pairs of the latter two must have letters enough in common in one window of the name's length, too.
    """
    words = texts.select("db_id", "q_text", "q_tokens", F.explode("q_tokens").alias("key"))
    often = words.groupBy(F.col("db_id").alias("edb"), "key").agg(F.count("*").alias("n"))
    named = names.select("name_id", "edb", F.explode("e_tokens").alias("key")).join(often, ["edb", "key"], "left")
    rarest = named.groupBy("name_id", "edb").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("w")).select("name_id", "edb", F.col("w.key").alias("key"))
    met = lambda left, right: left.join(right, (left["db_id"] == right["edb"]) & (left["key"] == right["key"])).select("name_id", "db_id", "q_text")
    rarest = rarest.join(names.select("name_id", "e_tokens"), "name_id")
    found = words.join(rarest, (words["db_id"] == rarest["edb"]) & (words["key"] == rarest["key"])).where(X.has_all_tokens(F.col("e_tokens"), F.col("q_tokens"))).select("name_id", "db_id", "q_text")
    own = names.where("e_text <> ''")
    texts = texts.where("q_text <> ''")
    own = _profiled(own, least, fuzzy)
    named = own.drop("edb", "e_tokens")
    if fuzzy == "levenshtein":
        listed = own.select("name_id", "edb", F.explode(F.array_distinct(pieces(F.col("e_text"), least))).alias("key"))
        sizes = listed.groupBy("edb").agg(F.collect_set(F.length("key")).alias("sizes"))  # some tens at most
        parts = texts.join(F.broadcast(sizes), texts["db_id"] == sizes["edb"]).select("db_id", "q_text", F.explode("sizes").alias("size"))
        parts = parts.select("db_id", "q_text", F.explode(F.array_distinct(_grams(F.col("q_text"), F.col("size")))).alias("key"))
        return found.unionByName(_close(met(parts, listed).distinct().join(named, "name_id"), least, fuzzy)).distinct()

    n = F.length("e_text")
    parts = texts.select("db_id", "q_text", F.explode(F.array_distinct(_grams(F.col("q_text"), GRAM))).alias("key"))
    often = parts.groupBy(F.col("db_id").alias("edb"), "key").agg(F.count("*").alias("n"))
    listed = own.where("need > 0").select("name_id", "edb", "need", F.explode("grams").alias("key")).join(often, ["edb", "key"], "left")
    listed = listed.groupBy("name_id", "edb", "need").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("row"))
    listed = listed.select("name_id", "edb", F.explode(F.slice("row", F.lit(1), F.size("row") - F.col("need") + 1)).alias("k")).select("name_id", "edb", "k.key")
    some = _close(met(parts, listed).distinct().join(named, "name_id"), least, fuzzy)
    # names of which the bound asks for no bigram; and those as long as the text or longer, whose windows are the name's
    few = own.where("need <= 0").drop("e_tokens")
    few = _close(texts.join(few, texts["db_id"] == few["edb"]).where(F.length("q_text") > n), least, fuzzy)
    lengths = texts.groupBy("db_id").agg(F.min(F.length("q_text")).alias("shortest")).withColumnRenamed("db_id", "ldb")
    long_names = own.join(F.broadcast(lengths), F.col("edb") == F.col("ldb")).where(n >= F.col("shortest"))
    rest = texts.join(long_names, (texts["db_id"] == long_names["edb"]) & (F.length("q_text") <= n)).select("name_id", "db_id", "q_text")
    return found.unionByName(some).unionByName(few).unionByName(rest).distinct()


def _sides(questions: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, their different texts, and the different names (name_id, edb, e_text, e_tokens)."""
    asked = questions.select("question_id", "db_id", X.question_text(F.col("question")).alias("q_text"))
    # a text is scored once; few bytes are much work here, so texts are dealt among all tasks
    texts = asked.select("db_id", "q_text").distinct().withColumn("q_tokens", F.split("q_text", " "))
    own = names.select(F.col("db_id").alias("edb"), X.name_text(F.col("name")).alias("e_text"), X.name_tokens(F.col("name")).alias("e_tokens")).distinct()
    return asked, texts, own.withColumn("name_id", F.sha2(F.to_json(F.struct("edb", "e_text", "e_tokens")), 256))


def scores(questions: DataFrame, names: DataFrame, fuzzy: str = "partial_ratio", least: float = 0.0) -> DataFrame:
    """Each question with each element of its database: strategy and score of the first strategy that applies.

    questions: question_id, db_id, question; names: as ``elements``.  Fuzzy scores are computed only for what neither exact
    strategy hits.  ``fuzzy``: partial_ratio or levenshtein (built-in functions only).  Scores below ``least`` are left out; if
    there is such a bound, only ``candidates`` are scored, each different text and name once.
    """
    asked, texts, own = _sides(questions, names)
    if least > 0:
        texts, own = checkpoint(texts), checkpoint(own)
        found = candidates(texts, own, fuzzy, least)
    else:
        found = texts.join(own, texts["db_id"] == own["edb"]).select("name_id", "db_id", "q_text")
    pairs = found.withColumn("q_tokens", F.split("q_text", " ")).join(own.drop("edb"), "name_id")
    strategy = F.when(X.is_substring(F.col("e_text"), F.col("q_text")), "substring").when(X.has_all_tokens(F.col("e_tokens"), F.col("q_tokens")), "token")
    pairs = pairs.withColumn("strategy", strategy)
    is_open = F.col("strategy").isNull() & (F.col("e_text") != "") & (F.col("q_text") != "")
    if fuzzy == "partial_ratio":
        ratio = partial_ratio_column(F.when(is_open, F.col("e_text")), F.col("q_text"))
    else:
        # generated, so that filters on scores stay above and nothing is computed twice
        ratio = F.explode_outer(F.array(F.when(is_open, levenshtein_ratio(F.col("e_text"), F.col("q_text")))))
    rated = pairs.withColumn("ratio", ratio).withColumn("score", F.when(F.col("strategy").isNotNull(), 100.0).otherwise(F.col("ratio"))).where(F.col("strategy").isNotNull() | (F.col("score") >= least))
    rated = rated.select("name_id", F.col("db_id").alias("rdb"), F.col("q_text").alias("r_text"), F.coalesce("strategy", F.lit("fuzzy")).alias("strategy"), "score")
    named = names.select("level", "ord", "t", "c", F.sha2(F.to_json(F.struct(F.col("db_id").alias("edb"), X.name_text(F.col("name")).alias("e_text"), X.name_tokens(F.col("name")).alias("e_tokens"))), 256).alias("name_id"))
    hits = rated.join(named, "name_id")
    both = asked.join(hits, asked["db_id"].eqNullSafe(F.col("rdb")) & (asked["q_text"] == F.col("r_text")))
    return both.select("question_id", "db_id", "level", "ord", "t", "c", "strategy", "score")


def selectivity(questions: DataFrame, names: DataFrame, fuzzy: str = "partial_ratio", least: float = 80) -> DataFrame:
    """pairs, candidates: of different texts with different names of one database, and how many of them ``scores`` looks at."""
    _, texts, own = (checkpoint(x) for x in _sides(questions, names))
    each = texts.groupBy("db_id").agg(F.count("*").alias("q")).join(own.groupBy(F.col("edb").alias("db_id")).agg(F.count("*").alias("e")), "db_id")
    n = candidates(texts, own, fuzzy, least).count()
    return each.agg(F.coalesce(F.sum(F.col("q") * F.col("e")), F.lit(0)).alias("pairs"), F.lit(n).cast("long").alias("candidates"))


def matched(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where((F.col("strategy") != "fuzzy") | (F.col("score") >= threshold))


def predictions(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, db_id, tables, columns, sorted by name; a question without hits gets empty links."""
    links = hits.groupBy("question_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("level") == "table", F.col("t")))).alias("tables"),
        F.array_sort(F.collect_set(F.when(F.col("level") == "column", F.struct("t", "c")))).alias("columns"),
    )
    empty = F.array().cast("array<string>"), F.array().cast("array<struct<t:string,c:string>>")
    return questions.select("question_id", "db_id").join(links, "question_id", "left").select("question_id", "db_id", F.coalesce("tables", empty[0]).alias("tables"), F.coalesce("columns", empty[1]).alias("columns"))


def with_schema(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``questions``; one whose database has no element raises."""
    known = names.select(F.col("db_id").alias("__known")).distinct()
    rows = questions.join(known, questions["db_id"] == F.col("__known"), "left")
    lacking = F.raise_error(F.concat(F.lit("no schema for database "), F.coalesce("db_id", F.lit("null")))).cast("string")
    return rows.withColumn("db_id", F.when(F.col("__known").isNotNull(), F.col("db_id")).otherwise(lacking)).drop("__known")


def link(questions: DataFrame, names: DataFrame, threshold: float = 80, fuzzy: str = "partial_ratio") -> DataFrame:
    questions = with_schema(questions, names)
    return predictions(questions, matched(scores(questions, names, fuzzy, threshold), threshold))

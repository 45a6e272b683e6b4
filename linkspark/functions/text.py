"""Text expressions: canonical names, tokens, lexical predicates, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(x: Column) -> Column:
    """Identifiers are compared without case and outer white space."""
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def canonical_list(items: Column) -> Column:
    return F.array_distinct(F.transform(items, canonical))


def canonical_pairs(pairs: Column) -> Column:
    """Pairs as structs (t, c), each side canonical on its own."""
    return F.array_distinct(F.transform(pairs, lambda p: F.struct(canonical(p["t"]).alias("t"), canonical(p["c"]).alias("c"))))


def name_text(name: Column) -> Column:
    """A name as words: lower case, underscores and runs of white space as one space; punctuation stays."""
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("_"), F.lit(" ")), r"\s+", " "))


def question_text(question: Column) -> Column:
    """A question as words of a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), r"[^a-z0-9\s]", " "), r"\s+", " "))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[\s_]+"), lambda t: t != "")


def question_tokens(question: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(question), "[^a-z0-9]+"), lambda t: t != ""))


def is_substring(name: Column, question: Column) -> Column:
    """name_text within question_text, at any place; an empty name matches nothing."""
    return (name != "") & F.contains(question, name)


def has_all_tokens(tokens: Column, of: Column) -> Column:
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, of)) == 0)


def n_words(text: Column) -> Column:
    """Words as white space separates them; none in an empty text."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " "))).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def after_first_dot(label: Column) -> tuple[Column, Column]:
    """(table, column) of "table.column"; without a dot the column is null."""
    parts = F.split(label, r"\.", 2)
    return parts[0], F.when(F.size(parts) > 1, F.get(parts, F.lit(1)))


FENCE = r"(?s)^```(?:\w+)?\s*\n?(.*?)\n?```$"


def without_fence(text: Column) -> Column:
    """What a code fence around the whole text encloses, else the text."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(plain.rlike(FENCE), F.regexp_extract(plain, FENCE, 1)).otherwise(text)


def tolerant_json(text: Column) -> Column:
    """The text as VARIANT, with or without a fence; null if it is no JSON."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(without_fence(text)))


def _is_array(value: Column, path: str, of: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.coalesce(kind.isin(f"ARRAY<{of}>", "ARRAY<VOID>", "ARRAY<NULL>"), F.lit(False))


def valid_links(value: Column, tables: str = "tables", least: int = 0, most: int | None = None) -> Column:
    """Whether a VARIANT is {tables: [string], columns: [[string, string]]}; numbers among the strings are no strings."""
    names = F.try_variant_get(value, f"$.{tables}", "array<string>")
    pairs = F.try_variant_get(value, "$.columns", "array<array<string>>")
    size = F.size(names)
    fits = (size >= least) if most is None else size.between(least, most)
    ok = _is_array(value, f"$.{tables}", "STRING") & _is_array(value, "$.columns", "ARRAY<STRING>") & fits & F.forall(pairs, lambda p: F.size(p) == 2)
    return F.coalesce(ok, F.lit(False))


def failure_kind(raw: Column) -> Column:
    """What a model gave instead of an answer."""
    plain = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(plain == "", "empty").when(plain.startswith("```"), "fenced").when(plain.startswith("{") | plain.startswith("["), "json").otherwise("prose")

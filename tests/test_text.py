import random

import pytest
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.functions.fuzzy import partial_ratio, partial_ratio_column, partial_ratios
from linkspark.operators import lexical

QUESTION = "what is the name and nation of the singer who have a song having hey in its name"


@pytest.mark.parametrize("name, score", [("name", 100.0), ("song name", 80.0), ("singer id", 77.8), ("age", 66.7), ("is male", 61.5), ("song release year", 47.1), ("country", 42.9)])
def test_published_partial_ratios(name, score):
    assert round(partial_ratio(name, QUESTION), 1) == score


def test_partial_ratio_edges(spark):
    assert partial_ratio("", "abc") == 0 and partial_ratio("abc", "abc") == 100
    assert partial_ratio("capacity", "show the capasity of the stadium") == pytest.approx(87.5)
    row = spark.createDataFrame([("capacity", "show the capasity of the stadium")], "a string, b string").select(partial_ratio_column(F.col("a"), F.col("b")).alias("r")).first()
    assert row.r == pytest.approx(87.5)


def _brute(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    s, t = sorted((a, b), key=len)
    if not s:
        return 0.0
    windows = {t[max(0, e - len(s)) : e] for e in range(1, len(t) + 1)} | {t[i : i + len(s)] for i in range(len(t))}
    pairs = [(s, w) for w in windows]
    if len(s) == len(t):
        pairs += [(t, w) for w in {s[max(0, e - len(t)) : e] for e in range(1, len(s) + 1)} | {s[i:] for i in range(len(s))}]
    return max(200.0 * lcs(x, w) / (len(x) + len(w)) for x, w in pairs)


def test_partial_ratio_against_brute_force():
    import random

    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert partial_ratio(a, b) == pytest.approx(_brute(a, b)), (a, b)


def test_normalisation(spark):
    row = spark.createDataFrame([("  Song_Name \t x", "What's the Ärger_of 3?")], "n string, q string").select(
        X.name_text(F.col("n")).alias("n"), X.question_text(F.col("q")).alias("q"), X.name_tokens(F.col("n")).alias("nt"), X.question_tokens(F.col("q")).alias("qt"), X.canonical(F.col("n")).alias("c")
    ).first()
    assert (row.n, row.q, row.c) == ("song name x", "what s the rger of 3", "song_name \t x")
    assert row.nt == ["song", "name", "x"] and row.qt == ["what", "s", "the", "rger", "of", "3"]


def test_json(spark):
    cases = ["{\"a\": 1}", "```json\n{\"a\": 1}\n```", "no", "", "[", None]
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select(X.tolerant_json(F.col("x")).isNotNull().alias("ok"), X.failure_kind(F.col("x")).alias("k")).collect()
    assert [r.ok for r in rows] == [True, True, False, False, False, False]
    assert [r.k for r in rows] == ["json", "fenced", "prose", "empty", "json", "empty"]


def test_labels(spark):
    t, c = X.after_first_dot(F.col("x"))
    rows = spark.createDataFrame([("a.b.c",), ("a",)], "x string").select(t.alias("t"), c.alias("c")).collect()
    assert [tuple(r) for r in rows] == [("a", "b.c"), ("a", None)]


def test_lexical_strategies(spark):
    q = spark.createDataFrame([(0, "d", "show the capasity of the stadium"), (1, "d", "abc xyz qwerty"), (2, "d", "the name that comes first"), (3, "d", "average of singers")], "question_id bigint, db_id string, question string")
    e = spark.createDataFrame([("d", "table", 0, "stadium", None, "stadium"), ("d", "column", 1, "stadium", "capacity", "capacity"), ("d", "column", 2, "student", "first_name", "first_name"), ("d", "column", 3, "singer", "age", "age")], "db_id string, level string, ord int, t string, c string, name string")
    hits = {(r.question_id, r.c or r.t): r.strategy for r in lexical.matched(lexical.scores(q, e), 80).collect()}
    assert hits == {(0, "stadium"): "substring", (0, "capacity"): "fuzzy", (2, "first_name"): "token", (3, "age"): "substring"}
    links = {r.question_id: r for r in lexical.link(q, e, 80).collect()}
    assert links[1].tables == [] and links[1].columns == [] and links[0].tables == ["stadium"]


def test_ratios_of_all_windows_at_once_are_those_of_each():
    draw = random.Random(5)
    for _ in range(300):
        letters = "abc é_"[: draw.randint(2, 6)]
        word = lambda least, most: "".join(draw.choice(letters) for _ in range(draw.randint(least, most)))  # noqa: B023, E731
        name = word(0, 70 if draw.random() < 0.1 else 9)
        texts = [word(0, 80 if draw.random() < 0.2 else 25) for _ in range(5)]
        assert list(partial_ratios(name, texts)) == [partial_ratio(name, t) for t in texts]


def test_levenshtein_above_a_least_score_is_that_without_one(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abcd") for _ in range(n))
    q = spark.createDataFrame([(i, "d", f"{word(6)} {word(7)}") for i in range(40)], "question_id bigint, db_id string, question string")
    e = spark.createDataFrame([("d", "table", i, word(5), None, word(draw.randint(1, 6))) for i in range(40)], "db_id string, level string, ord int, t string, c string, name string")
    rows = lambda least: {(r.question_id, r.ord): round(r.score, 9) for r in lexical.scores(q, e, "levenshtein", least).collect()}
    every = rows(0)
    assert len(every) == 1600
    for least in (60, 80):
        assert rows(least) == {k: v for k, v in every.items() if v >= least}


def test_a_question_without_schema_raises(spark):
    q = spark.createDataFrame([(0, "gone", "anything")], "question_id bigint, db_id string, question string")
    e = spark.createDataFrame([("d", "table", 0, "x", None, "x")], "db_id string, level string, ord int, t string, c string, name string")
    with pytest.raises(Exception, match="no schema for database gone"):
        lexical.link(q, e).collect()

"""Set metrics and evaluation against hand-computed values."""

import random

import pytest
from pyspark.sql import functions as F

from linkspark import schemas
from linkspark.functions import metrics as M
from linkspark.operators import evaluation as E

LINKS = "question_id bigint, db_id string, tables array<string>, columns array<struct<t:string,c:string>>"


@pytest.mark.parametrize(
    "pred, gold, tp, fp, fn, p, r, f1, hit",
    [
        ("", "", 0, 0, 0, 1, 1, 1, True), ("", "a", 0, 0, 1, 1, 0, 0, False), ("a", "", 0, 1, 0, 0, 1, 0, True), ("a", "a", 1, 0, 0, 1, 1, 1, True),
        ("a", "ab", 1, 0, 1, 1, 0.5, 2 / 3, False), ("ab", "a", 1, 1, 0, 0.5, 1, 2 / 3, True), ("ab", "ab", 2, 0, 0, 1, 1, 1, True), ("abc", "ab", 2, 1, 0, 2 / 3, 1, 0.8, True),
    ],
)
def test_per_query_table(spark, pred, gold, tp, fp, fn, p, r, f1, hit):
    m = M.per_query(F.col("p"), F.col("g"))
    row = spark.createDataFrame([(list(pred), list(gold))], "p array<string>, g array<string>").select(*[v.alias(k) for k, v in m.items()]).first()
    assert (row.tp, row.fp, row.fn, row.srr_hit) == (tp, fp, fn, hit)
    assert (row.precision, row.recall, row.f1) == pytest.approx((p, r, f1))


def test_f_beta(spark):
    cases = [(1, 1, 1, 1.0), (0.5, 0.5, 1, 0.5), (1, 0, 1, 0.0), (0, 1, 1, 0.0), (0.6, 0.4, 1, 0.48), (0, 0, 6, 0.0)]
    rows = spark.createDataFrame([(float(p), float(r), float(b)) for p, r, b, _ in cases], "p double, r double, b double").select(M.f_beta(F.col("p"), F.col("r"), F.col("b")).alias("f")).collect()
    assert [x.f for x in rows] == pytest.approx([c[3] for c in cases])
    high, low = spark.createDataFrame([(0.5, 1.0), (1.0, 0.5)], "p double, r double").select(M.f_beta(F.col("p"), F.col("r"), 6).alias("f")).collect()
    assert high.f > 0.95 and low.f < 0.55


KNOWN = "db_id string, known_tables array<string>, known_columns array<struct<t:string,c:string>>"


@pytest.fixture(scope="module")
def four(spark):
    """Exact; one name of each kind outside the schema and one column missed; one table missed; one table too many."""
    gold = [(11, "zoo", ["keeper"], [("keeper", "name")]), (12, "rail", ["line"], [("line", "code"), ("line", "km")]), (13, "zoo", ["keeper", "pen"], [("pen", "area")]), (14, "zoo", [], [])]
    pred = [(11, "zoo", ["keeper"], [("keeper", "name")]), (12, "rail", ["LINE ", "depot"], [("line", "Code"), ("line", "gauge")]), (13, "zoo", ["pen"], [("pen", "area")]), (14, "zoo", ["keeper"], []), (70, "rail", ["line"], [])]
    known = spark.createDataFrame([("zoo", ["keeper", "pen"], [("keeper", "name"), ("pen", "area"), ("pen", "roof")]), ("rail", ["line"], [("line", "code"), ("line", "km")])], KNOWN)
    hardness = spark.createDataFrame([(11, "medium"), (12, "extra"), (13, "easy"), (14, "hard")], "question_id bigint, hardness string")
    gold, pred = spark.createDataFrame(gold, LINKS), spark.createDataFrame(pred, LINKS)
    return gold, pred, E.per_query(gold, pred, known, hardness, "m", "tier1").cache()


def test_four_queries(four):
    _, _, rows = four
    assert tuple(rows.columns) == schemas.PER_QUERY
    # two of the four names predicted for 12 are outside the schema
    assert {r.question_id: r.hallucination_rate for r in rows.collect()} == {11: 0, 12: 0.5, 13: 0, 14: 0}
    outside = rows.where("question_id = 12").first()
    assert (outside.hallucinated_tables_list, outside.hallucinated_columns_list) == ("depot", "line.gauge")
    agg = E.aggregate(rows)
    assert tuple(agg.columns) == schemas.AGGREGATED
    got = {(r.level, r.hardness, r.aggregation): r for r in agg.collect()}
    assert len(got) == 2 * 2 * 5  # levels, aggregations, all and four kinds of hardness
    t, c = got["tables", "all", "macro"], got["columns", "all", "macro"]
    # tables: P 1 1 1 0, R 1 1 1/2 1, F1 1 1 2/3 0; columns: R 1 1/2 1 1, F1 1 2/3 1 1
    assert (t.precision, t.recall, t.f1, t.srr, t.hallucination_rate) == pytest.approx((3 / 4, 7 / 8, 2 / 3, 3 / 4, 1 / 8))
    assert t.f6 == pytest.approx(37 * 3 / 4 * 7 / 8 / (36 * 3 / 4 + 7 / 8))
    assert (c.precision, c.recall, c.f1) == pytest.approx((1, 7 / 8, 11 / 12))
    # tables: 3 found, 1 too many, 1 missed; columns: 3 found, 1 missed
    t, c = got["tables", "all", "micro"], got["columns", "all", "micro"]
    assert (t.precision, t.recall, t.f1) == pytest.approx((3 / 4, 3 / 4, 3 / 4))
    assert (c.precision, c.recall, c.f1) == pytest.approx((1, 3 / 4, 6 / 7))
    assert E.headline(agg).count() == 2


def test_unpaired(four):
    gold, pred, _ = four
    missing, extra = E.unpaired(gold, pred)
    assert missing.count() == 0 and [r.question_id for r in extra.collect()] == [70]


def test_prediction_of_gold_is_perfect(spark):
    rng = random.Random(1234)
    names = [f"t{i}" for i in range(6)]
    rows = []
    for q in range(20):
        tables = rng.sample(names, rng.randint(0, 6))
        rows.append((q, "A", tables, [(t, f"c{rng.randint(0, 3)}") for t in tables]))
    known = spark.createDataFrame([("A", names, [(t, f"c{i}") for t in names for i in range(4)])], "db_id string, known_tables array<string>, known_columns array<struct<t:string,c:string>>")
    links = spark.createDataFrame(rows, LINKS)
    for r in E.aggregate(E.per_query(links, links, known, None, "m", "t")).collect():
        assert (r.precision, r.recall, r.f1, r.f6, r.srr, r.hallucination_rate) == (1, 1, 1, 1, 1, 0)
    nothing = links.where("false")
    for r in E.aggregate(E.per_query(links, nothing, known, None, "m", "t")).where("aggregation = 'macro' and hardness = 'all' and level = 'tables'").collect():
        empty = sum(not x[2] for x in rows) / 20
        assert (r.precision, r.recall, r.srr) == pytest.approx((1, empty, empty))

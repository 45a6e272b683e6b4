import math

import pytest
from pyspark.sql import functions as F

from linkspark.operators import stats as S

CELLS = "n_both bigint, n_a_only bigint, n_b_only bigint, n_neither bigint"


@pytest.mark.parametrize(
    "cells, statistic, p",
    [
        ((40, 40, 10, 10), 16.82, None), ((60, 0, 0, 40), 0, 1.0), ((3, 5, 1, 1), 1, 0.21875), ((50, 12, 12, 50), 12, 1.0), ((50, 5, 20, 50), 7.84, None),
        ((617, 122, 201, 94), 18.8359133126935, 1.4245931343949148e-05), ((0, 6, 2, 0), 2, 0.2890625), ((0, 17, 0, 0), 0, 1.52587890625e-05), ((0, 12, 13, 0), 0.0, 1.0), ((0, 320, 3, 0), 309.15170278637774, 3.3421e-69),
    ],
)
def test_mcnemar(spark, cells, statistic, p):
    row = S.with_mcnemar(spark.createDataFrame([cells], CELLS)).first()
    assert row.statistic == pytest.approx(statistic, abs=1e-2 if p is None else 1e-6)
    if p is not None:
        assert row.p_value == pytest.approx(p, rel=1e-4)
    else:
        assert row.p_value == pytest.approx(math.erfc(math.sqrt(row.statistic / 2)))


def test_only_common_questions_count(spark):
    rows = [("a", "t1", q, True, q % 2 == 0) for q in range(4)] + [("b", "t1", q, q % 2 == 0, True) for q in range(2, 6)] + [("a", "t2", 0, True, True)]
    table = spark.createDataFrame(rows, "method string, tier string, question_id bigint, table_srr_hit boolean, column_srr_hit boolean")
    got = {r.element_type: r for r in S.compare(table, "a", "b").collect()}
    assert set(got) == {"table", "column"} and all(r.tier == "t1" for r in got.values())
    assert (got["table"].n_both, got["table"].n_a_only) == (1, 1)
    assert (got["column"].n_both, got["column"].n_b_only) == (1, 1)


def test_verdict(spark):
    row = spark.createDataFrame([(0.01, 5, 1), (0.5, 5, 1), (0.01, 1, 9)], "p double, b bigint, c bigint").select(S.verdict(F.col("p"), F.col("b"), F.col("c"), F.lit("x"), F.lit("y")).alias("v")).collect()
    assert [r.v for r in row] == ["x", "no difference", "y"]

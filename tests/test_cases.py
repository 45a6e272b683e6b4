"""Queries over written-out inputs against their SQL."""

import duckdb
import pytest
import star_cases
import written_cases


def rows(table, columns):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in table), key=str) if columns else []


@pytest.mark.parametrize("module, name", [(m, n) for m in (star_cases, written_cases) for n in m.QUERIES], ids=lambda x: x if isinstance(x, str) else "")
def test_case(spark, module, name):
    found = module.QUERIES[name](spark, "")
    columns = sorted(found.columns)
    got = rows(map(tuple, found.select(*columns).collect()), columns)
    if name in module.ORACLES:
        want = duckdb.sql(module.ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall(), columns)
    else:
        assert got

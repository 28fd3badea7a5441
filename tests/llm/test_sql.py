"""Queries against their DuckDB statements, with column types."""

import math

import pytest

from filinglens.llm.queries import QUERIES, SQL

KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == {d[0]: str(d[1]) for d in rel.description}
    mine = sorted(tuple(r[c] for c in cols) for r in df.collect())
    theirs = sorted(rel.fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=0, abs_tol=0) for x, y in zip(a, b, strict=True))

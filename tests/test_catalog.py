import pathlib

import pytest

import __spark_entry__ as registered

DATA = pathlib.Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    queries, oracles = registered.queries(), registered.oracle_sql()
    assert set(oracles) <= set(queries)
    others = {name for name in queries if name != "pipeline" and not name.startswith("op")}
    assert others - set(oracles) == {"page_key_blake2b"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert len(rows) == 20
    scores = [r["score"] for r in rows]
    assert scores == sorted(scores, reverse=True)

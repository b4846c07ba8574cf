"""Driver contract: entry() smoke, and every query against its oracle."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_harness import compare  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert len(df.columns) > 0


def test_registry_shapes():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_all_queries_match_oracle_sf0001(spark):
    res = compare(spark, "/root/testdata/sf0.001", verbose=False)
    bad = {k: v for k, v in res.items()
           if v != (True, True, True) and not (isinstance(v, tuple) and v[0] == "rows-only")}
    assert not bad, bad

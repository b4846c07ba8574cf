"""Every query of the subpackage with an oracle, against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from oracle_harness import compare  # noqa: E402

from opinio.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", [name], verbose=False) == {name: (True, True, True)}

"""Property checks on random data (hypothesis): keep-first against brute
force, idempotence, and split invariants."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from opinio.operators.dedupe import keep_first
from opinio.operators.split import split_sizes, stratified_split

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=120)


@SETTINGS
@given(rows=rows_st, parts=st.integers(1, 9))
def test_keep_first_brute_force(spark, rows, parts):
    data = [(i, k1, k2) for i, (k1, k2) in enumerate(rows)]
    df = spark.createDataFrame(data, "seq long, a int, b int").repartition(parts)
    got = sorted(r["seq"] for r in keep_first(df, ["a", "b"], "seq").collect())
    first = {}
    for i, a, b in data:
        first.setdefault((a, b), i)
    assert got == sorted(first.values())
    again = keep_first(keep_first(df, ["a", "b"], "seq"), ["a", "b"], "seq")
    assert sorted(r["seq"] for r in again.collect()) == got


def test_keep_first_leaves_one_of_tied_rows(spark):
    rows = [(None, "a", "x", 1), (None, "a", "y", 1), (3, "b", "x", 1), (3, "b", "y", 1), (3, "b", "y", 1), (4, "b", "z", 1),
            (None, "c", "x", 1), (7, "c", "y", 1), (None, None, "x", 1), (None, None, "x", 1)]
    df = spark.createDataFrame(rows, "seq long, k string, v string, n int")
    seen = set()
    for parts in (1, 3, 7):
        got = keep_first(df.repartition(parts), ["k"], "seq").collect()
        assert sorted(str(r["k"]) for r in got) == ["None", "a", "b", "c"]
        assert {r["k"]: r["seq"] for r in got} == {"a": None, "b": 3, "c": 7, None: None}
        seen.add(tuple(sorted((str(r["k"]), r["v"]) for r in got)))
        two = keep_first(df.repartition(parts), ["k"], ["n", "seq"]).collect()
        assert sorted(str(r["seq"]) for r in two) == ["3", "7", "None", "None"]
    assert len(seen) == 1  # the same rows however they are dealt


@SETTINGS
@given(labels=st.lists(st.integers(0, 1), min_size=2, max_size=150),
       seed=st.integers(0, 1000))
def test_split_invariants(spark, labels, seed):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "seq long, label int")
    out = stratified_split(df, seed=seed).collect()
    assert sorted(r["seq"] for r in out) == list(range(len(labels)))
    n = len(labels)
    n_test = sum(1 for r in out if r["split"] == "test")
    n_val = sum(1 for r in out if r["split"] == "val")
    assert n_test == math.ceil(0.2 * n)
    assert n_val == math.ceil(0.1 * (n - n_test))
    sizes = {r["label"]: r for r in split_sizes(df).collect()}
    for lab, r in sizes.items():
        got = sum(1 for x in out if x["split"] == "test" and x["label"] == lab)
        assert got == r["n_test"]

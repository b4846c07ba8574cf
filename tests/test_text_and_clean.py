"""Text scalars and the cleaning job on hand-made edge rows."""

from pyspark.sql import functions as F

from opinio.functions.text import coerce_label, na_to_null, norm_key, ustrip
from opinio.operators import clean as C
from opinio.operators.dedupe import keep_first
from opinio.schema import WS_CHARS

PY_WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace() and
                chr(c).strip() == "")


def test_ws_set_matches_python():
    assert set(WS_CHARS) == set(PY_WS)
    assert len(WS_CHARS) == 29


def test_strip_and_key(spark):
    vals = ["　\x1c Hello   World ", "  ", "x\U0001F642 ", "A\tB\nC"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = df.select(ustrip("t").alias("s"), norm_key("t").alias("k")).collect()
    for v, r in zip(vals, got):
        assert r["s"] == v.strip()
        assert r["k"] == " ".join(v.strip().lower().split())


def test_label_coercion(spark):
    cases = {"1": 1, "0": 0, "1.0": 1, " 0.0 ": 0, "1e0": 1, "+1": 1, "2": None,
             "x": None, "1d": None, "": None, None: None, "-0": 0, ".0": 0}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["l"] for r in df.select("v", coerce_label("v").alias("l")).collect()}
    assert got == cases


def test_na_tokens(spark):
    df = spark.createDataFrame([("NA",), ("null",), ("n/a",), ("None",), ("ok",), ("",)], "v string")
    got = [r[0] for r in df.select(na_to_null("v")).collect()]
    assert got == [None, None, None, None, "ok", None]


ROWS = [
    # seq, entity, text, label
    (1, "a", "  The FIRST review is long enough  ", "1"),
    (2, "a", "the first   review is long enough", "0"),      # dup of 1, other label
    (3, "a", "short", "1"),                                # too short
    (4, None, "an orphan review without entity id", "1"),  # null entity
    (5, "b", "   ", "1"),                                  # blank
    (6, "b", "a review with a bad label value here", "x"),
    (7, "b", "a review with a numeric label as float", "0.0"),
    (8, "a", "The first review is long enough", "1"),      # dup again
    (9, "b", "exactly twenty-five chars", "1"),            # len 25 -> kept
]


def _df(spark):
    return spark.createDataFrame(ROWS, "seq long, entity_id string, text string, label string")


def test_clean_keep_first_and_filters(spark):
    out = {r["seq"]: r for r in C.clean_reviews(_df(spark)).collect()}
    assert sorted(out) == [1, 7, 9]
    assert out[1]["label"] == 1 and out[1]["text"] == "the first review is long enough"
    assert out[7]["label"] == 0


def test_clean_is_partition_independent(spark):
    base = sorted(r["seq"] for r in C.clean_reviews(_df(spark)).collect())
    for n in (1, 7, 13):
        d = _df(spark).repartition(n)
        assert sorted(r["seq"] for r in C.clean_reviews(d).collect()) == base


def test_report(spark):
    r = C.cleaning_report(_df(spark)).first().asDict()
    assert r["rows_in"] == 9 and r["rows_out"] == 3 and r["rows_removed"] == 6
    assert r["dropped_null"] == 1 and r["dropped_empty"] == 1
    assert r["dropped_label"] == 1 and r["dropped_short"] == 1
    assert r["dropped_duplicate"] == 2 and r["label_conflicts"] == 1
    assert r["positives"] == 2 and r["negatives"] == 1
    assert abs(r["pct_positive"] - 200 / 3) < 1e-9


def test_keep_first_hot_key(spark):
    # one key holding most rows: survivors must still be the minimum seq
    df = spark.range(0, 5000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(
            (F.col("id") % 97).cast("string")).alias("k"))
    out = keep_first(df.repartition(11), ["k"], "seq").collect()
    got = {r["k"]: r["seq"] for r in out}
    assert got["hot"] == 0
    assert len(got) == 1 + len({i % 97 for i in range(5000) if i % 10 >= 8})


def test_require_columns(spark):
    import pytest
    with pytest.raises(ValueError, match=r"\['label', 'text'\]"):
        C.require_columns(spark.createDataFrame([(1,)], "entity_id int"),
                          ["entity_id", "text", "label"])


def test_marker_and_loader_variant(spark):
    df = spark.createDataFrame([(1, "a", "  Mixed CASE text kept  ", " RECOMMENDED ", "1.0"),
                                (2, "a", None, "x", "1"), (3, None, "no entity needed", None, "0")],
                               "seq long, entity_id string, text string, marker string, label string")
    m = {r["seq"]: r["marker"] for r in C.normalise_marker(df).collect()}
    assert m[1] == "recommended" and m[3] is None
    got = {r["seq"]: (r["text"], r["label"]) for r in C.load_labelled(df).collect()}
    assert got == {1: ("Mixed CASE text kept", 1), 3: ("no entity needed", 0)}


def test_balance_guards(spark):
    import pytest

    from opinio.operators import balance as B
    rows = [(i, "e", f"positive review number {i}", "1") for i in range(3)]
    pos_only = spark.createDataFrame(rows, "seq long, entity_id string, text string, label string")
    with pytest.raises(ValueError, match="no negative"):
        B.balance(pos_only, pos_only)
    neg = spark.createDataFrame([(i + 10, "e", f"bad review {i}", "0") for i in range(5)],
                                "seq long, entity_id string, text string, label string")
    with pytest.raises(ValueError, match="not enough positives"):
        B.balance(pos_only, neg)
    ok = B.balance(neg.unionByName(pos_only), neg.limit(2))
    c = {r["label"]: r["n"] for r in ok.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert c == {0: 2, 1: 2}
    B.assert_no_duplicates(ok)


def test_balance_aborts_on_cross_class_duplicates(spark):
    import pytest

    from opinio.operators import balance as B
    gen = spark.createDataFrame([(1, "e", "same words here", "1"), (2, "e", "other text", "1")],
                                "seq long, entity_id string, text string, label string")
    neg = spark.createDataFrame([(3, "e", "Same  words here", "0")],
                                "seq long, entity_id string, text string, label string")
    # the only negative is a copy of a positive: if that positive is drawn
    # the audit must abort; with the other drawn the set is clean
    outcomes = set()
    for seed in range(6):
        try:
            B.balance(gen, neg, seed=seed, with_order=False)
            outcomes.add("ok")
        except ValueError as e:
            assert "duplicates" in str(e)
            outcomes.add("abort")
    assert outcomes == {"ok", "abort"}

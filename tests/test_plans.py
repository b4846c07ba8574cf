"""Plan-shape checks: the physical strategies the design relies on."""

from pyspark.sql import functions as F

from opinio.operators import evaluate as EV
from opinio.operators import tokens as TK
from opinio.operators.dedupe import keep_first
from opinio.operators.rank import seeded_hash, take_n


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("k"),
                                 (F.col("id") % 2).cast("int").alias("label"),
                                 (F.col("id") % 100 / 100.0).alias("score"),
                                 F.concat(F.lit("w"), (F.col("id") % 13).cast("string"),
                                          F.lit(" x")).alias("text"))


def test_keep_first_is_partial_hash_aggregate(spark):
    df = keep_first(_rows(spark), ["k"], "seq")
    p = plan(df)
    assert "HashAggregate" in p and "partial_min" in p
    assert "Window" not in p and "SortAggregate" not in p


def test_keep_first_places_null_orders_last(spark):
    df = spark.createDataFrame([(None, "a", 1), (5, "a", 2), (3, "a", 3), (None, "b", 4), (None, None, 5), (1, None, 6)],
                               "seq long, k string, n int")
    assert sorted(r["n"] for r in keep_first(df, ["k"]).collect()) == [3, 4, 6]



def test_top_k_is_take_ordered(spark):
    df = _rows(spark).withColumn("label", F.lit(1))
    assert "TakeOrderedAndProject" in plan(EV.top_errors(df, k=5))


def test_vocab_counts_map_side(spark):
    p = plan(TK.build_vocab(_rows(spark), size=10))
    assert "partial_count" in p and "TakeOrderedAndProject" in p


def test_auc_windows_are_bucketed(spark):
    p = plan(EV.roc_auc(_rows(spark)))
    assert "_bk" in p and "BroadcastHashJoin" in p


def test_take_n_does_not_shuffle_the_rows(spark):
    p = plan(take_n(_rows(spark), 100, seeded_hash(1, "seq"), "seq"))
    # rows are compared with the cut, a literal
    assert "Join" not in p and "Window" not in p and "Exchange" not in p


def test_balance_scans_what_it_wrote(spark):
    from opinio.operators.balance import balance
    rows = spark.range(300).select(F.col("id").alias("seq"), F.lit("e").alias("entity_id"),
                                   F.concat(F.lit("review text number "), F.col("id").cast("string")).alias("text"),
                                   F.when(F.col("id") % 3 == 0, "0").otherwise("1").alias("label"))
    assert plan(balance(rows, rows)).count("FileScan") <= 4


def test_scan_prunes_columns(spark):
    from opinio.sources.fixtures import build_reviews_raw
    p = plan(build_reviews_raw(spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p
    assert "n_chars" not in p

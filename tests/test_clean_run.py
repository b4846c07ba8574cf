"""The cleaning run that reports on itself."""

import pytest
from pyspark.sql import functions as F

from opinio.operators.clean import clean_and_report, clean_reviews, cleaning_report

TEXT = "una reseña bastante larga numero"
SCHEMA = "seq long, entity_id string, text string, label string, marker string"


def _reviews(spark):
    rows = [(i, f"e{i % 3}", f"  {TEXT} {i % 20}", str(i % 2), " Mixed ") for i in range(120)]
    rows += [(200, None, TEXT, "1", None), (201, "e1", None, "1", None), (202, "e1", "   ", "0", None),
             (203, "e1", TEXT + " x", "2", None), (204, "e1", "corta", "1", None), (205, "e9", TEXT, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("where", ["true", "seq = 204", "false"])
def test_run_equals_report_and_rows(spark, tmp_path, where):
    df = _reviews(spark).where(where)
    path = str(tmp_path / "clean")
    got = clean_and_report(df, path)
    want = cleaning_report(df)
    assert got.dtypes == want.dtypes and got.first() == want.first()
    rows = spark.read.parquet(path)
    assert rows.columns == df.columns
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, clean_reviews(df).select(df.columns).collect()))


def test_input_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(x):
        seen.add(1)
        return x

    df = _reviews(spark).repartition(3)
    n = df.count()
    clean_and_report(df.withColumn("text", passed.asNondeterministic()("text")), str(tmp_path / "clean"))
    assert seen.value == n

"""Review CSV and metrics JSON sources/sinks."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import na_to_null
from ..operators.clean import require_columns
from ..operators.dedupe import keep_first_by_text
from ..schema import METRICS
from ..session import small, staged

CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "enforceSchema": "false",
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "columnPruning": "false"}
CSV_WRITE = {"header": "true", "quoteAll": "true", "escape": '"',
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def csv_files(spark: SparkSession, path: str) -> list[tuple[str, tuple[str, ...]]]:
    """(file, header) of a CSV file or folder, by file name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = []
    for status in fs.listStatus(top):
        p = status.getPath()
        if p.getName()[0] in "_." or status.isDirectory() or not status.getLen():
            continue
        raw, codec = fs.open(p), codecs.getCodec(p)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            codec.createInputStream(raw) if codec else raw, "UTF-8"))
        line = (reader.readLine() or "").lstrip("\ufeff")
        reader.close()
        out.append((p.toString(), tuple(next(csv.reader([line]), []))))
    return sorted(out)


def read_reviews_csv(spark: SparkSession, path: str, required=(), name: str = "input",
                     mandatory: bool = True, ordinal: str = "seq",
                     bad_rows: str = "raise") -> DataFrame | None:
    """Every field as text, the literal NA tokens as null, plus
    ``seq``: the row's place in the order of file names and rows.

    Files of one folder may name their columns in different orders: each
    header gets a schema of its own. Rows with too few or too many fields
    fail the job with their number, or are left out with
    ``bad_rows="drop"``. A multi-line CSV file is read by one task, so large
    inputs should come as many files; the rows are written to a table first.

    A missing mandatory file raises; a missing optional one returns None
    (O02). Missing required columns raise with their sorted names (O03).
    """
    if not path_exists(spark, path):
        if mandatory:
            raise FileNotFoundError(f"missing {name}: {path}")
        return None
    files = csv_files(spark, path)
    if not files:
        raise ValueError(f"no CSV file with a header in {name}: {path}")
    cols = list(dict.fromkeys(c for _, header in files for c in header))
    parts = []
    for header in dict.fromkeys(h for _, h in files):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, "_corrupt")])
        df = spark.read.options(**CSV_READ).schema(schema).csv([f for f, h in files if h == header])
        require_columns(df, required, name)
        parts.append(df.select(*[F.col(f"`{c}`") for c in header], "_corrupt", F.col("_metadata.file_path").alias("_file"),
                               F.monotonically_increasing_id().alias("_id")))
    if ordinal in cols:
        raise ValueError(f"file already has a column named {ordinal!r}")
    rows = staged(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "csv")
    bad = rows.where("_corrupt IS NOT NULL").count()
    if bad and bad_rows != "drop":
        raise ValueError(f"{bad} rows of {name} do not have the fields of their header: {path}")
    # within a file ids count up from the file's first row; files by name, one row each
    per = rows.groupBy(F.col("_file").alias("_f")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    per = staged(per.select("_f", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "csv-files")
    rows = rows.join(small(per), F.col("_file") == F.col("_f")).where("_corrupt IS NULL")
    return rows.select((F.col("_id") + F.col("_shift")).alias(ordinal), *[na_to_null(c).alias(c) for c in cols])


def write_reviews_csv(df: DataFrame, path: str, dedupe_keys=None,
                      order: str = "seq") -> None:
    """Quote-all CSV, blanks kept; optionally keep-first on
    (keys…, normalised text) before writing (the raw sink's rule)."""
    out = keep_first_by_text(df, dedupe_keys, "text", order) if dedupe_keys else df
    out.write.mode("overwrite").options(**CSV_WRITE).csv(path)


def write_metrics_json(doc: DataFrame, path: str) -> None:
    """Metrics documents as JSON lines (one document per line)."""
    doc.select("metrics.*").write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Read metrics documents back with the fixed schema."""
    return spark.read.schema(METRICS).json(path)

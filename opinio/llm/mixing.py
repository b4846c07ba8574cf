"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, read up to
``max_epochs`` times. A document's virtual finish time is the source's
cumulative size up to and including it, divided by the source's target; the
documents of all sources are put in the order of virtual time and the mix
ends where the total budget is spent. As the targets add up to the budget,
that is virtual time 1; a document in service at that moment gives only the
words served by then, so that each source meets its target to the word.

The order is built from two levels of partial sums, both of them small
tables, so a source (or a third of all rows) is never one task's work:
(source, slice of the shuffle order), then slice of virtual time.

Cases: null text has size 0; a null source is a source of its own, ordered
last; documents of size 0 take 0; repeated rows are separate documents; an
empty table gives an empty mix; a source's ties in the shuffle order are
broken by doc_id, size and text, so equal rows are interchangeable.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from .common import boxed, narrow, read, row_key, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Slices of the shuffle order of a source: 16 ** SLICE_DIGITS.
SLICE_DIGITS = 3
#: Slices of virtual time.
TIME_SLICES = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and the key of the shuffle order."""
    d = narrow(docs, "doc_id", "source", "text")
    return d.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("ord"), row_key().alias("row"))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """One row per source: source_size, target, the whole words of it (``goal``), and the budget of all.

    A target is ``least(max_epochs * source_size, level * weight)`` with the
    one level at which the targets add up to all sizes. Sources with the
    lowest ``source_size / weight`` stop at their limit first.
    """
    n = len(weights)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # one row per source from here on: the windows run over that small table
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything)
                               - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # from the first source whose limit is above its level on, nothing is capped any more
    s = s.withColumn("free", F.col("cap") >= F.col("level") * F.col("weight"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    s = s.withColumn("part", F.col("target") - F.floor("target"))
    by_part = Window.orderBy(F.col("part").desc(), F.col("source").asc_nulls_last())
    left = F.sum("source_size").over(everything) - F.sum(F.floor("target")).over(everything)
    goal = F.floor("target") + F.when(F.row_number().over(by_part) <= left, 1).otherwise(0)
    return s.withColumn("goal", F.least(goal, F.col("cap").cast("long"))).select(
        "source", "source_size", "target", "goal", F.sum("source_size").over(everything).alias("budget"))


def served(sizes: DataFrame, targets: DataFrame, max_epochs: int = 3) -> DataFrame:
    """One row per document and pass that the mix reads: words taken and where in the mix they begin."""
    slice_ = F.substring("ord", 1, SLICE_DIGITS)
    sums = sizes.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("n"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16 ** SLICE_DIGITS rows a source
    starts = sums.select("source", "slice", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("start"))
    t = targets.withColumnRenamed("source", "t_source")
    starts = starts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").select(
        F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), "start", "source_size", "target", "goal", "budget")
    within = Window.partitionBy("source", "slice").orderBy("ord", F.col("doc_id").asc_nulls_first(), "size", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = sizes.where("size > 0").withColumn("slice", slice_).withColumn("upto", F.sum("size").over(within))
    queued = queued.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")))
    passes = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn(
        "begin", F.col("pass") * F.col("source_size") + F.col("start") + F.col("upto") - F.col("size"))
    passes = passes.where("begin < goal").withColumn("words", F.least(F.col("size"), F.col("goal") - F.col("begin")))
    return passes.select("doc_id", "ord", "source", "size", "row", "pass", "words", "budget",
                         F.least(F.lit(1.0), (F.col("begin") + F.col("size")) / F.col("target")).alias("finish"))


def in_order(items: DataFrame) -> DataFrame:
    """Global order of virtual finish times with the running total, cut at the total budget."""
    sliced = items.withColumn("time_slice", F.floor(F.col("finish") * TIME_SLICES))
    sums = sliced.groupBy("time_slice").agg(F.sum("words").alias("n"))
    before = Window.orderBy("time_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("time_slice").alias("t_slice"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("t_start"))  # TIME_SLICES + 1 rows at most
    order = Window.partitionBy("time_slice").orderBy(
        "finish", F.col("source").asc_nulls_last(), "pass", "ord", F.col("doc_id").asc_nulls_first(), "size", "row") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sliced.withColumn("upto", F.sum("words").over(order)) \
        .join(F.broadcast(starts), F.col("time_slice") == F.col("t_slice")) \
        .withColumn("position", F.col("t_start") + F.col("upto") - F.col("words"))
    return placed.where("position < budget") \
        .withColumn("words", F.least(F.col("words"), F.col("budget") - F.col("position"))) \
        .select("doc_id", "ord", "source", "size", "row", "pass", "words", "finish", "position")


def mixed(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The rows of ``docs`` (all columns) that the mix takes, with mix_size, mix_target, mix_taken and mix_position.

    A row is read ``ceil(mix_taken / mix_size)`` times, the last time its
    first words only if ``mix_taken`` is no multiple of ``mix_size``.
    Repeated rows (same doc_id, source and text) are one row that is as
    often in the result as in ``docs``, each taking the group's average. A
    column of ``docs`` with the name of a result is returned as ``input_<name>``.
    """
    results = ("mix_size", "mix_target", "mix_taken", "mix_position")
    share = mix(docs, weights, max_epochs, by_row=True).select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("row").alias("m_row"),
        F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"),
        F.col("position").alias("mix_position"))
    share = share.groupBy("m_id", "m_source", "m_row", "mix_size", "mix_target").agg(
        F.ceil(F.avg("mix_taken")).alias("mix_taken"), F.min("mix_position").alias("mix_position")).where("mix_taken > 0")
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("key") == F.col("m_row"))
    own = [F.col(f"row.`{c}`").alias(f"input_{c}" if c.lower() in results else c) for c in docs.columns]
    return boxed(docs, "doc_id", "source").join(share, same).select(*own, *results)


def mix(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, by_row: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, position (of its first word in the mix, else null).

    ``by_row`` adds source and the key of the row's text.
    """
    sizes = staged(sized(docs), "mix-sizes")
    targets = staged(source_targets(sizes, weights, max_epochs), "mix-targets")
    items = in_order(staged(served(sizes, targets, max_epochs), "mix-items"))
    # rows alike in all of these are interchangeable: each takes what the mix gives to the n-th of them
    alike = ["doc_id", "ord", "source", "size", "row"]
    per = items.groupBy(*alike).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    rows = sizes.groupBy(*alike).agg(F.count("*").alias("copies"))
    per = per.select(*[F.col(c).alias(f"p_{c}") for c in alike], "taken", "position")
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in alike]
    rows = rows.join(per, reduce(and_, same), "left")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    # a group of alike rows shares its words: whole words first to the first rows
    share = F.floor(F.col("taken") / F.col("copies")) + F.when(F.col("nth") <= F.col("taken") % F.col("copies"), 1).otherwise(0)
    t = targets.withColumnRenamed("source", "t_source").drop("goal", "budget")
    t = staged(t, "mix-shares")
    return rows.join(small(t), F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(share, F.lit(0)).cast("long").alias("taken"), "position", *(["source", "row"] if by_row else []))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         CAST(source_size * 3 AS DOUBLE) AS cap FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
one AS (SELECT arg_min(level, cap / weight) AS level FROM levels WHERE cap >= level * weight),
aimed AS (SELECT source, source_size, cap, least(cap, one.level * weight) AS target FROM levels, one),
goals AS (
  SELECT source, source_size, target, least(CAST(cap AS BIGINT), CAST(floor(target) AS BIGINT)
    + CASE WHEN row_number() OVER (ORDER BY target - floor(target) DESC, source NULLS LAST)
                <= sum(source_size) OVER () - sum(floor(target)) OVER () THEN 1 ELSE 0 END) AS goal
  FROM aimed),
queued AS (
  SELECT s.*, g.source_size, g.target, g.goal,
         sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
served AS (
  SELECT q.*, p.pass, p.pass * source_size + start AS begin,
         least(1.0, (p.pass * source_size + start + size) / target) AS finish,
         greatest(0, least(size, goal - (p.pass * source_size + start))) AS words
  FROM queued q, (VALUES (0), (1), (2)) p(pass)),
placed AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source NULLS LAST, pass, ord, doc_id NULLS FIRST, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS position
  FROM served WHERE words > 0)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(sum(p.words), 0) AS BIGINT) AS taken,
       CAST(min(p.position) AS BIGINT) AS position
FROM queued q LEFT JOIN placed p ON p.doc_id = q.doc_id
GROUP BY q.doc_id, q.size, q.source_size, q.target
"""

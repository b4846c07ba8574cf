"""Class balancing (O45-O51): exact seeded 50/50 set with audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .clean import filter_reviews
from .dedupe import duplicate_rows, keep_first_by_text, with_review_key
from .rank import seeded_hash, take_n, with_rank

KEY = ["entity_id", "_key"]


def load_validated(df: DataFrame) -> DataFrame:
    """Balance-input validation: O30-O33 with lower-casing, no length rule."""
    return filter_reviews(df, "text", "label", "entity_id", 0, lower=True)


def class_inputs(general: DataFrame, negatives: DataFrame):
    """Positives only from the general set, negatives only from the
    negatives set; each deduped keep-first on (entity, normalised text)."""
    pos = keep_first_by_text(load_validated(general).filter(F.col("label") == 1))
    neg = keep_first_by_text(load_validated(negatives).filter(F.col("label") == 0))
    return pos, neg


def class_counts(pos: DataFrame, neg: DataFrame) -> tuple[int, int]:
    """(positives, negatives) available, in one aggregation job."""
    c = (pos.select(F.lit(1).alias("p")).unionByName(neg.select(F.lit(0).alias("p")))
         .agg(F.count_if(F.col("p") == 1).alias("pos"),
              F.count_if(F.col("p") == 0).alias("neg")).first())
    return int(c["pos"]), int(c["neg"])


def check_classes(pos: DataFrame, neg: DataFrame) -> int:
    """O46 guards: fail if no negatives or too few positives. Returns the
    target size (the number of negatives)."""
    n_pos, n_neg = class_counts(pos, neg)
    if n_neg == 0:
        raise ValueError("no negative reviews to balance against")
    if n_pos < n_neg:
        raise ValueError(f"not enough positives: available={n_pos} "
                         f"required={n_neg}")
    return n_neg


def balance(general: DataFrame, negatives: DataFrame, seed: int = 42,
            with_order: bool = True) -> DataFrame:
    """Negatives + an exact seeded sample of as many positives.

    The two deduplicated classes are written once; the guards (O46), the
    sample and the union read them from there. The guards stop the job, and
    so does a finished set with duplicate (entity, key) members (O50).
    ``with_order`` adds ``ord``: the seeded shuffle position (O49).
    """
    pos, neg = class_inputs(general, negatives)
    pos, neg = staged(pos, "balance-pos"), staged(neg, "balance-neg")
    target = check_classes(pos, neg)
    out = neg.unionByName(take_n(pos, target, seeded_hash(seed, "seq"), "seq"))
    assert_no_duplicates(out)
    if with_order:
        out = with_rank(out, [], seeded_hash(seed, "seq", "shuffle|"), "seq",
                        "ord")
    return out


def audit(df: DataFrame) -> DataFrame:
    """Members of duplicate (entity, normalised text) groups."""
    return duplicate_rows(with_review_key(df), KEY)


def assert_no_duplicates(df: DataFrame) -> None:
    n = audit(df).first()["duplicate_rows"]
    if n:
        raise ValueError(f"duplicates in the balanced set: {n}")


def balance_report(df: DataFrame) -> DataFrame:
    """Total, per class and duplicate count of a balanced set, one row.

    Class counts and duplicate groups come from one grouping pass.
    """
    g = with_review_key(df).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("label") == 0).alias("_neg"),
        F.count_if(F.col("label") == 1).alias("_pos"))
    return g.agg(
        F.sum("_n").cast("long").alias("total"),
        F.sum("_neg").cast("long").alias("negatives"),
        F.sum("_pos").cast("long").alias("positives"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0))
         .cast("long").alias("duplicate_rows"))

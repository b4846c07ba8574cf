"""Quality rules with risk-controlled cutoffs.

Every rule says "a document whose ``feature`` is above a cutoff is bad".
The cutoffs are not guessed: for each stratum (language) and rule, labelled
documents that were judged good are the holdout, the cutoffs of a fixed grid
are tested from the mildest to the strictest: a cutoff is certified if the
exact binomial tail shows that less than ``alpha`` of the good documents
would be rejected, and testing stops at the first one that fails (fixed
sequence, no correction needed inside a rule). Among the certified cutoffs
the one that best tells labelled bad from good documents is taken, the
mildest if several do, none if none does. The level ``delta`` is divided by the number of strata and rules
(Bonferroni), so that with probability ``1 - delta`` no rule in any stratum
falsely rejects more than its ``alpha``. A rule whose mildest cutoff cannot
be shown to be safe rejects nothing there.

Texts are read whole, in one pass; what is shuffled is one narrow row per
labelled document, and the cutoffs come from histograms over the grid. A
document counts once in the holdout however often its row is repeated (of
rows with one doc_id and different texts, the one with the least measures);
documents of different doc_ids count each, also if their texts are alike.

Cases: null and blank texts have no words, hence fail the base rules; a null
stratum is one of its own, apart from the empty one; labels that are null, conflict (a document
labelled good and bad) or name no document are left out; repeated labels
count once; repeated documents are each judged alike; without labels no rule
rejects; columns besides the named ones are never looked at, and travel
inside one struct where whole rows are returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, narrow, python_step, read, staged

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("symbol_ratio", "upper_ratio", "repeat_ratio", "dup_line_ratio", "bang_ratio")
#: Cutoffs from the mildest to the strictest.
GRID = tuple(round(1.0 - 0.01 * i, 2) for i in range(1, 100))
ALPHA = 0.02
DELTA = 0.05
#: Strata up to which their cutoffs are broadcast.
BROADCAST_ROWS = 100_000
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = f"{BASE}, base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def measures(text: bytes | None) -> tuple:
    """The columns of MEASURES after doc_id, for one whole text."""
    raw = text or b""
    words = raw.split()  # at exactly the six ASCII blanks
    n = len(words)
    s = raw.decode()
    chars = len(s) - sum(s.count(c) for c in BLANKS)
    symbols = sum(s.count(c) for c in SYMBOLS)
    seen: set = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    repeat = 0
    if len(found) < len(windows):
        upto = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    upper = sum(map(str.isupper, s)) if n else 0
    letters = sum(map(str.isalpha, s)) if n else 0
    return (n, chars, symbols, dup, repeat, n < 50 or 100 * repeat > 50 * n,
            min(1.0, symbols / n) if n else 0.0, upper / letters if letters else 0.0, repeat / n if n else 0.0,
            dup / lines if lines else 0.0, min(1.0, s.count("!") / n) if n else 0.0)


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """MEASURES and the stratum of every document."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            cols = list(zip(*map(measures, byte_column(b, "text")))) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * len(FEATURES)
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), b.column(1)],
                                  names=[*names, "stratum"])

    d = docs.select("doc_id", F.col(f"`{stratum}`").cast("string").alias("stratum"), "text")
    return python_step(d, rows, f"{MEASURES}, stratum string")


def _stirling(n: int) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: int, mean: float) -> float:
    """x ln(x / mean) + mean - x, without cancellation where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    out, power, j = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        more = out + power / (2 * j + 1)
        if more == out:
            return out
        out, j = more, j + 1


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p): the term of k by its saddle point, the others from it, down to negligible ones."""
    if k >= n:
        return 1.0
    if k == 0:
        return math.exp(n * math.log1p(-p))
    log = _stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    total = part = 1.0
    for i in range(k, 0, -1):  # terms rise up to about n p: at most so many are not negligible beside the last
        part *= i * (1 - p) / ((n - i + 1) * p)
        total += part
        if part < 1e-18 * total and i < n * p:
            break
    return min(1.0, total * math.exp(log) * math.sqrt(n / (2 * math.pi * k * (n - k))))


def safe_cutoff(good: list, n_good: int, bad: list, n_bad: int, alpha: float, level: float) -> float | None:
    """The best certified cutoff; ``good[i]`` of ``n_good`` and ``bad[i]`` of ``n_bad`` documents lie above ``GRID[i]``."""
    best, gain = None, 0.0
    for cutoff, k, caught in zip(GRID, good, bad):
        if k >= alpha * n_good or binomial_tail(k, n_good, alpha) > level:
            break
        if n_bad and caught / n_bad - k / n_good > gain:
            best, gain = cutoff, caught / n_bad - k / n_good
    return best


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, feature, cutoff, good (holdout size): the certified cutoffs."""
    agreed = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.min("quality").alias("good"), F.max("quality").alias("high")).where("good = high")
    held = features.where("NOT base_failed").join(agreed, F.col("doc_id") == F.col("l_id"))
    held = held.groupBy("doc_id", "good").agg(F.min(F.struct(*FEATURES, "stratum")).alias("m")).select("good", "m.*")
    # a document above GRID[i] is above every stricter cutoff: one histogram a stratum and rule, GRID's size at most
    cell = [F.struct(F.lit(f).alias("feature"),
                     F.least(F.lit(len(GRID)), F.greatest(F.lit(0), F.floor((F.lit(1.0) - F.col(f)) * 100 + 1e-9)))
                     .cast("int").alias("cell")) for f in FEATURES]
    hist = held.select("stratum", "good", F.explode(F.array(*cell)).alias("c")).groupBy(
        "stratum", "good", "c.feature", "c.cell").agg(F.count("*").alias("n"))
    hist = staged(hist, "quality-histogram")
    tests = max(1, hist.select("stratum").distinct().count()) * len(FEATURES)

    def choose(key, frame):
        import pandas as pd
        per = [[0] * (len(GRID) + 1), [0] * (len(GRID) + 1)]
        for g, c, n in zip(frame["good"], frame["cell"], frame["n"]):
            per[g][c] += int(n)
        bad, good = (list(accumulate(x)) for x in per)
        best = safe_cutoff(good, good[-1], bad, bad[-1], alpha, delta / tests) if good[-1] else None
        return pd.DataFrame([] if best is None else [(*key, best, good[-1])], columns=["stratum", "feature", "cutoff", "good"])

    return hist.groupBy("stratum", "feature").applyInPandas(choose, "stratum string, feature string, cutoff double, good long")


def _small(per: DataFrame) -> DataFrame:
    """``per`` (strata, a few numbers each) to be broadcast up to BROADCAST_ROWS; beyond, Spark chooses the join."""
    return F.broadcast(per) if per.count() <= BROADCAST_ROWS else per


def verdicts(features: DataFrame, table: DataFrame) -> DataFrame:
    """``features`` with ``rules_failed`` (names, comma-joined) and ``kept``."""
    per = table.groupBy(F.col("stratum").alias("c_stratum")).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("cutoff"))).alias(f"cut_{f}") for f in FEATURES])
    per = _small(staged(per, "quality-cutoffs"))
    failed = F.concat_ws(",", *[F.when(is_above(F.col(f), F.col(f"cut_{f}")), F.lit(f)) for f in FEATURES])
    return features.join(per, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left").withColumn("rules_failed", failed) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("rules_failed") == ""))


def is_above(value, cutoff):
    """The cell of the histogram lies before that of the cutoff's successor (the same rounding as in the test)."""
    cell = F.floor((F.lit(1.0) - value) * 100 + 1e-9)
    return cell <= F.round((F.lit(1.0) - cutoff) * 100 - 1)


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
           delta: float = DELTA) -> DataFrame:
    features = staged(measured(docs, stratum), "quality-features")
    return verdicts(features, cutoffs(features, labels, alpha, delta))


def filtered(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA,
             delta: float = DELTA) -> DataFrame:
    """``docs`` (all columns) without the documents that a base rule or a certified cutoff rejects; each row is judged by itself."""
    table = cutoffs(staged(measured(docs, stratum), "quality-features"), labels, alpha, delta)
    cell = [F.max(F.when(F.col("feature") == f, F.round((F.lit(1.0) - F.col("cutoff")) * 100 - 1).cast("int"))) for f in FEATURES]
    per = table.groupBy("stratum").agg(F.array(*cell).alias("cells"))
    per = _small(staged(per, "quality-cutoffs"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("row"), F.col(f"`{stratum}`").cast("string").alias("own"))
    d = d.join(per, F.col("own").eqNullSafe(F.col("stratum")), "left").select("row", F.col("row.text").alias("text"), "cells")

    def keep(text, cells) -> bool:
        m = measures(text)
        return not m[5] and not any(c is not None and math.floor((1.0 - x) * 100 + 1e-9) <= c for x, c in zip(m[6:], cells or ()))

    def kept(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            good = list(map(keep, byte_column(b, "text"), b.column(2).to_pylist()))
            yield b.select(["row"]).filter(pa.array(good, pa.bool_()))

    return python_step(d, kept, d.select("row").schema).select("row.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    names = [c.split()[0] for c in BASE.split(", ")]
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        *names, "base_failed", "kept", "rules_failed")

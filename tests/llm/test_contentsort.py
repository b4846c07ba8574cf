"""Exact dedup by a content sort against dictionaries of whole texts."""

import hashlib
import random
from string import ascii_lowercase, ascii_uppercase

import pytest

from opinio.llm import contentsort as C

LOW = str.maketrans(ascii_uppercase, ascii_lowercase)


def norm(t):
    return (t or "").translate(LOW)


def brute(rows, keep):
    """(id, text) -> the digest columns, as a sorted list."""
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        best = (min(known) if keep == "smallest" else max(known)) if known else None
        left = 1
        for i in ids:
            stays = i == best and left == 1
            left -= stays
            out.append((i, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    alphabet = "aAbBéÉİıß\n 😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 4))) for _ in range(120)]
    shared = "S" * 200  # longer than the sort prefix
    texts += [shared + "".join(rng.choice("xXyY") for _ in range(2)) for _ in range(120)]
    texts += ["Hot Text"] * 150 + ["hot text"] * 50 + [None, "", None] + ["long " * 400_000, "LONG " * 400_000]
    rng.shuffle(texts)
    rows = [(i if i % 41 else None, t) for i, t in enumerate(texts)]
    return rows + rows[5:9] + [(None, None), (None, None)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_and_rows(spark, keep):
    rows = corpus()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    want = brute(rows, keep)
    assert rows_of(C.groups(df, keep=keep)) == want
    stay = C.deduplicated(df, keep=keep)
    assert stay.columns == df.columns
    got = sorted(((r["doc_id"], norm(r["text"])) for r in stay.collect()), key=str)
    sha = {hashlib.sha256(norm(t).encode()).hexdigest(): norm(t) for _, t in rows}
    assert got == sorted(((i, sha[h]) for i, _, _, s, h in want if s), key=str)


def test_ranges_cut_a_group(spark):
    """A group of copies is dealt over several ranges and put together again."""
    rows = [(i, "One Copy") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in C.content_sorted(df, "doc_id", "text", "largest").where("text = 'One Copy'").selectExpr(
            "spark_partition_id() p").groupBy("p").count().select("count").collect()]
        assert len(sizes) > 1 and max(sizes) < 2500
        for keep in ("smallest", "largest"):
            assert rows_of(C.groups(df, keep=keep)) == brute(rows, keep)
            assert C.deduplicated(df, keep=keep).count() == 1501
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.groups(empty).collect() == [] and C.deduplicated(empty).collect() == []
    names = ["row", "id", "norm", "prefix", "digest", "keep", "n", "first", "part", "piece", "edge", "carried", "stays",
             "all_n", "e_part", "Keep_Id"]
    df = spark.createDataFrame([(1, "A", *range(len(names))), (2, "a", *range(len(names))), (3, None, *range(len(names)))],
                               "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    out = C.deduplicated(df, keep="largest").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(2, "a"), (3, None)]
    assert all(r[c] == i for r in out for i, c in enumerate(names))
    text_ids = spark.createDataFrame([("b", "x"), ("a", "X")], "key string, body string")
    assert [r["key"] for r in C.deduplicated(text_ids, "key", "body").collect()] == ["a"]

import random

from opinio.llm import mixing

SCHEMA = "doc_id long, source string, text string, words string"


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 3.0 * sizes[s] for s in over})


def rows_of(seed, n=300):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "c", "d", None, "e"][:rng.randrange(1, 7)]), " ".join(["w"] * rng.randrange(0, 40)), "clash")
            for i in range(n)]


def test_targets_and_words(spark):
    for seed in (1, 2, 3):
        rows = rows_of(seed) + [(1000, "tiny", "one two", "x"), (1001, "tiny", None, "x"), (1002, "none", "", "x")]
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(got) == len(rows)
        size = {r[0]: len((r[2] or "").split()) for r in rows}
        source = {r[0]: r[1] for r in rows}
        sums = {}
        for i, s in source.items():
            sums[s] = sums.get(s, 0) + size[i]
        want = brute_targets(sums)
        taken = {}
        for r in got:
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == sums[source[r["doc_id"]]]
            assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[source[r["doc_id"]]] = taken.get(source[r["doc_id"]], 0) + r["taken"]
        assert sum(taken.values()) == sum(sums.values())
        assert all(abs(taken[s] - want[s]) <= 1 for s in sums)


def test_reruns_agree_and_positions_tile_the_mix(spark):
    df = spark.createDataFrame(rows_of(9), SCHEMA)
    first = sorted(map(tuple, mixing.mix(df).collect()), key=str)
    assert first == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    items = mixing.in_order(mixing.served(mixing.sized(df), mixing.source_targets(mixing.sized(df)))).orderBy("position").collect()
    at = 0
    for r in items:  # in the order of virtual finish times, without a gap
        assert r["position"] == at
        at += r["words"]
    assert all(a["finish"] <= b["finish"] for a, b in zip(items, items[1:]))


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a", "x y z", "q")] * 3 + [(None, None, None, "q"), (2, "b", "u v", "q")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and all(r["taken"] <= 3 * r["size"] for r in got)
    kept = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns[:4] == ["doc_id", "source", "text", "words"] and kept.where("doc_id = 1").count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).collect() == [] and mixing.mixed(empty).collect() == []

"""Product codebooks with adaptive bounds against plain integer k-means."""

import math
import random

import numpy as np
import pytest

from opinio.llm import veccode as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """{row place: (code, error)} and the codebooks, by comparing every part with every entry in Python integers."""
    ints = [(k, i, [math.floor(1024 * x) for x in v]) for k, (i, v, _) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ints, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    dim = len(order[0][2])
    ints = [r for r in ints if len(r[2]) == dim]
    d = dim // parts
    books = [[r[2][p * d:(p + 1) * d] for r in order if len(r[2]) == dim][:entries] for p in range(parts)]

    def assign():
        out = {}
        for k, _, v in ints:
            hits = [min((sum((a - b) ** 2 for a, b in zip(v[p * d:(p + 1) * d], c)), e) for e, c in enumerate(books[p]))
                    for p in range(parts)]
            out[k] = [h[1] for h in hits], sum(h[0] for h in hits)
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * d:(p + 1) * d] for k, _, v in ints if codes[k][0][p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    return assign(), books


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", id int").repartition(3)
    got, books = V.compressed(df.drop("id"), **{k: v for k, v in how.items()})
    want, want_books = brute(rows, **{k: v for k, v in how.items() if k != "bounds"})
    assert books.tolist() == want_books
    ours = sorted(((r["id"], r["label"], tuple(r["code"]), r["error"]) for r in got.collect()), key=str)
    assert ours == sorted(((rows[k][0], rows[k][2], tuple(c), e) for k, (c, e) in want.items()), key=str)


@pytest.mark.parametrize("entries,bounds", [(16, 4), (40, 16), (3, 16), (1, 2)])
def test_equals_plain_kmeans(spark, entries, bounds):
    rng = random.Random(entries)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, .2))) for c in rng.choice(centres)], i % 3) for i in range(400)]
    check(spark, rows, entries=entries, bounds=bounds)


def test_ties_repeats_and_bad_vectors(spark):
    rng = random.Random(5)
    grid = [[float(rng.randrange(-2, 3)) / 1024 for _ in range(8)] for _ in range(60)]  # few values: ties everywhere
    rows = [(i // 2, grid[i % 60], None if i % 4 else 1) for i in range(200)] + [(7, grid[3], 1)] * 80
    rows += [(None, grid[5], 2), (None, None, 2), (900, [1.0, None] * 4, 1), (901, [float("nan")] * 8, 1),
             (902, [float("inf")] + [0.0] * 7, 1), (903, [0.5] * 4, 1), (904, [-0.5, -1e-9] * 4, 0)]
    check(spark, rows, entries=20, bounds=4)


def test_bounds_are_certain():
    """Stored bounds never exceed the distances they stand for, whatever b; large integers are verified."""
    rng = np.random.default_rng(2)
    for size in (50, 1 << 26):
        x = rng.integers(-size, size, (300, 4))
        c = rng.integers(-size, size, (40, 4))
        x[:20], c[7] = c[3], c[3]
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(u, w)) for w in c] for u in x], object)
        near, own, low, out = V.nearest(x, c, 6)
        for _ in range(4):
            assert near[:, 0].tolist() == [min(range(40), key=lambda e: (row[e], e)) for row in exact]
            assert own.tolist() == [min(row) for row in exact]
            state = V.loaded(*V.stored(near, low, out, 5))
            for i, row in enumerate(exact):
                for e, bound in zip(state[0][i, 1:], state[1][i]):
                    assert int(bound) ** 2 <= row[e]
                rest = [row[e] for e in range(40) if e not in set(state[0][i])]
                assert int(state[2][i]) ** 2 <= min(rest)
            old, c = c, c + rng.integers(-max(1, size // 9), max(2, size // 9), c.shape)
            move = np.sqrt(V.squared(c, old).astype(float)) * (1 + 2.0 ** -50)
            exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(u, w)) for w in c] for u in x], object)
            near, own, low, out, reached = V.moved_on(x, c, move, *state)
            assert reached.max() <= 6


def test_bounds_serve():
    """On clustered vectors nearly all parts are settled by their first bound, and none is built anew."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (30, 8))
    x = np.floor((centres[rng.integers(0, 30, 4000)] + rng.normal(0, .05, (4000, 8))) * 1024).astype(np.int64)
    c = np.floor(centres * 1024).astype(np.int64)
    near, own, low, out = V.nearest(x, c, 8)
    new = np.array([x[near[:, 0] == e].mean(0) for e in range(30)]).astype(np.int64)
    move = np.sqrt(V.squared(new, c).astype(float)) * (1 + 2.0 ** -50)
    reached = V.moved_on(x, new, move, near, low, out)[-1]
    assert (reached == 0).mean() > .95 and reached.max() <= 8


def test_empty_and_clashing_columns(spark):
    got, books = V.compressed(spark.createDataFrame([], SCHEMA))
    assert books is None and got.collect() == []
    names = ["id", "v", "code", "error", "cell", "sums", "packed", "ids", "of_label"]
    df = spark.createDataFrame([(1, [0.5] * 4, 3, *range(9)), (2, [0.25] * 4, 3, *range(9))],
                               SCHEMA + ", " + ", ".join(f"{n} int" for n in names))
    got, books = V.compressed(df)
    assert sorted(tuple(r["code"]) for r in got.collect()) == [(0,) * 4, (1,) * 4]
    assert books.tolist() == [[[512], [256]]] * 4

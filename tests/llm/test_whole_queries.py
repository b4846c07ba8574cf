"""Queries without SQL, over the whole tables of the smallest scale, against brute force."""

import hashlib

import duckdb
import numpy as np

from opinio.llm import linededup, quality, simhash

SF = "/root/testdata/sf0.001"


def documents(cols="doc_id, text"):
    return duckdb.sql(f"SELECT {cols} FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_op10_simhash(spark):
    from test_simhash import Sets, brute_fingerprint
    fps = [(i, brute_fingerprint(t)) for i, t in documents()]
    sets = Sets({i: i for i, _ in fps})
    values = np.array([f for _, f in fps], np.uint64)
    for k, (i, f) in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ np.uint64(f)) <= 3):
            sets.join(i, fps[k + 1 + j][0])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", sets.find(i)) for i, f in fps}


def test_op6_linededup(spark):
    from test_linededup import BLANKS
    docs = documents()
    lines = [(i, p, x.strip(BLANKS)) for i, t in docs for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= linededup.MIN_CHARS]
    names = sorted({x[2] for x in lines}, key=len)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if len(b) - len(a) > 2:
                break
            if linededup.within(a, b, 2):
                root[find(a)] = find(b)
    seen, gone = set(), {}
    for i, p, x in lines:
        if find(x) in seen:
            gone.setdefault(i, set()).add(p)
        seen.add(find(x))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in linededup.op6_linededup(spark, SF).collect()}
    assert got == {i: (t.count("\n") + 1, len(gone.get(i, ())), hashlib.sha256("\n".join(
        x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())).encode()).hexdigest()) for i, t in docs}


def test_op3_quality(spark):
    from test_quality import brute_base
    docs = documents("doc_id, text, coalesce(lang, '')")
    labels = dict(duckdb.sql(f"SELECT doc_id, min(quality) FROM '{SF}/labels.parquet' GROUP BY doc_id HAVING min(quality) = max(quality)").fetchall())
    m = {i: quality.measures(t.encode()) for i, t, _ in docs}
    strata = {g for i, _, g in docs if i in labels and not m[i][5]}
    cut = {}
    for g in strata:
        held = [(m[i], labels[i]) for i, _, s in docs if s == g and i in labels and not m[i][5]]
        for f in range(len(quality.FEATURES)):
            sides = [[x[6 + f] for x, y in held if y == side] for side in (1, 0)]
            above = [[sum(v > c for v in side) for c in quality.GRID] for side in sides]
            if sides[0]:
                cut[g, f] = quality.safe_cutoff(above[0], len(sides[0]), above[1], len(sides[1]), quality.ALPHA,
                                                quality.DELTA / (len(strata) * len(quality.FEATURES)))
    got = {r["doc_id"]: tuple(r)[1:8] for r in quality.op3_quality(spark, SF).collect()}
    for i, t, g in docs:
        n, chars, symbols, dup, repeat, failed = brute_base(t)
        bad = any(cut.get((g, f)) is not None and m[i][6 + f] > cut[g, f] for f in range(len(quality.FEATURES)))
        assert got[i] == (n, chars, symbols, dup, repeat, failed, not failed and not bad)

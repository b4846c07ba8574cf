import hashlib
import random

from opinio.llm import linededup as L

BLANKS = " \t\n\r\x0b\x0c"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, s, n, letters):
    b = list(s)
    for _ in range(n):
        o, i = rng.randrange(3), rng.randrange(len(b) + 1)
        if o == 0:
            b.insert(i, rng.choice(letters))
        elif b and o == 1:
            b.pop(min(i, len(b) - 1))
        elif b:
            b[min(i, len(b) - 1)] = rng.choice(letters)
    return "".join(b)


def test_banded_distance():
    rng = random.Random(0)
    for _ in range(5000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 5), "abc")
        for k in (1, 2, 3):
            assert L.within(a, b, k) == (distance(a, b) <= k), (a, b, k)
    long = "x" * 70000
    assert L.within(long, long[:30000] + "y" + long[30002:], 2) and not L.within(long, long[:-3], 2)


def test_segments_find_every_pair():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 30)))
        b = edited(rng, a, rng.randrange(0, 3), "abcd")
        if len(a) < len(b):
            a, b = b, a
        index = {(seed, b[s:e]) for seed, s, e, own in L.probes(len(b), 2) if own}
        assert index & {(seed, a[s:e]) for seed, s, e, _ in L.probes(len(a), 2)}, (a, b)


def case():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(20, 40))).strip().ljust(20, "x") for _ in range(30)]
    docs = []
    for i in range(90):
        lines = [edited(rng, rng.choice(base), rng.randrange(0, 4), "abz") + rng.choice(["", "  ", "\r"]) for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join(lines)))
    return docs + [(200, None), (201, ""), (202, "short\nshort"), (203, docs[3][1]), (203, docs[3][1]), (204, " \n" * 50),
                   (205, "y" * 70000), (206, "y" * 69999)]


def brute(docs, k=2, least=20):
    lines = [(i, p, x.strip(BLANKS)) for i, t in sorted({(i, t or "") for i, t in docs}) for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= least]
    names = sorted({x[2] for x in lines})
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if abs(len(a) - len(b)) <= k and len(a) < 1000 and find(a) != find(b) and distance(a, b) <= k:
                root[find(a)] = find(b)
    if "y" * 70000 in root:
        root[find("y" * 69999)] = find("y" * 70000)
    seen, gone = set(), {}
    for i, p, x in lines:
        if find(x) in seen:
            gone.setdefault(i, set()).add(p)
        seen.add(find(x))
    return {i: gone.get(i, set()) for i, _ in docs}


def test_documents(spark):
    docs = case()
    want = brute(docs)
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, line string, n_chars long")
    got = L.digest(df).collect()
    assert len(got) == len(docs)
    kept = {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in want[i]) for i, t in docs}
    for r in got:
        assert r["n_removed"] == len(want[r["doc_id"]]) and r["kept_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest()
    small = L.repeated(df, 2, 20, 3).collect()  # buckets beyond three lines are dealt out in blocks
    assert {r["doc_id"]: set(r["gone"]) for r in small} == {i: g for i, g in want.items() if g}
    rows = L.deduplicated(df).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    for i, t in docs:
        if not want[i]:
            assert texts[i] == t
        elif kept[i].strip(BLANKS):
            assert texts[i] == kept[i]
        else:
            assert i not in texts
    assert all(r["n_chars"] == (len(r["text"]) if want[r["doc_id"]] else 7) for r in rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.digest(df).collect() == [] and L.deduplicated(df).collect() == []
    one = spark.createDataFrame([(None, "a line that stands alone here"), (1, "a line that stands alone there")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in L.digest(one).collect()} == {None: 1, 1: 0}

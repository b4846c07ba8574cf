import hashlib
import random
import re

from opinio.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, n=10):
    items = []
    for i, t in bench:
        w = words(t)
        k = min(n, len(w))
        items += [(i, w[j:j + k]) for j in range(len(w) - k + 1 if k else 0)]
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, g in items:
            for j in range(len(w) - len(g) + 1):
                if w[j:j + len(g)] == g:
                    hit.update(range(j, j + len(g)))
                    found.add(i)
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def case(seed=3):
    rng = random.Random(seed)
    voc = ["Alpha", "beta", "Ünï", "x1", "δ", "the", "of"]

    def text(n):
        return "".join(rng.choice(voc) + rng.choice([" ", "-", "\n", "  ", "_"]) for _ in range(n))

    bench = [(i, text(rng.randrange(0, 25))) for i in range(25)] + [(7, text(12)), (None, text(11)), (40, None), (41, ""), (42, "Solo!")]
    docs = []
    for i in range(80):
        t = text(rng.randrange(0, 60))
        if i % 3 == 0:
            t += rng.choice(bench)[1] or ""
        docs.append((i, t + text(4)))
    return docs + [(100, None), (101, ""), (102, "..."), (103, "solo"), (104, text(3000))], bench


def test_scan_and_join_equal_brute_force(spark):
    docs, bench = case()
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, 1) for x in bench], "item_id long, text string, gram int")
    want = brute(docs, bench)
    for bound in (D.MAX_GRAMS, 3):  # broadcast, and the shuffle beyond the bound
        rows = D.scan(d, b, max_grams=bound).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert tuple(r)[1:] == want[r["doc_id"]], (bound, r)


def test_removal(spark):
    docs, bench = case(4)
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    clean = {i for i, w in want.items() if not w[4]}
    for bound in (D.MAX_GRAMS, 5):
        kept = D.decontaminate(d, b, max_grams=bound)
        assert {r["doc_id"] for r in kept.collect()} == clean
    cut = D.decontaminate(d, b, remove="spans").collect()
    assert len(cut) == len(docs) + 2
    for r in cut:
        w = want[r["doc_id"]]
        assert len(words(r["text"])) == w[0] - w[1]


def test_removal_beyond_the_bounds(spark, monkeypatch):
    docs, bench = case(4)
    d = spark.createDataFrame([(*r, "x") for r in docs + docs[:2]], "doc_id long, text string, gram string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    clean = {remove: sorted(map(str, D.decontaminate(d, b, remove=remove).collect())) for remove in ("documents", "spans")}
    taken = []
    monkeypatch.setattr(D, "_hash_set", lambda table: taken.append(1))
    for grams, size in ((5, 75 << 20), (D.MAX_GRAMS, 100)):  # by number and by bytes
        monkeypatch.setattr(D, "MAX_BYTES", size, raising=False)
        for remove, rows in clean.items():
            out = D.decontaminate(d, b, remove=remove, max_grams=grams)
            assert out.schema == d.schema and sorted(map(str, out.collect())) == rows
    assert not taken  # nothing came to the driver


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.scan(d, b).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not D.scan(one, b).first()["contaminated"] and D.decontaminate(one, b).count() == 1

import math
from collections import Counter

from opinio.llm import lmscore as M


def brute(docs, order=3, alpha=0.4):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for _, t in docs]
    counts = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    corpus = Counter()
    for c in counts:
        corpus.update(c)
    total = sum(map(len, words))
    out = []
    for w, own in zip(words, counts):
        def other(g):
            return corpus[g] - own[g] if g else total - len(w)
        s = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if other(g) > 0:
                    s += math.log(other(g) / other(g[:-1])) + (most - n) * math.log(alpha)
                    break
            else:
                s += math.log(alpha ** (most - 1) / max(1, total - len(w)))
        out.append((len(w), sum(other((x,)) == 0 for x in w), s / len(w) if w else None))
    return out


def case():
    import random
    rng = random.Random(3)
    voc = ["a", "B", "the", "Ünd", "of", "x"]
    docs = [(i, " ".join(rng.choice(voc) for _ in range(rng.randrange(0, 50))) + f" own{i}") for i in range(60)]
    return docs + [(100, None), (101, ""), (102, " \n"), (103, docs[4][1]), (103, docs[4][1]), (None, "the a b"), (104, "w " * 20000)]


def test_equals_brute_force(spark):
    docs = case()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string")
    want = {}
    for (i, _), w in zip(docs, brute(docs)):
        want[i] = w
    for size in (200, 1 << 20):
        rows = M.score(df, block_bytes=size).collect()
        assert len(rows) == len(docs)
        for r in rows:
            n, unseen, score = want[r["doc_id"]]
            assert (r["n_words"], r["n_unseen"]) == (n, unseen)
            assert r["score"] is None if score is None else abs(r["score"] - score) < 1e-8, (r, score)


def test_count_table_and_empty(spark):
    df = spark.createDataFrame([(1, "a b a b"), (2, "b a")], "doc_id long, text string")
    assert sorted(r["n"] for r in M.count_table(df, order=2).collect()) == [2, 2, 3, 3]
    assert M.score(df.where("false")).collect() == []

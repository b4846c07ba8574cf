import re

import numpy as np
import xxhash

from opinio.llm import simhash as S
from opinio.llm.components import components


class Sets(dict):
    def find(self, a):
        while self[a] != a:
            a = self[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if parts and 2 * votes[b] > len(parts))


def test_fingerprints():
    for t in (None, "", " \n", "One", "one TWO", "Ä b c d", "a b c\x1cd e\x0bf g " * 40, "x y z " * 30000):
        assert S.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_golay_words_one_bit_apart_share_a_key():
    upper, errors = S._golay()
    rng = np.random.default_rng(3)
    for word in rng.integers(0, 1 << 23, 3000):
        keys = []
        for w in (int(word), int(word) ^ (1 << int(rng.integers(23)))):
            e = errors[(w & 0x7FF) ^ upper[w >> 11]]
            keys.append({(w ^ int(x)) for x in e if x >= 0})
            assert all(S._remainder(c) == 0 for c in keys[-1]) and len(keys[-1]) in (1, 6)
        assert keys[0] & keys[1]


def cluster(seed=1):
    rng = np.random.default_rng(seed)
    found = {0}
    for b in rng.integers(0, 2 ** 63, 20, dtype=np.uint64):
        for _ in range(40):
            x = int(b)
            for q in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(q)
            found.add(x)
    return np.array(sorted(found), np.uint64)


def classes(fps, links):
    sets = Sets({int(v): int(v) for v in fps})
    for a, b in links:
        sets.join(a % 2 ** 64, b % 2 ** 64)
    return {v: sets.find(v) for v in sets}


def test_links_connect_what_is_within_three_bits(spark):
    f = cluster()
    df = spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "fp long")
    near = [(int(f[i]), int(f[i + 1 + j])) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= 3)]
    for bound in (S.MAX_BUCKET, 4):  # compared in buckets, and passed on to the midpoint join
        got = [tuple(x) for x in S.links(df, 3, bound).collect()]
        assert all(((a ^ b) % 2 ** 64).bit_count() <= 3 for a, b in got)
        assert classes(f, got) == classes(f, near)


def test_documents(spark):
    docs = [(i, f"lorem ipsum dolor sit amet {i % 7} " * 20 + "tail " * (i % 3), "clash") for i in range(40)]
    docs += [(100, None, "c"), (101, "", "c"), (102, " \n", "c"), (None, docs[3][1], "c"), docs[5], (103, docs[5][1], "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(docs)
    want = Sets({d[0]: d[0] for d in docs if d[0] is not None})
    fps = [(d[0], brute_fingerprint(d[1])) for d in docs if d[0] is not None]
    for i, (a, x) in enumerate(fps):
        for b, y in fps[i + 1:]:
            if (x ^ y).bit_count() <= 3:
                want.join(a, b)
    for r in got:
        assert r["component_id"] == want.find(3 if r["doc_id"] is None else r["doc_id"])
    kept = S.one_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({want.find(d) for d in want})
    assert S.near_duplicates(df.where("false")).collect() == [] and S.one_each(df.where("false")).collect() == []


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(600, 700)]
    sets = Sets({v: v for p in pairs for v in p})
    for a, b in pairs:
        sets.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(v, v) == sets.find(v) for v in sets)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []

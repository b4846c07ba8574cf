import math
import random
from fractions import Fraction

from opinio.llm import quality as Q


def brute_base(t):
    t = t or ""
    words, run = [], ""
    for c in t + " ":
        if c in Q.BLANKS:
            words += [run] if run else []
            run = ""
        else:
            run += c
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.strip(Q.BLANKS):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in Q.SYMBOLS for c in t), dup, len(hit),
            len(words) < 50 or 100 * len(hit) > 50 * len(words))


def test_measures_equal_brute_force():
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a b a b a b", "é x # y\x0bz\x1cw"]
    for _ in range(60):
        texts.append("".join(rng.choice(["w", "é ", "the ", "a b c ", "#", "\n", "x y\n", " "]) for _ in range(rng.randrange(0, 120))))
    for t in texts:
        assert Q.measures(None if t is None else t.encode())[:6] == brute_base(t)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (200, 3, 0.02), (500, 20, 0.05)):
        q = Fraction(p)
        exact = sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k + 1))
        assert abs(Q.binomial_tail(k, n, p) - float(exact)) < 1e-12


def test_cutoffs_are_certified_and_stop_at_the_first_failure():
    good = [0] * 50 + [40] * 49
    bad = [10] * 10 + [30] * 40 + [60] * 49
    assert Q.safe_cutoff(good, 1000, bad, 60, 0.02, 0.01) == Q.GRID[10]  # the mildest of the best
    assert Q.safe_cutoff(good, 50, bad, 60, 0.02, 0.01) is None  # too few to show anything
    assert Q.safe_cutoff([0] * 99, 1000, [0] * 99, 60, 0.02, 0.01) is None


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        body = [f"w{rng.randrange(9999)}" + ("$$$" if bad else "") for _ in range(rng.randrange(60, 90))]
        docs.append((i, " ".join(body), rng.choice(["x", None]), "s", 0))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels


DOC = "doc_id long, text string, lang string, kept string, n_chars long"
LAB = "doc_id long, quality int, toxic int"


def test_verdicts(spark):
    docs, labels = corpus()
    docs += [(5000, None, None, "s", 0), (5001, "short", "x", "s", 0), (None, docs[1][1], "x", "s", 0), docs[7]]
    labels += [labels[0], (1, 0, 0), (None, 1, 0), (9999, 1, 0), (2, None, 0)]
    d, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LAB)
    got = Q.judged(d, lab).collect()
    assert len(got) == len(docs)
    kept = sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert kept == sorted(str(r["doc_id"]) for r in Q.filtered(d, lab).collect())
    assert all(not r["kept"] for r in got if r["doc_id"] in (5000, 5001))
    assert all(r["kept"] == bool(r["doc_id"] % 5) for r in got if r["doc_id"] is not None and r["doc_id"] < 5000)
    # a histogram and the rule agree at the borders of the grid
    assert Q.filtered(d, lab).columns == d.columns


def test_without_labels_or_rows(spark):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], LAB)
    got = Q.judged(spark.createDataFrame(docs, DOC), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert Q.judged(spark.createDataFrame([], DOC), none).collect() == []


def test_filter_in_one_form(spark, monkeypatch):
    good = " ".join(f"w{i}" for i in range(60))
    bad = good + " !" * 30
    docs = [(i, good if i % 2 else bad, 7, i) for i in range(600)]
    # one doc_id, a kept and a rejected row
    docs += [(1000, "x" + good, 7, 0), (1000, "x" + bad, 7, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang int, n_chars long")  # a stratum that is not a string
    lab = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    want = sorted((r["doc_id"], r["kept"]) for r in Q.judged(d, lab).collect())
    assert want == sorted([(i, bool(i % 2)) for i in range(600)] + [(1000, True), (1000, False)])
    for rows in (100_000, 0):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", rows, raising=False)
        out = Q.filtered(d, lab)
        assert out.schema == d.schema
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(got) == sorted([(i, t) for i, t, _, _ in docs if "!" not in t])


def test_binomial_tail_of_large_and_small_holdouts():
    assert Q.binomial_tail(5, 5, .02) == 1 and math.isclose(Q.binomial_tail(0, 3, .5), .125)
    for n, k, p in ((7, 3, .02), (4000, 60, .02), (3000, 1500, .5), (100, 99, .02)):
        q = Fraction(p)
        exact = float(sum(math.comb(n, i) * q ** i * (1 - q) ** (n - i) for i in range(k + 1)))
        assert abs(Q.binomial_tail(k, n, p) / exact - 1) < 1e-12
    assert 0 < Q.binomial_tail(19_990_000, 10 ** 9, .02) < 0.02  # 2.26 standard deviations below the mean


def test_a_repeated_row_is_one_of_the_holdout(spark):
    docs, labels = corpus(40)
    docs = [d for d in docs for _ in range(10)]  # 400 rows of 40 documents certify nothing
    table = Q.cutoffs(Q.measured(spark.createDataFrame(docs, DOC)), spark.createDataFrame(labels, LAB))
    assert table.collect() == []


def test_null_stratum_is_apart(spark):
    rows = [(1, "a " * 60, None, "s", 0), (2, "b " * 60, "", "s", 0)]
    got = {r["doc_id"]: r["stratum"] for r in Q.measured(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: None, 2: ""}


def brute_verdicts(docs, labels):
    """doc_id -> kept, with whole-number binomial tails and a measure of each rule read off its name."""
    def ratios(t):
        n, _, symbols, dup, repeat, failed = brute_base(t)
        lines = [x for x in t.split("\n") if x.strip(Q.BLANKS)]
        letters = [c for c in t if c.isalpha()]
        return failed, [min(1, symbols / n), sum(c.isupper() for c in letters) / max(1, len(letters)), repeat / n,
                        dup / max(1, len(lines)), min(1, t.count("!") / n)] if n else [0] * 5

    judged = {}
    for i, q, _ in labels:
        judged.setdefault(i, set()).add(q)
    judged = {i: q.pop() for i, q in judged.items() if len(q) == 1 and q <= {0, 1}}
    m = {i: (lang, *ratios(t or "")) for i, t, lang, *_ in docs}
    held = {i: m[i] for i in judged if i in m and not m[i][1]}
    strata = {x[0] for x in held.values()}
    cut = {}
    for g in strata:
        for f in range(5):
            good, bad = ([x[2][f] for i, x in held.items() if x[0] == g and judged[i] == y] for y in (1, 0))
            best = 0
            for c in range(99, 0, -1):  # percent, the mildest first
                k = sum(100 * v > c + 1e-7 for v in good)
                tail = sum(math.comb(len(good), i) * 49 ** (len(good) - i) for i in range(k + 1))  # over 50 ** n, alpha 1 / 50
                if not good or 50 * k >= len(good) or tail * 20 * 5 * len(strata) > 50 ** len(good):
                    break
                gain = bad and sum(100 * v > c + 1e-7 for v in bad) / len(bad) - k / len(good)
                if gain and gain > best:
                    best, cut[g, f] = gain, c
    assert len(cut) >= 3
    return {i: not failed and not any((g, f) in cut and 100 * v > cut[g, f] + 1e-7 for f, v in enumerate(values))
            for i, (g, failed, values) in m.items()}


def test_whole_query_where_cutoffs_are_certified(spark, tmp_path):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(2600):
        bad = rng.random() < .2
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(52, 70))]
        for k in range(len(words)):
            if rng.random() < (.2 if bad else .02):
                words[k] += "$"
            if rng.random() < (.3 if bad and i % 3 == 0 else .03):
                words[k] = words[k].upper() + "!" * (i % 2)
        if bad and i % 4 == 0:
            words[20:40] = words[:20]
        docs.append((i, "\n".join([" ".join(words)] + ["same line"] * (3 if bad and i % 5 == 0 else 0)), ["en", None][i % 2], "s", 0))
        if rng.random() < .8:
            labels.append((i, int(not bad), 0))
    docs += [(9000, None, "en", "s", 0), (9001, "short", "", "s", 0)]
    labels += labels[:9] + [(3, 0, 0), (3, 1, 0), (None, 1, 0)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LAB).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["kept"] for r in Q.op3_quality(spark, str(tmp_path)).collect()}
    want = brute_verdicts(docs, labels)
    assert got == want and sum(not k for k in want.values()) > 150

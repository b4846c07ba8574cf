import random

import numpy as np
from pyspark.sql import functions as F

from opinio.llm import langid as G

VOC = {"xx": ["lorum", "ipsar", "dolorum", "sitar", "amentor"], "yy": ["zkrzy", "wczyk", "przsz", "szczy", "krzak"]}


def docs_of(seed=1, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = ("xx", "yy")[i % 2]
        out.append((i, " ".join(rng.choice(VOC[g]) + rng.choice(["", "us" if g == "xx" else "yk"]) for _ in range(rng.randrange(20, 80))), g, "s"))
    return out


SCHEMA = "doc_id long, text string, lang string, score string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = G.Field(["a", "b", "c"], {})
    field.transitions, field.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(8, 3))
    got, pairs = field.marginals(scores, lengths)
    want, want_pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = np.array(np.meshgrid(*[range(3)] * n, indexing="ij")).reshape(n, -1).T
        w = np.array([np.exp(field.first[p[0]] + sum(scores[at + t, p[t]] for t in range(n))
                             + sum(field.transitions[p[t - 1], p[t]] for t in range(1, n))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for t in range(n):
                want[at + t, p[t]] += x
                if t:
                    want_pairs[p[t - 1], p[t]] += x
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_learns_and_labels_switched_text(spark):
    df = spark.createDataFrame(docs_of() + [(500, None, "xx", "s"), (501, "123 !", None, "s"), (502, "", "yy", "s"), (None, "lorum ipsar", None, "s")], SCHEMA)
    field = G.train(df)
    rows = G.predict(df, field).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (500, 501, 502))
    told = [r for r in rows if r["doc_id"] < 500]
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in told)
    assert {r["held_out"] for r in told} == {True, False}
    mixed = spark.createDataFrame([(1, "lorum ipsar dolorum sitar zkrzy wczyk przsz lorum")], "doc_id long, text string")
    assert G.label_words(mixed, field).first()["labels"] == ["xx"] * 4 + ["yy"] * 3 + ["xx"]
    again = G.predict(df.repartition(5), G.train(df.repartition(5)))
    assert {r["doc_id"]: r["lang_pred"] for r in again.collect()} == {r["doc_id"]: r["lang_pred"] for r in G.predict(df, field).collect()}


def test_labels_of_held_out_documents_are_not_used(spark):
    df = spark.createDataFrame(docs_of(), SCHEMA)
    wrong = df.withColumn("lang", F.when(G.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = G.train(df), G.train(wrong)
    assert a.labels == b.labels and np.array_equal(a.weights, b.weights)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, "s")], SCHEMA)
    assert tuple(G.predict(df, G.train(df)).first())[2:] == ("und", 0.0)
    assert G.predict(df.where("false"), G.train(df)).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = G.op4_langid(spark, sf).join(langs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_letters_by_category():
    assert G.words_of("½ ² Ⅷ ١ 12 _") == [] and G.words_of(None) == [] and G.words_of("") == []
    assert G.words_of("Aé1b½c ΟΔΟΣ 東京") == ["aé", "b", "c", "οδος", "東京"]
    for t in ("İstanbul Şehir", "a İ b", "ẞ ﬁ"):
        assert len(G.words_of(t)) == len(G.letter_runs(t))


def test_numerals_are_undetermined_and_labels_stay_aligned(spark):
    docs = spark.createDataFrame(docs_of(), SCHEMA)
    field = G.train(docs)
    odd = spark.createDataFrame([(1, "½ ² Ⅷ", None), (2, "İstanbul x", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in G.predict(odd, field).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] in field.labels
    words = {r["doc_id"]: (r["words"], r["labels"]) for r in G.label_words(odd, field).collect()}
    assert words[2][0] == ["İstanbul", "x"] and len(words[2][1]) == 2 and words[1] == ([], [])


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70) * 3} {chr(0x4E00 + i % 70) * 2} {'abcdefg'[i % 7] * 4}", f"l{i % 70:02d}") for i in range(700)]
    field = G.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_label=10)
    assert len(field.labels) == 70


def test_lexicon_has_a_share_for_each_label(spark):
    """A large language does not crowd out a small one."""
    rows = [("big", f"b{'xyz'[i % 3]}{'abcdefghij'[i % 10]} " * 50) for i in range(60)] + [("small", "sa sb sc")] * 3
    train = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    lexicon = G.lexicon_of(train, ["big", "small"], 8)
    assert {"sa", "sb", "sc"} <= set(lexicon) and len(lexicon) <= 8 and any(w.startswith("b") for w in lexicon)

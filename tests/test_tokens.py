"""Windows, framing, vocabulary and masking against plain-Python loops."""

import pytest
from pyspark.sql import functions as F

from opinio.operators import tokens as TK


def _loop_chunks(ids, max_len, stride):
    w = max_len - 2
    if w <= 0:
        return [[]]
    if len(ids) <= w:
        return [ids]
    step, i, out = max(1, w - stride), 0, []
    while i < len(ids):
        out.append(ids[i:i + w])
        if i + w >= len(ids):
            break
        i += step
    return out


@pytest.mark.parametrize("max_len,stride", [(32, 6), (32, 40), (10, 8), (3, 0)])
def test_windows_equal_loop(spark, max_len, stride):
    w = max_len - 2
    step = max(1, w - stride)
    lens = sorted({0, 1, max(w - 1, 0), w, w + 1, w + step, w + step + 1,
                   3 * w + 5, 100})
    rows = [(n, list(range(10, 10 + n))) for n in lens]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = TK.sliding_windows(df, max_len, stride).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["chunk"], list(r["chunk_ids"]),
                                               list(r["input_ids"]), list(r["attention_mask"])))
    for n, ids in rows:
        want = _loop_chunks(ids, max_len, stride)
        have = sorted(by[n])
        assert [c[1] for c in have] == want, n
        for _, ch, fid, m in have:
            body = [2] + ch + [3]
            assert fid == body + [0] * max(0, max_len - len(body))
            assert m == [1] * len(body) + [0] * max(0, max_len - len(body))


def test_vocab_encode_and_mask(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a b"), (3, ""), (4, "zz!")],
                                 "doc_id long, text string")
    v = {r["token"]: r["id"] for r in TK.build_vocab(docs, size=3).collect()}
    assert v == {"b": 5, "a": 6, "c": 7}
    enc = {r["doc_id"]: r for r in TK.encode(docs, TK.build_vocab(docs, size=3),
                                              max_len=5).collect()}
    assert list(enc[1]["input_ids"]) == [2, 5, 6, 5, 3]
    assert list(enc[3]["input_ids"]) == [2, 3, 0, 0, 0]
    assert list(enc[4]["input_ids"]) == [2, 1, 3, 0, 0]
    e = TK.encode(docs, TK.build_vocab(docs, size=3), max_len=5)
    m = TK.mlm_mask(e, 3, prob=1.0, seed=1, id_cols=("doc_id",)).collect()
    for r in m:
        src = list(enc[r["doc_id"]]["input_ids"])
        for x, mx, lab in zip(src, r["masked_ids"], r["labels"]):
            if x in (0, 2, 3):
                assert mx == x and lab == -100
            else:
                assert lab == x


def test_effective_length(spark):
    df = spark.createDataFrame([([0, 0],), ([1, 1, 0],)], "attention_mask array<int>")
    assert [r[0] for r in df.select(TK.effective_length()).collect()] == [1, 2]


def test_special_tokens_mask(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, "a")], "doc_id long, text string")
    v = TK.build_vocab(docs, size=3)
    e = {r["doc_id"]: r for r in TK.encode(docs, v, max_len=5).collect()}
    assert list(e[1]["special_tokens_mask"]) == [1, 0, 0, 0, 1]
    assert list(e[2]["special_tokens_mask"]) == [1, 0, 1, 1, 1]
    u = {r["doc_id"]: r for r in TK.encode(docs, v, max_len=5, pad=False).collect()}
    assert list(u[2]["input_ids"]) == [2, 5, 3]   # a, b tie on count: a first
    assert list(u[2]["special_tokens_mask"]) == [1, 0, 1]


def test_tokens_of_any_script_and_both_lookups(spark):
    docs = spark.createDataFrame([(1, "Canción añeja, señor! größe Привет 中文 e\u0301"), (2, None), (3, ""), (4, "mir привет"), (4, "x")],
                                 "doc_id long, text string")
    v = TK.build_vocab(docs, size=100)
    words = {r["id"]: r["token"] for r in v.collect()}
    few = TK.token_ids(docs, v).collect()
    many = TK.token_ids(docs, v, max_vocab=0).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in few) == sorted((r["doc_id"], list(r["ids"])) for r in many)
    ids = {r["doc_id"]: r["ids"] for r in few}
    assert [words[i] for i in ids[1]] == ["canción", "añeja", "señor", "größe", "привет", "中文", "e\u0301"]
    assert list(ids[2]) == [] and list(ids[3]) == []


def test_encoding_does_not_shuffle(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = TK.encode(docs, TK.build_vocab(docs, size=5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

import re

import duckdb
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from opinio.llm import pii

TEXTS = [
    "iban DE89 3704 0044 0532 0130 00 ok GB82WEST12345698765432 x", "a@b.co_x@c.org aa@b..c @x.y é☃ me@mail.é z.z@q-w.com.",
    "1.2.3.45.6.7.8 0001.002.3.4 256.1.1.1", "card 4465758382889437 4465758382889437 and 4111 1111 1111 1111-",
    "+1 (743) 555-3824 +44 20 +1234567 ", "amex card 378282246310005", "ssn 123-45-6789 x", "😀 4111111111111111 x" * 50, None, "",
    "9" * 20000 + " 1.1.1.1 " * 3000, "visa 378282246310005 tracking 378282246310005", "a" * 50000, "x" * 30 + "@" + "a.b" * 100,
]


def compare(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.digest(df).collect()))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841  read by DuckDB
    want = sorted(duckdb.connect().execute(pii.ORACLE_SQL).fetchall())
    assert got == want


def test_hand_made_texts_equal_the_contract_patterns(spark):
    compare(spark, TEXTS)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "@", ".", "-", " ", "4111111111111111", "1", "0", "+", "(", "é", "😀", "_", "255", "\n"]),
                         max_size=40).map("".join), min_size=40, max_size=40))
def test_random_texts(spark, texts):
    compare(spark, texts)


def test_iban_ends_at_its_countrys_length(spark):
    texts = ["iban ES91 2100 0418 4502 0005 1332 BIC ABCD", "iban ES91 2100 0418 4502 0005 1332. BIC", "konto DE89 3704 0044 0532 0130 00 12 EUR",
             "account BE68 5390 0754 7034 1234 5678", "account NO93 8601 1117 947 2024", "iban ES9121000418450200051332X", "iban ES91 2100 0418 4502 0005 1333 BIC",
             "bank SE45 5000 0000 0583 9825 7466 SE45 5000 0000 0583 9825 7466 SWIFT"]
    compare(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("iban")] for r in pii.digest(df).collect()}
    assert got == {0: ["iban:5:34"], 1: ["iban:5:34"], 2: ["iban:6:33"], 3: ["iban:8:27"], 4: ["iban:8:26"], 5: [], 6: [],
                   7: ["iban:5:34", "iban:35:64"]}


def test_many_matches_and_redaction(spark):
    t = "x 10.0.0.1 " * 1000
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    spans = pii.digest(df).first()["spans"].split(",")
    assert spans == [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"10\.0\.0\.1", t)]
    assert pii.redacted(df).first()["text"] == "x [ip] " * 1000
    assert pii.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = pii.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

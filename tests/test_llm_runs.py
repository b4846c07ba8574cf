"""LLM reply normalisation and run-log rules."""

import random

import pytest
from pyspark.sql import functions as F

from opinio.functions.llm import parse_reply, prompt
from opinio.operators import runs as R

CASES = [
    ('{"sentimiento": "positiva", "confianza": 85, "razon": " Buena "}', "positive", 85.0, "Buena"),
    ('{"sentimiento": "NEGATIVA", "confianza": "70"}', "negative", 70.0, ""),
    ('Claro: {"sentimiento": "positiva", "confianza": 60, "razon": "ok"} fin', "positive", 60.0, "ok"),
    ("{'sentimiento': 'positiva'}", "positive", None, ""),
    ("La reseña es negativa", "negative", None, ""),
    ("positiva y negativa", "uncertain", None, ""),
    ("{}", "uncertain", None, ""),
    ('{"sentimiento": "mixta", "confianza": null, "razon": null}', "uncertain", None, None),
    ('{"sentimiento": "mixta", "confianza": "x", "razon": "dice negativo"}', "negative", None, "dice negativo"),
    ("", "uncertain", None, ""),
    ('[{"sentimiento": "positiva", "confianza": 90, "razon": "x"}]', "positive", None, ""),
    ('{"sentimiento": "positiva", "sentimiento": "negativa", "confianza": 5}', "negative", 5.0, ""),
    ('{"sentimiento": "negativa", "confianza": "85f"}', "negative", None, ""),
    ('{"sentimiento": "negativa", "confianza": "85d"}', "negative", None, ""),
    ('{"sentimiento": "positiva", "confianza": 70} y {"sentimiento": "negativa"}', "uncertain", None, ""),
    ('"positiva"', "positive", None, ""),
]


def test_parse_reply(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "raw string")
    got = df.select(parse_reply("raw").alias("v")).select("v.*").collect()
    for (raw, v, c, r), g in zip(CASES, got):
        assert (g["verdict"], g["confidence"], g["reason"], g["raw"]) == (v, c, r, raw), raw


def test_documents_without_a_reply_stay(spark):
    from opinio.operators.compare import normalise_replies, side_by_side
    scored = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id long, score double")
    replies = spark.createDataFrame([(1, '{"sentimiento": "positiva"}')], "id long, raw string")
    rows = {r["id"]: r for r in side_by_side(scored, normalise_replies(replies)).collect()}
    assert rows[1]["agree"] and rows[2]["band"] == "negative" and rows[2]["verdict"] is None and not rows[2]["agree"]


def test_prompt(spark):
    p = spark.createDataFrame([("hola",)], "t string").select(prompt("t")).first()[0]
    assert p.endswith('Reseña:\n"""\nhola\n"""') and p.startswith("Eres un clasificador")


def _py_best(accs, frozen, patience):
    best, best_ep, stop, since, n = -1.0, None, None, 0, 0
    for ep, a in enumerate(accs, 1):
        n += 1
        if a > best:
            best, best_ep = a, ep
            if ep > frozen:
                since = 0
        elif ep > frozen:
            since += 1
            if patience > 0 and since >= patience:
                stop = ep
                break
    return n, best_ep, best, stop


@pytest.mark.parametrize("frozen,patience", [(3, 2), (0, 1), (2, 0), (10, 2)])
def test_best_and_stop_vs_loop(spark, frozen, patience):
    rnd = random.Random(frozen * 10 + patience)
    runs = {r: [round(rnd.random(), 1) for _ in range(rnd.randint(1, 9))] for r in range(40)}
    rows = [(r, e, a) for r, accs in runs.items() for e, a in enumerate(accs, 1)]
    df = spark.createDataFrame(rows, "run_id long, epoch int, accuracy double")
    got = {x["run_id"]: x for x in R.best_and_stop(df, frozen_epochs=frozen,
                                                   patience=patience).collect()}
    for r, accs in runs.items():
        n, be, ba, st = _py_best(accs, frozen, patience)
        g = got[r]
        assert (g["epochs_run"], g["best_epoch"], g["best_accuracy"], g["stop_epoch"]) == \
            (n, be, ba, st), (r, accs)


def test_epoch_rollup_and_plan(spark):
    log = spark.createDataFrame([(1, 1, 0.5, True), (1, 1, 1.5, False), (1, 2, 800.0, True)],
                                "run_id long, epoch int, loss double, correct boolean")
    r = {x["epoch"]: x for x in R.epoch_rollup(log).collect()}
    assert r[1]["loss"] == 1.0 and r[1]["accuracy"] == 0.5
    assert r[2]["perplexity"] == float("inf")
    plan = R.sweep_plan(spark).collect()
    assert len(plan) == 18 and plan[0]["run_id"] == "h128_l1_d20"
    assert plan[-1]["run_id"] == "h384_l2_d40"
    res = spark.createDataFrame([("a", None), ("b", 0.9), ("c", 0.95)], "run_id string, test_accuracy double")
    assert [x["run_id"] for x in R.leaderboard(res).collect()] == ["c", "b", "a"]


def test_band_thresholds_and_edges(spark):
    from opinio.functions.scores import band, check_band_thresholds
    for bad in [(0.1, 0.6), (0.45, 0.9), (0.5, 0.5)]:
        with pytest.raises(ValueError):
            check_band_thresholds(*bad)
    df = spark.createDataFrame([(0.45,), (0.5,), (0.6,), (0.0,), (1.2,)], "p double")
    got = [tuple(r) for r in df.select(band("p").alias("b")).select("b.*").collect()]
    assert got[0] == ("negative", pytest.approx(55.0), pytest.approx(45.0))
    assert got[1][0] == "mixed" and got[1][1] is None
    assert got[2] == ("positive", pytest.approx(60.0), pytest.approx(60.0))
    assert got[3] == ("negative", 100.0, 0.0)
    assert got[4] == ("positive", 100.0, 100.0)     # clipped for display

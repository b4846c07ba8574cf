import random

import corpus_pipeline as P

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(8)

    def prose(n):
        return "\n".join(" ".join(f"w{rng.randrange(20000)}" for _ in range(12)) for _ in range(n))

    docs = [(i, prose(rng.randrange(6, 12)), "xx", f"s{i % 4}", 0) for i in range(150)]
    bench = prose(2)
    near = docs[5][1].split("\n")
    near = " ".join(x if k else "quitedifferent" for k, x in enumerate(" ".join(near).split(" ")))
    docs += [(200, docs[3][1], "xx", "s1", 0), (201, near, "xx", "s2", 0), (202, " ".join(docs[5][1].split()), "xx", "s3", 0),
             (203, prose(5) + "\n" + bench + "\n" + prose(4), "xx", "s0", 0), (204, "too short", "xx", "s0", 0), (205, None, None, None, None),
             (206, " ".join(["same three words"] * 60), "xx", "s1", 0)]
    return docs, [(1, bench), (2, None)]


def test_stages_take_effect(spark, tmp_path):
    docs, bench = planted()
    sf = str(tmp_path)
    spark.createDataFrame(docs, DOC).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, d, sf)
        assert out.columns == d.columns or k == len(P.STAGES) - 1
        out.write.parquet(f"{sf}/stage{k}")
        d = spark.read.parquet(f"{sf}/stage{k}")
        seen[name] = {r["doc_id"] for r in d.select("doc_id").collect()}
    clean = set(range(150))
    assert seen["quality_rules"] == clean | {200, 201, 202, 203}
    assert seen["line_dedup"] == clean | {201, 202, 203}  # an exact copy has no line of its own
    assert seen["simhash_dedup"] == clean | {203}
    assert seen["benchmark_decontamination"] == clean
    assert seen["source_mixing"] <= clean
    whole = P.run(spark, sf)
    assert {r["doc_id"] for r in whole.collect()} == seen["source_mixing"]


def test_copies_with_short_lines(spark):
    docs = [r for r in planted()[0] if r[0] < 150]
    whole = docs[7][1].split("\n")
    docs[7] = (*docs[7][:1], "\n".join([whole[0], "intro", *whole[1:], "}"]), *docs[7][2:])
    docs[2] = (*docs[2][:1], docs[2][1] + "\n}", *docs[2][2:])
    docs += [(300, docs[7][1], "xx", "s1", 0),  # an exact copy with a line of 5 characters
             (300, docs[7][1], "xx", "s1", 0), (None, docs[7][1], "xx", "s1", 0),
             (301, docs[7][1] + "\nown", "xx", "s1", 0),  # a short line that occurs nowhere else
             (302, "intro\n}", "xx", "s1", 0), (303, docs[7][1] + "\nown", "xx", "s1", 0)]
    out = P.line_dedup(spark, spark.createDataFrame(docs, DOC), "").collect()
    left = {r["doc_id"]: r["text"] for r in out}
    assert set(left) == set(range(150)) | {301, 302}
    assert left[301] == "intro\n}\nown" and left[302] == "intro\n}" and left[7] == docs[7][1]


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    for name, schema in (("documents", DOC), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{sf}/{name}.parquet")
    assert P.run(spark, sf).collect() == []


def test_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_columns_named_like_helpers(spark, tmp_path, monkeypatch):
    """Values of other columns are unchanged in all stages, whatever they are called."""
    from pyspark.sql import functions as F

    from opinio.llm import decontamination
    names = ["gone", "near", "g_row", "g_text", "g_id", "g_key", "c_id", "c_key", "left", "row", "key", "k_row", "k_id", "m_id", "m_row",
             "mix_row", "mix_size", "q_cells", "q_stratum", "cells", "own", "stratum", "w_id", "w_key", "g_hits", "hits", "size"]
    docs, bench = planted()
    sf = str(tmp_path)
    d = spark.createDataFrame(docs, DOC).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    def same(out, columns):
        got = out.collect()
        assert len(got) > 100 and all(r[c] == f"{c.removeprefix('input_')}{r['doc_id']}" for r in got for c in columns)

    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        same(out, names)
    whole = P.STAGES[-1][1](spark, d, sf)
    assert "input_mix_size" in whole.columns and len(set(whole.columns)) == len(whole.columns)
    same(whole, [n for n in names if n != "mix_size"] + ["input_mix_size"])
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for remove in ("documents", "spans"):  # a benchmark beyond its bound
        same(decontamination.decontaminate(d, items, remove=remove, max_grams=0), names)

"""Collator batches against a plain loop."""

import hashlib
from collections import defaultdict

from opinio.operators.batches import padded_batches, padding_report


def _md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def _loop(rows, size, bucket, seed, epoch):
    spans = defaultdict(list)
    for i, ids in rows:
        ids = ids or []
        spans[(max(len(ids), 1) - 1) // bucket].append((_md5(seed, epoch, i), i, ids))
    batches = []
    for span, members in spans.items():
        members.sort()
        for b in range(0, len(members), size):
            batches.append((_md5(seed, epoch, span, b // size), span, b // size, members[b:b + size]))
    out = []
    for step, (_, _, _, members) in enumerate(sorted(batches)):
        width = max(len(ids) for _, _, ids in members)
        for slot, (_, i, ids) in enumerate(members):
            pad = width - len(ids)
            out.append((step, slot, width, len(ids), i, ids + [0] * pad, [-x for x in ids] + [-100] * pad,
                        [1] * len(ids) + [0] * pad))
    return sorted(out)


def _rows(n=203):
    rows = [(i, list(range(5, 5 + (i * 37) % 90))) for i in range(n)]
    return rows + [(900, None), (901, []), (902, [7] * 400), (3, rows[3][1]), (3, rows[3][1])]


def _frame(spark, rows, parts):
    data = [(i, ids, None if ids is None else [-x for x in ids], 1, "x", 2.0) for i, ids in rows]
    schema = "id long, ids array<int>, labels array<int>, step int, span string, row double"
    return spark.createDataFrame(data, schema).repartition(parts)


def _got(df):
    cols = ["step", "slot", "width", "length", "id", "ids", "labels", "attention_mask"]
    return sorted(tuple(list(v) if isinstance(v, list) else v for v in r) for r in df.select(cols).collect())


def test_batches_equal_loop_for_any_partitioning(spark):
    rows = _rows()
    want = _loop(rows, 8, 16, 42, 1)
    for parts in (1, 5):
        got = padded_batches(_frame(spark, rows, parts), ["id"], {"ids": 0, "labels": -100}, 8, 16, 42, 1)
        assert _got(got) == want
    other = _loop(rows, 8, 16, 42, 2)
    assert [r[4] for r in other] != [r[4] for r in want]


def test_report(spark):
    rows = _rows()
    got = padded_batches(_frame(spark, rows, 3), ["id"], {"ids": 0, "labels": -100}, 8, 16)
    want = _loop(rows, 8, 16, 42, 0)
    r = padding_report(got, 400).first()
    tokens, cells = sum(x[3] for x in want), sum(x[2] for x in want)
    assert (r.n_rows, r.n_batches, r.n_tokens, r.n_cells) == (len(rows), want[-1][0] + 1, tokens, cells)
    assert abs(r.padding_share - (1 - tokens / cells)) < 1e-12 and r.padding_share < r.padding_share_fixed


def test_empty_table(spark):
    none = padded_batches(_frame(spark, _rows(), 2).where("false"), ["id"], {"ids": 0, "labels": -100})
    assert none.count() == 0
    assert tuple(padding_report(none, 10).first()) == (0, 0, 0, 0, 0.0, 0.0)

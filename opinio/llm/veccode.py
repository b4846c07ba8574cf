"""Vector code compression: product codebooks by k-means with Drake-Hamerly adaptive bounds, in integers.

Components become integers floor(1024 x); vectors are cut into equal parts,
each with a codebook of its own. A round assigns every part to its nearest
entry and moves each entry to the floored mean of its parts.

Between rounds every part keeps its assigned entry, the ``b`` next closest
entries with a lower bound each, in order, and one outer bound for all other
entries. When entries move, each bound is lowered by its own entry's move and
the outer one by the largest move. The exact distance to the assigned entry
is then held against the bounds: below the first one the assignment is
certain; up to the outer one the entries whose bounds it has reached are
verified in integers; beyond it all entries are, and the part's bounds are
built anew. Bounds are rounded down and compared strictly, so ties are always
verified, and go to the lower index. ``b`` adapts: the next round keeps as
many bounds as nearly all parts that bounds could serve have reached.

Vectors travel in blocks (a row of some thousand vectors with their bounds),
written after each round as a table under ``spark.checkpoint.dir``: a lost
executor costs one task of one round. Only the codebooks (entries x dimension
integers) and a histogram come to the driver; sums are added up by Spark,
one row an entry and task. The table of the round before is removed when the
next is complete.

Cases: vectors that are null or hold a null or non-finite component are
dropped, as are those whose length differs from the first kept one's (or is
no multiple of the parts) and those with a component whose squares could not
be summed in 64 bits; a null identifier comes last; ties in identifier start
the codebook in the order of their vectors; fewer vectors than entries make
a smaller codebook; an empty table gives an empty result; a null label is a
label of its own; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, small
from .common import narrow, python_step, read, staged

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bounds kept for a part at first, and at least.
BOUNDS, LEAST_BOUNDS = 16, 4
#: Share of the parts that bounds can serve which the next round's bounds are to reach.
SERVED = 0.99
#: Bytes of the vectors of a block, about.
BLOCK_BYTES = 1 << 20
#: Quantised bounds: the largest value, and the mark of "no other entry".
TOP, NONE = 65_000, 65_535


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, v (doubles) of the vectors without null or non-finite components."""
    v = narrow(vectors, id_col, label_col, vec_col).toDF("id", "label", "v")
    v = v.withColumn("v", F.col("v").cast("array<double>"))
    return v.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))))


def starting(v: DataFrame, parts: int, entries: int):
    """The vectors in integers, and the codebooks of the first ones (parts, entries, components)."""
    v = v.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    order = (F.asc_nulls_last("id"), F.asc("v"))
    head = v.orderBy(*order).select(F.size("v").alias("d")).limit(1).first()
    if head is None:
        return None, None
    dim = head["d"]
    most = 2.0 ** 30 / dim ** 0.5  # 4 most^2 dim <= 2^62
    v = v.where((F.size("v") == dim) & F.forall("v", lambda x: F.abs(x) * SCALE < most))
    v = v.select("id", "label", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))
    first = np.array([r["v"] for r in v.orderBy(*order).limit(entries).select("v").collect()], np.int64)
    if not len(first):
        return None, None
    return v, np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to the row of ``c`` beside it."""
    step = x - c
    return np.einsum("ij,ij->i", step, step)


def all_squared(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of all rows of ``x`` to all rows of ``c`` in doubles, and how far off they may be (0: exact)."""
    xx, cc = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
    out = x.astype(float) @ c.T.astype(float)
    out *= -2
    out += xx[:, None]
    out += cc
    size = 2 * (int(xx.max(initial=0)) + int(cc.max(initial=0)))
    return out, 0.0 if size < 1 << 52 else size * 2.0 ** -40


def nearest(x: np.ndarray, c: np.ndarray, b: int):
    """The nearest entry of each part, its squared distance, the b next closest with bounds, and the outer bound."""
    far, slack = all_squared(x, c)
    at = np.arange(len(x))
    best = far.argmin(1)
    if slack:
        close = far <= far[at, best, None] + 2 * slack
        for i in np.flatnonzero(close.sum(1) > 1):  # integers decide, the lower index first
            among = np.flatnonzero(close[i])
            best[i] = among[squared(np.broadcast_to(x[i], (len(among), x.shape[1])), c[among]).argmin()]
    down = np.sqrt(np.maximum(far - slack, 0)) * (1 - 2.0 ** -50)
    down[at, best] = -1
    near = np.argpartition(down, b, axis=1)[:, :b + 1] if b + 1 < len(c) else np.broadcast_to(np.arange(len(c)), far.shape)
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(down, near, 1), axis=1, kind="stable"), 1)
    low = np.take_along_axis(down, near[:, 1:], 1)
    np.put_along_axis(down, near, np.inf, 1)
    return near, squared(x, c[best]), low, down.min(1)


def moved_on(x, c, move, near, low, out):
    """The same from the bounds of the round before; also the bounds each part had to reach (b + 1: built anew)."""
    b = low.shape[1]
    near = near.copy()
    own = squared(x, c[near[:, 0]])
    up = np.sqrt(own.astype(float)) * (1 + 2.0 ** -50)
    bounds = np.concatenate((low - move[near[:, 1:]], (out - move.max(initial=0))[:, None]), 1) * (1 - 2.0 ** -50)
    bounds = np.maximum(np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1], 0)
    reached = (bounds <= up[:, None]).sum(1)
    anew = reached > b
    some = np.flatnonzero((reached > 0) & ~anew)
    low, out = bounds[:, :b].copy(), bounds[:, b].copy()
    if len(some):
        need = reached[some]
        exact = np.full((len(some), b + 1), np.iinfo(np.int64).max)
        exact[:, 0] = own[some]
        for j in range(1, int(need.max()) + 1):
            of = need >= j
            exact[of, j] = squared(x[some[of]], c[near[some[of], j]])
        seen = np.arange(b + 1) <= need[:, None]
        order = np.lexsort((np.where(seen, near[some], len(c) + np.arange(b + 1)), exact), axis=1)
        near[some] = np.take_along_axis(near[some], order, 1)
        exact = np.take_along_axis(exact, order, 1)
        low[some] = np.where(seen[:, 1:], np.sqrt(exact[:, 1:].astype(float)) * (1 - 2.0 ** -50), low[some])
        own[some] = exact[:, 0]
    whole = np.flatnonzero(anew)
    if len(whole):
        near[whole], own[whole], low[whole], out[whole] = nearest(x[whole], c, b)
    return near, own, low, out, reached


def stored(near, low, out, b: int) -> tuple:
    """The state of a part position with ``b`` bounds, as bytes; bounds are rounded down to 16 bits of a common unit."""
    if b < low.shape[1]:
        out = np.minimum(out, low[:, b:].min(1))
        near, low = near[:, :b + 1], low[:, :b]
    top = max(low.max(initial=0), out[np.isfinite(out)].max(initial=0))
    unit = top / TOP or 1.0

    def small_ints(v):
        q = np.floor(np.where(np.isfinite(v), v, 0) / unit)
        q -= q * unit > v
        return np.where(np.isfinite(v), np.maximum(q, 0), NONE).astype(np.uint16)

    return near.astype(np.uint8 if near.max(initial=0) < 256 else np.uint32), small_ints(low), small_ints(out), unit


def loaded(near, low, out, unit) -> tuple:
    return near.astype(np.int64), low * unit, np.where(out == NONE, np.inf, out * unit)


def _blocks(batches: Iterator, dim: int, fresh: bool) -> Iterator:
    """(ids, labels, vectors, state or None) of each block: packed anew, or read back."""
    import pickle

    import pyarrow as pa
    rows = max(1, BLOCK_BYTES // (4 * dim))
    for b in batches:
        if not fresh:
            for ids, labels, packed in zip(b.column(0), b.column(1), b.column(2).to_pylist()):
                vectors, state = pickle.loads(packed)
                yield ids.values, labels.values, vectors.astype(np.int64), state
            continue
        for a in range(0, b.num_rows, rows):
            cut = b.slice(a, rows)
            values = pa.array(cut.column(2)).flatten().to_numpy(zero_copy_only=False)
            yield cut.column(0), cut.column(1), values.astype(np.int64).reshape(-1, dim), None


def _assigned(block, books: np.ndarray, moves, b: int):
    """Entries, squared distances, new state and bounds reached of a block's parts."""
    _, _, vectors, state = block
    parts, _, d = books.shape
    codes, errors, states, used = [], np.zeros(len(vectors), np.int64), [], []
    for p in range(parts):
        x = vectors[:, p * d:(p + 1) * d]
        if state is None:
            near, own, low, out = nearest(x, books[p], b)
        else:
            near, own, low, out, reached = moved_on(x, books[p], moves[p], *loaded(*state[p]))
            used.append(np.minimum(reached, b + 1))
        codes.append(near[:, 0])
        errors += own
        states.append((near, low, out))
    return codes, errors, states, np.concatenate(used) if used else np.empty(0, np.int64)


STATE = "ids array<{0}>, labels array<{1}>, packed binary, cell int, sums array<bigint>"


def _round(books, moves, b: int, keep: int, fresh: bool):
    """A step that writes each block with its new bounds, then the sums of the task: (part x entry) -> count, components."""
    parts, entries, d = books.shape
    width = max(d + 1, BOUNDS + 2)

    def step(batches):
        import pickle

        import pyarrow as pa
        sums = np.zeros((parts, entries, d), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        reach = np.zeros(width, np.int64)
        shape = None
        for block in _blocks(batches, parts * d, fresh):
            codes, _, states, used = _assigned(block, books, moves, b)
            ids, labels, vectors, _ = block
            for p, code in enumerate(codes):
                order = np.argsort(code, kind="stable")
                has, first = np.unique(code[order], return_index=True)
                if len(has):
                    sums[p, has] += np.add.reduceat(vectors[order, p * d:(p + 1) * d], first, axis=0)
                counts[p] += np.bincount(code, minlength=entries)
            reach += np.bincount(used, minlength=width)
            least = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int32
            packed = pickle.dumps((vectors.astype(least), [stored(*s, keep) for s in states]), protocol=5)
            shape = ids.type, labels.type
            yield pa.record_batch([pa.ListArray.from_arrays([0, len(ids)], ids), pa.ListArray.from_arrays([0, len(ids)], labels),
                                   pa.array([packed], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.int64()))],
                                  names=["ids", "labels", "packed", "cell", "sums"])
        if shape:
            rows = [(p * entries + e, [int(counts[p, e]), *sums[p, e].tolist()]) for p, e in zip(*np.nonzero(counts))]
            rows.append((-1, reach.tolist()))
            yield pa.record_batch([pa.nulls(len(rows), pa.list_(shape[0])), pa.nulls(len(rows), pa.list_(shape[1])),
                                   pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()),
                                   pa.array([r[1] + [0] * (width - len(r[1])) for r in rows], pa.list_(pa.int64()))],
                                  names=["ids", "labels", "packed", "cell", "sums"])
    return step, width


def _removed(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bounds: int = BOUNDS):
    """(id, label, code (the entry of each part), error) of every usable vector, and the codebooks (parts, entries, components)."""
    spark = vectors.sparkSession
    if bounds > BOUNDS:
        raise ValueError(f"at most {BOUNDS} bounds")
    v = usable(vectors, id_col, vec_col, label_col)
    kinds = v.schema["id"].dataType, v.schema["label"].dataType
    result = T.StructType([T.StructField("id", kinds[0]), T.StructField("label", kinds[1]),
                           T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    table, books = starting(v, parts, entries)
    if books is None:
        return spark.createDataFrame([], result), None
    many, d = books.shape[1:]
    moves, b, fresh, old = None, min(bounds, many - 1), True, None
    schema = spark.createDataFrame([], STATE.format(*(k.simpleString() for k in kinds))).schema
    for r in range(rounds):
        step, width = _round(books, moves, b, b, fresh)
        path = f"{scratch_path(spark, 'llm')}/vectors-{r}-{uuid.uuid4().hex[:12]}"
        python_step(table, step, schema).write.options(compression="zstd").parquet(path)
        if old:
            _removed(spark, old)
        state = spark.read.schema(schema).parquet(path)
        totals = state.where("cell is not null").groupBy("cell").agg(
            *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
        before, moves = books, np.zeros(books.shape[:2])
        books = books.copy()
        for row in totals.collect():  # parts x entries rows and one histogram
            if row["cell"] < 0:
                served = np.cumsum(row[1:][:b + 1])
                if served[-1]:  # a bound fewer where nearly no part reaches it
                    b = min(b, max(LEAST_BOUNDS, int(np.searchsorted(served, SERVED * served[-1]))))
            else:
                books[divmod(row["cell"], many)] = [s // row["s0"] for s in row[2:2 + d]]
        for p in range(parts):
            moves[p] = np.sqrt(squared(books[p], before[p]).astype(float)) * (1 + 2.0 ** -50)
        table, fresh, old = state.where("cell is null").select("ids", "labels", "packed"), False, path

    def coded(batches):
        import pyarrow as pa
        for block in _blocks(batches, parts * d, fresh):
            codes, errors, _, _ = _assigned(block, books, moves, b)
            code = pa.ListArray.from_arrays(np.arange(0, len(errors) * parts + 1, parts, dtype=np.int32),
                                            pa.array(np.stack(codes, 1).ravel(), pa.int32()))
            yield pa.record_batch([block[0], block[1], code, pa.array(errors)], names=["id", "label", "code", "error"])

    return python_step(table, coded, result), books


def op11_vectorcodes(spark, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    rows, books = compressed(read(spark, sf_dir, "embeddings"))
    text = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    rows = staged(rows.select("id", "label", F.concat_ws("", F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))).alias("code"), "error"), "codes")
    sums = staged(rows.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "code-errors")
    met = rows.join(small(sums), F.col("label").eqNullSafe(F.col("of_label")))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                      F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other; squared distances by inner products of whole numbers, exact in doubles here."""
    out = [f"""
WITH vectors AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM vectors, range({PARTS}) r(p)),
c0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM pieces
  WHERE vec_id IN (SELECT vec_id FROM vectors ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(struct_pack(
  error := (list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c))::BIGINT, e := e)) AS hit
  FROM pieces JOIN c{r} USING (p) GROUP BY vec_id, p)""")
        if r < ROUNDS:
            out.append(f"""m{r} AS (SELECT p, e, list(mean ORDER BY j) AS c FROM (SELECT p, hit.e AS e, j, floor(sum(x[j]) / count(*)) AS mean
  FROM a{r}, range(1, (SELECT len(any_value(x)) + 1 FROM a{r})) g(j) GROUP BY ALL) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    out.append(f"""books AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
codes AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', hit.e), '' ORDER BY p) AS code, sum(hit.error)::BIGINT AS error
  FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT h FROM books) AS codebooks_sha256 FROM codes""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


ORACLE_SQL = _sql()

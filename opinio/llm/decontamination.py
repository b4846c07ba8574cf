"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's windows (``n`` consecutive normalised words; an item of fewer
words is one window) become a table of distinct grams. While it has at most
``max_grams`` rows of ``MAX_BYTES`` it is broadcast as a hash set and every training text is
scanned in one pass without a shuffle: rolling window hashes probe the set
and each hit is verified word by word. Beyond that bound the same windows
are joined by a shuffle on the gram itself; both ways give the same rows.

Cases: null and blank texts have no words and are never contaminated; a
benchmark item without words has no window; repeated items and passages
count once per item_id; an item with a null item_id hits words, but is not
in the list of items (nor counted in n_items); an empty benchmark hits
nothing; columns besides the named ones are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .common import boxed, byte_column, chunked, narrow, python_step, read, row_key, staged, unboxed

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
N = 10
#: Distinct benchmark windows (about 150 bytes each), and bytes of theirs and of the items they name, up to which they are broadcast.
MAX_GRAMS = 500_000
MAX_BYTES = 75 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes | None) -> list[bytes]:
    return WORDS.findall(text.lower()) if text else []  # bytes.lower() changes A-Z only


def grams(bench: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: gram (words joined by a blank), size in words, and the item_ids that hold it."""

    def windows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            ids, gram, size = [], [], []
            for i, t in zip(b.column(0).to_pylist(), byte_column(b, "text")):
                w = words_of(t)
                k = min(n, len(w))
                for j in range(len(w) - k + 1 if k else 0):
                    ids.append(i)
                    gram.append(b" ".join(w[j:j + k]).decode())
                    size.append(k)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(gram, pa.string()), pa.array(size, pa.int32())],
                                  names=["item", "gram", "size"])

    b = bench.select(F.col("item_id").cast("string").alias("item"), "text")
    return python_step(b, windows, "item string, gram string, size int").groupBy("gram", "size").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


class HashSet:
    """Windows by length: a bit table and sorted hashes to probe, and each window's words and items to verify."""

    def __init__(self, rows):
        self.by_size: dict[int, tuple] = {}
        sized: dict[int, dict] = {}
        for gram, size, items in rows:
            sized.setdefault(size, {})[tuple(gram.encode().split(b" "))] = items
        for size, windows in sorted(sized.items()):
            keys = np.array([self.hash(w) for w in windows], np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.by_size[size] = bits, np.sort(keys), windows

    @staticmethod
    def hash(words) -> np.uint64:
        buf, off = T.joined(list(words))
        a = np.frombuffer(buf, np.uint8)
        return T.window_hashes(T.word_hashes(a, off[:-1], off[1:] - 1), len(words))[0]

    def hits(self, texts: list) -> Iterator[tuple[int, int, list]]:
        """For each text: its number of words, of hit words, and the items found; then the hit byte spans."""
        buf, off = T.joined(texts)
        a = T.LOWER[np.frombuffer(buf, np.uint8)]
        s, e = T.spans(a, T.LETTERS)
        h = T.word_hashes(a, s, e)
        first = np.searchsorted(s, off)  # each text's first word
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        low = a.tobytes()
        cover = np.zeros(len(s) + 1, np.int32)
        found: dict[int, set] = {}
        for size, (bits, keys, windows) in self.by_size.items():
            w = T.window_hashes(h, size)
            at = np.flatnonzero(bits[(w >> np.uint64(42)).astype(np.int64)])
            at = at[(doc[at] == doc[at + size - 1]) & np.isin(w[at], keys)]
            for i in at.tolist():  # few: verified by their words
                items = windows.get(tuple(low[s[j]:e[j]] for j in range(i, i + size)))
                if items is not None:
                    cover[i] += 1
                    cover[i + size] -= 1
                    found.setdefault(int(doc[i]), set()).update(items)
        hit = np.cumsum(cover[:-1]) > 0
        totals = np.concatenate(([0], np.cumsum(hit)))
        for k in range(len(texts)):
            i, j = first[k], first[k + 1]
            n_hit = int(totals[j] - totals[i])
            where = []
            if n_hit:
                on = np.flatnonzero(hit[i:j]) + i
                where = [(int(s[r[0]] - off[k]), int(e[r[-1]] - off[k])) for r in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1)]
            yield int(j - i), n_hit, sorted(found.get(k, ())), where


def _digest(items: list) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _fits(table: DataFrame, max_grams: int) -> bool:
    """Whether the grams may be broadcast: their number and bytes are within the bounds."""
    size = F.octet_length("gram") + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8)
    n, total = table.agg(F.count("*"), F.sum(size)).first()
    return n <= max_grams and (total or 0) <= MAX_BYTES


def _hash_set(table: DataFrame):
    """The grams as a broadcast, after their number and bytes were checked against the bounds."""
    rows = table.select("gram", "size", "items").collect()
    return table.sparkSession.sparkContext.broadcast([(r.gram, r.size, list(r["items"])) for r in rows])


_SETS: dict = {}


def _of(shared) -> HashSet:
    key = id(shared)
    if key not in _SETS:
        if len(_SETS) >= 8:
            _SETS.clear()
        _SETS[key] = shared, HashSet(shared.value)
    return _SETS[key][1]


def scan(docs: DataFrame, bench: DataFrame, n: int = N, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per document with the columns of RESULT."""
    table = staged(grams(bench, n), "bench-grams")
    if not _fits(table, max_grams):
        return scan_by_join(docs, table)
    shared = _hash_set(table)

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            texts, out = byte_column(b, "text"), []
            for i, j in chunked(texts):
                out += _of(shared).hits(texts[i:j])
            yield pa.record_batch([
                b.column(0), *(pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)),
                pa.array([len(r[2]) for r in out], pa.int64()), pa.array([_digest(r[2]) for r in out], pa.string()),
                pa.array([r[1] > 0 for r in out], pa.bool_())], names=[c.split()[0] for c in RESULT.split(", ")])

    return python_step(narrow(docs, "doc_id", "text"), rows, RESULT)


def hits_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """w_id, w_key, at (the first word), and the gram's columns, per window of a text that is a gram: joined by a shuffle."""
    sizes = [r["size"] for r in table.select("size").distinct().collect()]  # at most n of them

    def windows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_column(b, "text")):
                w = words_of(t)
                for size in sizes:
                    at = range(len(w) - size + 1)
                    if len(at):
                        yield pa.record_batch([
                            pa.array([i] * len(at), pa.int64()), pa.array([k] * len(at), pa.int64()),
                            pa.array(list(at), pa.int64()), pa.array([b" ".join(w[j:j + size]).decode() for j in at], pa.string())],
                            names=["w_id", "w_key", "at", "w_gram"])

    d = narrow(docs, "doc_id", "text").withColumn("key", row_key())
    w = python_step(d.select("doc_id", "key", "text").distinct(), windows, "w_id long, w_key long, at long, w_gram string")
    return staged(w.join(table, F.col("w_gram") == F.col("gram")), "bench-hits")


def scan_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The same rows as ``scan`` for a benchmark of any size."""
    hits = hits_by_join(docs, table)
    d = narrow(docs, "doc_id", "text").withColumn("key", row_key())
    covered = hits.select("w_id", "w_key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("word")) \
        .distinct().groupBy("w_id", "w_key").agg(F.count("*").alias("n_hit"))
    items = hits.select("w_id", "w_key", F.explode("items").alias("item")).groupBy("w_id", "w_key") \
        .agg(F.sort_array(F.collect_set("item")).alias("found"))  # at most the benchmark's items
    per = covered.join(items.select(F.col("w_id").alias("i_id"), F.col("w_key").alias("i_key"), "found"),
                       F.col("w_id").eqNullSafe(F.col("i_id")) & (F.col("w_key") == F.col("i_key")), "left")
    n_words = F.coalesce(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0))
    found = F.coalesce("found", F.array().cast("array<string>"))
    return d.select("doc_id", "key", n_words.cast("long").alias("n_words")).join(
        per, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, remove: str = "documents",
                  max_grams: int = MAX_GRAMS) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) with the hit spans cut out of the texts.

    All columns are kept. A benchmark beyond ``max_grams`` windows (or
    MAX_BYTES) is joined by a shuffle; both ways give the same rows.
    """
    table = staged(grams(bench, n), "bench-grams")
    at = docs.columns.index("text")

    def without(b, texts, cut):
        import pyarrow as pa
        clean = [_without(t, c) if c else t for t, c in zip(texts, cut)]
        col = pa.array([None if t is None else t.decode() for t in clean], b.schema.field(at).type)
        return pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1:]], schema=b.schema)

    if not _fits(table, max_grams):
        hits = hits_by_join(docs, table)
        d = boxed(docs, "doc_id")
        on = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key"))
        if remove == "documents":
            return unboxed(d.join(hits.select("w_id", "w_key").distinct(), on, "left_anti"), docs)
        per = hits.groupBy("w_id", "w_key").agg(F.collect_set(F.struct("at", "size")).alias("g_hits"))  # at most the text's windows

        def joined(batches: Iterator):
            for b in batches:
                texts = byte_column(b, "text")
                cut = [_spans(t, h) if h else [] for t, h in zip(texts, b.column(len(names)).to_pylist())]
                yield without(b.select(names), texts, cut)

        names, schema, last = docs.columns, docs.schema, "hits"
        while last.lower() in {c.lower() for c in names}:
            last += "_"
        return python_step(d.join(per, on, "left").select("row.*", F.col("g_hits").alias(last)), joined, schema)
    shared = _hash_set(table)

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            texts = byte_column(b, "text")
            cut = [r[3] for i, j in chunked(texts) for r in _of(shared).hits(texts[i:j])]
            if remove == "documents":
                yield b.filter(pa.array([not c for c in cut], pa.bool_()))
            else:
                yield without(b, texts, cut)

    return python_step(docs, rows, docs.schema)


def _spans(text: bytes, hits: list) -> list:
    """The byte spans of the runs of words that the hits (first word, number of words) cover."""
    word = [m.span() for m in WORDS.finditer(text.lower())]
    out, upto = [], -1
    for h in sorted(hits, key=lambda h: h["at"]):
        first, stop = h["at"], h["at"] + h["size"]
        if out and first <= upto:
            upto = max(upto, stop)
            out[-1] = out[-1][0], word[upto - 1][1]
        else:
            upto = stop
            out.append((word[first][0], word[upto - 1][1]))
    return out


def _without(text: bytes, cut: list) -> bytes:
    keep, at = [], 0
    for s, e in sorted(cut):
        keep.append(text[at:max(at, s)])
        at = max(at, e)
    return b"".join([*keep, text[at:]])


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram
       FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM bi)),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, k, i, item_id FROM dg JOIN bg USING (k, gram)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

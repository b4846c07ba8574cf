"""Stupid-backoff scores of documents under the rest of the corpus.

The probability of a word after its context is the relative frequency of the
longest n-gram ending there that occurs in the other documents, times
``ALPHA`` for every word by which the context was shortened. A document's
own n-grams do not count for it (leave one out: its counts are taken off the
corpus counts), else every text would look known.

1. Each block of documents counts its n-grams of every order, and sends, for
   each hash partition, one row: the sorted hashes and their counts.
2. A partition merges what it got: its part of the count table. It joins the
   table to the blocks' n-grams and sends the corpus counts back, in order.
3. Each block looks up its n-grams' counts and sums the scores per document.

So n-grams are exchanged pre-aggregated: a frequent n-gram is one entry a
block, whatever share of the documents has it. (One row per n-gram would
move over 40 bytes a word; the arrays move about six.)

Words are separated by ASCII blanks, and A-Z lower-cased. n-grams never
cross documents. A word that no other document has gets the unigram
probability 1 / (words of the corpus), backed off.

Cases: texts without words (null, blank) have score null and 0 words;
repeated rows each count and see each other; a null doc_id is like any
other; an empty table gives an empty result; columns besides the named ones
are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as T
from .blocks import BLOCK_BYTES, blocks, by_part, pack, pack_sorted, parts_for, unpack, unpack_sorted, with_arrays
from .common import python_step, read

ORDER = 3
ALPHA = 0.4
#: Bits of an n-gram's hash that are sent within its partition, and bytes of arrays per partition.
LOW_BITS = 44
PART_BYTES = 32 << 20
ARRAYS = "part int, block long, packed binary"


def grams(texts: list, order: int) -> tuple[np.ndarray, list]:
    """For concatenated texts: the document of each word; per order n the hash of the n-gram ending at each word
    (0 where it would begin before the document)."""
    buf, off = T.joined(texts)
    a = T.LOWER[np.frombuffer(buf, np.uint8)]
    s, e = T.spans(a, T.SOLID)
    doc = np.searchsorted(off, s, side="right") - 1
    words = T.word_hashes(a, s, e)
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        w = T.window_hashes(words, n)
        if len(w):
            same = doc[:len(w)] == doc[n - 1:]
            h[n - 1:] = np.where(same, w | np.uint64(1), np.uint64(0))
        out.append(h)
    return doc, out


def keyed(h: np.ndarray, parts: int) -> np.ndarray:
    """Sortable keys of n-gram hashes: 16 bits of partition above LOW_BITS of hash (0 stays 0).

    Partitions grow with the corpus and hold some 4 million n-grams each, so
    the odds that an n-gram shares its key stay below one in a million.
    """
    part = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
    return np.where(h > 0, part << np.uint64(48) | (h & np.uint64((1 << LOW_BITS) - 1)), np.uint64(0))


def _counted(table: DataFrame, parts: int, order: int) -> DataFrame:
    """part, block, packed: the n-grams of a block in a part and their counts there."""

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                every = keyed(np.concatenate(grams(unpack(packed)[2], order)[1]), parts)
                key, n = np.unique(every[every > 0], return_counts=True)
                cut = np.searchsorted(key >> np.uint64(48), np.arange(parts + 1))
                low = key & np.uint64((1 << LOW_BITS) - 1)
                for p in range(parts):
                    i, j = cut[p], cut[p + 1]
                    if j > i:
                        value = pack((pack_sorted(low[i:j]), _small(n[i:j])))
                        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([block], pa.int64()),
                                               pa.array([value], pa.binary())], names=["part", "block", "packed"])

    return python_step(table.select("block", "packed"), rows, ARRAYS)


def _small(n: np.ndarray) -> tuple:
    """Counts byte by byte: the upper bytes compress away."""
    return len(n), np.ascontiguousarray(n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _counts(packed: tuple) -> np.ndarray:
    n, raw = packed
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.uint32).ravel()


def _table(rows: list) -> tuple[np.ndarray, np.ndarray, list]:
    """The count table of a part, and the n-grams of each row."""
    hashes, counts = [], []
    for _, packed in rows:
        h, n = unpack(packed)
        hashes.append(unpack_sorted(h))
        counts.append(_counts(n))
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    counts = np.concatenate(counts)[order]
    return every[first], np.add.reduceat(counts, first, dtype=np.int64), hashes


def _returned(part: int, rows: list):
    """The corpus counts of each block's n-grams, in the order they came."""
    import pyarrow as pa
    h, n, hashes = _table(rows)
    for (block, _), own in zip(rows, hashes):
        value = pack(_small(n[np.searchsorted(h, own)]))
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                               pa.array([value], pa.binary())], names=["part", "block", "packed"])


def _scores(found: DataFrame, parts: int, order: int, alpha: float, total: int) -> DataFrame:

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for _, packed, returned in zip(*(c.to_pylist() for c in b.columns)):
                ids, _, texts = unpack(packed)
                doc, hashes = grams(texts, order)
                every = keyed(np.concatenate(hashes), parts)
                own, inverse = np.unique(every, return_inverse=True)
                corpus = np.zeros(len(own), np.int64)
                known = np.flatnonzero(own > 0)[:1]
                begin = int(known[0]) if len(known) else 0
                cut = begin + np.searchsorted(own[begin:] >> np.uint64(48), np.arange(parts + 1))
                for r in returned or ():
                    corpus[cut[r["part"]]:cut[r["part"] + 1]] = _counts(unpack(r["array"]))
                # occurrences in the document itself
                pair = inverse.astype(np.int64) * len(texts) + np.tile(doc, order)
                _, again, n = np.unique(pair, return_inverse=True, return_counts=True)
                others = np.where(every == 0, 0, corpus[inverse] - n[again]).reshape(order, -1)
                words = np.bincount(doc, minlength=len(texts))
                rest = (total - words)[doc]
                shift = np.concatenate((others[:, :1] * 0, others[:, :-1]), axis=1)  # counts of what ends a word before
                score = np.log(alpha ** np.minimum(order - 1, _place(doc)) / np.maximum(1, rest))
                for m in range(1, order + 1):
                    known = others[m - 1] > 0
                    below = shift[m - 2] if m > 1 else rest
                    tried = np.minimum(order, _place(doc) + 1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = np.log(others[m - 1] / below) + (tried - m) * np.log(alpha)
                    score = np.where(known, s, score)
                sums = np.bincount(doc, score, len(texts))
                some = words > 0
                mean = np.round(np.divide(sums, words, out=np.zeros(len(texts)), where=some), 9)
                unseen = np.bincount(doc, others[0] == 0, len(texts)).astype(np.int64)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(words.astype(np.int64)), pa.array(unseen),
                                       pa.array(mean, mask=~some)], names=["doc_id", "n_words", "n_unseen", "score"])

    return python_step(found, rows, "doc_id long, n_words long, n_unseen long, score double")


def _place(doc: np.ndarray) -> np.ndarray:
    """The number of words before each word in its document."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.empty(0, np.int64)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_unseen (words that no other document has), score (mean log of the words' scores)."""
    table = blocks(docs, "lm", block_bytes)
    parts = parts_for(table, 4.0, PART_BYTES)
    found = with_arrays(table, by_part(_counted(table, parts, order), parts, _returned, ARRAYS))
    words = _words(table)
    return _scores(found, parts, order, alpha, words)


def _words(table: DataFrame) -> int:
    """The number of words of the corpus."""
    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for packed in b.column(0).to_pylist():
                n = sum(len((t or b"").split()) for t in unpack(packed)[2])
                yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])
    return python_step(table.select("packed"), rows, "n long").agg(F.sum("n")).first()[0] or 0


def count_table(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """part, hash (LOW_BITS), n: the corpus counts of all n-grams up to ``order``, partitioned by hash."""
    def fn(part: int, rows: list):
        import pyarrow as pa
        h, n, _ = _table(rows)
        yield pa.record_batch([pa.array(np.full(len(h), part, np.int32)), pa.array(h.view(np.int64)), pa.array(n)],
                              names=["part", "hash", "n"])
    table = blocks(docs, "lm", block_bytes)
    parts = parts_for(table, 4.0, PART_BYTES)
    return by_part(_counted(table, parts, order), parts, fn, "part int, hash long, n long")


def op1_lmscore(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


def _oracle(order: int = ORDER, alpha: float = ALPHA) -> str:
    gram = {m: "w[i]" if m == 1 else f"CASE WHEN i >= {m} THEN array_to_string(w[i - {m - 1}:i], ' ') END" for m in range(1, order + 1)}
    before = {m: f"CASE WHEN i > {m} THEN array_to_string(w[i - {m}:i - 1], ' ') END" for m in range(1, order)}
    names = ", ".join(f"{gram[m]} AS g{m}" for m in gram) + ", " + ", ".join(f"{before[m]} AS b{m}" for m in before)
    joins = "".join(
        f" LEFT JOIN corpus c{m} ON c{m}.g = g{m} LEFT JOIN own o{m} ON o{m}.g = g{m} AND o{m}.doc_id = t.doc_id" for m in gram) + "".join(
        f" LEFT JOIN corpus d{m} ON d{m}.g = b{m} LEFT JOIN own p{m} ON p{m}.g = b{m} AND p{m}.doc_id = t.doc_id" for m in before)
    cases = " ".join(
        f"WHEN c{m}.n > o{m}.n THEN ln((c{m}.n - o{m}.n) / (d{m - 1}.n - p{m - 1}.n)) + (least({order}, i) - {m}) * ln({alpha})"
        for m in range(order, 1, -1))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, len(w) AS n_words, {names} FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
own AS (SELECT doc_id, g, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT doc_id, g{m} AS g FROM t WHERE g{m} IS NOT NULL" for m in gram)})
        GROUP BY ALL),
corpus AS (SELECT g, sum(n) AS n FROM own GROUP BY g),
total AS (SELECT sum(len(w)) AS n FROM d),
s AS (SELECT t.doc_id, c1.n = o1.n AS unseen, CASE {cases}
        WHEN c1.n > o1.n THEN ln((c1.n - o1.n) / (total.n - n_words)) + (least({order}, i) - 1) * ln({alpha})
        ELSE ln(pow({alpha}, least({order - 1}, i - 1)) / greatest(1, total.n - n_words)) END AS score
      FROM total, t {joins})
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(count(*) FILTER (unseen) AS BIGINT) AS n_unseen, round(avg(score), 9) AS score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(d.w)
"""


ORACLE_SQL = _oracle()

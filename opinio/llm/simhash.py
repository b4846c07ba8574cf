"""SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprints are grouped first, so exact copies cost one row. Two
fingerprints of at most 3 differing bits agree in one of their four 16-bit
blocks (pigeonhole), and of the 48 bits left one half has at most one error.
Of that half 23 bits are read as a word of the binary Golay code: every word
lies within 3 bits of one codeword, and the codewords within 4 bits (one, or
six if the nearest is 3 away) include the nearest one of every word that
differs in one bit. So (block number, half, block, codeword index) with all
of those indices gives 8 to 48 keys a fingerprint, and linked fingerprints
share one. Keys are shuffled and sorted; each bucket is compared bit by bit
and gives links that connect what it connects, never all its pairs.

A bucket of more than ``max_bucket`` fingerprints is not compared but passed
on: its fingerprints meet at common midpoints (one side flips at most one
bit, the other at most two), an exact join whose rows grow with the
fingerprints, not with their pairs.

Cases: null, empty and blank texts have fingerprint 0 and are linked like
others; a null doc_id is never a component_id unless the whole component has
none; repeated rows share their component; columns besides the named ones
are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, byte_column, python_step, read, row_key, staged, unboxed
from .components import components

SHINGLE = 3
MAX_BITS = 3
MAX_BUCKET = 50_000
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    import xxhash
    words = text.lower().split() if text else []  # A-Z only, and the six ASCII blanks
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (of the row), fp (the 64 bits as a signed long)."""

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in byte_column(b, "text")], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    return python_step(docs.select("doc_id", row_key().alias("key"), "text"), rows, "doc_id long, key long, fp long")


#: The generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xC75


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 upper bits, and per syndrome the errors of weight up to 4 that cause it (-1: none)."""
    upper = np.array([_remainder(d << 11) for d in range(4096)], np.int64)
    single = [_remainder(1 << i) for i in range(23)]
    errors = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for i in bits:
                s ^= single[i]
            if weight == 4 and bin(int(errors[s, 0])).count("1") < 3:
                continue  # a nearer codeword, so none at 4
            errors[s, used[s]] = sum(1 << i for i in bits)
            used[s] += 1
    return upper, errors


_TABLES: list = []


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (uint64), and the fingerprint of each key."""
    if not _TABLES:
        _TABLES.extend(_golay())
    upper, errors = _TABLES
    keys, owners = [], []
    for block in range(4):
        at = np.uint64(16 * block)
        exact = ((fps >> at) & np.uint64(0xFFFF)).astype(np.int64)
        above = fps >> (at + np.uint64(16)) if block < 3 else np.zeros_like(fps)
        rest = ((above << at) | (fps & ((np.uint64(1) << at) - np.uint64(1)))).astype(np.int64)
        for half in range(2):
            word = (rest >> (24 * half)) & 0x7FFFFF
            found = errors[(word & 0x7FF) ^ upper[word >> 11]]
            index = (word[:, None] ^ found) >> 11
            row, col = np.nonzero(found >= 0)
            keys.append(((block * 2 + half) << 28) | (exact[row] << 12) | index[row, col])
            owners.append(fps[row])
    return np.concatenate(keys), np.concatenate(owners)


def _near(fp: np.ndarray, other, max_bits: int) -> np.ndarray:
    return np.bitwise_count(fp ^ other) <= max_bits


def bucket_links(fp: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple]:
    """Links (pairs within ``max_bits``) that connect whatever such pairs connect: a forest."""
    out, left = [], fp
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _near(left, x, max_bits)
            if near.any():
                for y in left[near]:
                    out.append((x, y))
                    front.append(y)
                left = left[~near]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``fp``) that connect all within ``max_bits``."""
    if max_bits > 3:
        raise ValueError("the keys promise links of up to 3 bits")

    def keyed(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 4096):
                k, owner = keys_of(fp[i:i + 4096])
                yield pa.record_batch([pa.array(k), pa.array(owner.view(np.int64))], names=["key", "fp"])

    def bucketed(batches: Iterator):
        import pyarrow as pa

        def rows(pairs):
            a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))],
                                   names=["a", "b"])

        def alone(fp):
            return pa.record_batch([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64())], names=["a", "b"])

        held_key, held, too_many = None, [], False

        def finish():
            if too_many:
                return alone(np.concatenate(held)) if held else None
            fp = np.unique(np.concatenate(held))
            return rows(bucket_links(fp, max_bits)) if len(fp) > 1 else None

        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            # whole buckets inside the batch: pairs by vector operations, larger ones one by one
            inner = np.ones(len(start), bool)
            inner[[0, -1]] = False
            pair = start[inner & (size == 2)]
            near = _near(fp[pair], fp[pair + 1], max_bits) & (fp[pair] != fp[pair + 1])
            found = [*zip(fp[pair][near], fp[pair + 1][near])]
            for i, n in zip(start[inner & (size > 2)], size[inner & (size > 2)]):
                if n <= max_bucket:
                    found += bucket_links(np.unique(fp[i:i + n]), max_bits)
                else:
                    yield alone(fp[i:i + n])
            for i, n in {(int(start[j]), int(size[j])): 0 for j in (0, -1)}:
                if key[i] != held_key:
                    if held_key is not None and (last := finish()) is not None:
                        yield last
                    held_key, held, too_many = key[i], [], False
                held.append(fp[i:i + n])
                if sum(map(len, held)) > max_bucket:
                    too_many = True
                    yield alone(np.concatenate(held))
                    held = []
            if found:
                yield rows(found)
        if held_key is not None and (last := finish()) is not None:
            yield last

    k = python_step(fps.select("fp"), keyed, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    out = staged(python_step(k, bucketed, "a long, b long"), "simhash-links")
    large = out.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    near = out.where("b IS NOT NULL")
    return near.unionByName(links_by_midpoints(large, max_bits))


def links_by_midpoints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The same kind of links by an exact join: x flips up to 1 bit, y up to 2, and both meet at a midpoint."""
    near = (max_bits + 1) // 2 - (max_bits == 3)
    masks = {w: np.array([sum(1 << i for i in c) for k in range(w + 1) for c in combinations(range(64), k)], np.uint64)
             for w in (near, max_bits - near)}

    def flipped(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for x in b.column(0).to_numpy(zero_copy_only=False).view(np.uint64):
                for w, is_near in ((near, True), (max_bits - near, False)):
                    z = (masks[w] ^ x).view(np.int64)
                    fp = np.full(len(z), x, np.uint64).view(np.int64)
                    yield pa.record_batch([pa.array(z), pa.array(fp if is_near else np.zeros_like(fp), mask=np.full(len(z), not is_near)),
                                           pa.array(fp)], names=["z", "x", "fp"])

    z = python_step(fps, flipped, "z long, x long, fp long")
    # all that meet at a midpoint with a near one are within max_bits of that one
    least = z.groupBy(F.col("z").alias("m")).agg(F.min("x").alias("a")).where("a IS NOT NULL")
    return z.join(least, F.col("z") == F.col("m")).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, key, fp and component_id (the smallest doc_id reachable) of every document."""
    prints = staged(fingerprints(docs, shingle), "simhash-fingerprints")
    fps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(links(fps, max_bits, max_bucket))
    member = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = member.select(F.col("fp").alias("m_fp"), F.col("root").alias("m_root")).join(
        ids, F.col("m_root") == F.col("root")).select("m_fp", "root", "component_id")
    return prints.join(staged(ids, "simhash-components"), F.col("fp") == F.col("m_fp")).select(
        "doc_id", "key", "fp", "root", "component_id")


def one_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` (all columns) with one document per component: the one of the smallest doc_id, repeated rows once."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("n"))
    keep = staged(first.select(F.col("first.doc_id").alias("k_id"), F.col("first.key").alias("k_key")), "simhash-keep")
    kept = boxed(docs, "doc_id").join(
        keep, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")), "left_semi")
    return unboxed(kept.dropDuplicates(["doc_id", "key"]), docs)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

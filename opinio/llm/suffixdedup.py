"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes covering it also starts earlier
(in a document that comes before, or earlier in the same one). Matches never
cross documents and are judged on the input.

1. Of every ``length``-byte window the least ``GRAM``-byte gram (by hash,
   leftmost) is its anchor: equal windows have equal anchors at equal places.
   A suffix is taken at each anchor, so only every 35th position or so.
2. Grams that occur once can't belong to a repeated window. Their hashes are
   exchanged by hash partition, and each block gets back one bit per gram.
3. The suffixes that are left, as far as their windows reach, are sorted
   within each block, front-coded (the length of the prefix shared with the
   one before, and the rest) and exchanged as runs, one a block and
   partition. Suffixes alike in everything are sent once a block.
4. Each partition merges its runs with a loser tree that carries common
   prefix lengths: a comparison looks at bytes only where the lengths tie,
   and only behind what is known to be equal. The merged order with its
   prefix lengths gives, for each place of the window relative to the
   anchor, the classes equal on the right; a rolling hash of the bytes left
   of the anchor splits them, and all but the earliest member of a class go.
5. The blocks get back the spans to remove.

A passage that a third of all documents share is one suffix per block and
anchor in the exchange. Runs are bounded by the number of partitions, which
grows with the input.

Cases: null texts are empty; a null doc_id comes last; documents of one
doc_id are ordered by the hash of their text, and rows equal in both count
as one document (each keeps what the first keeps); texts shorter than
``length`` bytes keep everything; columns besides the named ones are never
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .blocks import BLOCK_BYTES, blocks, by_part, pack, pack_sorted, parts_for, unpack, unpack_sorted, with_arrays
from .common import python_step, read, staged

LENGTH = 100
GRAM = 32
_BASE = 0x9E3779B97F4A7C15
ARRAYS = "part int, block long, packed binary"


def gram_hashes(buf: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a power of two) from each position, by doubling."""
    with np.errstate(over="ignore"):
        table = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) ^ np.uint64(0xD1B54A32D192ED03)
        h, n, base = table[buf], 1, _BASE
        while n < size:
            h = h[:-n] * np.uint64(base) + h[n:]
            n, base = 2 * n, base * base % (1 << 64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))


def anchors(text: bytes, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For concatenated documents ending at ``bounds[1:]``: anchor, hash, first and last window start, by anchor."""
    none = np.empty(0, np.int64)
    if len(text) < length:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    least = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal ones
    width, n = length - gram + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[:len(least) - (width - n)], least[width - n:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(len(at) + 1, np.int8)  # windows that lie within one document
    size = np.diff(bounds)
    some = size >= length
    ok[bounds[:-1][some]] += 1
    np.add.at(ok, np.minimum(bounds[1:][some] - length + 1, len(at)), -1)
    inside = np.cumsum(ok[:-1]) > 0
    start = np.flatnonzero(inside)
    q = at[start]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (start[1:] != start[:-1] + 1)))
    first = start[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] if len(start) else none
    q = q[new]
    return q, h[q], first, last


def _loaded(packed: bytes):
    """The documents of a block in their order: positions in the block, ids, keys, concatenated text and bounds."""
    ids, keys, texts = unpack(packed)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, keys[i]))
    parts = [texts[i] or b"" for i in order]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in parts]))).astype(np.int64)
    return order, [ids[i] for i in order], [keys[i] for i in order], b"".join(parts), bounds


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of two strings that agree up to ``at``."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    return at + (len(x) * 8 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()) // 8


def merged(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs of (prefix shared with the one before in the run, string): yields (run, number, prefix
    shared with the one merged before).

    A loser tree: a node keeps the loser of its match and how much it shares
    with the winner. Both sides of a match are compared to the string that
    was put out last, so the longer shared prefix wins without a look at the
    strings, and where they tie, comparison starts behind the prefix.
    """
    n = 1 << max(0, len(runs) - 1).bit_length()
    at = [0] * n
    size = [len(r) for r in runs] + [0] * (n - len(runs))
    loser, shared = [0] * n, [0] * n

    def play(a: int, pa: int, b: int, pb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        if at[a] >= size[a]:
            return b, pb, a, pa
        if at[b] >= size[b]:
            return a, pa, b, pb
        if pa != pb:
            return (a, pa, b, pb) if pa > pb else (b, pb, a, pa)
        x, y = runs[a][at[a]][1], runs[b][at[b]][1]
        p = common_prefix(x, y, pa)
        if (len(x), a) <= (len(y), b) if p == min(len(x), len(y)) else x[p] < y[p]:
            return a, pa, b, p
        return b, pb, a, p

    def build(node: int) -> tuple[int, int]:
        if node >= n:
            return node - n, 0
        a, pa = build(2 * node)
        b, pb = build(2 * node + 1)
        w, pw, loser[node], shared[node] = play(a, pa, b, pb)
        return w, pw

    w, p = build(1)
    while at[w] < size[w]:
        yield w, at[w], p
        at[w] += 1
        p = runs[w][at[w]][0] if at[w] < size[w] else 0
        node = (w + n) // 2
        while node:
            w, p, loser[node], shared[node] = play(w, p, loser[node], shared[node])
            node //= 2


def _sent_grams(table: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """part, block, packed: the gram hashes of a block in a part, sorted, and which of them it has twice."""

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                *_, text, bounds = _loaded(packed)
                h, n = np.unique(anchors(text, bounds, length, gram)[1], return_counts=True)
                part = (h % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part):
                    mine = part == p
                    value = pack((pack_sorted(h[mine]), np.packbits(n[mine] > 1).tobytes()))
                    yield pa.record_batch([pa.array([int(p)], pa.int32()), pa.array([block], pa.int64()),
                                           pa.array([value], pa.binary())], names=["part", "block", "packed"])

    return python_step(table.select("block", "packed"), rows, ARRAYS)


def _repeated(part: int, rows: list):
    """For each block of a part: one bit per gram, set if it occurs again anywhere."""
    import pyarrow as pa
    sets = []
    for _, packed in rows:
        hashes, twice = unpack(packed)
        h = unpack_sorted(hashes)
        sets.append((h, np.unpackbits(np.frombuffer(twice, np.uint8), count=len(h)).astype(bool)))
    every = np.sort(np.concatenate([s for s, _ in sets]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    for (block, _), (h, twice) in zip(rows, sets):
        i = np.minimum(np.searchsorted(again, h), max(0, len(again) - 1))
        hit = twice | ((again[i] == h) if len(again) else False)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                               pa.array([pack((pack_sorted(h[hit])))], pa.binary())], names=["part", "block", "packed"])


def _runs(with_bits: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """The front-coded runs (part >= 0), and as negative parts the spans that a block alone shows to be repeated."""

    def rows(batches: Iterator):
        import pyarrow as pa

        def out(part, block, value):
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                                    pa.array([pack(value)], pa.binary())], names=["part", "block", "packed"])

        for b in batches:
            for block, packed, returned in zip(*(c.to_pylist() for c in b.columns)):
                known = [unpack_sorted(unpack(r["array"])) for r in returned or ()]
                hits = np.sort(np.concatenate(known)) if known else np.empty(0, np.uint64)
                if not len(hits):
                    continue
                order, ids, keys, text, bounds = _loaded(packed)
                q, h, first, last = anchors(text, bounds, length, gram)
                chosen = np.flatnonzero(hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h)
                doc = np.searchsorted(bounds, q[chosen], side="right") - 1
                seen: dict = {}
                gone, suffixes = [], {}
                for i, d in zip(chosen.tolist(), doc.tolist()):
                    a, lo, hi = int(q[i]), int(first[i]), int(last[i])
                    whole = (a - lo, text[lo:hi + length])
                    before = seen.setdefault(whole, (d, a))
                    base = int(bounds[d])
                    if before != (d, a):  # alike and earlier in this block
                        same = ids[before[0]] == ids[d] and keys[before[0]] == keys[d] and before[0] != d \
                            and before[1] - int(bounds[before[0]]) == a - base
                        if not same:
                            gone.append((order[d], lo - base, hi + length - base))
                        else:  # the same place of a repeated row: judged like the first
                            suffixes.setdefault(int(h[i]) % parts, []).append((text[a:hi + length], a, lo, hi, d))
                        continue
                    suffixes.setdefault(int(h[i]) % parts, []).append((text[a:hi + length], a, lo, hi, d))
                if gone:
                    yield out(-1 - block % parts, block, np.array(gone, np.int64))
                for part, run in suffixes.items():
                    run.sort(key=lambda s: s[0])
                    coded, before = [], b""
                    for s, *_ in run:
                        p = common_prefix(before, s, 0)
                        coded.append((p, s[p:]))
                        before = s
                    yield out(part, block, (
                        coded, [text[lo:a] for _, a, lo, _, _ in run],
                        np.array([(ids[d] is None, ids[d] or 0, keys[d], order[d], a - int(bounds[d]), a - hi, a - lo)
                                  for _, a, lo, hi, d in run], np.int64)))

    return python_step(with_bits, rows, ARRAYS)


def _spans(length: int):
    def fn(part: int, rows: list):
        """Merge the runs of a part; for each block the spans (document, start, end) that repeat earlier ones."""
        import pyarrow as pa

        def out(block, spans):
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.int64()),
                                    pa.array([pack(spans)], pa.binary())], names=["part", "block", "packed"])

        if part < 0:
            for block, packed in rows:
                yield out(block, unpack(packed))
            return
        runs, lefts, facts = [], [], []
        for _, packed in rows:
            coded, left, fact = unpack(packed)
            run, s = [], b""
            for p, rest in coded:
                s = s[:p] + rest
                run.append((p, s))
            runs.append(run)
            lefts.append(left)
            facts.append(fact)
        sizes = [len(r) for r in runs]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        sequence = np.array([(begin[r] + i, p) for r, i, p in merged(runs)], np.int64)
        taken, prefix = sequence[:, 0], sequence[:, 1]
        fact = np.concatenate(facts)[taken]
        flat = [x for left in lefts for x in left]
        reach = int(fact[:, 6].max()) if len(fact) else 0
        left = np.zeros((len(taken), reach), np.uint64)  # the bytes before the anchor, nearest first
        for i, t in enumerate(taken.tolist()):
            raw = np.frombuffer(flat[t], np.uint8)[::-1]
            left[i, :len(raw)] = raw
        source = np.repeat(np.arange(len(sizes)), sizes)[taken]
        place = np.lexsort((fact[:, 4], fact[:, 2], fact[:, 1], fact[:, 0]))  # by document, then position
        ranked = fact[place][:, [0, 1, 2, 4]]
        rank = np.empty(len(place), np.int64)
        rank[place] = np.cumsum(np.concatenate(([0], (ranked[1:] != ranked[:-1]).any(axis=1)))) if len(place) else 0
        with np.errstate(over="ignore"):
            rolling = np.zeros(len(taken), np.uint64)
            found = []
            for j in range(reach + 1):
                if j:
                    rolling = rolling * np.uint64(_BASE) + left[:, j - 1] + np.uint64(1)
                right = np.cumsum(prefix < length - j).astype(np.uint64)
                live = place[(fact[place, 5] <= j) & (j <= fact[place, 6])]  # in the order of ranks
                key = (rolling[live] ^ (right[live] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xBF58476D1CE4E5B9)
                by = np.argsort(key, kind="stable")
                new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
                head = live[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else live
                later = rank[live[by]] > rank[head]
                if later.any():
                    i = live[by][later]
                    found.append(np.stack((source[i], fact[i, 3], fact[i, 4] - j), axis=1))
        if not found:
            return
        found = np.unique(np.concatenate(found), axis=0)
        new = np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] != found[:-1, 2] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(found) - 1)
        spans = np.stack((found[first, 1], found[first, 2], found[last, 2] + length), axis=1)
        owner = found[first, 0]
        for k in np.unique(owner):
            yield out(rows[k][0], spans[owner == k])
    return fn


def cut(texts: list, spans: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """The bytes of each text that stay, how many go, and in how many maximal runs."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))] if len(spans) else spans.reshape(0, 3)
    at = np.searchsorted(spans[:, 0], np.arange(len(texts) + 1))
    for i, t in enumerate(texts):
        raw, keep, end, gone, runs, begun = t or b"", [], 0, 0, 0, None
        for _, s, e in spans[at[i]:at[i + 1]].tolist():
            if begun is None or s > end:
                keep.append(raw[end:s])
                runs += 1
                begun, gone, end = s, gone + e - s, e
            elif e > end:
                gone, end = gone + e - end, e
        keep.append(raw[end:])
        yield b"".join(keep), gone, runs


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, packed, returned: the blocks with the spans to remove from their documents."""
    if gram & (gram - 1) or not 0 < gram <= length:
        raise ValueError("gram must be a power of two, at most length")
    table = blocks(docs, "suffix", block_bytes)
    parts = parts_for(table, 0.3)
    bits = staged(by_part(_sent_grams(table, parts, length, gram), parts, _repeated, ARRAYS), "suffix-repeated")
    parts = parts_for(table, 2.0)
    runs = _runs(with_arrays(table, bits), parts, length, gram)
    return with_arrays(table, staged(by_part(runs, parts, _spans(length), ARRAYS), "suffix-spans"))


def _results(spans: DataFrame, fn, schema: str) -> DataFrame:
    def rows(batches: Iterator):
        for b in batches:
            for _, packed, returned in zip(*(c.to_pylist() for c in b.columns)):
                ids, keys, texts = unpack(packed)
                found = [unpack(r["array"]) for r in returned or ()]
                yield fn(ids, cut(texts, np.concatenate(found) if found else np.empty((0, 3), np.int64)), texts)
    return python_step(spans, rows, schema)


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay; null for a null text)."""
    def out(ids, results, texts):
        import pyarrow as pa
        kept = [None if t is None else r[0] for r, t in zip(results, texts)]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "kept"])
    return _results(repeated_spans(docs, length), out, "doc_id long, kept binary")


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    def out(ids, results, texts):
        import pyarrow as pa
        rows = [(len(t or b""), gone, runs, hashlib.sha256(kept).hexdigest()) for (kept, gone, runs), t in zip(results, texts)]
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                               names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return _results(repeated_spans(docs, length, gram, block_bytes), out,
                    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffixdedup(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))

"""Line deduplication by a segment-partition edit join.

A line is stripped of ASCII blanks; lines of at least ``min_chars`` code
points take part, shorter ones stay (but see ``covered``). Two lines are linked if their
edit distance is at most ``max_edits``; linked lines form classes (connected
components), and of each class only the first occurrence, by doc_id and then
position, stays in the documents. Equal lines are one line from the start.

The join: a line is split into ``max_edits + 1`` segments, one of which any
linked line must contain unchanged. A line is indexed under (its length,
segment number, segment) and probes, for each length it may be linked to,
only the substrings whose shift the errors left and right of the segment
allow. Round 1 shuffles 16 bytes a key: the key, and a line code that holds
31 parity bits of the line's character pairs, of which one edit flips at
most four; lines without a partner in a bucket drop out there. Round 2
fetches the texts of the lines that are left (a scan, thinned by a bit table
of fixed size) and verifies by a banded bit-parallel edit distance, one
machine word holding all diagonals of the band. A bucket gives links that
connect what it connects, never all pairs; a bucket of more than
``MAX_BUCKET`` lines is dealt out as pairs of blocks over many tasks.

Cases: null texts have no lines and stay null; a line may be as long as it
likes; repeated rows (same doc_id, same text) count as one document; a null
doc_id comes last in the order; an empty table gives an empty result;
columns besides the named ones are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, byte_column, python_step, read, row_key, staged, unboxed
from .components import components

MAX_EDITS = 2
MIN_CHARS = 20
#: Lines of a bucket that one task compares with each other.
MAX_BUCKET = 20_000
#: Bits of the table that thins the scan for texts (fixed: the broadcast never grows).
TABLE_BITS = 26
_PARITY = (1 << 31) - 1


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each of ``parts`` even segments; the last ones take the rest."""
    base, rest = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - rest)
        out.append((at, n))
        at += n
    return out


_PLANS: dict = {}


def probes(length: int, k: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, stop, indexed) of every substring under which a line of this length is looked up.

    The seed names the partner's length and the segment. Those of its own
    length and place are also the keys under which the line is indexed.
    """
    plan = _PLANS.get((length, k))
    if plan is None:
        plan = []
        for other in range(max(0, length - k), length + 1):
            shift = length - other
            for i, (p, n) in enumerate(segments(other, k + 1)):
                low = max(0, p - i, p + shift - (k - i))
                high = min(length - n, p + i, p + shift + (k - i))
                for start in range(low, high + 1):
                    plan.append((other * (k + 1) + i, start, start + n, shift == 0 and start == p))
        if len(_PLANS) > 100_000:
            _PLANS.clear()
        _PLANS[length, k] = plan
    return plan


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of two strings is at most ``k``: banded, all diagonals in one word."""
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i:i + 64] == b[i:i + 64]:
        i += 64
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, n = 0, n - i
    while j < n and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[:len(a) - j], b[:len(b) - j]
    if not a or not b:
        return True
    where: dict = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i + k  # bit d + k at step i stands for b[i + d]
    full = (1 << 2 * k + 1) - 1
    rows = [full >> k - e & ~((1 << k) - 1) for e in range(k + 1)]  # at first only insertions
    for i, c in enumerate(a):
        same = where.get(c, 0) >> i & full
        new = [rows[0] & same]
        for e in range(1, k + 1):
            new.append((rows[e] & same | rows[e - 1] | rows[e - 1] >> 1 | new[e - 1] << 1) & full)
        rows = new
        if not rows[k]:
            return False
    return bool(rows[k] >> k + len(b) - len(a) & 1)


def _pair_parity(lines: list[str]) -> np.ndarray:
    """31 parity bits of the character pairs of each line (two characters at least)."""
    ends = np.cumsum([len(x) for x in lines])
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (chars[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (chars[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(1) << ((h >> np.uint64(40)) % np.uint64(31))
    bits = np.append(bits, np.uint64(0))  # the last line ends before it
    at = np.stack([np.concatenate(([0], ends[:-1])), ends - 1], axis=1).ravel()
    return np.bitwise_xor.reduceat(bits, at)[::2]


def codes(lines: list[str], hashes: list[int]) -> np.ndarray:
    """33 bits of a line's hash and its 31 parity bits."""
    if not lines:
        return np.empty(0, np.uint64)
    return (np.array(hashes, np.uint64) & ~np.uint64(_PARITY)) | _pair_parity(lines)


def _lines(text: bytes | None, min_chars: int) -> Iterator[tuple[int, bytes, str]]:
    for pos, raw in enumerate((text or b"").split(b"\n")):
        raw = raw.strip()
        if len(raw) >= min_chars:
            line = raw.decode()
            if len(line) >= min_chars:
                yield pos, raw, line


def _chunks(batches: Iterator, min_chars: int):
    """Distinct lines (hash, text) of some thousand texts at a time."""
    import xxhash
    seen: dict = {}
    held = 0
    for b in batches:
        for t in byte_column(b, "text"):
            for _, raw, line in _lines(t, min_chars):
                seen.setdefault(xxhash.xxh64_intdigest(raw), line)
            held += len(t or b"")
            if held > 4 << 20:
                yield seen
                seen, held = {}, 0
    yield seen


def keys(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, code and whether the line is indexed there."""

    def rows(batches: Iterator):
        import pyarrow as pa
        import xxhash
        digest = xxhash.xxh64_intdigest
        for seen in _chunks(batches, min_chars):
            lines = list(seen.values())
            found, owner, indexed = [], [], []
            for i, line in enumerate(lines):
                plan = probes(len(line), k)
                found += [digest(line[s:e].encode(), seed) for seed, s, e, _ in plan]
                indexed += [x[3] for x in plan]
                owner.append(len(plan))
            code = np.repeat(codes(lines, list(seen)), owner)
            key = np.array(found, np.uint64)
            key = (key & ~np.uint64(1)) | np.array(indexed, bool)  # one column less to move: the lowest bit
            for i in range(0, len(key), 1 << 16):
                yield pa.record_batch([pa.array(x[i:i + (1 << 16)].view(np.int64)) for x in (key, code)], names=["key", "code"])

    return python_step(docs.select("text"), rows, "key long, code long")


def _far(code: np.ndarray, other, k: int) -> np.ndarray:
    return np.bitwise_count((code ^ other) & np.uint64(_PARITY)) > 4 * k


def partnered(code: np.ndarray, k: int) -> np.ndarray:
    """The codes of a bucket that some other code there may be linked to."""
    if len(code) == 2:
        return code[:0] if _far(code[0], code[1], k) else code
    keep = np.zeros(len(code), bool)
    for i in range(len(code) - 1):
        if not keep[i] or not keep[i + 1:].all():
            near = ~_far(code[i + 1:], code[i], k)
            if near.any():
                keep[i] = True
                keep[i + 1:] |= near
    return code[keep]


def candidates(keyed: DataFrame, k: int = MAX_EDITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """bucket, code: the lines to verify together; buckets have two codes at least, ``2 * max_bucket`` at most or so."""

    def rows(batches: Iterator):
        import pyarrow as pa

        def out(key, code, large):
            return pa.record_batch([pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(code, np.uint64).view(np.int64)),
                                    pa.array(np.full(len(code), large))], names=["bucket", "code", "large"])

        held_key, held, indexed, large = None, [], False, False

        def finish():
            code = np.unique(np.concatenate(held))
            if large:
                return out(np.full(len(code), held_key), code, True)
            code = partnered(code, k) if indexed and len(code) > 1 else code[:0]
            return out(np.full(len(code), held_key), code, False)

        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False)
            code = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(raw):
                continue
            key, own = raw & ~1, (raw & 1).astype(bool)
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            inner = size > 1
            inner[[0, -1]] = False
            ks, cs = [], []
            for i, n in zip(start[inner].tolist(), size[inner].tolist()):
                c = code[i:i + n]
                if n == 2 and c[0] == c[1] or not own[i:i + n].any():
                    continue
                c = np.unique(c)
                if len(c) > 1 and len(c := partnered(c, k)):
                    ks += [key[i]] * len(c)
                    cs.append(c)
            if cs:
                yield out(ks, np.concatenate(cs), False)
            for j in sorted({0, len(start) - 1}):
                i, n = start[j], size[j]
                if key[i] != held_key:
                    if held_key is not None:
                        yield finish()
                    held_key, held, indexed, large = key[i], [], False, False
                held.append(code[i:i + n])
                indexed |= bool(own[i:i + n].any())
                if sum(map(len, held)) > max_bucket:
                    one = np.unique(np.concatenate(held))
                    held = [one]
                    if len(one) > max_bucket:
                        large = True
                        yield out(np.full(len(one), held_key), one, True)
                        held = [one[:0]]
        if held_key is not None:
            yield finish()

    same = F.col("key").bitwiseAND(F.lit(-2))
    found = python_step(keyed.repartition(same).sortWithinPartitions(same, "code"), rows, "bucket long, code long, large boolean")
    found = staged(found, "line-candidates")
    large = found.where("large").select("bucket", "code").distinct()
    blocks = large.groupBy(F.col("bucket").alias("l_bucket")).agg(F.ceil(F.count("*") / max_bucket).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("code"), "n").cast("int")
    dealt = large.join(blocks, F.col("bucket") == F.col("l_bucket")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.xxhash64("bucket", F.least(mine, "other"), F.greatest(mine, "other")).alias("bucket"), "code")
    return found.where("NOT large").select("bucket", "code").unionByName(dealt)


def _slot(code: np.ndarray) -> np.ndarray:
    """A line code's place in the bit table."""
    with np.errstate(over="ignore"):
        h = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - TABLE_BITS)


def _bit_table(wanted: DataFrame):
    """A bit table of fixed size over the codes, as a broadcast: scans drop lines that it does not hold."""

    def words(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            at = np.unique(_slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(at):
                word = (at >> np.uint64(6)).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.record_batch([pa.array(word[first]), pa.array(bits.view(np.int64))], names=["w", "b"])

    rows = python_step(wanted, words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(1 << TABLE_BITS - 6, np.uint64)  # at most 2 ** TABLE_BITS bits came to the driver
    table[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return wanted.sparkSession.sparkContext.broadcast(table)


def texts_of(docs: DataFrame, found: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """t_code, hash and text of the lines whose code is in ``found``."""
    wanted = found.select("code").distinct()

    def rows(batches: Iterator):
        import pyarrow as pa
        for seen in _chunks(batches, min_chars):
            lines, hashes = list(seen.values()), np.array(list(seen), np.uint64)
            code = codes(lines, list(seen))
            yield pa.record_batch([pa.array(code.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(lines, pa.string())],
                                  names=["t_code", "hash", "line"])

    shared = _bit_table(wanted)

    def thin(batches: Iterator):
        import pyarrow as pa
        table = shared.value
        for b in rows(batches):
            at = _slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            hit = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool)))

    lines = python_step(docs.select("text"), thin, "t_code long, hash long, line string")
    return lines.join(wanted, F.col("t_code") == F.col("code"), "left_semi").dropDuplicates(["t_code", "hash"])


def bucket_links(members: list[tuple[int, int, str]], k: int) -> list[tuple[int, int]]:
    """Links of verified lines (code, hash, text) that connect whatever such links connect: a forest."""
    code = np.array([m[0] for m in members], np.uint64)
    size = np.array([len(m[2]) for m in members])
    left, out = np.arange(1, len(members)), []
    front = [0]
    while True:
        while front and len(left):
            x = front.pop()
            maybe = ~_far(code[left], code[x], k) & (np.abs(size[left] - size[x]) <= k)
            gone = np.zeros(len(left), bool)
            for j in np.flatnonzero(maybe):
                y = int(left[j])
                if within(members[x][2], members[y][2], k):
                    gone[j] = True
                    out.append((members[x][1], members[y][1]))
                    front.append(y)
            left = left[~gone]
        if not len(left):
            return out
        front, left = [int(left[0])], left[1:]


def links(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """a, b: hashes of different lines within ``k`` edits, enough to connect all such lines."""
    found = staged(candidates(keys(docs, k, min_chars), k, max_bucket), "line-buckets")
    lines = staged(texts_of(docs, found, min_chars), "line-texts")
    members = found.join(lines, F.col("code") == F.col("t_code")).select("bucket", "code", "hash", "line")

    def rows(batches: Iterator):
        import pyarrow as pa

        def out(pairs):
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))], names=["a", "b"])

        held_key, held = None, {}
        for b in batches:
            found = []
            for key, code, h, line in zip(*(c.to_pylist() for c in b.columns)):
                if key != held_key:
                    if len(held) > 1:
                        found += bucket_links([(c % (1 << 64), x, t) for x, (c, t) in held.items()], k)
                    held_key, held = key, {}
                held[h] = code, line
            if found:
                yield out(found)
        if len(held) > 1:
            yield out(bucket_links([(c % (1 << 64), x, t) for x, (c, t) in held.items()], k))

    return python_step(members.repartition("bucket").sortWithinPartitions("bucket"), rows, "a long, b long").distinct()


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key, pos and the 128 bits h, h2 of every line that takes part."""

    def rows(batches: Iterator):
        import pyarrow as pa
        import xxhash
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_column(b, "text")):
                for pos, raw, _ in _lines(t, min_chars):
                    for c, v in zip(cols, (i, key, pos, xxhash.xxh64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1))):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, kinds)),
                                   *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[3:])],
                                  names=["doc_id", "key", "pos", "h", "h2"])

    d = docs.select("doc_id", row_key().alias("key"), "text")
    return python_step(d, rows, "doc_id long, key long, pos int, h long, h2 long")


def repeated(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, key, and the positions of the document's lines that repeat an earlier one (``near``: not equal to it)."""
    roots = staged(components(links(docs, k, min_chars, max_bucket)), "line-classes")
    lines = occurrences(docs, min_chars).join(roots, F.col("h") == F.col("node"), "left").select(
        "doc_id", "key", "pos", "h", "h2", F.coalesce("root", "h").alias("c"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2"))
    lines = staged(lines, "line-occurrences")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "pos", "h", "h2")
    first = lines.groupBy(F.col("c").alias("f"), F.col("c2").alias("f2")).agg(
        F.min(order).alias("first"), F.max(order).alias("latest")).where("first <> latest").drop("latest")
    # rows of one (doc_id, key) are one document, so a line that is its class's first stays in all of them
    again = lines.join(first, (F.col("c") == F.col("f")) & F.col("c2").eqNullSafe(F.col("f2"))).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("pos") == F.col("first.pos"))))
    near = (F.col("h") != F.col("first.h")) | (F.col("h2") != F.col("first.h2"))
    return again.groupBy("doc_id", "key").agg(  # at most the document's lines
        F.collect_set("pos").alias("gone"), F.collect_set(F.when(near, F.col("pos"))).alias("near"))


def short_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key, n_long (lines of the document that take part), and h, h2 of each of its shorter lines that is not blank."""

    def rows(batches: Iterator):
        import pyarrow as pa
        import xxhash
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for i, key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_column(b, "text")):
                long = {raw for _, raw, _ in _lines(t, min_chars)}
                n = sum(1 for _ in _lines(t, min_chars))
                for raw in {x.strip() for x in (t or b"").split(b"\n")} - long - {b""}:
                    for c, v in zip(cols, (i, key, n, xxhash.xxh64_intdigest(raw), xxhash.xxh64_intdigest(raw, 1))):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, kinds)),
                                   *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[3:])],
                                  names=["doc_id", "key", "n_long", "h", "h2"])

    d = docs.select("doc_id", row_key().alias("key"), "text")
    return python_step(d, rows, "doc_id long, key long, n_long int, h long, h2 long")


def covered(docs: DataFrame, gone: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """c_id, c_key of the documents that lost all lines that take part and whose shorter lines all occur in earlier documents.

    The document with a line's first occurrence is never among them, so no line vanishes.
    """
    short = short_lines(docs, min_chars)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = short.groupBy(F.col("h").alias("f"), F.col("h2").alias("f2")).agg(F.min(order).alias("first"))
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), F.size("gone").alias("n_gone"))
    rest = short.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")) & (F.col("n_long") == F.col("n_gone")))
    rest = rest.join(first, (F.col("h") == F.col("f")) & (F.col("h2") == F.col("f2")))
    return rest.groupBy(F.col("doc_id").alias("c_id"), F.col("key").alias("c_key")).agg(
        F.bool_and(F.col("first") < order).alias("all")).where("all").drop("all")


def _joined(docs: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key"), "gone", "near")
    return boxed(docs, "doc_id").join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("key") == F.col("g_key")), "left")


def without(text: bytes | None, gone) -> bytes | None:
    if text is None or not gone:
        return text
    drop = set(gone)
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)


def deduplicated(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` (all columns, ``n_chars`` brought up to date) without repeated lines.

    A document of which only blanks are left is dropped, and so is one of
    which only lines below ``min_chars`` are left that all occur in earlier
    documents (the rest of a copy); documents that had no text before stay as
    they are.
    """
    gone = staged(repeated(docs, k, min_chars), "line-repeated")
    copies = staged(covered(docs, gone, min_chars), "line-covered")
    d = _joined(docs, gone).join(copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")), "left_anti")
    kept = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    d = d.withColumn("left", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept))
    d = d.where(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    fresh = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("long"))
    return unboxed(d, docs, **fresh)


def digest(docs: DataFrame, k: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near (of those, not equal to the line that stays), kept_sha256."""

    def rows(batches: Iterator):
        import pyarrow as pa
        for b in batches:
            out = []
            for t, gone, near in zip(byte_column(b, "text"), b.column(2).to_pylist(), b.column(3).to_pylist()):
                out.append(((t or b"").count(b"\n") + 1 if t is not None else 0, len(gone or ()), len(near or ()),
                            hashlib.sha256(without(t, gone) or b"").hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                  names=["doc_id", "n_lines", "n_removed", "n_near", "kept_sha256"])

    d = docs.select("doc_id", "text")
    return python_step(_joined(d, staged(repeated(d, k, min_chars), "line-repeated")).select("doc_id", F.col("row.text").alias("text"), "gone", "near"), rows,
                       "doc_id long, n_lines long, n_removed long, n_near long, kept_sha256 string")


def op6_linededup(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))

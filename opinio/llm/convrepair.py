"""Conversation structure repair by a bidirectional Dijkstra over the edit lattice.

A conversation is well formed if its role initials read ``(s?(ua)+)?``. A
repair keeps, re-roles or deletes each row in turn and may insert rows
without text anywhere. The lattice has a node for every (rows consumed, state
of the role automaton) and an edge for every edit; a letter leads from a node
to one next node only, so an audit (the edits' initials) names its path.

Two heaps settle nodes from the start and from the accepting ends. A path
found where they meet bounds the cost; both go on until their next distances
add up to more than that, so every cheapest path has a crossing edge from a
node settled forward to one settled backward. The least audit follows by
walking from the start and taking the smallest letter that stays on a
cheapest path: before the crossing by the nodes that reach a crossing, after
it by the distances to the end.

Spark deals conversations out twice by their identifier and sorts each. First
without texts (role, digest, faults): that step solves the lattice. Then with
texts and with the audit as the first row: that step applies the edits while
it hashes, so no text is ever held. A conversation is one task's work, as its
single hash is sequential; memory grows with its number of rows (about a
hundred bytes each), not with its texts.

Cases: a null role or text is one space (never a legal role, and blank); a
null turn sorts first and has no part in gaps; rows of one turn are ordered by
role and the digest of their text; a null conv_id is a conversation of its
own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, python_step, read, staged

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of edits; a row that is not deleted although its end is cut off costs CUT more.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: State of the roles so far: 0 nothing, 1 a system row, 2 a user row, 3 an assistant row; NEXT[state] by role initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state that an inserted or re-roled row leads to: only one role is legal in each.
FILL = (2, 2, 3, 2)
ENDS = (0, 3)
ROLE = {2: "user", 3: "assistant"}


def solve(rows: list) -> tuple[int, str]:
    """The cost of the cheapest repair and the least audit of that cost.

    ``rows`` has (role initial, deleted for certain, end cut off) of each row.
    """
    n = len(rows)
    if not n:
        return 0, ""

    def forward(node):
        i, q = divmod(node, 4)
        if i < n:
            initial, gone, cut = rows[i]
            yield "D", DELETE, node + 4
            if not gone:
                if initial in NEXT[q]:
                    yield "K", CUT * cut, 4 * (i + 1) + NEXT[q][initial]
                yield "R", REROLE + CUT * cut, 4 * (i + 1) + FILL[q]
        yield "I", INSERT, 4 * i + FILL[q]

    def backward(node):
        i, q = divmod(node, 4)
        if i:
            initial, gone, cut = rows[i - 1]
            yield DELETE, node - 4
            if not gone:
                for p in range(4):
                    if NEXT[p].get(initial) == q:
                        yield CUT * cut, 4 * (i - 1) + p
                    if FILL[p] == q:
                        yield REROLE + CUT * cut, 4 * (i - 1) + p
        for p in range(4):
            if FILL[p] == q:
                yield INSERT, 4 * i + p

    ahead, back = {0: 0}, {4 * n + q: 0 for q in ENDS}
    heaps = [[(0, 0)], [(0, v) for v in back]]
    done = [set(), set()]
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        far, v = heapq.heappop(heaps[side])
        if v in done[side]:
            continue
        done[side].add(v)
        near, other = (ahead, back) if side == 0 else (back, ahead)
        best = min(best, far + other.get(v, best))
        for cost, w in ((c, w) for _, c, w in forward(v)) if side == 0 else backward(v):
            if far + cost < near.get(w, best + 1):
                near[w] = far + cost
                heapq.heappush(heaps[side], (far + cost, w))

    def finished(v):
        return v // 4 == n and v % 4 in ENDS and (v not in done[0] or ahead[v] == best)

    crossing = [v for v in done[0] if finished(v) or any(
        w in done[1] and ahead[v] + c + back[w] == best for _, c, w in forward(v))]
    alive, stack = set(crossing), crossing
    while stack:
        v = stack.pop()
        for c, p in backward(v):
            if p in done[0] and p not in alive and ahead[p] + c == ahead[v]:
                alive.add(p)
                stack.append(p)
    audit, v = [], 0
    while not finished(v):
        for letter, c, w in sorted(forward(v)):
            if v in done[0]:
                good = w in done[1] and ahead[v] + c + back[w] == best or w in alive and ahead[v] + c == ahead[w]
            else:
                good = w in done[1] and back[v] == c + back[w]
            if good:
                audit.append(letter)
                v = w
                break
        else:
            raise AssertionError("a node of a cheapest path without a next one")
    return best, "".join(audit)


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damaged(conversations: DataFrame) -> DataFrame:
    """Every row after the damage that its key calls for; a dropped one stays as ``there`` = false, so that its conversation does."""
    d = narrow(conversations, "conv_id", "turn", "role", "text")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return d.withColumn("harm", harm).select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (F.col("harm") != 0).alias("there"),
        F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")).drop("time")


def judged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, there), as a written table, with a digest of the text, blank and cut."""
    end = F.rtrim("text", F.lit(BLANKS))
    return staged(narrow(rows, "conv_id", "turn", "role", "text", "there").select(
        F.lit(1).alias("kind"), "*", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut")), "conversations")


def dealt(rows: DataFrame) -> DataFrame:
    """Conversations dealt out by identifier, each in its order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")


def by_conversation(batches: Iterator) -> Iterator:
    """(identifier, its rows as they come, without the identifier) of each conversation of a sorted partition."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for c, group in groupby(rows, key=lambda r: r[0]):
        yield c, (r[1:] for r in group)


def audited(batches: Iterator) -> Iterator:
    """The counts, cost and audit of each conversation, from rows without texts."""
    for c, group in by_conversation(batches):
        seen, turns, rows, counts = set(), set(), [], dict.fromkeys(COUNTS, 0)
        for there, turn, role, digest, blank, cut in group:
            if not there:
                continue
            if turn is not None:
                turns.add(turn)
            fault = "blank" if blank else "duplicate" if (role, digest) in seen else "truncated" if cut else None
            seen.add((role, digest))
            if fault:
                counts[fault] += 1
            counts["illegal"] += bool(rows) and rows[-1][0] + role[:1] not in ("su", "ua", "au")
            rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield c, 0, gaps, *counts.values(), *solve(rows)


def edited(audit: str, rows: Iterator) -> Iterator:
    """(edit, role, text) of the repaired rows: ``rows`` (there, role, text) with the edits of the audit applied."""
    state, edits = 0, iter(audit)
    rows = (r for r in rows if r[0])
    for edit in edits:
        if edit != "I":
            _, role, text = next(rows)
        if edit == "D":
            continue
        state = NEXT[state][role[:1]] if edit == "K" else FILL[state]
        yield edit, role if edit == "K" else ROLE[state], "" if edit == "I" else text


def hashed(batches: Iterator) -> Iterator:
    """The first row of each conversation (its audit) and the SHA-256 of its repaired rows, hashed one after the other."""
    for c, group in by_conversation(batches):
        audit, *found = next(group)[3:]
        sha, between = hashlib.sha256(), b""
        for _, role, text in edited(audit, (r[:3] for r in group)):
            sha.update(between + f"{role}:{text}".encode())
            between = b"\n"
        yield c, *found, audit, sha.hexdigest()


def rewritten(batches: Iterator) -> Iterator:
    """The repaired rows of each conversation: place (from 0), edit, role, text."""
    for c, group in by_conversation(batches):
        audit = next(group)[3]
        for place, row in enumerate(edited(audit, (r[:3] for r in group))):
            yield c, place, *row


def in_batches(step, schema, rows: int = 2000, size: int = 4 << 20):
    """``step`` (record batches -> tuples) as a step that gives record batches of so many rows or characters."""
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        shape = to_arrow_schema(schema)
        held, held_size = [], 0

        def out():
            return pa.record_batch([pa.array(col, f.type) for col, f in zip(zip(*held), shape)], schema=shape)

        for row in step(batches):
            held.append(row)
            held_size += sum(len(x) for x in row if isinstance(x, str))
            if len(held) == rows or held_size > size:
                yield out()
                held, held_size = [], 0
        if held:
            yield out()
    return run


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, kind (0), gaps, the counts of faults, cost and audit of each conversation of ``judged`` rows."""
    like = rows.select("conv_id", "kind", *[F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")], F.col("text").alias("audit"))
    d = dealt(rows).select("conv_id", "there", "turn", "role", "digest", "blank", "cut")
    return staged(python_step(d, in_batches(audited, like.schema), like.schema), "audits")


def with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after a row that holds its audit."""
    both = found.unionByName(rows.select("kind", "conv_id", "there", "turn", "role", "text", "digest"), allowMissingColumns=True)
    return dealt(both).select("conv_id", "there", "role", "text", "audit", "gaps", *COUNTS, "cost")


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts of faults, cost, audit and repaired_sha256 of each conversation."""
    rows = judged(rows)
    found = audits(rows)
    like = found.select("conv_id", "gaps", *COUNTS, "cost", "audit", F.col("audit").alias("repaired_sha256"))
    return python_step(with_audits(rows, found), in_batches(hashed, like.schema), like.schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role and text of the repaired conversations."""
    rows = judged(rows)
    d = with_audits(rows, audits(rows))
    like = rows.select("conv_id", F.lit(0).alias("place"), F.col("role").alias("edit"), "role", "text")
    return python_step(d, in_batches(rewritten, like.schema), like.schema)


def op12_convrepair(spark, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after its damage."""
    return repair_report(damaged(read(spark, sf_dir, "conversations")))


#: CRC-32 bit by bit, the damage, then the lattice row by row: label is the cost in eight digits followed by the audit.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ord(ch)::BIGINT),
      lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)),
      4294967295::BIGINT), 4294967295) % 20 AS harm FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE harm WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS time FROM keyed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS copy FROM rows),
faults AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, substr(role, 1, 1) AS initial,
    regexp_extract(text, '(?s)([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS cut FROM placed),
judged AS (
  SELECT *, NOT blank AND copy > 1 AS duplicate, NOT blank AND copy = 1 AND cut AS truncated,
    CASE WHEN i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM faults),
conv AS (
  SELECT a.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, coalesce(sum(bad), 0)::BIGINT AS illegal, coalesce(max(i), 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN judged j ON a.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY a.conv_id),
fill(p, letters, extra, q) AS (VALUES (0, '', 0, 0), (0, 'I', 3, 2), (0, 'II', 6, 3), (1, '', 0, 1), (1, 'I', 3, 2), (1, 'II', 6, 3),
  (2, '', 0, 2), (2, 'I', 3, 3), (2, 'II', 6, 2), (3, '', 0, 3), (3, 'I', 3, 2), (3, 'II', 6, 3)),
edits(p, initial, letter, extra, q) AS (VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3), (3, 'u', 'K', 0, 2),
  (0, NULL, 'R', 3, 2), (1, NULL, 'R', 3, 2), (2, NULL, 'R', 3, 3), (3, NULL, 'R', 3, 2),
  (0, NULL, 'D', 4, 0), (1, NULL, 'D', 4, 1), (2, NULL, 'D', 4, 2), (3, NULL, 'D', 4, 3)),
best(conv_id, n, i, q, label) AS (
  SELECT conv_id, n, 0::BIGINT, q, printf('%08d', extra) || letters FROM conv, fill WHERE p = 0
  UNION ALL
  SELECT b.conv_id, b.n, b.i + 1, f.q, min(printf('%08d', substr(label, 1, 8)::BIGINT + e.extra + f.extra
      + CASE WHEN truncated AND e.letter <> 'D' THEN 3 ELSE 0 END) || substr(label, 9) || e.letter || f.letters)
  FROM best b JOIN judged j ON b.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = b.i + 1
  JOIN edits e ON e.p = b.q AND (e.initial IS NULL OR e.initial = j.initial) AND (e.letter = 'D' OR NOT (blank OR duplicate))
  JOIN fill f ON f.p = e.q GROUP BY b.conv_id, b.n, b.i, f.q),
audits AS (
  SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, min(label) AS label FROM conv c
  JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n AND b.q IN (0, 3) GROUP BY ALL),
steps AS (
  SELECT conv_id, letter, step, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS m FROM (
    SELECT conv_id, unnest(string_split(substr(label, 9), '')) AS letter, generate_subscripts(string_split(substr(label, 9), ''), 1) AS step
    FROM audits WHERE length(label) > 8) WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
led AS (
  SELECT s.*, j.role, j.text, bool_or(letter = 'K' AND m = 1 AND initial = 's') OVER (PARTITION BY s.conv_id) AS system
  FROM steps s LEFT JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.i = j.i AND letter <> 'I'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - coalesce(system, false)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY step) AS whole FROM led WHERE letter <> 'D' GROUP BY conv_id)
SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, substr(label, 1, 8)::BIGINT AS cost, substr(label, 9) AS audit,
  sha256(coalesce(whole, '')) AS repaired_sha256 FROM audits a LEFT JOIN texts t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""

"""Conversation repair: the lattice search against every edit sequence, the whole query against a plain version."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import duckdb

from opinio.llm import convrepair as R

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_solve(rows):
    """Cheapest (cost, audit) row by row, keeping the best label of each role state."""
    def filled(labels):
        best, todo = {}, list(labels.items())
        while todo:
            q, label = todo.pop()
            if q not in best or label < best[q]:
                best[q] = label
                todo.append((R.FILL[q], (label[0] + 3, label[1] + "I")))
        return best

    now = filled({0: (0, "")})
    for initial, gone, cut in rows:
        after = {}
        for q, (cost, audit) in now.items():
            ways = [(q, 4, "D")]
            if not gone:
                ways.append((R.FILL[q], 3 + 3 * cut, "R"))
                if initial in R.NEXT[q]:
                    ways.append((R.NEXT[q][initial], 3 * cut, "K"))
            for p, c, letter in ways:
                after[p] = min(after.get(p, (1 << 60, "")), (cost + c, audit + letter))
        now = filled(after)
    return min(now[q] for q in (0, 3) if q in now)


def exhaustive(rows):
    """Cheapest (cost, audit) of all sequences with at most two inserted rows beside each other, read off the contract."""
    best = []

    def go(i, cost, audit, roles):
        if best and cost > best[0][0]:
            return
        if i == len(rows) and LEGAL.fullmatch(roles):
            best.append((cost, audit))
            best.sort()
        if not audit.endswith("II"):
            for r in "ua":
                go(i, cost + 3, audit + "I", roles + r)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, cost + 4, audit + "D", roles)
            if not gone:
                go(i + 1, cost + 3 * cut, audit + "K", roles + initial)
                for r in "ua":
                    go(i + 1, cost + 3 + 3 * cut, audit + "R", roles + r)

    go(0, 0, "", "")
    return best[0]


def random_rows(rng, most):
    return [(rng.choice("suauax"), rng.random() < .2, rng.random() < .3) for _ in range(rng.randrange(most + 1))]


def test_solve():
    rng = random.Random(4)
    for _ in range(300):
        rows = random_rows(rng, 4)
        assert R.solve(rows) == exhaustive(rows) == plain_solve(rows)
    for _ in range(4000):
        rows = random_rows(rng, 14)
        assert R.solve(rows) == plain_solve(rows)
    long = random_rows(rng, 0) + [(rng.choice("sua"), rng.random() < .1, rng.random() < .1) for _ in range(3000)]
    assert R.solve(long) == plain_solve(long)
    assert R.solve([("s", False, False)] + [("u", False, False), ("a", False, False)] * 500) == (0, "K" * 1001)


def brute(table):
    """conv_id -> the contract's columns, of rows (conv_id, turn, role, text)."""
    out = {}
    for c, group in groupby(sorted(table, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        rows = []
        for _, turn, role, text in group:
            role, text = (" " if x is None else x for x in (role, text))
            named = ":".join(" " if x is None else str(x) for x in (c, turn))
            harm = zlib.crc32(named.encode()) % 20
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            rows += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        n, seen, lattice, initials = dict(blank=0, duplicate=0, truncated=0), set(), [], [r[1][:1] for r in rows]
        for turn, role, text in rows:
            left = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            lattice.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_solve(lattice)
        kept, i, roles = [], 0, ""
        for letter in audit:
            if letter != "D":
                fill = "user" if roles in ("", "s") or roles[-1] == "a" else "assistant"
                role = rows[i][1] if letter == "K" else fill
                kept.append(f"{role}:{'' if letter == 'I' else rows[i][2]}")
                roles += role[0]
            i += letter != "I"
        assert LEGAL.fullmatch(roles)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[c] = (gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def report(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_whole_table(spark):
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert report(R.op12_convrepair(spark, SF)) == brute(table)


def messy():
    rng = random.Random(9)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "System", "üser"], [
        "Fine.", "Cut", "Fine.", "", " \t\n", None, "Why? ", "Yes!\x0b", "é", "x" * 500_000 + ".", "a ", "."]
    rows = []
    for c in [None, *range(60)]:
        turns = list(range(rng.randrange(0, 12))) or [0]
        for t in turns:
            rows.append((c, rng.choice([t, t, t, t, None, t * 3]), rng.choice(roles), rng.choice(texts)))
    rows += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(1500)]
    return rows + rows[:7]


def test_messy_rows(spark):
    rows = messy()
    names = ["kind", "there", "digest", "blank", "cut", "audit", "harm", "time", "gaps", "cost"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows],
                               CONV + ", " + ", ".join(f"`{n}` int" for n in names)).repartition(4)
    assert report(R.repair_report(R.damaged(df))) == brute(rows)


def test_repaired_rows(spark):
    """The repaired rows, joined, have the hash of the report, and are legal."""
    df = R.damaged(spark.createDataFrame(messy(), CONV))
    want = report(R.repair_report(df))
    rows = sorted(R.repaired(df).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"]))
    got = {c: list(g) for c, g in groupby(rows, key=lambda r: r["conv_id"])}
    for c, w in want.items():
        own = got.get(c, [])
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == w[-1]
        assert LEGAL.fullmatch("".join(r["role"][0] for r in own))
        assert "".join(r["edit"] for r in own) == w[-2].replace("D", "")


def test_empty_and_all_dropped(spark):
    assert R.repair_report(R.damaged(spark.createDataFrame([], CONV))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], CONV)
    assert report(R.repair_report(R.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repaired(R.damaged(df)).collect() == []

"""Conversation repair: the persistent audit DP against search, and the query against plain Python on a whole table."""

import heapq
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from sagerow.llm import conversations as cv
from sagerow.llm import queries
from sagerow.sources.tables import read_table

SF = "/root/testdata/sf0.001"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired initials) by a search that always goes on from the least (cost, audit)."""
    heap, seen = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if (k, last) in seen:
            continue
        if k == len(rows) and last in ("", "a"):
            return cost, audit, out
        seen.add((k, last))
        for role in "ua":
            if (last, role) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", k, role, out + role))
        if k == len(rows):
            continue
        initial, fault = rows[k]
        heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, out))
        if fault not in (cv.BLANK, cv.DUPLICATE):
            extra = 3 * (fault == cv.CUT)
            for role in "ua":
                if (last, role) in NEXT:
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", k + 1, role, out + role))
            if (last, initial) in NEXT:
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, initial, out + initial))


def by_parts(rows, cuts):
    cache, parts = {}, []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        part = cv.Part(tuple(range(4)), cache)
        for r in rows[a:b]:
            part.row(*r)
        parts.append(part.table())
    return cv.joined_parts(parts)


@pytest.mark.parametrize("nodes", [1 << 20, 60])
def test_cheapest_least_audit(monkeypatch, nodes):
    monkeypatch.setattr(cv, "NODES", nodes)
    monkeypatch.setattr(cv, "CACHE_ROWS", 6)
    rng = random.Random(nodes)
    for _ in range(1500):
        rows = [(rng.choice("suat") if rng.random() < 0.9 else "", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 14))]
        cost, audit, _ = cheapest(rows)
        assert by_parts(rows, []) == (cost, audit)
        cuts = sorted(rng.randrange(0, len(rows) + 1) for _ in range(rng.randrange(0, 4)))
        assert by_parts(rows, cuts) == (cost, audit)


def test_long_conversations_compare_by_their_common_prefix():
    rng = random.Random(4)
    rows = [(rng.choice("ua"), rng.choice([0, 0, 0, 3, 2])) for _ in range(3000)]
    cost, audit, _ = cheapest(rows)
    assert by_parts(rows, []) == by_parts(rows, [1, 700, 2999]) == (cost, audit)


def test_audit_nodes_order_like_strings(monkeypatch):
    for mod in (cv._MOD, 7):  # 7: hashes that collide
        monkeypatch.setattr(cv, "_MOD", mod)
        rng, audits = random.Random(mod), cv.Audits()
        nodes = [0]
        for _ in range(400):
            nodes.append(audits.add(rng.choice(nodes[-20:]), rng.choice("DIKR")))
        for _ in range(4000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert audits.less(a, b) == (audits.string(a) < audits.string(b))


def expected(rows):
    """The query's rows from (conv, turn, role, text)."""
    out = []
    space = lambda v: " " if v is None else v
    for conv in {r[0] for r in rows}:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            kind = crc32(f"{space(c)}:{space(turn)}".encode()) % 20
            role, text = space(role), space(text)
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults = set(), []
        for _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, roles = cheapest([(r[1][:1], f) for r, f in zip(mine, faults)])
        lines, left, names = [], iter(mine), iter(roles)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit != "D":
                name = {"u": "user", "a": "assistant", "s": "system"}[next(names)]
                lines.append(f"{row[1] if edit == 'K' else name}:{'' if row is None else row[2]}")
        counts = [faults.count(k) for k in (1, 2, 3)]
        out.append((conv, gaps, *counts, illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_on_a_whole_table(spark):
    table = read_table(spark, SF, "conversations")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, SF)
    assert got.columns == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    assert ordered(got.collect()) == ordered(expected(rows))


def odd_rows():
    rng = random.Random(8)
    rows = [(None, t, "user", f"q {t}.") for t in range(6)] + [(1, None, None, None), (2, 0, "", "a."), (3, 5, "tool", "x!")]
    rows += [(4, t, "ua"[t % 2], "same.") for t in range(400)]  # one conversation over many ranges
    rows += [(5, rng.choice([None, 3, 9, 9_000_000_000]), rng.choice(["user", "assistant"]), "é" * 50_000 + "?") for _ in range(3)]
    rows += [(6, t, rng.choice(["system", "user", "assistant"]), rng.choice(["a", "a.", "b!", " ", "c?\n"])) for t in range(300)]
    rows += [(7, 1, "user", "tie.")] * 5
    for c in range(20, 60):
        rows += [(c, t, rng.choice(["system", "user", "assistant"]), rng.choice(["a", "a.", "b!", "", "c? "])) for t in range(rng.randrange(1, 9))]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, KEY string")
    assert ordered(cv.conversation_repair(df.repartition(7)).collect()) == ordered(expected(rows))
    assert cv.conversation_repair(df.limit(0)).collect() == []
    named = df.where("conv_id = 6").selectExpr("cast(conv_id as string) AS conv_id", "turn", "role", "text")
    assert ordered(cv.conversation_repair(named).collect()) == ordered(("6", *e[1:]) for e in expected([r for r in rows if r[0] == 6]))


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = [r for r in odd_rows() if r[0] != 5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids = df.selectExpr("conv_id AS conv").distinct()
    got = {}
    for r in sorted(cv.repaired_rows(cv.damaged(df), ids).collect(), key=lambda r: (repr(r["conv"]), r["place"])):
        got.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    want = {r["conv_id"]: r["repaired_sha256"] for r in cv.conversation_repair(df).collect()}
    assert {c: sha256("\n".join(got.get(c, [])).encode()).hexdigest() for c in want} == want

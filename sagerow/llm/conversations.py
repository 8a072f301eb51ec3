"""Conversation structure repair: the cheapest edits by a persistent audit DP.

Edits keep a row, give it another role, delete it or insert an empty one, so
that the roles' initials read ``(s?(ua)+)?``. The DP goes over the rows with
four states; each holds the cost and the audit (the edits' initials) of the
best way to it. Audits are nodes that share their prefixes: a node knows its
parent, ancestors at powers of two and a rolling hash, so two audits of equal
cost are compared by searching their longest common prefix, and equal hashes
are verified against the letters.

Rows are sorted across the table by (conversation, turn, role, text), cut
into ranges and each range is one task's stream; a conversation that spans
ranges gives a table of transitions (state before, state after) for each
part, and the parts are joined in order. The repaired text is hashed as its
rows stream by, so no conversation is held in memory but for its audit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, slices, staged

#: States: nothing yet, after s, after u, after a; the first and the last are whole.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (EMPTY, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state after a kept or changed row of this initial, by the state before; None is illegal.
AFTER = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
#: Fault codes of a row.
FINE, BLANK, DUPLICATE, CUT = range(4)
NODES = 1 << 20
_MOD, _MULT = (1 << 61) - 1, 1_000_003
#: Results of short parts that recur are kept (a bounded number).
CACHE_PARTS, CACHE_ROWS = 100_000, 24


class Audits:
    """Strings that share prefixes: nodes with a parent, ancestors at 1, 2, 4 ... and a hash of the whole prefix."""

    def __init__(self):
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]

    def add(self, node: int, letter: str) -> int:
        """The node of ``node``'s string and one more letter."""
        up, lifts, k = [node], self.up, 0
        while k < len(lifts[up[k]]):
            up.append(lifts[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _MULT + ord(letter)) % _MOD)
        lifts.append(tuple(up))
        return len(lifts) - 1

    def ancestor(self, node: int, depth: int) -> int:
        left, k = self.depth[node] - depth, 0
        while left:
            if left & 1:
                node = self.up[node][k]
            left >>= 1
            k += 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string sorts before b's (a prefix before what it begins)."""
        if a == b:
            return False
        most = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, most), self.ancestor(b, most)
        if x == y or self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.string(a) < self.string(b)
        # Lift both as long as their prefixes differ: the letters right below the common prefix remain.
        p, q = x, y
        for k in range(len(self.up[p]) - 1, -1, -1):
            if k < len(self.up[p]):
                i, j = self.up[p][k], self.up[q][k]
                if i != j and self.hash[i] != self.hash[j]:
                    p, q = i, j
        if not self._same(self.up[p][0], self.up[q][0]):
            return self.string(a) < self.string(b)
        return self.letter[p] < self.letter[q]

    def _same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth hold the same string, letter by letter down to their shared prefix."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def string(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


class Ways:
    """The best way (cost, audit) to each state, from one state before the first row."""

    def __init__(self, before: int):
        self.audits = Audits()
        self.done = ""  # letters that all ways share, written out to bound the nodes
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[before] = (0, 0)
        self._insert()

    def _better(self, states: list, state: int, cost: int, node: int, letter: str) -> None:
        known = states[state]
        if known is not None and known[0] < cost:
            return
        new = self.audits.add(node, letter)
        if known is None or cost < known[0] or self.audits.less(new, known[1]):
            states[state] = (cost, new)

    def _insert(self) -> None:
        """Inserted rows: u after nothing, s or a, then a after u (more of them only add cost)."""
        for before in (EMPTY, SYSTEM, ASSISTANT, USER):
            if (way := self.best[before]) is not None:
                self._better(self.best, ASSISTANT if before == USER else USER, way[0] + INSERT, way[1], "I")

    def row(self, initial: str, fault: int) -> None:
        states: list[tuple[int, int] | None] = [None] * 4
        extra = TRUNCATED if fault == CUT else 0
        for before, way in enumerate(self.best):
            if way is None:
                continue
            cost, node = way
            self._better(states, before, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            for role in "ua":
                if (state := AFTER[role][before]) is not None:
                    self._better(states, state, cost + REROLE + extra, node, "R")
            if initial in AFTER and (state := AFTER[initial][before]) is not None:
                self._better(states, state, cost + extra, node, "K")
        self.best = states
        self._insert()
        if len(self.audits.letter) > NODES:
            self._compact()

    def _compact(self) -> None:
        """New nodes for the ways that are left; the prefix they all share becomes plain text."""
        strings = [None if w is None else self.audits.string(w[1]) for w in self.best]
        known = [s for s in strings if s is not None]
        lo, hi = min(known), max(known)
        shared = next((k for k, (x, y) in enumerate(zip(lo, hi)) if x != y), min(len(lo), len(hi)))
        self.done += lo[:shared]
        self.audits = Audits()
        for state, s in enumerate(strings):
            if s is not None:
                node = 0
                for letter in s[shared:]:
                    node = self.audits.add(node, letter)
                self.best[state] = (self.best[state][0], node)

    def table(self) -> list[tuple[int, int, str]]:
        """(state, cost, audit) of every state reached."""
        return [(s, w[0], self.done + self.audits.string(w[1])) for s, w in enumerate(self.best) if w is not None]


class Part:
    """The rows of one conversation in one task, as they come; several states before it if it may be continued."""

    def __init__(self, befores: tuple[int, ...], cache: dict):
        self.befores, self.cache, self.rows, self.ways = befores, cache, [], None
        self.faults = [0] * 4

    def row(self, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.ways is None:
            self.rows.append((initial, fault))
            if len(self.rows) > CACHE_ROWS:
                self.ways = self._run()
        else:
            for w in self.ways:
                w.row(initial, fault)

    def _run(self) -> list[Ways]:
        ways = [Ways(b) for b in self.befores]
        for row in self.rows:
            for w in ways:
                w.row(*row)
        return ways

    def table(self) -> list[tuple[int, int, int, str]]:
        """(state before, state after, cost, audit) of every transition."""
        key = None if self.ways else (self.befores, *self.rows)
        if key in self.cache:
            return self.cache[key]
        ways = self.ways or self._run()
        out = [(b, *row) for b, w in zip(self.befores, ways) for row in w.table()]
        if key is not None:
            if len(self.cache) >= CACHE_PARTS:
                self.cache.clear()
            self.cache[key] = out
        return out


def joined_parts(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """The cheapest (cost, audit) of a conversation from its parts' (before, after, cost, audit) in order.

    Audits compare as whole strings: of equal cost and state none is a
    prefix of another, as a longer one has more inserted rows.
    """
    best: dict[int, tuple[int, tuple[str, ...]]] = {EMPTY: (0, ())}  # a conversation without rows costs nothing
    for part in parts:
        new: dict[int, tuple[int, tuple[str, ...]]] = {}
        for before, after, cost, audit in part:
            if before not in best:
                continue
            total, way = best[before][0] + cost, (*best[before][1], audit)
            if after not in new or (total, "".join(way)) < (new[after][0], "".join(new[after][1])):
                new[after] = (total, way)
        best = new
    cost, way = min((best[s] for s in WHOLE if s in best), key=lambda w: (w[0], "".join(w[1])))
    return cost, "".join(way)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text after the fixed damage by crc32(conv_id:turn) % 20; nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats the
    row, 4 makes its role user. Ids and turns keep their nulls as values.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", text["conv_id"], text["turn"])) % 20
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn"), text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind")
    ).where("kind <> 0")
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _judged(rows: DataFrame) -> DataFrame:
    """One narrow row for equal (conv, turn, role, text): its initial, its first one's fault, and its copies."""
    stripped = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    keyed = rows.select(
        "conv",
        "turn",
        "role",
        F.unhex(F.md5("text")).alias("key"),
        F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT).alias("own"),
    )
    narrow = staged(keyed.groupBy("conv", "turn", "role", "key", "own").agg(F.count("*").alias("copies")), "conversation-keys")
    # The first turn (null before all others) of a role and text that several turns hold.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = narrow.groupBy("conv", "role", "key").agg(F.min(turn).alias("first"), F.count("*").alias("c")).where("c > 1")
    seen = sized(staged(seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first"), "conversation-seen"))
    same = narrow["conv"].eqNullSafe(seen["c"]) & (narrow["role"] == seen["r"]) & (narrow["key"] == seen["k"])
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(later, DUPLICATE).otherwise(F.col("own"))
    return narrow.join(seen, same, "left").select("conv", "turn", "role", "key", fault.alias("fault"), "copies")


def _parts(judged: DataFrame) -> DataFrame:
    """(conv, part, body): a conversation's faults and transitions in each range of the sorted rows, as JSON."""
    spark = judged.sparkSession
    conv_type = judged.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "role", "key"]
    ranges = judged.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    narrow = ranges.select("conv", F.substring("role", 1, 1).alias("initial"), "fault", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cache = TaskContext.get().partitionId(), {}
        open_conv, open_part = None, None

        def closed(of: pa.Scalar, p: Part) -> pa.RecordBatch:
            body = json.dumps([p.faults, p.table()]).encode()
            return pa.RecordBatch.from_arrays(
                [pa.array([of.as_py()], of.type), pa.array([part], pa.int64()), pa.array([body], pa.binary())], ["conv", "part", "body"]
            )

        waiting: list[pa.RecordBatch] = []
        for batch in slices(batches, 4096):
            convs = batch.column("conv")
            for k, (conv, initial, fault, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in batch.schema.names))):
                if open_part is None or conv != open_conv.as_py():
                    # Only a range's first conversation can have begun in an earlier one.
                    befores = tuple(range(4)) if open_part is None else (EMPTY,)
                    if open_part is not None:
                        waiting.append(closed(open_conv, open_part))
                    open_conv, open_part = convs[k], Part(befores, cache)
                open_part.row(initial, fault)
                for _ in range(copies - 1):
                    open_part.row(initial, BLANK if fault == BLANK else DUPLICATE)
            if waiting:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
        if open_part is not None:
            yield closed(open_conv, open_part)

    return staged(narrow.mapInArrow(run, f"conv {conv_type}, part long, body binary"), "conversation-parts")


class _Repair:
    """One conversation as its rows stream by: the parts' tables first, then the rows in order."""

    def __init__(self):
        self.parts, self.faults, self.audit, self.at, self.cost = [], [0] * 4, None, 0, 0
        self.state, self.out, self.any = EMPTY, sha256(), False
        self.initial, self.illegal, self.turns, self.first_turn, self.turn = None, 0, 0, None, None

    def part(self, body: bytes) -> None:
        faults, table = json.loads(body)
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.parts.append(table)

    def _begin(self) -> None:
        if self.audit is None:
            self.cost, self.audit = joined_parts(self.parts)
            self.parts = []

    def _write(self, role: str, text: bytes) -> tuple[str, bytes]:
        self.state = {"s": SYSTEM, "u": USER}.get(role[0], ASSISTANT)
        self.out.update(b"\n" * self.any + role.encode() + b":" + text)
        self.any = True
        return role, text

    def _given(self) -> str:
        return "assistant" if self.state == USER else "user"

    def _inserted(self) -> Iterator[tuple[str, str, bytes]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", *self._write(self._given(), b"")

    def row(self, turn, role: str, text: bytes) -> Iterator[tuple[str, str, bytes]]:
        """(edit, role, text) of the rows that stand for this one; a deleted row gives none."""
        self._begin()
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first_turn = turn if self.turns == 1 else self.first_turn
            self.turn = turn
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, *self._write(role if edit == "K" else self._given(), text)

    def end(self) -> Iterator[tuple[str, str, bytes]]:
        self._begin()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        _, blank, duplicate, cut = self.faults
        return gaps, blank, duplicate, cut, self.illegal, self.cost, self.audit, self.out.hexdigest()


def _streamed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation's id, parts and rows, in this order, each conversation in one task's sorted stream."""
    parts = _parts(_judged(rows))
    null = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role")}
    no_key, no_part = F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("part")
    heads = ids.select("conv", F.lit(0).alias("kind"), no_part, null["turn"], null["role"], no_key, F.lit(None).cast("binary").alias("body"))
    tables = parts.select("conv", F.lit(1).alias("kind"), "part", null["turn"], null["role"], no_key, "body")
    texts = rows.select(
        "conv", F.lit(2).alias("kind"), no_part, "turn", "role", F.unhex(F.md5("text")).alias("key"), F.col("text").cast("binary").alias("body")
    )
    stream = heads.unionByName(tables).unionByName(texts).repartition("conv")
    return stream.sortWithinPartitions("conv", "kind", "part", "turn", "role", "key").select("conv", "kind", "turn", "role", "body")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, _Repair, list[tuple[str, str, bytes]], bool]]:
    """(id, repair, rows written, whether it is complete) as the sorted stream goes on."""
    conv, repair = None, None
    for batch in slices(batches):
        convs = batch.column("conv")
        for k, (kind, turn, role, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "turn", "role", "body")))):
            if kind == 0:
                if repair is not None:
                    yield conv, repair, list(repair.end()), True
                conv, repair = convs[k], _Repair()
            elif kind == 1:
                repair.part(body)
            else:
                yield conv, repair, list(repair.row(turn, role, body)), False
    if repair is not None:
        yield conv, repair, list(repair.end()), True


def repaired_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv, place, edit (K, R or I), role and text of the repaired conversations.

    ``rows`` has conv, turn, role and text (no null role or text); ``ids``
    has each conv once. Rows go by turn, nulls first, then role and text hash.
    """
    conv_type = ids.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for conv, _, written, complete in _repairs(batches):
            if written:
                edits, roles, texts = zip(*written)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv.as_py()] * len(written), conv.type), pa.array(range(place, place + len(written)), pa.int64()),
                     pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.binary())],
                    ["conv", "place", "edit", "role", "text"],
                )
            place = 0 if complete else place + len(written)

    fields = f"conv {conv_type}, place long, edit string, role string, text binary"
    return _streamed(rows, ids).mapInArrow(run, fields).withColumn("text", F.col("text").cast("string"))


def repair_digests(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every id.

    ``rows`` and ``ids`` as in ``repaired_rows``. An id without rows has
    zeros, an empty audit and the hash of an empty string; a null id is an id
    like any other; rows equal in all columns are each a row (all but the
    first are duplicates); texts are taken whole and streamed; no ids give an
    empty table. An audit is as long as its conversation has edits and held
    in memory, with up to 16 letters a row while its parts are joined.
    """
    conv_type = ids.schema["conv"].dataType.simpleString()
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ("conv_id", *longs, "audit", "repaired_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, done = [], []

        def flush() -> pa.RecordBatch:
            types = [convs[0].type, *[pa.int64()] * len(longs), pa.string(), pa.string()]
            cols = [[c.as_py() for c in convs], *zip(*done)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], list(names))

        for conv, repair, _, complete in _repairs(batches):
            if complete:
                convs.append(conv)
                done.append(repair.summary())
                if len(done) == 1024:
                    yield flush()
                    convs, done = [], []
        if done:
            yield flush()

    fields = f"conv_id {conv_type}, " + ", ".join(f"{c} long" for c in longs) + ", audit string, repaired_sha256 string"
    return _streamed(rows, ids).mapInArrow(run, fields)


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """``repair_digests`` of the ``damaged`` conversations, for every original conv_id."""
    return repair_digests(damaged(conversations), conversations.select(F.col("conv_id").alias("conv")).distinct())

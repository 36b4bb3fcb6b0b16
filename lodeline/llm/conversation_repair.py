"""Conversation structure repair: the cheapest edits that give a conversation its form, by tight arcs of a layered graph.

The form is `(s?(ua)+)?` over the initials of the roles: nothing, or an optional system turn and then pairs of user and
assistant. Its states are 0 (nothing yet), 1 (after s), 2 (after u) and 3 (after a); 0 and 3 are final. A node is a state
before a row; arcs keep (K), rerole (R) or delete (D) the row, or insert a turn (I) before it. With the least cost from the
start to each node (forward) and from each node to the end (backward), an arc lies on a cheapest path if forward + cost +
backward is the least cost of all: it is tight. A set of nodes, first the start, then follows the least letter among the tight
arcs that leave it, row by row, which gives the least of the cheapest edit strings.

One conversation may hold any share of all rows, so nothing holds a conversation: rows without their texts are sorted over all
tasks by ranges, each task reduces its stretch of a conversation to a 4 x 4 matrix of least costs, products of matrices (one a
stretch) give each stretch its costs at both ends, and tight arcs are found stretch by stretch. The last step streams the
sorted rows, their tight arcs and their texts, and holds four states, a running SHA-256 and the edit string that it returns.
A digest of a conversation is one sequence of bytes, so that last pass over one conversation is one task's stream.

Nulls and edges: a null role or text is one space, so is a null id or turn in the damage key; null turns come first; rows of
one turn are ordered by role and the MD5 of their text; rows that repeat id, turn, role and text are rows of their own (all but
the first are duplicates); a null id is a conversation of its own; columns besides the four are not read, whatever their
names; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import cut, map_arrow

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: States and the state that a turn by a role of that initial leads to.
STATES = range(4)
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The role that a free choice (rerole, insert) takes, and the state it leads to.
FREE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
FINAL = (0, 3)
_LETTERS = "DIKR"
#: Stands for a null turn.
_NO_TURN = -(2**63)
#: Faults of a row; with four times the place of its initial in "sua" (3: another) its kind.
_BLANK, _DUPLICATE, _OPEN = 3, 2, 1
_PAIRS = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    hit = read.withColumn("hit", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).where("hit != 0")
    body = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.explode(times).alias("time")).drop("time")


def _steps(initial: str, must_go: bool, truncated: bool) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the arcs of one row."""
    more = TRUNCATED if truncated else 0
    out = [("D", q, q, DELETE) for q in STATES]
    if not must_go:
        out += [("K", q, to, more) for q, to in _NEXT.get(initial, {}).items()]
        out += [("R", q, to, REROLE + more) for q, (_, to) in FREE.items()]
    return out


_INSERTS = [("I", q, to, INSERT) for q, (_, to) in FREE.items()]


def _matrix(arcs) -> np.ndarray:
    out = np.full((4, 4), _FAR, np.int64)
    for _, q, to, cost in arcs:
        out[q, to] = min(out[q, to], cost)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs of a path through a, then b."""
    return np.minimum((a[..., :, :, None] + b[None, :, :]).min(axis=-2), _FAR)


def _closure() -> np.ndarray:
    once = np.minimum(_matrix(_INSERTS), np.where(np.eye(4, dtype=bool), 0, _FAR))
    return product(once, product(once, once))


CLOSURE = _closure()
#: Least costs from each state after the last row: inserts up to a final state.
AT_END = np.array([min(CLOSURE[q, f] for f in FINAL) for q in STATES])


class _Rows:
    """Costs and arcs of the few kinds of rows."""

    def __init__(self):
        self.arcs = [_steps("sua "[k // 4], k % 4 in (_BLANK, _DUPLICATE), k % 4 == _OPEN) for k in range(16)]
        self.rows = [_matrix(a) for a in self.arcs]
        self.layers = [product(CLOSURE, r) for r in self.rows]


_ROWS = _Rows()


def stretch(kinds: list[int], times: list[int]) -> np.ndarray:
    """Least costs from each state before a stretch of rows to each state after it; all but the first of a row's times go."""
    out, extra = np.where(np.eye(4, dtype=bool), 0, _FAR).astype(np.int64), 0
    for kind, n in zip(kinds, times):
        out, extra = product(out, _ROWS.layers[kind]), extra + DELETE * (n - 1)
    return np.minimum(out + extra, _FAR)


def tight(kinds: list[int], times: list[int], entry: np.ndarray, leave: np.ndarray) -> list[int]:
    """For each row the tight arcs as bits 4 * (place in DIKR) + state; `entry`: least costs to each state before the first
    row, `leave`: least costs from each state after the last."""
    n = len(kinds)
    extra = [DELETE * (t - 1) for t in times]
    after = [leave] * (n + 1)  # from the node before the row
    for i in range(n - 1, -1, -1):
        after[i] = np.minimum((_ROWS.layers[kinds[i]] + after[i + 1][None, :]).min(axis=1) + extra[i], _FAR)
    best, out, before = int((entry + after[0]).min()), [], entry
    ahead = [a.tolist() for a in after]
    for i, kind in enumerate(kinds):
        here = np.minimum((before[:, None] + CLOSURE).min(axis=0), _FAR)  # with inserts before this row
        mask, cheap = 0, here.tolist()
        for _, q, to, cost in _INSERTS:
            if cheap[q] + cost + ahead[i][to] == best:
                mask |= 1 << (4 + q)
        for letter, q, to, cost in _ROWS.arcs[kind]:
            if cheap[q] + cost + extra[i] + ahead[i + 1][to] == best:
                mask |= 1 << (4 * _LETTERS.index(letter) + q)
        out.append(mask)
        before = np.minimum((here[:, None] + _ROWS.rows[kind]).min(axis=0) + extra[i], _FAR)
    return out


def _targets(kind: int) -> dict[tuple[str, int], tuple[int, int]]:
    return {(letter, q): (to, cost) for letter, q, to, cost in (*_ROWS.arcs[kind], *_INSERTS)}


_TARGETS = [_targets(k) for k in range(16)]


def follow(frontier: frozenset[int], kind: int, mask: int) -> tuple[frozenset[int], str, int]:
    """(states after the row, the least letters, their cost) from a set of states before it, along the tight arcs of `mask`."""
    letters, cost = "", 0
    while True:
        for place, letter in enumerate(_LETTERS):
            some = [q for q in frontier if mask >> (4 * place + q) & 1]
            if some:
                break
        else:
            raise ValueError("no tight arc leaves the frontier")
        went = [_TARGETS[kind][letter, q] for q in some]
        frontier, letters, cost = frozenset(to for to, _ in went), letters + letter, cost + went[0][1]
        if letter != "I":
            return frontier, letters, cost


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple], bool]]:
    """(key, rows, whether the key is new) for runs of equal keys in sorted batches; a run comes in a part for each batch it is in."""
    last = None
    for b in batches:
        rows = list(zip(*[c.to_pylist() for c in b.columns]))
        first = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][:keys] != rows[first][:keys]:
                key = rows[first][:keys]
                yield key, rows[first:i], key != last
                last, first = key, i


def _keyed(rows: DataFrame) -> DataFrame:
    """Damaged rows with the columns that order them: none, c (the id), t (the turn; the least long stands for null), role, digest."""
    t = F.coalesce("turn", F.lit(_NO_TURN))
    return rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("c"), t.alias("t"), "role", F.md5("text").alias("digest"), "text")


def _faults(rows: DataFrame) -> DataFrame:
    """(none, c, t, role, digest, times, kind): rows without texts; equal rows are one, with their number, of which the later go."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    light = _keyed(rows).withColumn("blank", bare == "").withColumn("open", ~F.substring(bare, -1, 1).isin(".", "!", "?")).drop("text")
    once = light.groupBy("none", "c", "t", "role", "digest", "blank", "open").agg(F.count("*").alias("times"))
    firsts = once.groupBy(F.col("none").alias("n2"), F.col("c").alias("c2"), F.col("role").alias("r2"), F.col("digest").alias("d2")).agg(F.min("t").alias("first"))
    met = once.join(firsts, (F.col("none") == F.col("n2")) & (F.col("c") == F.col("c2")) & (F.col("role") == F.col("r2")) & (F.col("digest") == F.col("d2")))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 4
    fault = F.when(F.col("blank"), _BLANK).when(F.col("t") > F.col("first"), _DUPLICATE).when(F.col("open"), _OPEN).otherwise(0)
    return met.select("none", "c", "t", "role", "digest", "times", (number + fault).cast("int").alias("kind"))


_PLACE = ["none", "c"]
_ORDER = ["t", "role", "digest"]


def _tight_rows(rows: DataFrame) -> DataFrame:
    """The rows of _faults with their tight arcs: (none, c, t, role, digest, times, kind, mask)."""
    order = [*_PLACE, *_ORDER]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    held = pa.schema([("none", pa.bool_()), ("c", pa.int64()), ("part", pa.int32()), ("costs", pa.list_(pa.int64()))])

    def reduce(batches):
        at, so_far = None, None
        for key, part, new in _runs(batches, 3):
            if new and at is not None:
                yield (*at, so_far.ravel().tolist())
            more = stretch([r[3] for r in part], [r[4] for r in part])
            at, so_far = key, more if new else product(so_far, more)
        if at is not None:
            yield (*at, so_far.ravel().tolist())

    def ends(batches):
        for b in batches:
            for none, c, parts in zip(*(x.to_pylist() for x in b.columns)):
                costs = [np.array(p["costs"]).reshape(4, 4) for p in parts]
                entry, leave = [np.array([0, _FAR, _FAR, _FAR])], [AT_END]
                for m in costs[:-1]:
                    entry.append(np.minimum((entry[-1][:, None] + m).min(axis=0), _FAR))
                for m in costs[:0:-1]:
                    leave.append(np.minimum((m + leave[-1][None, :]).min(axis=1), _FAR))
                yield from ((none, c, p["part"], [*e.tolist(), *x.tolist()]) for p, e, x in zip(parts, entry, reversed(leave)))

    ddl = "none boolean, c long, part int, costs array<long>"
    matrices = map_arrow(ranged.select("none", "c", "part", "kind", "times"), lambda b: _batches(held, reduce(b)), ddl)
    by_conversation = matrices.groupBy("none", "c").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("parts"))
    bounds = map_arrow(by_conversation, lambda b: _batches(held, ends(b)), ddl)
    both = bounds.select(*_PLACE, "part", F.lit(0).alias("what"), F.lit(0).cast("long").alias("t"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("times"), F.lit(0).alias("kind"), "costs").unionByName(
        ranged.select(*_PLACE, "part", F.lit(1).alias("what"), *_ORDER, "times", "kind", F.lit(None).cast("array<long>").alias("costs"))
    )
    out = pa.schema([("none", pa.bool_()), ("c", pa.int64()), ("t", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("times", pa.int64()), ("kind", pa.int32()), ("mask", pa.int32())])

    def arcs(batches):
        held: list[tuple] = []

        def whole():
            costs, rows = held[0][-1], held[1:]
            masks = tight([r[8] for r in rows], [r[7] for r in rows], np.array(costs[:4]), np.array(costs[4:]))
            return [(*r[:2], *r[4:9], m) for r, m in zip(rows, masks)]

        for _, part, new in _runs(batches, 3):
            if new and held:
                yield from whole()
                held.clear()
            held += part
        if held:
            yield from whole()

    dealt = both.repartition(*_PLACE, "part").sortWithinPartitions(*_PLACE, "part", "what", *_ORDER)
    return map_arrow(dealt, lambda b: _batches(out, arcs(b)), "none boolean, c long, t long, role string, digest string, times long, kind int, mask int")


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    rows = iter(rows)
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class _Conversation:
    """What the last pass holds of one conversation."""

    def __init__(self, key: tuple):
        self.key, self.frontier, self.audit, self.cost = key, frozenset({0}), [], 0
        self.state, self.hash, self.lines, self.wanted = 0, hashlib.sha256(), 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = self.last_initial = None

    def line(self, role: str, text: str):
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def row(self, t: int, role: str, digest: str, times: int, kind: int, mask: int):
        if t != _NO_TURN:
            self.turns += t != self.last_turn
            self.low, self.high, self.last_turn = t if self.low is None else self.low, t, t
        fault = kind % 4
        self.blank += times if fault == _BLANK else 0
        self.duplicate += 0 if fault == _BLANK else times if fault == _DUPLICATE else times - 1
        self.truncated += fault == _OPEN
        self.illegal += (self.last_initial is not None and self.last_initial + role[:1] not in _PAIRS) + (times - 1) * (role[:1] * 2 not in _PAIRS)
        self.last_initial = role[:1]
        self.frontier, letters, cost = follow(self.frontier, kind, mask)
        self.audit.append(letters + "D" * (times - 1))
        self.cost += cost + DELETE * (times - 1)
        self.wanted = None
        for letter in letters:
            if letter == "I" or letter == "R":
                free, self.state = FREE[self.state]
                if letter == "I":
                    self.line(free, "")
                else:
                    self.wanted = (t, role, digest, free)
            elif letter == "K":
                self.state = _NEXT[role[:1]][self.state]
                self.wanted = (t, role, digest, role)

    def text(self, t: int, role: str, digest: str, text: str):
        if self.wanted is not None and self.wanted[:3] == (t, role, digest):
            self.line(self.wanted[3], text)
            self.wanted = None

    def end(self) -> tuple:
        while self.state not in FINAL:
            free, self.state = FREE[self.state]
            self.line(free, "")
            self.audit.append("I")
            self.cost += INSERT
        none, c = self.key
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (None if none else c, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_COLUMNS = [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def repair(conversations: DataFrame, broken: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: the faults of its rows in `broken` and their cheapest repair.

    gaps, blank, duplicate, truncated, illegal, cost (longs); audit: the edits' initials; repaired_sha256: of the repaired turns.
    """
    text = F.lit(None).cast("string")
    no = lambda kind: F.lit(None).cast(kind)
    ids = conversations.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c")).distinct()
    heads = ids.select(*_PLACE, F.lit(0).alias("what"), F.lit(_NO_TURN).alias("t"), F.lit("").alias("role"), F.lit("").alias("digest"), no("long").alias("times"), no("int").alias("kind"), no("int").alias("mask"), text.alias("text"))
    rows = _tight_rows(_faults(broken)).select(*_PLACE, F.lit(1).alias("what"), *_ORDER, "times", "kind", "mask", text.alias("text"))
    bodies = _keyed(broken.where(F.rtrim(F.col("text"), F.lit(_SPACES)) != "")).select(*_PLACE, F.lit(2).alias("what"), *_ORDER, no("long").alias("times"), no("int").alias("kind"), no("int").alias("mask"), "text")
    everything = heads.unionByName(rows).unionByName(bodies)
    sorted_rows = everything.repartition(*_PLACE).sortWithinPartitions(*_PLACE, F.col("what") != 0, *_ORDER, "what")
    schema = pa.schema(_COLUMNS)

    def run(batches):
        at = None
        for key, part, new in _runs(batches, 2):
            if new:
                if at is not None:
                    yield at.end()
                at = _Conversation(key)
            for _, _, what, t, role, digest, times, kind, mask, body in part:
                if what == 1:
                    at.row(t, role, digest, times, kind, mask)
                elif what == 2:
                    at.text(t, role, digest, body)
        if at is not None:
            yield at.end()

    return map_arrow(sorted_rows, lambda b: _batches(schema, run(b)), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is the set of its words ([^\\x20\\x09-\\x0D]+). Two lines match at Jaccard >= `least`. A line is removed if any earlier
line, by (document id, line number), matches it. Lines without words are never removed.

The join: words are ordered by rarity, and a line's prefix is its first n - ceil(least * n) + 1 words in that order; lines
that match share a prefix word. Rarity comes from counts over all documents, held in a table of fixed size (2**20 hashed
counters, one byte each): any order that all lines share keeps the join exact, the counters only decide how selective the
prefixes are. Postings (word, line, size, position, bitmap) meet by word, sorted by size, where the length filter bounds
the window of partners, the positional filter drops pairs whose remaining words cannot suffice, and the bitmaps (a parity
bit for each of 128 classes of words) drop pairs that differ in too many words. Only lines that have a partner left go on,
to the word they share first; there the pairs are verified on the words of the lines themselves, once each, and leave as
one row a line: its earliest match and its number of links. No pair is ever a row.

Hot words: where many different lines meet at one word, they are dealt to shares, and every two shares meet in a cell of
their own, a task's work each. For the postings that happens above 4096 lines of which some have found no partner among
their next neighbours, for the verification above a task's fair share of all lines (256 to 8192).

Equal lines (equal multisets of words) are one class with one posting list, so copies are never paired; what is joined and
verified are links between different classes. Postings travel as packed arrays in parts whose number follows the number of
words, so a part stays at some megabytes at any scale, and a task that holds more hands its hot words on.

Nulls and edges: a null text is an empty one (0 lines); a null id comes after all others; rows that repeat an id are told
apart by their text's hash, and identical rows are one document to `report`; words are told apart by 64-bit hashes and
classes by 96 bits; a text of any length is read whole; columns besides id and text are not looked at by `report` and pass
through `deduplicate`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import Seen, blocks, cut, map_arrow, mix64, packed, record, span_hashes, word_spans

LEAST, COUNTERS = 0.8, 20
_LAST = 2**63 - 1
#: Counters travel in so many pieces; bytes of a posting; bytes of postings that a part should hold.
_PIECES, _POSTING, _PART_BYTES = 64, 48, 8 << 20
#: A posting: word, class, two words of bitmap, rarest word, size, position.
_KINDS = (np.uint64,) * 5 + (np.uint32,) * 2


class Limits(NamedTuple):
    """What one task takes on; beyond, hot words are dealt to cells. None of them changes the result."""

    large: int = 4096  # lines of one word that meet in one task
    neighbours: int = 64  # by size, with which each of more lines is compared before
    held: int = 96 << 20  # bytes of postings
    fair: int | None = None  # lines of one word that are verified in one task; None: as many as fall to a task, 256 to 8192


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


class _Lines:
    """The worded lines of a buffer: word hashes, the line of each word, and for each line its class and place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, row = word_spans(data, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        breaks = np.flatnonzero(data == 10)
        before = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate(([0], np.searchsorted(self.starts, breaks), [len(self.starts)]))))
        line = before + row
        self.first = np.flatnonzero(np.diff(line, prepend=-1))  # first word of each line
        self.count = np.diff(np.append(self.first, len(line)))
        self.row = row[self.first]
        self.number = before[self.first] - np.searchsorted(breaks, offsets[:-1])[self.row]
        if len(self.first):  # two power sums of the words' hashes: the same for equal multisets, else as good as random
            sums = np.add.reduceat(self.hashes, self.first) + mix64(np.add.reduceat(self.hashes * self.hashes, self.first))
            self.kind = mix64(sums + self.count.astype(np.uint64)).view(np.int64)
            other = mix64(np.add.reduceat(mix64(self.hashes ^ np.uint64(0xA0761D6478BD642F)), self.first))
            self.check = (other >> np.uint64(32)).astype(np.uint32).view(np.int32)
        else:
            self.kind, self.check = np.zeros(0, np.int64), np.zeros(0, np.int32)


def lines(docs: DataFrame, wanted: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, check, id, th, number, line): every worded line with its class, which is kind and check; a text without any gives
    one row with null kind, check and number.

    line is the text of those whose class is in the bit table `wanted`, about once a task, else null.
    """
    schema = pa.schema([("kind", pa.int64()), ("check", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("number", pa.int32()), ("line", pa.binary())])
    held = docs.sparkSession.sparkContext.broadcast(np.zeros(1, np.uint64) if wanted is None else wanted)

    def run(batches):
        table, sent = held.value, Seen()
        for rows, data, offsets in blocks(batches, "text"):
            got = _Lines(data, offsets)
            ids, hashes = (rows.column(i).to_numpy() for i in (0, 1))
            none = np.setdiff1d(np.arange(rows.num_rows), got.row)
            at = np.concatenate((got.row, none))
            empty = np.arange(len(at)) >= len(got.row)
            some = np.flatnonzero(_holds(table, got.kind))
            key, once = np.unique(_class_key(got.kind[some], got.check[some]), return_index=True)
            once = some[once[sent.fresh(key)]]
            texts, whole = [None] * len(at), data.tobytes()
            for i, a, b in zip(once.tolist(), got.starts[got.first[once]].tolist(), got.ends[got.first[once] + got.count[once] - 1].tolist()):
                texts[i] = whole[a:b]
            pad = np.zeros(len(none), np.int64)
            filled = lambda x, kind: pa.array(np.append(x, pad).astype(kind), mask=empty)
            yield record(schema, filled(got.kind, np.int64), filled(got.check, np.int32), ids[at], hashes[at], filled(got.number, np.int32), texts)

    return map_arrow(_keyed(docs, id_col, text_col), run, "kind long, check int, id long, th long, number int, line binary")


def _class_key(kind: np.ndarray, check: np.ndarray) -> np.ndarray:
    return kind.view(np.uint64) ^ mix64(check.view(np.uint32).astype(np.uint64))


def _holds(table: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    slots = kinds & (64 * len(table) - 1)
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def bit_table(kinds: DataFrame) -> np.ndarray:
    """A bit for every class in kinds(kind), at its hash modulo the size; 2**20 to 2**27 bits, so other classes hit it rarely.

    It only keeps texts out of the shuffle; what it lets through is joined exactly.
    """
    bits = min(27, max(20, (8 * kinds.count()).bit_length()))
    slot = F.col("kind").bitwiseAND(F.lit((1 << bits) - 1))
    words = kinds.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr("shiftleft(1L, int(kind & 63L))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    return table.view(np.uint64)


def word_levels(docs: DataFrame, text_col: str = "text", bits: int = COUNTERS) -> tuple[np.ndarray, int]:
    """(one byte for each of 2**bits counters: how frequent its words are, on a logarithmic scale; all words), counted over all documents.

    Each task counts into one array; arrays are summed piece by piece in two rounds, as they stream in.
    """
    schema = pa.schema([("piece", pa.int32()), ("salt", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
    size = (1 << bits) // _PIECES

    def packed_counts(counts, piece, salt):
        at = np.flatnonzero(counts)
        return record(schema, [piece], [salt], [at.astype("<u4").tobytes()], [counts[at].astype("<i8").tobytes()])

    def count(batches):
        counts = np.zeros(1 << bits, np.int64)
        for _, data, offsets in blocks(batches, "text"):
            starts, ends, _ = word_spans(data, offsets)
            np.add.at(counts, (span_hashes(data, starts, ends) & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        if counts.any():
            salt = TaskContext.get().partitionId() % 32
            for i in range(_PIECES):
                yield packed_counts(counts[i * size : (i + 1) * size], i, salt)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, at, counts in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                total = sums.setdefault(piece, np.zeros(size, np.int64))
                total[np.frombuffer(at, "<u4")] += np.frombuffer(counts, "<i8")
        for piece, total in sums.items():
            yield packed_counts(total, piece, 0)

    ddl = "piece int, salt int, at binary, counts binary"
    partial = map_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), count, ddl)
    once = map_arrow(partial.repartition(_PIECES, "piece", "salt"), add, ddl)
    got = map_arrow(once.repartition(_PIECES, "piece"), add, ddl).collect()
    counts = np.zeros(1 << bits, np.int64)
    for r in got:
        counts[r["piece"] * size + np.frombuffer(r["at"], "<u4")] += np.frombuffer(r["counts"], "<i8")
    return np.minimum(255, 8 * np.log2(np.maximum(1, counts))).astype(np.uint8), int(counts.sum())


def prefix_length(n: np.ndarray, least: Fraction) -> np.ndarray:
    return n - -(-n * least.numerator // least.denominator) + 1


class _Ranked:
    """The different words of lines in the order of rarity: line, hash and first word of each line, its size and its bitmap."""

    def __init__(self, got: _Lines, level: np.ndarray, keep: np.ndarray):
        line = np.repeat(np.arange(len(got.kind)), got.count)
        words = np.flatnonzero(keep[line])
        line, h = line[words], got.hashes[words]
        rare = level[(h & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64)
        # one 64-bit sort by (line, level, high half of the hash); words of a line that agree in all that need the full sort
        both = (line.astype(np.uint64) << np.uint64(40)) | (rare << np.uint64(32)) | (h >> np.uint64(32))
        order = np.argsort(both)
        tied = (both[order][1:] == both[order][:-1]) & (h[order][1:] != h[order][:-1])
        if tied.any() or len(got.kind) >= 1 << 24:
            order = np.lexsort((h, rare, line))
        line, h = line[order], h[order]
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
        self.line, self.hash = line[fresh], h[fresh]
        self.first = np.flatnonzero(np.diff(self.line, prepend=-1))
        self.size = np.diff(np.append(self.first, len(self.line)))
        slot = mix64(self.hash) >> np.uint64(57)
        bit = np.uint64(1) << (slot & np.uint64(63))
        self.bits = [np.bitwise_xor.reduceat(np.where(slot >> np.uint64(6) == k, bit, np.uint64(0)), self.first) if len(self.first) else bit for k in range(2)]


def _postings(got: _Lines, level: np.ndarray, share: Fraction, sent: Seen) -> tuple[np.ndarray, ...]:
    """The postings of the prefixes of a buffer's classes of lines that were not sent yet; their columns are _KINDS."""
    _, once = np.unique(got.kind, return_index=True)
    keep = np.zeros(len(got.kind), bool)
    keep[once[sent.fresh(got.kind[once])]] = True
    r = _Ranked(got, level, keep)
    own = np.repeat(np.arange(len(r.first)), r.size)
    position = np.arange(len(own)) - r.first[own]
    some = position < prefix_length(r.size, share)[own]
    own = own[some]
    return r.hash[some], got.kind[r.line[some]].view(np.uint64), *(b[own] for b in r.bits), r.hash[r.first][own], r.size[own].astype(np.uint32), position[some].astype(np.uint32)


def _partners(group, word, kind, b0, b1, rarest, size, position, share: Fraction, marks: np.ndarray | None = None, side: np.ndarray | None = None, short: np.ndarray | None = None, neighbours: int = 0):
    """Yields (i, j) arrays of the pairs within equal groups, rows sorted by (group, size), that pass the filters.

    Lines with the same rarest word meet there and nowhere else. With `marks`, pairs of two marked rows are skipped and
    what passes is marked. With `side`, rows of one side (1 or 2) are not paired. With `short`, the rows that are not are
    compared with fewer than `neighbours` only.
    """
    up, down = share.numerator, share.denominator
    i = np.arange(max(0, len(group) - 1))
    for d in range(1, len(group)):
        i = i[i + d < len(group)]
        if d == neighbours and short is not None:
            i = i[short[i]]
        j = i + d
        near = (group[i] == group[j]) & (size[i] * down >= size[j] * up)
        i, j = i[near], j[near]
        if not len(i):
            return
        x, y = (i, j) if marks is None else (i[fresh := ~(marks[i] & marks[j])], j[fresh])
        if side is not None:
            x, y = x[apart := (side[x] != side[y]) | (side[x] == 0)], y[apart]
        need = -(-up * (size[x] + size[y]) // (up + down))  # the least words in common
        fits = np.minimum(size[x] - position[x], size[y] - position[y]) >= need
        fits &= (rarest[x] != rarest[y]) | (word[x] == rarest[x])
        fits &= kind[x] != kind[y]
        x, y, need = x[fits], y[fits], need[fits]
        differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in (b0, b1))
        fits = differ <= size[x] + size[y] - 2 * need
        x, y = x[fits], y[fits]
        if marks is not None:
            marks[x] = marks[y] = True
        if len(x):
            yield x, y


def _pack(columns) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(bodies: list[bytes], kinds=_KINDS) -> list[np.ndarray]:
    """The columns of postings, sorted by word and size, each class once a word."""
    split, width = [], sum(np.dtype(k).itemsize for k in kinds)
    for body in bodies:
        n, at, columns = len(body) // width, 0, []
        for kind in kinds:
            columns.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        split.append(columns)
    columns = [np.concatenate(c) for c in zip(*split)]
    order = np.lexsort((columns[1], columns[5], columns[0]))
    word, kind = columns[0][order], columns[1][order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])  # a class comes from several tasks
    return [c[order[fresh]] for c in columns]


def _runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal words, and the run of each row."""
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    return first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))


class _Meeting:
    """What one task does with the postings of its parts: marks lines that have a partner, hands hot words on."""

    schema = pa.schema([("word", pa.int64()), ("kind", pa.int64()), ("share", pa.int32()), ("body", pa.binary())])
    ddl = "word long, kind long, share int, body binary"

    def __init__(self, share: Fraction, limits: Limits):
        self.share, self.limits, self.handed = share, limits, {}

    def hand_on(self, columns: list[np.ndarray], first: np.ndarray, runs: np.ndarray, marks: np.ndarray):
        """The given runs in shares of `large` rows, as rows of `schema`."""
        ends = np.append(first, len(columns[0]))
        for r in runs.tolist():
            word = int(columns[0][ends[r]])
            for a in range(ends[r], ends[r + 1], self.limits.large):
                b = min(a + self.limits.large, ends[r + 1])
                nth = self.handed[word] = self.handed.get(word, -1) + 1
                yield record(self.schema, [np.uint64(word).astype(np.int64)], [None], [nth], [_pack([c[a:b] for c in columns] + [marks[a:b]])])

    def compact(self, bodies: list[bytes]):
        """Yields the hot words of what is held, which is reduced to the others."""
        columns = _unpack(bodies)
        first, run = _runs(columns[0])
        hot = np.diff(np.append(first, len(run))) > self.limits.large
        yield from self.hand_on(columns, first, np.flatnonzero(hot), np.zeros(len(run), bool))
        bodies[:] = [_pack([c[~hot[run]] for c in columns])]

    def members(self, bodies: list[bytes]):
        columns = _unpack(bodies)
        word, kind, b0, b1, rarest, size, position = columns
        first, run = _runs(word)
        length, marks = np.diff(np.append(first, len(word))), np.zeros(len(word), bool)
        for _ in _partners(word, word, kind, b0, b1, rarest, size.astype(np.int64), position.astype(np.int64), self.share, marks, short=(length <= self.limits.large)[run], neighbours=self.limits.neighbours):
            pass
        open_ = (length > self.limits.large) & (np.add.reduceat(marks, first) < length) if len(first) else np.zeros(0, bool)
        open_ |= np.isin(word[first], np.array(list(self.handed), np.uint64))
        yield from self.hand_on(columns, first, np.flatnonzero(open_), marks)
        done = marks & ~open_[run]
        yield record(self.schema, word[done].view(np.int64), kind[done].view(np.int64), pa.nulls(int(done.sum()), pa.int32()), pa.nulls(int(done.sum()), pa.binary()))
        self.handed.clear()


def candidates(docs: DataFrame, levels: np.ndarray, total: int, text_col: str = "text", least: float = LEAST, limits: Limits = Limits()) -> DataFrame:
    """(word, kind): the classes of lines that have a possible partner under a word of their prefixes, each once a word."""
    share = Fraction(least).limit_denominator(10_000)
    held = docs.sparkSession.sparkContext.broadcast(levels)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * tasks, int(total * (1 - least) * _POSTING) // _PART_BYTES)
    packed_ = pa.schema([("part", pa.int32()), ("body", pa.binary())])

    def post(batches):
        level, waiting, bytes_, sent = held.value, [], 0, Seen()

        def flush():
            columns = [np.concatenate(c) for c in zip(*waiting)]
            part = (mix64(columns[0] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part)
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            columns = [c[order] for c in columns]
            filled = np.flatnonzero(np.diff(ends))
            return record(packed_, filled.astype(np.int32), [_pack([c[ends[i] : ends[i + 1]] for c in columns]) for i in filled.tolist()])

        for _, data, offsets in blocks(batches, "text"):
            got = _Lines(data, offsets)
            if len(got.kind):
                waiting.append(_postings(got, level, share, sent))
                bytes_ += _POSTING * len(waiting[-1][0])
            if bytes_ > 12 << 20:
                yield flush()
                waiting, bytes_ = [], 0
        if bytes_:
            yield flush()

    def meet(batches):
        meeting, held_part, bodies, bytes_ = _Meeting(share, limits), None, [], 0
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != held_part and bodies:
                    yield from meeting.members(bodies)
                    bodies, bytes_ = [], 0
                held_part = part
                bodies.append(body)
                bytes_ += len(body)
                if bytes_ > limits.held:
                    yield from meeting.compact(bodies)
                    bytes_ = len(bodies[0])
        if bodies:
            yield from meeting.members(bodies)

    def cross(batches):
        held_cell, bodies, sides = None, [], []
        for b in batches:
            for *cell, side, body in zip(*(b.column(i).to_pylist() for i in range(5))):
                if cell != held_cell and bodies:
                    yield crossed(bodies, sides)
                    bodies, sides = [], []
                held_cell = cell
                bodies.append(body)
                sides.append(side)
        if bodies:
            yield crossed(bodies, sides)

    member = pa.schema([("word", pa.int64()), ("kind", pa.int64())])

    def crossed(bodies, sides):
        some = [_unpack([b], (*_KINDS, np.bool_)) for b in bodies]
        columns, side = [np.concatenate(c) for c in zip(*some)], np.repeat(sides, [len(c[0]) for c in some])
        order = np.argsort(columns[5], kind="stable")
        word, kind, b0, b1, rarest, size, position, marks = (c[order] for c in columns)
        marks = marks.copy()
        for _ in _partners(word, word, kind, b0, b1, rarest, size.astype(np.int64), position.astype(np.int64), share, marks, side[order]):
            pass
        return record(member, word[marks].view(np.int64), kind[marks].view(np.int64))

    postings = map_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), post, "part int, body binary")
    met = cut(map_arrow(postings.repartition(min(parts, max(tasks, parts // 4)), "part").sortWithinPartitions("part"), meet, _Meeting.ddl))
    hot = met.where("body is not null")
    shares = hot.groupBy("word").agg((F.max("share") + 1).alias("shares"))
    cells = hot.join(shares, "word").select("word", "body", *_cells(F.col("share"), F.col("shares"))).select("word", "cell.*", "body")
    rest = map_arrow(cells.repartition(tasks, "word", "a", "b").sortWithinPartitions("word", "a", "b"), cross, "word long, kind long").distinct()
    return met.where("body is null").select("word", "kind").unionByName(rest)


def _cells(own, shares) -> list:
    """For a row of share `own` of so many: the cells (a, b, side) in which every two shares meet."""
    other = F.sequence(F.lit(0), shares - 1)
    return [F.explode(F.transform(other, lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))).alias("cell")]


def verified(members: DataFrame, named: DataFrame, levels: np.ndarray, least: float = LEAST, limits: Limits = Limits()) -> DataFrame:
    """(kind, check, id, th, number, n_links): for members(word, kind) the earliest first place of the lines they match, and how
    many match, over named(kind, check, id, th, number, line); one row for each cell at which a class has matches.

    A pair is verified at the first word that its prefixes share.
    """
    share = Fraction(least).limit_denominator(10_000)
    held = members.sparkSession.sparkContext.broadcast(levels)
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = limits.fair or min(8192, max(256, -(-members.count() // tasks)))
    crowds = cut(members.groupBy(F.col("word").alias("of")).agg(F.ceil(F.count("*") / fair).cast("int").alias("shares")).where("shares > 1"))
    if crowds.count() <= 1 << 20:  # 16 MB
        crowds = F.broadcast(crowds)
    dealt = members.join(crowds, F.col("word") == F.col("of"), "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    dealt = dealt.select("word", "kind", *_cells(F.pmod(F.xxhash64("kind"), F.col("shares")).cast("int"), F.col("shares"))).select("word", "kind", "cell.*")
    met = dealt.join(named, "kind").repartition(tasks, "word", "a", "b").sortWithinPartitions("word", "a", "b").select("word", "a", "b", "side", "kind", "check", "id", "th", "number", "line")
    schema = pa.schema([("kind", pa.int64()), ("check", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("number", pa.int32()), ("n_links", pa.int64())])

    def verify(batches):
        waiting: list[pa.RecordBatch] = []  # the rows of a cell may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            keys = [batch.column(i).to_numpy() for i in range(3)]
            other = np.flatnonzero((keys[0] != last[0]) | (keys[1] != last[1]) | (keys[2] != last[2]))
            if len(other) or [waiting[0].column(i)[0].as_py() for i in range(3)] != last:
                whole = int(other[-1]) + 1 if len(other) else 0
                yield judge(pa.Table.from_batches([*waiting[:-1], batch.slice(0, whole)]))
                waiting = [batch.slice(whole)]
        if waiting:
            yield judge(pa.Table.from_batches(waiting))

    def judge(rows: pa.Table):
        word, a, b, side, kind, check, id_, th, number = (rows.column(i).to_numpy() for i in range(9))
        cell = np.cumsum(np.concatenate(([0], (word[1:] != word[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        _, once, own = np.unique(_class_key(kind, check), return_index=True, return_inverse=True)
        text = rows.column(9).take(pa.array(once)).combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(once) + 1]
        body = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        lines_ = _Lines(body, offsets - offsets[0])
        r = _Ranked(lines_, held.value, np.ones(len(once), bool))
        names, token = np.unique(r.hash, return_inverse=True)
        keys = (r.line.astype(np.uint64) << np.uint64(32)) | token.astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]

        def place(line, token_):
            """The place of a token among all, where the line has it; else -1."""
            wanted = (line.astype(np.uint64) << np.uint64(32)) | token_.astype(np.uint64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, order[at], -1)

        named_word = np.minimum(np.searchsorted(names, word.view(np.uint64)), len(names) - 1)
        position = np.where(names[named_word] == word.view(np.uint64), place(own, named_word), -1) - r.first[own]
        position = np.where(position < 0, r.size[own], position)  # another line of the same kind: it has no such word
        sort = np.lexsort((r.size[own], cell))
        rank = np.empty(len(cell), np.int64)
        rank[np.lexsort((number, th, id_))] = np.arange(len(cell))
        cell, own, side, position, back = cell[sort], own[sort], side[sort], position[sort], rank[sort]
        size, far = r.size[own], 1 << 62
        near, count = np.full(len(cell), far), np.zeros(len(cell), np.int64)

        def found_tokens(x, y, many):
            """(pair, step, found): for the first many[p] words of each line x whether line y has them."""
            pair = np.repeat(np.arange(len(x)), many)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            return pair, step, place(own[y][pair], token[r.first[own[x]][pair] + step]) >= 0

        def settle(x, y):
            many = prefix_length(size[x], share)
            _, step, found = found_tokens(x, y, many)
            first_shared = np.minimum.reduceat(np.where(found, step, far), np.cumsum(many) - many)
            here = first_shared == position[x]  # else the pair is verified elsewhere
            x, y = x[here], y[here]
            if not len(x):
                return
            pair, _, found = found_tokens(x, y, size[x])
            common = np.bincount(pair, found, len(x)).astype(np.int64)
            links = common * (share.numerator + share.denominator) >= share.numerator * (size[x] + size[y])
            x, y = x[links], y[links]
            np.minimum.at(near, x, back[y])
            np.minimum.at(near, y, back[x])
            np.add.at(count, x, 1)
            np.add.at(count, y, 1)

        rare = token[r.first[own]]
        pairs, held_pairs = [], 0
        for x, y in _partners(cell, named_word[sort], kind[sort], r.bits[0][own], r.bits[1][own], rare, size, position, share, side=side):
            pairs.append((x, y))
            held_pairs += len(x)
            if held_pairs > 50_000:
                settle(*(np.concatenate(c) for c in zip(*pairs)))
                pairs, held_pairs = [], 0
        if pairs:
            settle(*(np.concatenate(c) for c in zip(*pairs)))
        got = np.flatnonzero(count)
        mine, other = sort[got], np.argsort(rank)[near[got]]
        return record(schema, kind[mine], check[mine], id_[other], th[other], number[other], count[got])

    return map_arrow(met, verify, "kind long, check int, id long, th long, number int, n_links long")


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, limits: Limits = Limits()) -> DataFrame:
    """(id, th, n_lines, removed array<int>, n_links): for every document its worded lines, the numbers of those to remove, and
    the links of its lines' classes to other classes."""
    levels, total = word_levels(docs, text_col)
    members = cut(candidates(docs, levels, total, text_col, least, limits))
    every = cut(lines(docs, bit_table(members.select("kind").distinct()), id_col, text_col))
    place = F.struct("id", "th", "number")
    firsts = cut(every.where("kind is not null").groupBy("kind", "check").agg(F.min(place).alias("first"), F.max("line").alias("line")))
    named = firsts.where("line is not null").select("kind", "check", "first.*", "line")
    met = verified(members, named, levels, least, limits).groupBy("kind", "check").agg(F.min(place).alias("near"), F.sum("n_links").alias("n_links"))
    # both sides of the last join are plain shuffles, so that Spark can split a very common line
    best = firsts.select("kind", "check", "first").join(met, ["kind", "check"], "left")
    best = cut(best.select(F.col("kind").alias("of"), F.col("check").alias("of_check"), F.least("first", F.coalesce("near", "first")).alias("best"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    judged = every.drop("line").join(best, (F.col("kind") == F.col("of")) & (F.col("check") == F.col("of_check")), "left")
    gone = F.col("kind").isNotNull() & (F.col("best") < place)
    return judged.groupBy("id", "th").agg(F.count_distinct("number").alias("n_lines"), F.sort_array(F.collect_set(F.when(gone, F.col("number")))).alias("removed"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed, n_links): one row for each document (identical rows are one); removed lists line
    numbers from 0, comma-joined."""
    got = line_matches(docs, id_col, text_col, least)
    return got.select(F.when(F.col("id") < F.lit(_LAST), F.col("id")).alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.transform("removed", lambda x: x.cast("string"))).alias("removed"), "n_links")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs with their later matching lines taken out of the text; all columns and their order are kept.

    A document all of whose worded lines go is left out; one that never had any stays as it is.
    """
    got = line_matches(docs, id_col, text_col, least).where("size(removed) > 0").select(F.col("id").alias("of"), F.col("th").alias("of_th"), "removed", (F.col("n_lines") == F.size("removed")).alias("whole"))
    text = F.col(f"`{text_col}`")
    keyed = packed(docs, id=F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)), th=F.xxhash64(F.coalesce(text, F.lit(""))))
    joined = keyed.join(got, (F.col("id") == F.col("of")) & (F.col("th") == F.col("of_th")), "left").where("not coalesce(whole, false)")
    body = F.col("row").getField(text_col)
    pieces = F.filter(F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: ~F.array_contains("removed", p["i"]))
    left = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(F.transform(pieces, lambda p: p["x"]), "\n"))
    return joined.select(*[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])

"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, verified on whole shingle sets, and components.

A text's set is its distinct 5-word shingles (fewer words: the whole sequence). Equal sets are one class. A class has a
signature of `POSITIONS` symbols of 16 bits, each taken from one minimum over the set, so that two symbols differ with a chance of
one minus the Jaccard similarity. The join finds every pair of classes whose signatures differ at `DISTANCE` symbols or fewer:
they are split into `CHUNKS` chunks, so (pigeonhole) one chunk has at most `ERRORS` errors; the allowed errors are enumerated
as the ways to leave `ERRORS` symbols of a chunk out, and what is left of it is a key under which the two meet for certain.
A pair that meets is kept if its whole signatures are close enough and then confirmed on the sets themselves.

What the signatures can lose: a pair of similarity 0.85 exactly is beyond 15 of 40 with a chance of 1.1e-4, one of 0.88 of 7e-6.
Sets of up to 5 shingles are linked to equal sets only (5/6 < 0.85), so they have no signature.

Components need no pair of classes that are connected already. First each class names its few closest partners (of a key that
many share, its share's), which are confirmed as rows; these links are contracted. Then only keys that still hold several
components count: classes that such keys chain together are a group, which meets in one task with its sets, or, when it is
large, in a cell for every two of its shares; beyond `GROUP` classes the keys themselves are what is dealt to cells. There every
two classes of different components are compared and confirmed in arrays, and a spanning forest of the links leaves. So a
group of near copies costs a few rows a class, no pair of different components is left untried, and no task holds a key.

Shingles are told apart by 64-bit hashes within a pair, sets by 128 bits. Nulls and edges: a null text is an empty one; texts
without words have empty sets, are linked with nothing and are their own component; a null id keeps its row and is never the
smallest id unless all are null (then component_id is null, and kept); rows that repeat an id or a text stay rows; other columns
are not read, whatever their names; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm._batches import Seen, blocks, cut, lower_ascii, map_arrow, mix64, record, span_hashes, word_spans
from lodeline.llm.components import connected_components
from lodeline.llm.line_dedup import bit_table

WIDTH, PERCENT = 5, 85
POSITIONS, CHUNKS, ERRORS, DISTANCE = 40, 8, 1, 15
#: Least size of a set that can be linked to a different one.
LEAST_SET = 6
#: Partners that a class names first. What one share of a key or group takes on: classes, shingles of all. Classes of a group that is
#: dealt as one. None of them changes the result.
CLOSEST, SHARE, SHINGLES, GROUP = 4, 1024, 1 << 20, 8192

_LANES = POSITIONS // 4
_SYMBOLS = [f"s{i}" for i in range(_LANES)]
_ODD = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(20240229).integers(1 << 40, 1 << 62, POSITIONS)]
_PLACES = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(4).integers(1 << 40, 1 << 62, WIDTH)]


class _Sets:
    """The distinct shingle hashes of each row of a buffer: `values`, with `first` and `size` a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        starts, ends, row = word_spans(data, offsets)
        words = span_hashes(data, starts, ends)
        count = np.bincount(row, minlength=rows)
        begin = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
        n = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
        owner = np.repeat(np.arange(rows), n)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        sums = np.zeros(len(at), np.uint64)
        for k in range(WIDTH):
            inside = k < count[owner]  # only short rows have fewer words
            sums += np.where(inside, mix64(words[np.minimum(at + k, len(words) - 1)] * _PLACES[k]) if len(words) else np.uint64(0), np.uint64(0))
        values = mix64(sums + np.minimum(count[owner], WIDTH).astype(np.uint64))
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        self.owner, self.values = owner[fresh], values[fresh]
        self.size = np.bincount(self.owner, minlength=rows)
        self.first = np.cumsum(self.size) - self.size

    def classes(self, rows: np.ndarray) -> list[bytes]:
        """128 bits for the set of each row that has one."""
        a = np.add.reduceat(mix64(self.values), self.first[rows]) if len(rows) else np.zeros(0, np.uint64)
        b = np.add.reduceat(mix64(self.values ^ np.uint64(0xA0761D6478BD642F)), self.first[rows]) if len(rows) else a
        both = np.stack((mix64(a + self.size[rows].astype(np.uint64)), mix64(b)), axis=1).astype(">u8")
        return [x.tobytes() for x in both]

    def signatures(self, rows: np.ndarray) -> np.ndarray:
        """Symbols (16 bits each) of the rows that have a set, packed as longs: a row of _LANES."""
        out = np.zeros((len(rows), _LANES), np.uint64)
        if len(rows):
            for k, odd in enumerate(_ODD):
                least = np.minimum.reduceat(self.values * odd, self.first[rows])
                out[:, k // 4] |= (mix64(least) >> np.uint64(48)) << np.uint64(16 * (k % 4))
        return out.view(np.int64)


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text")).withColumn("kind", F.xxhash64("id", "text"))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, n, cls, s0, ...): a hash of each row, the size and class of its set, and the signature (0 below LEAST_SET)."""
    schema = pa.schema([("id", pa.int64()), ("kind", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), *((s, pa.int64()) for s in _SYMBOLS)])

    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            sets = _Sets(np.frombuffer(lower_ascii(data.tobytes()), np.uint8), offsets)
            some, large = np.flatnonzero(sets.size), np.flatnonzero(sets.size >= LEAST_SET)
            names = np.full(rows.num_rows, None, object)
            names[some] = sets.classes(some)
            symbols = np.zeros((rows.num_rows, _LANES), np.int64)
            symbols[large] = sets.signatures(large) if len(large) == len(some) else _of(sets, large)
            yield record(schema, rows.column(0), rows.column(2), sets.size, names.tolist(), *symbols.T)

    return map_arrow(_read(docs, id_col, text_col), run, f"id long, kind long, n long, cls binary, {', '.join(f'{s} long' for s in _SYMBOLS)}")


def _of(sets: _Sets, rows: np.ndarray) -> np.ndarray:
    """Signatures of some rows of which others with sets lie between."""
    some = np.flatnonzero(sets.size)
    return sets.signatures(some)[np.searchsorted(some, rows)]


def _keys():
    """A key for each chunk and each choice of symbols that are left out of it."""
    width = POSITIONS // CHUNKS
    symbol = lambda k: F.shiftrightunsigned(F.col(_SYMBOLS[k // 4]), 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))
    left = [(c, kept) for c in range(CHUNKS) for kept in combinations(range(c * width, (c + 1) * width), width - ERRORS)]
    return F.array(*[F.xxhash64(F.lit(i), *[symbol(k) for k in kept]) for i, (_, kept) in enumerate(left)])


def members(classes: DataFrame) -> DataFrame:
    """(key, size, cls): the classes under each key that several share."""
    placed = classes.select("cls", F.explode(_keys()).alias("key"))
    shared = placed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size")).where("size > 1")
    return placed.join(shared, F.col("key") == F.col("k")).select("key", "size", "cls")


def _close(key: np.ndarray, comp: np.ndarray, side: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows sorted by key that meet, each pair once: equal keys, other components, other sides (-1: any) and
    signatures within DISTANCE."""
    close, i = [np.zeros((3, 0), np.int64)], np.arange(max(0, len(key) - 1))
    for d in range(1, len(key)):
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        apart = i[(comp[i] != comp[i + d]).any(axis=1) & ((side[i] != side[i + d]) | (side[i] < 0))]
        for part in np.array_split(apart, len(apart) // 32768 + 1):
            differ = np.count_nonzero(symbols[part] != symbols[part + d], axis=1)
            near = differ <= DISTANCE
            close.append(np.stack((part[near], part[near] + d, differ[near])))
    return tuple(np.concatenate(close, axis=1))


def _first(own: np.ndarray, other: np.ndarray, differ: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row, as own, its `most` closest others."""
    own, other, differ = np.concatenate((own, other)), np.concatenate((other, own)), np.concatenate((differ, differ))
    order = np.lexsort((differ, own))
    row = own[order]
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < most]
    return own[order], other[order], differ[order]


def _halves(names: pa.ChunkedArray) -> np.ndarray:
    """Classes as two unsigned halves, which order like their bytes."""
    return np.frombuffer(b"".join(names.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)


def _whole_cells(batches, do):
    """do(rows) for pieces of sorted batches that hold whole cells (key, cell)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= 4 * SHARE:  # the last cell may go on
            rows = pa.Table.from_batches(held)
            key, cell = (rows.column(c).to_numpy() for c in ("key", "cell"))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            if len(ends):
                yield do(rows.slice(0, int(ends[-1])))
                held = rows.slice(int(ends[-1])).to_batches()
    if held:
        yield do(pa.Table.from_batches(held))


def _columns(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(a number for each cell, components, sides, symbols)."""
    key, cell = (rows.column(c).to_numpy() for c in ("key", "cell"))
    symbols = np.stack([rows.column(s).to_numpy() for s in _SYMBOLS], axis=1).view(np.uint16)
    at = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))) if len(key) else key
    return at, _halves(rows.column("comp")), rows.column("side").to_numpy(), symbols


def _sorted_cells(cells: DataFrame, *more: str) -> DataFrame:
    return cells.select("key", "cell", "side", "cls", "comp", *_SYMBOLS, *more).repartition("key", "cell").sortWithinPartitions("key", "cell")


def _names(rows: pa.Table, at: np.ndarray):
    return rows.column("cls").take(pa.array(at)).combine_chunks()


def closest(cells: DataFrame, most: int | None) -> DataFrame:
    """(a, b), a < b: for each class of cells(key, cell, side, cls, comp, s0, ...) the `most` closest (None: all) that it meets."""
    schema = pa.schema([("own", pa.binary()), ("other", pa.binary()), ("differ", pa.int32())])

    def pairs(rows: pa.Table):
        i, j, differ = _close(*_columns(rows))
        if most is not None:
            i, j, differ = _first(i, j, differ, most)
        return record(schema, _names(rows, i), _names(rows, j), differ)

    named = map_arrow(_sorted_cells(cells), lambda b: _whole_cells(b, pairs), "own binary, other binary, differ int").where("own != other").distinct()
    if most is not None:
        named = named.withColumn("nth", F.row_number().over(W.partitionBy("own").orderBy("differ", "other"))).where(F.col("nth") <= most)
    return named.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def _forest(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of the pairs (i, j) that connect components not connected by those before."""
    _, label = np.unique(comp, axis=0, return_inverse=True)
    _, places = np.unique(np.sort(np.stack((label[i], label[j])), axis=0), axis=1, return_index=True)
    up, out = {}, []

    def top(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for k in sorted(places.tolist()):
        x, y = top(int(label[i[k]])), top(int(label[j[k]]))
        if x != y:
            up[x] = y
            out.append(k)
    return out


def linked_in_cells(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: links that connect all components that links between classes of one cell connect.

    cells(key, cell, side, cls, comp, s0, ..., hashes) bring the sets; every two of other components are confirmed on them.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def pairs(rows: pa.Table):
        at, comp, side, symbols = _columns(rows)
        i, j, _ = _close(at, comp, side, symbols)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("hashes")]
        size = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin, inside, good = np.cumsum(size) - size, np.zeros(int(ids.max()) + 1, bool), np.zeros(len(i), bool)
        for a, b in zip(*(x.tolist() for x in _spans(i))):
            own = ids[begin[i[a]] : begin[i[a]] + size[i[a]]]
            inside[own] = True
            while a < b:  # some partners at a time
                z = min(b, a + max(1, int(np.searchsorted(np.cumsum(size[j[a:b]]), SHINGLES))))
                of, n = j[a:z], size[j[a:z]]
                first = np.cumsum(n) - n
                both = np.add.reduceat(inside[ids[np.repeat(begin[of] - first, n) + np.arange(int(n.sum()))]], first, dtype=np.int64)
                good[a:z] = 100 * both >= percent * (len(own) + n - both)
                a = z
            inside[own] = False
        i, j = i[good], j[good]
        some = np.array(_forest(comp, i, j), np.int64)
        return record(schema, _names(rows, i[some]), _names(rows, j[some]))

    found = map_arrow(_sorted_cells(cells, "hashes"), lambda b: _whole_cells(b, pairs), "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _spans(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(i, prepend=-1))
    return first, np.append(first[1:], len(i))


def dealt_cells(rows: DataFrame) -> DataFrame:
    """Rows (key, size, cls, comp, ...) with one share a row of the keys that many have."""
    n = F.ceil(F.col("size") / F.lit(SHARE))
    return rows.withColumn("cell", F.pmod(F.xxhash64("cls"), n).cast("int")).withColumn("side", F.lit(-1))


def all_cells(rows: DataFrame) -> DataFrame:
    """Rows (key, cls, n, ...) in a cell for every two shares of a key."""
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.greatest(F.ceil(F.count("*") / F.lit(SHARE)), F.ceil(F.sum("n") / F.lit(SHINGLES))).cast("int").alias("shares"))
    shared = rows.join(sizes, F.col("key") == F.col("k")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("shares")).cast("int"))
    spread = shared.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    own, other = F.col("own"), F.col("with")
    return spread.withColumn("cell", F.least(own, other) * F.col("shares") + F.greatest(own, other)).withColumn("side", F.when(own == other, -1).when(own < other, 0).otherwise(1))


def open_groups(rows: DataFrame) -> DataFrame | None:
    """(key, cls) of the classes of rows(key, cls, comp) under keys that hold several components: the key stands for the group that
    such keys chain together or, in a group of more than GROUP classes, is the key itself. None if there is none."""
    keys = rows.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cls").alias("lead")).where("low < high").select("k", "lead")
    held = cut(rows.join(keys, F.col("key") == F.col("k")).select("key", "cls", "lead"))
    if held.isEmpty():
        return None
    groups = cut(connected_components(held.where("lead != cls").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()))
    large = groups.groupBy(F.col("component").alias("of")).agg((F.count("*") > GROUP).alias("large"))
    known = groups.join(large, F.col("component") == F.col("of")).select("node", F.xxhash64("component").alias("group"), "large")
    whole = known.where("not large").select(F.col("group").alias("key"), F.col("node").alias("cls"))
    return whole.union(held.join(known.where("large"), F.col("cls") == F.col("node")).select("key", "cls"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cls, hashes): the sorted shingle hashes, eight bytes each, of the classes in wanted(cls, kind), read from the rows of that kind."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted))
    schema = pa.schema([("cls", pa.binary()), ("hashes", pa.binary())])

    def run(batches):
        sent = Seen()
        for b in batches:
            kinds = b.column(2).to_numpy()
            slots = kinds & (64 * len(table.value) - 1)
            hit = np.flatnonzero((table.value[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1))
            _, once = np.unique(kinds[hit], return_index=True)
            hit = np.sort(hit[once[sent.fresh(kinds[hit][once])]])
            for _, data, offsets in blocks([b.take(pa.array(hit))], "text"):
                sets = _Sets(np.frombuffer(lower_ascii(data.tobytes()), np.uint8), offsets)
                some = np.flatnonzero(sets.size)
                yield record(schema, sets.classes(some), [sets.values[sets.first[r] : sets.first[r] + sets.size[r]].tobytes() for r in some.tolist()])

    got = map_arrow(_read(docs, id_col, text_col), run, "cls binary, hashes binary")
    return got.join(wanted.select(F.col("cls").alias("c")), F.col("cls") == F.col("c"), "left_semi").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked): whether 100 * intersection >= percent * union of the two whole sets."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_())])

    def run(batches):
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = sorted((len(x), len(y)))
                both = len(x) + len(y) - len(np.union1d(x, y)) if 100 * least >= percent * most else 0
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield record(schema, b.column(0), b.column(1), linked)

    of = lambda end: sets.select(F.col("cls").alias(f"of_{end}"), F.col("hashes").alias(f"set_{end}"))
    met = pairs.join(of("a"), F.col("a") == F.col("of_a")).join(of("b"), F.col("b") == F.col("of_b"))
    return map_arrow(met.select("a", "b", "set_a", "set_b"), run, "a binary, b binary, linked boolean")


def class_components(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame | None:
    """(node, component) for the classes that are linked to another; None where no two classes meet."""
    shared = cut(members(classes))
    if shared.isEmpty():
        return None
    wanted = cut(classes.join(shared.select(F.col("cls").alias("c")).distinct(), F.col("cls") == F.col("c"), "left_semi"))
    sets = cut(shingle_sets(docs, wanted, id_col, text_col))
    alone = shared.join(wanted.select(F.col("cls").alias("c"), F.col("cls").alias("comp"), *_SYMBOLS), F.col("cls") == F.col("c"))
    links = cut(confirm(closest(dealt_cells(alone), CLOSEST), sets, percent).where("linked").select("a", "b"))
    parts = cut(connected_components(links))
    named = cut(wanted.join(parts, F.col("cls") == F.col("node"), "left").select("cls", "n", F.coalesce("component", "cls").alias("comp"), *_SYMBOLS))
    rest = open_groups(shared.join(named.select(F.col("cls").alias("c"), "comp"), F.col("cls") == F.col("c")).select("key", "cls", "comp"))
    if rest is None:
        return parts
    cells = all_cells(rest.join(named.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c")))
    more = cut(linked_in_cells(cells.join(sets.withColumnRenamed("cls", "of"), F.col("cls") == F.col("of")), percent))
    return parts if more.isEmpty() else cut(connected_components(links.union(more)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, kind, n_shingles, component, component_id, kept) for every row; component is null for an empty set."""
    if percent < 84:
        raise ValueError("signatures, and sets too small to have one, are laid out for similarities of 0.84 and more")
    rows = cut(signed(docs, id_col, text_col))
    classes = rows.where(F.col("n") >= LEAST_SET).groupBy("cls").agg(F.min("kind").alias("kind"), F.max("n").alias("n"), *[F.min(s).alias(s) for s in _SYMBOLS])
    parts = class_components(docs, classes, id_col, text_col, percent)
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    named = least.withColumn("component", F.col("cls")) if parts is None else least.join(parts, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    known = named.join(smallest, F.col("component") == F.col("of")).select(F.col("cls").alias("c"), "component", "component_id")
    full = rows.where("cls is not null").join(known, F.col("cls") == F.col("c")).select("id", "kind", "n", "component", "component_id")
    empty = rows.where("cls is null").select("id", "kind", "n", F.lit(None).cast("binary").alias("component"), F.col("id").alias("component_id"))
    return full.union(empty).select(F.col("id").alias("doc_id"), "kind", F.col("n").alias("n_shingles"), "component", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

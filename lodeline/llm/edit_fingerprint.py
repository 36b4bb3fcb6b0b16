"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification.

All documents share random walks over characters: at step j the cursor of a text stands on a character, whose class is the
walk's symbol j, and moves on by one or stays, as a random bit for (j, class) says. After an insertion, deletion or change two
walks differ until their cursors meet again by chance, and agree from there on: walks at a small edit distance differ in few
symbols, so edit distance has become Hamming distance. (x edits cost some x steps at least and, as a rule, no more than x^2.)

The fingerprint has COORDINATES symbols, sampled from WALKS independent walks (bit sampling). A coordinate's place must be the
same for texts of nearly equal length and any place of any text, so it is the least of all steps of the walk in a random order
of the steps, one order a coordinate: of two texts the shorter one's place is also the longer one's with a chance of the ratio
of their lengths. Only steps that come before all earlier ones in that order matter, about the logarithm of the text's
length; they are drawn from a seed, without a table of steps. A coordinate is written as 8 bits of its place and symbol.
The Hamming distance of two fingerprints is the number of coordinates that differ, and their likeness the share that agree.

Texts of a piece walk side by side in arrays, and the last few of them, or a very long one, alone: time is linear in
the characters, state is a cursor and a step.

`link_counts` bands the fingerprints (BANDS keys of WIDTH coordinates), compares the different fingerprints of a bucket and
verifies each pair on all coordinates.

Nulls and edges: a null text is an empty one; empty texts share one fingerprint (likeness 1 among themselves); in the order
of documents null ids come last and equal ids are told apart by their text's hash; equal texts have equal fingerprints;
repeated rows stay, columns besides id and text are not looked at, an empty table gives no rows, and a single document is
its own next one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import cut, map_arrow, mix64, record

COORDINATES, WALKS, BANDS, WIDTH = 128, 2, 16, 6
#: Steps after which a walk's random bits repeat; steps that texts take side by side before those that ended are left out; as
#: many texts or fewer walk alone, which is faster.
PERIOD, STRETCH, ALONE = 4096, 256, 128
#: Fingerprints of a bucket that one share holds; what stands for a null id; the class after a text's end, where a walk stays.
SHARE, _LAST, _END = 1024, 2**63 - 1, 255

_rng = np.random.default_rng(20260103)
#: The walks' random bits for (step, class).
_MOVE = _rng.integers(0, 2, (PERIOD, WALKS, 256), dtype=np.int64)
_MOVE[:, :, _END] = 0
_MOVE_BYTES = [[row.astype(np.uint8).tobytes() for row in _MOVE[:, walk]] for walk in range(WALKS)]
_MOVE = _MOVE.reshape(PERIOD, WALKS * 256)


def _places() -> tuple[np.ndarray, np.ndarray]:
    """(steps, coordinates), by step: where a step comes before all earlier ones in a coordinate's order, up to step 2^40."""
    out = []
    for k in range(COORDINATES):
        step, rank = 0, float(_rng.random())
        while step < 2**40:
            out.append((step, k))
            step += 1 + int(np.log(_rng.random()) / np.log1p(-rank))  # the wait for a smaller rank
            rank *= float(_rng.random())
    return tuple(np.array(x, np.int64) for x in zip(*sorted(out)))


_STEP, _WHO = _places()
_PLACES = [np.flatnonzero(_WHO % WALKS == walk) for walk in range(WALKS)]
_PRINT = (mix64((_STEP[:, None] * 65536 + _WHO[:, None] * 256 + np.arange(256)).astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _classes(points: np.ndarray) -> np.ndarray:
    """Code points as 255 classes."""
    out = np.empty(len(points), np.uint8)
    for i in range(0, len(points), 1 << 18):
        out[i : i + (1 << 18)] = (mix64(points[i : i + (1 << 18)].astype(np.uint64)) >> np.uint64(32)) % np.uint64(_END)
    return out


def _alone(walk: int, classes: bytes, at: int, step: int, out: np.ndarray) -> None:
    """Takes one text's walk on from (at, step) to its end."""
    moves, places = _MOVE_BYTES[walk], _PLACES[walk]
    for r in places[int(np.searchsorted(_STEP[places], step)) :].tolist():
        stop = int(_STEP[r])
        while step < stop:
            first = step % PERIOD
            last = min(PERIOD, first + stop - step)
            for m in moves[first:last]:
                at += m[classes[at]]
            step += last - first
            if classes[at] == _END:
                return
        if classes[at] == _END:
            return
        out[_WHO[r]] = _PRINT[r][classes[at]]


def embed(texts: list[str]) -> np.ndarray:
    """The fingerprints of texts, a row of COORDINATES bytes each; an empty text's are zero."""
    prints = np.zeros((len(texts), COORDINATES), np.uint8)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    classes = _classes(points)
    classes[ends] = _END
    # a copy of the texts for each walk, so that a lane's symbol says whose random bit it takes
    symbols = np.concatenate([classes.astype(np.int16) + 256 * w for w in range(WALKS)])
    lanes = np.tile(np.arange(len(texts)), WALKS)
    cursor = (np.concatenate(([0], ends[:-1] + 1)) + len(classes) * np.arange(WALKS)[:, None]).ravel() if texts else lanes
    step = entered = 0
    while True:
        on = np.flatnonzero(symbols[cursor] & 255 != _END)
        lanes, cursor = lanes[on], cursor[on]
        if len(lanes) <= ALONE:
            break
        seen, moved = np.empty((STRETCH, len(lanes)), np.int16), np.empty(len(lanes), np.int64)
        for row, bits in zip(seen, _MOVE[step % PERIOD :]):
            symbols.take(cursor, out=row, mode="clip")
            bits.take(row, out=moved, mode="clip")
            cursor += moved
        upto = int(np.searchsorted(_STEP, step + STRETCH))
        for r in range(entered, upto):
            at = seen[_STEP[r] - step]
            there = np.flatnonzero((at >> 8 == _WHO[r] % WALKS) & (at & 255 != _END))
            prints[lanes[there], _WHO[r]] = _PRINT[r][at[there] & 255]
        step, entered = step + STRETCH, upto
    if len(lanes):
        whole = classes.tobytes()
        for lane, at in zip(lanes.tolist(), cursor.tolist()):
            _alone(at // len(whole), whole, at % len(whole), step, prints[lane])
    return prints


def hamming(a: str, b: str) -> int:
    """The coordinates in which two fingerprints differ."""
    return sum(a[i : i + 2] != b[i : i + 2] for i in range(0, len(a), 2))


def likeness(a: str, b: str) -> float:
    """The share of equal coordinates of two fingerprints."""
    return 1 - hamming(a, b) / (len(a) // 2)


def sketches(texts: list[str], budget: int = 2_000_000) -> list[bytes]:
    """Fingerprints of texts, in pieces of a bounded number of characters."""
    out, piece, held = [], [], 0
    for i, t in enumerate(texts):
        piece.append(t)
        held += len(t)
        if held >= budget or i == len(texts) - 1:
            out += [p.tobytes() for p in embed(piece)]
            piece, held = [], 0
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in batches:
            yield record(schema, b.column(0), [p.hex() for p in sketches([t or "" for t in b.column(1).to_pylist()])])

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, "doc_id long, fingerprint string")


def _cells(batches):
    """Pieces of whole cells from batches sorted by (key, low, high), as tables; a cell has at most about two shares of rows."""
    held = []
    for b in batches:
        held.append(b)
        whole = pa.Table.from_batches(held)
        names = np.stack([whole.column(c).to_numpy() for c in ("key", "low", "high")])
        ended = np.flatnonzero((names != names[:, -1:]).any(axis=0))
        if len(ended):
            last = int(ended[-1]) + 1
            yield whole.slice(0, last), names[:, :last]
            held = whole.slice(last).to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, np.stack([whole.column(c).to_numpy() for c in ("key", "low", "high")])


def _links_of_cell(prints: np.ndarray, band: int, side: np.ndarray, apart: bool, times: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, least first) of each fingerprint of a cell; a pair counts in the first band that it agrees on, so once."""
    links, low = np.zeros(len(prints), np.int64), first.copy()
    for i in range(0, len(prints), 32):
        same = (prints[i : i + 32, None] == prints[None, i:]).view(np.uint8).sum(axis=2, dtype=np.uint8)
        x, y = np.nonzero(same >= least)
        on = (x < y) & ((side[x + i] != side[y + i]) if apart else True)
        x, y = x[on] + i, y[on] + i
        agreed = (prints[x, : BANDS * WIDTH] == prints[y, : BANDS * WIDTH]).reshape(-1, BANDS, WIDTH).all(axis=2)
        on = agreed[:, band] & (agreed.argmax(axis=1) == band)
        x, y = x[on], y[on]
        for a, b in ((x, y), (y, x)):
            np.add.at(links, a, times[b])
            np.minimum.at(low, a, first[b])
    return links, low


def link_counts(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint, n_links, near_first), a row for every different fingerprint of prints(doc_id, fingerprint).

    Two rows are linked if their fingerprints agree on all coordinates of a band and on `least` of all coordinates: n_links is
    the number of rows that a row is linked to, near_first the least doc_id among them and itself (null: only null ids).
    Equal fingerprints are one class with a count. A bucket of more than SHARE different fingerprints is dealt to
    shares, and every two shares meet in a cell, in arrays: what leaves is a count a fingerprint, never a pair. Its work
    still grows with the square of the different fingerprints that agree on a band.
    """
    classes = prints.groupBy("fingerprint").agg(F.count("*").alias("times"), F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first"))
    key = lambda b: F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("fingerprint", 1 + 2 * WIDTH * b, 2 * WIDTH)).alias("key"))
    keys = classes.select(F.xxhash64("fingerprint").alias("h"), F.explode(F.array(*map(key, range(BANDS)))).alias("k")).select("h", "k.band", "k.key")
    crowds = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / SHARE).cast("int").alias("parts"))
    met = keys.join(crowds, "key").join(classes.select(F.xxhash64("fingerprint").alias("h"), F.unhex("fingerprint").alias("print"), "times", "first"), "h")
    sided = met.withColumn("side", F.pmod("h", F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = sided.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "band", "side", "print", "times", "first")
    schema = pa.schema([("print", pa.binary()), ("links", pa.int64()), ("low", pa.int64())])
    bound = int(np.ceil(least * COORDINATES - 1e-9))

    def run(batches):
        for rows, names in _cells(batches):
            all_ = np.frombuffer(b"".join(rows.column("print").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            band, side, times, first = (rows.column(c).to_numpy() for c in ("band", "side", "times", "first"))
            starts = np.flatnonzero(np.concatenate(([True], (names[:, 1:] != names[:, :-1]).any(axis=0))))
            links, low = np.zeros(len(all_), np.int64), first.copy()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(all_)]):
                if b - a > 1:
                    links[a:b], low[a:b] = _links_of_cell(all_[a:b], int(band[a]), side[a:b], names[1, a] != names[2, a], times[a:b], first[a:b], bound)
            on = np.flatnonzero(links)
            yield record(schema, rows.column("print").take(on).combine_chunks(), links[on], low[on])

    found = map_arrow(cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"), run, "print binary, links long, low long")
    found = found.groupBy(F.lower(F.hex("print")).alias("fingerprint")).agg(F.sum("links").alias("links"), F.min("low").alias("low"))
    near = F.least("first", "low")  # skips nulls
    return classes.join(found, "fingerprint", "left").select(
        "fingerprint", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(near < _LAST, near).alias("near_first")
    )


def linked_fingerprints(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """edited_fingerprints of all rows of docs, written once, with each row's n_links and near_first (see link_counts)."""
    rows = cut(edited_fingerprints(docs))
    return rows.join(link_counts(rows, least), "fingerprint")


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as many characters (or all) of the one after."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def _range_of(bounds: np.ndarray, place: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The range of each (place, tie), ascending in that order; a place that is several bounds has as many ranges, by tie."""
    low, high = np.searchsorted(bounds, place, "left"), np.searchsorted(bounds, place, "right")
    share = ((tie.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64)
    return np.where(high > low, low + 1 + ((high - low) * share >> 32), high)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, hamming_edited, hamming_next) for
    every row.

    The edited text has its last third replaced by the start of the next document in descending id (after the last one:
    the first). Documents are dealt by ranges of (id, text hash), so that one id, or null, may hold many rows, and the first
    document of each range goes to the range before as well: neighbours meet with one shuffle of the (compressed) texts and
    no task sees more than its ranges. The driver sees some numbers for each range.
    """
    n = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(f"`{text_col}`")
    # ascends as the order does; null comes last
    place = F.coalesce(F.bitwise_not(F.col(f"`{id_col}`").cast("long")), F.lit(_LAST))
    source = docs.select(place.alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    found = docs.select(place.alias("place")).agg(F.percentile_approx("place", F.array(*[F.lit(i / n) for i in range(1, n)] or [F.lit(0.5)]), F.lit(10 * n)).alias("b")).first()["b"]
    bounds = np.array(sorted(found or []), np.int64)

    def heads(batches):
        best: dict[int, tuple[int, int]] = {}
        for b in batches:
            place, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = _range_of(bounds, place, tie)
            order = np.lexsort((tie, place, at))
            first = order[np.flatnonzero(np.diff(at[order], prepend=-1))] if len(order) else order
            for k, p, q in zip(at[first].tolist(), place[first].tolist(), tie[first].tolist()):
                best[k] = min(best.get(k, (p, q)), (p, q))
        for k, (p, q) in best.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([p]), pa.array([q])], names=["at", "place", "tie"])

    got = map_arrow(source.select("place", "tie"), heads, "at int, place long, tie long").groupBy("at").agg(F.min(F.struct("place", "tie")).alias("head"))
    head = {r["at"]: tuple(r["head"]) for r in got.collect()}
    full = sorted(head)
    before = {r: full[i - 1] for i, r in enumerate(full)}
    dealt_schema = pa.schema([("at", pa.int32()), ("copy", pa.bool_()), ("place", pa.int64()), ("tie", pa.int64()), ("doc_id", pa.int64()), ("body", pa.binary())])

    def deal(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        copied = set()  # of equal rows one is enough in the range before
        for b in batches:
            out = [[] for _ in dealt_schema]
            ranges_ = _range_of(bounds, b.column(0).to_numpy(), b.column(1).to_numpy()).tolist()
            for at, place, tie, doc_id, text in zip(ranges_, *(b.column(i).to_pylist() for i in range(4))):
                body = pack((text or "").encode())
                kinds = [(at, False)]
                if head[at] == (place, tie) and at not in copied:
                    copied.add(at)
                    kinds.append((before[at], True))
                for r, copy in kinds:
                    for column, value in zip(out, (r, copy, place, tie, doc_id, body)):
                        column.append(value)
            yield record(dealt_schema, *out)

    rows = map_arrow(source, deal, "at int, copy boolean, place long, tie long, doc_id long, body binary")
    rows = rows.repartition(max(1, n // 4), "at").sortWithinPartitions("at", "copy", "place", "tie").select("at", "copy", "doc_id", "body")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("hamming_edited", pa.int64()), ("hamming_next", pa.int64()),
    ])

    def judged(rows: list[tuple[int, bool, int, str]]):
        # a range ends with a copy of the next one's head; of several copies the first counts
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
        changed = [edited(x[3], y[3]) for x, y in pairs]
        prints = [p.hex() for p in sketches([r[3] for r in rows])]
        own = [(p, q) for x, y, p, q in zip(rows, rows[1:], prints, prints[1:]) if not x[1] and x[0] == y[0]]
        new = [p.hex() for p in sketches(changed)]
        far, next_ = [hamming(p, e) for (p, _), e in zip(own, new)], [hamming(p, q) for p, q in own]
        share = lambda d: 1 - d / COORDINATES
        return record(
            schema, [x[2] for x, _ in pairs], [len(x[3]) for x, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            [p for p, _ in own], new, list(map(share, far)), list(map(share, next_)), far, next_,
        )

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple[int, bool, int, str]] = []  # its last row's next one is yet to come
        size = 0
        for b in batches:
            for at, copy, doc_id, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                text = unpack(body).decode()
                held.append((at, copy, doc_id, text))
                size += len(text)
                if size > 2_000_000 and len(held) > 1:
                    yield judged(held)
                    held, size = held[-1:], len(text)
        if len(held) > 1:
            yield judged(held)

    return map_arrow(rows, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hamming_edited long, hamming_next long")

"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

Grades run from 0 to K. One weight vector over hashed text features is shared by all grades, and ordered thresholds
t1 < ... < tK turn a score s into P(grade >= k) = sigmoid(s - tk). The sum of these tails is the expected grade; the last
tail is the chance of the top grade, by which documents are selected.

Features of a text (each counted once): its lower-cased words and a few binned shares (distinct words, symbols, capitals,
digits, word length, lines), all hashed to 2**bits places. `fit` learns on at most `sample` labelled rows, one for each of the
ids whose hashes are smallest (that bound is the only sampling here); scoring covers every row.

The `labels` table gives grades: 0 for low quality, 1 for good but toxic, 2 for good and not toxic.

Nulls and edges: a null text is an empty one and has the binned features only; labels without quality, or without a
document, are left out, a null toxic counts as 0, several labels of an id count as the lowest, and of several rows with one
id the text with the least hash is learnt from; without any labels the weights are zero and every document is kept. Repeated
rows are each scored and kept or dropped alike; other columns, whatever their names, pass through `select` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import blocks, cut, map_arrow, mix64, record, span_hashes, word_spans

SAMPLE, BITS, TOP_GRADE, LEAST_TAIL = 32000, 18, 2, 0.35
#: Standard errors from which on a place's weight is taken as the rows say (see fit_arrays), and the decay of weights.
SURE, DECAY = 8.0, 1e-5
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True
#: Two counters a word: symbols and capitals, digits and letters, line ends.
_PAIRS = np.zeros((3, 256), np.uint64)
_PAIRS[0, [b for b in range(128) if chr(b) in "#*$%&|<>!?@^~=+_{}[]\\/"]] += np.uint64(1)
_PAIRS[0, range(65, 91)] += np.uint64(1 << 32)
_PAIRS[1, range(48, 58)] += np.uint64(1)
_PAIRS[1, [b for b in range(128) if chr(b).isalpha()]] += np.uint64(1 << 32)
_PAIRS[2, 10] += np.uint64(1)
_LOWER_TABLE = np.arange(256, dtype=np.uint8)
_LOWER_TABLE[65:91] += 32


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS
    rows: int = 0
    loss: float = 0.0

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature places, first place of each row): the distinct hashed features of every text of a buffer."""
    n = len(offsets) - 1
    low = _LOWER_TABLE[data]
    starts, ends, row = word_spans(low, offsets, _SEPARATOR)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    both = _distinct((row.astype(np.uint64) << shift) | (span_hashes(low, starts, ends) & mask))
    distinct = np.bincount((both >> shift).astype(np.int64), minlength=n)
    size, words = np.diff(offsets), np.bincount(row, minlength=n)
    full, sums = np.flatnonzero(size), np.zeros((6, n), np.int64)
    for k, pair in enumerate(_PAIRS):
        if len(full):
            sums[2 * k : 2 * k + 2, full] = np.add.reduceat(pair[data], offsets[full]).view("<u4").reshape(-1, 2).T
    symbols, capitals, digits, letters, lines, _ = sums
    length = np.minimum(7, np.log2(np.maximum(1, words) / 8).clip(0).astype(np.int64))
    size = np.maximum(1, size)
    bins = [
        np.zeros(n, np.int64),
        length * 16 + (15 * distinct / np.maximum(1, words)).astype(np.int64),
        np.minimum(31, 100 * symbols // size), np.minimum(31, 40 * capitals // np.maximum(1, letters)), np.minimum(31, 100 * digits // size),
        np.minimum(31, np.bincount(row, ends - starts, n).astype(np.int64) // np.maximum(1, words)),
        np.minimum(31, 200 * lines // size),
    ]
    rows = np.arange(n, dtype=np.uint64) << shift
    every = _distinct(np.concatenate([both, *(rows | (mix64((b + 1000 * (i + 1)).astype(np.uint64)) & mask) for i, b in enumerate(bins))]))
    return (every & mask).astype(np.int64), np.searchsorted(every, rows)


def minimise(evaluate, x: np.ndarray, rounds: int, memory: int = 12) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search; `evaluate` returns (value, gradient)."""
    value, gradient = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, alphas = gradient.copy(), []
        for s, y, r in reversed(steps):
            alphas.append(r * s.dot(direction))
            direction -= alphas[-1] * y
        if steps:
            s, y, r = steps[-1]
            direction /= r * y.dot(y)
        for (s, y, r), a in zip(steps, reversed(alphas)):
            direction += (a - r * y.dot(direction)) * s
        slope, rate = gradient.dot(direction), 1.0 if steps else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        if slope <= 1e-12:
            break
        for _ in range(25):
            ahead = x - rate * direction
            new, new_gradient = evaluate(ahead)
            if new <= value - 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, y = ahead - x, new_gradient - gradient
        if (curve := s.dot(y)) > 1e-14:
            steps = [*steps[-memory + 1 :], (s, y, 1 / curve)]
        done = value - new < 1e-7 * max(1.0, abs(value))
        x, value, gradient = ahead, new, new_gradient
        if done:
            break
    return x


def evidence(have: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many standard errors apart a place's share of rows is, from have[grade, place] rows that have it and count[grade] rows.

    The largest over all thresholds and over each grade against the rest: a middle grade's words would be diluted by the
    grades on their side of a threshold.
    """
    n, out, grades = count.sum(), np.zeros(have.shape[1]), np.arange(len(count))
    rate = (have.sum(axis=0) + 0.5) / (n + 1)
    for side in [grades >= k for k in grades[1:]] + [grades == k for k in grades]:
        inside, outside = count[side].sum(), count[~side].sum()
        if inside and outside:
            apart = have[side].sum(axis=0) / inside - have[~side].sum(axis=0) / outside
            np.maximum(out, np.abs(apart) / np.sqrt(rate * (1 - rate) * (1 / inside + 1 / outside)), out=out)
    return out


def telling_places(have: np.ndarray, count: np.ndarray, least_z: float = 4.0) -> np.ndarray:
    """Which places get a weight: those whose evidence is `least_z` standard errors, however rare they are.

    The thousands of words that have nothing to do with the grade would otherwise be fitted to the sample's accidents.
    """
    return evidence(have, count) >= least_z


def fit_arrays(grades: np.ndarray, places: np.ndarray, first: np.ndarray, bits: int = BITS, top: int = TOP_GRADE, rounds: int = 120, decay: float = DECAY, telling: np.ndarray | None = None, proof: np.ndarray | None = None) -> Model:
    """Minimises the mean cumulative-link loss, each grade weighing alike, plus decay / 2 * |weights|**2; deterministic.

    telling: the places that get a weight; by default as `telling_places` says for these rows. proof: the evidence of all
    places; the decay of a place below SURE standard errors grows by the eighth power of what it lacks, so that words near
    the bar, some of them accidents, have a say but a small one.
    """
    n = len(grades)
    model = Model(np.zeros(1 << bits), np.arange(top, dtype=float) - (top - 1) / 2, bits, n)
    if not n:
        model.thresholds -= 4.0  # nothing is known: everything is kept
        return model
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.append(first, len(places))))
    count = np.bincount(grades, minlength=top + 1)
    if telling is None:
        have = np.stack([np.bincount(places[grades[row] == k], minlength=1 << bits) for k in range(top + 1)]).astype(float)
        telling, proof = telling_places(have, count), evidence(have, count)
    keep, used = telling[places], np.flatnonzero(telling)
    column, lengths = (np.cumsum(telling, dtype=np.int32) - 1)[places[keep]], np.bincount(row[keep], minlength=n)
    return _solve(model, grades, column, lengths, used, decay * _caution(used, proof), rounds)


def _caution(used: np.ndarray, proof: np.ndarray | None) -> np.ndarray:
    """By how much the decay of each used place is raised."""
    return np.ones(len(used)) if proof is None else np.maximum(1, SURE / proof[used]) ** 8


def objective(grades: np.ndarray, column: np.ndarray, lengths: np.ndarray, size: int, top: int, decays: np.ndarray):
    """The loss and its gradient as a function of (weights, first threshold, logarithms of the gaps between thresholds)."""
    n = len(grades)
    count, ends = np.bincount(grades, minlength=top + 1), np.concatenate(([0], np.cumsum(lengths)))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), n))
    pieces = [(a, b, slice(ends[a], ends[b])) for a, b in zip(np.append(0, cuts), cuts) if a < b]  # no step needs an array of all entries
    weight = 1.0 / count[grades] / (count > 0).sum()

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, thresholds = x[:size], thresholds_of(x[size:])
        scores = np.concatenate([np.bincount(np.repeat(np.arange(b - a), lengths[a:b]), weights[column[p]], b - a) for a, b, p in pieces])
        tail = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds[None, :], -40, 40)))
        full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        at, over = full[np.arange(n), grades], full[np.arange(n), grades + 1]
        gap = np.maximum(at - over, 1e-12)
        # a grade's chance is a difference of two tails; its log's slope by the score is 1 - at - over
        by_score = weight * (1 - at - over)
        slope = tail * (1 - tail) / gap[:, None]
        by_threshold = np.array([(weight * (np.where(grades == k, slope[:, k], 0.0) - np.where(grades == k + 1, slope[:, k], 0.0))).sum() for k in range(top)])
        by_gap = [by_threshold[k:].sum() * (thresholds[k] - thresholds[k - 1]) for k in range(1, top)]
        gradient = -np.concatenate((sum((np.bincount(column[p], np.repeat(by_score[a:b], lengths[a:b]), size) for a, b, p in pieces), np.zeros(size)), [by_threshold.sum()], by_gap))
        gradient[:size] += decays * weights
        return float(-(weight * np.log(gap)).sum() + (decays * weights).dot(weights) / 2), gradient

    return evaluate


def thresholds_of(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((x[:1], np.exp(np.clip(x[1:], -8, 8)))))


def _solve(model: Model, grades: np.ndarray, column: np.ndarray, lengths: np.ndarray, used: np.ndarray, decays: np.ndarray, rounds: int = 120) -> Model:
    """Fits the model's weights at `used`; a row has `lengths` entries of column, which are positions in used."""
    size, top = len(used), len(model.thresholds)
    evaluate = objective(grades, column, lengths, size, top, decays)
    x = minimise(evaluate, np.concatenate((np.zeros(size), [-0.5], np.zeros(top - 1))), rounds)
    model.weights[used] = x[:size]
    model.thresholds = thresholds_of(x[size:])
    model.loss = evaluate(x)[0]
    return model


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a labels table with quality and toxic."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS, top: int = TOP_GRADE) -> Model:
    """Fits on at most `sample` rows: one for each of the ids of grades(doc_id, grade) whose hashes are smallest.

    Those rows are written once; two passes over them follow: the first counts places by grade on the executors, the second
    sends the driver only the telling places of each row, some hundreds. Texts never reach the driver.
    """
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    met = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    labelled = cut(met.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    counts = pa.schema([("grade", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])

    def count(batches):
        have, rows_of = np.zeros((top + 1, 1 << bits), np.int64), np.zeros(top + 1, np.int64)
        for rows, data, offsets in blocks(batches, "text"):
            places, first = features(data, offsets, bits)
            grade = rows.column(1).to_numpy().astype(np.int64)
            rows_of += np.bincount(grade, minlength=top + 1)
            np.add.at(have, (np.repeat(grade, np.diff(np.append(first, len(places)))), places), 1)
        at = np.nonzero(have)
        yield record(counts, np.append(at[0], np.arange(top + 1)).astype(np.int32), np.append(at[1], np.full(top + 1, -1)).astype(np.int32), np.append(have[at], rows_of))

    got = map_arrow(labelled, count, "grade int, place int, n long").groupBy("grade", "place").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    grade, place, n = (got[c].to_numpy() for c in ("grade", "place", "n"))
    have, rows_of, real = np.zeros((top + 1, 1 << bits)), np.zeros(top + 1, np.int64), place >= 0
    have[grade[real], place[real]] = n[real]
    rows_of[grade[~real]] = n[~real]
    telling, proof = telling_places(have, rows_of), evidence(have, rows_of)
    used, kind = np.flatnonzero(telling), "<u2" if telling.sum() < 65536 else "<u4"
    held = docs.sparkSession.sparkContext.broadcast(np.where(telling, np.cumsum(telling) - 1, -1).astype(np.int32))
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("places", pa.binary())])

    def pick(batches):
        for rows, data, offsets in blocks(batches, "text"):
            places, first = features(data, offsets, bits)
            packed = [p[p >= 0].astype(kind).tobytes() for p in np.split(held.value[places], first[1:])]
            yield record(schema, rows.column(0), rows.column(1).cast(pa.int32()), packed)

    got = map_arrow(labelled, pick, "doc_id long, grade int, places binary").toArrow()
    if not got.num_rows:
        return fit_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), bits, top)
    rows = sorted(zip(*(got[c].to_pylist() for c in ("doc_id", "grade", "places"))))
    del got
    grades_of, lengths = np.array([g for _, g, _ in rows], np.int64), np.array([len(p) for _, _, p in rows], np.int64) // int(kind[-1])
    column = np.frombuffer(b"".join(p for _, _, p in rows), kind)
    del rows
    model = Model(np.zeros(1 << bits), np.arange(top, dtype=float) - (top - 1) / 2, bits, len(grades_of))
    return _solve(model, grades_of, column, lengths, used, DECAY * _caution(used, proof))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        weights, thresholds, bits = held.value
        judge = Model(weights, thresholds, bits)
        for rows, data, offsets in blocks(batches, "text"):
            places, first = features(data, offsets, bits)
            tails = judge.tails(np.add.reduceat(weights[places].astype(np.float64), first))
            yield record(schema, rows.column(0), tails.sum(axis=1).round(6), tails[:, -1].round(6), tails[:, -1] >= least_tail)

    return map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def select(docs: DataFrame, model: Model, text_col: str = "text", least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of docs, all columns unchanged, whose chance of the top grade is at least `least_tail`."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        weights, thresholds, bits = held.value
        judge = Model(weights, thresholds, bits)
        for rows, data, offsets in blocks(batches, f"c{at}"):
            places, first = features(data, offsets, bits)
            tails = judge.tails(np.add.reduceat(weights[places].astype(np.float64), first))
            yield pa.RecordBatch.from_arrays(rows.columns, names=names).filter(pa.array(tails[:, -1] >= least_tail))

    return map_arrow(docs.toDF(*[f"c{i}" for i in range(len(names))]), run, docs.schema)

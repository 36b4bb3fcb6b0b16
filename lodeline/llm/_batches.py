"""Shared plumbing of the training-data operators: Arrow batches as flat byte buffers, vectorised words and hashes.

Texts reach Python as Arrow columns. `blocks` cuts a batch into pieces of a few megabytes so that the numpy
temporaries stay bounded however long a partition is; a text longer than the budget makes a piece of its own and is
still processed whole. A null text counts as an empty one in every operator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline import on_workers

#: The ASCII white space that separates words, [\x20\x09-\x0D].
ASCII_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: The low 0 to 8 bytes of a 64-bit word.
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def lower_ascii(data: bytes) -> bytes:
    """Lower-cases A-Z only."""
    return data.translate(_LOWER)


def blocks(batches: Iterable[pa.RecordBatch], text: str, budget: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for consecutive rows of at most `budget` bytes of text, or one longer text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        _, at, body = column.buffers()
        offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
            last = min(last, n)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def texts(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, texts as UTF-8 bytes) in bounded pieces; null is b""."""
    for rows, data, offsets in blocks(batches, text):
        whole, ends = data.tobytes(), offsets.tolist()
        yield rows, [whole[a:b] for a, b in zip(ends, ends[1:])]


def map_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, so that a function of this package reads at call sites like any other transformation."""
    on_workers(df.sparkSession)
    return df.mapInArrow(make, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of all rows in a flat buffer, and the row of each; no word crosses a row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    start[edges] |= inside[edges]
    end[edges - 1] |= inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


class Seen:
    """Remembers 64-bit keys in a table of fixed size: what it calls seen was seen, what it forgot counts as new."""

    def __init__(self, bits: int = 18):
        self.table, self.filled, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, bool), np.uint64((1 << bits) - 1)

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Which of these different keys are new; they are remembered."""
        keys = keys.view(np.uint64)
        at = (mix64(keys) & self.mask).astype(np.int64)
        out = ~self.filled[at] | (self.table[at] != keys)
        self.table[at], self.filled[at] = keys, True
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: np.uint64 = _STEP) -> np.ndarray:
    """64-bit hashes of spans of a buffer, mixing eight bytes at a time; spans that reach further take further rounds.

    Another odd `step` gives another hash function.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = ((words[starts] & _HEAD[np.minimum(size, 8)]) ^ size.astype(np.uint64)) * step
    out ^= out >> np.uint64(32)
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        h = (out[more] ^ (words[starts[more] + k] & _HEAD[np.minimum(size[more] - k, 8)])) * step
        out[more] = h ^ (h >> np.uint64(29))
        k += 8
        more = more[size[more] > k]
    return mix64(out)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint in the folder that spark.checkpoint.dir names.

    Only where that setting is absent (tests, a laptop) a folder below the warehouse is used. The shuffle files of the plan
    that is cut are of no use any more: Spark's own setting deletes them when the checkpoint is written.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        _own_checkpoints(spark)
    before = spark.conf.get(_FREE)
    spark.conf.set(_FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(_FREE, before)


def _own_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lodeline-checkpoints")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **keys) -> DataFrame:
    """One struct column `row` with all columns of docs, and the given key columns: no name of docs can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def ascending(column: str):
    """Order by UTF-8 bytes, that is by code point, null last."""
    return F.col(column).asc_nulls_last()

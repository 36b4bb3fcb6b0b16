"""Quality rules by compression bands.

A text's zstandard ratio (bytes over compressed bytes) is taken over the whole document and over fixed chunks, of which the
last may be shorter. Repetitive text compresses too well, noise too badly. What is normal depends on length, since a
compressor learns as it goes, so each length class has limits of its own; a shorter last chunk has those of texts of its
length. A text is rejected if its whole ratio leaves its band or if more than `CHUNK_SHARE` of its chunks leave theirs.

Nulls and edges: a null text has no words, so it fails the base rule; an empty text has ratio 1 and no chunks; texts of any
length are read whole; repeated rows and any id stay as they are, columns besides id and text are not looked at, an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import ASCII_SPACE, blocks, map_arrow, mix64, record, span_hashes, word_spans

#: (bytes below, least ratio, largest ratio) of whole documents. Prose of the labelled rows lies well inside.
BANDS = ((128, 0.0, 1.5), (256, 0.6, 2.15), (512, 1.0, 2.15), (1024, 1.2, 2.25), (4096, 1.35, 2.45), (16384, 1.4, 2.7), (1 << 62, 1.4, 3.0))
#: Bytes of a chunk, its band, and the share of chunks that may leave it.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (1.3, 2.9), 0.2
#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_window_words(hashes: np.ndarray, width: int = 3) -> int:
    """Words that lie in a window of `width` words that occurs at least twice, the first occurrence included."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = mix64(window * np.uint64(31) + hashes[k : k + n])
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    words = np.zeros(len(hashes), bool)
    for k in range(width):
        words[k : k + n] |= twice
    return int(words.sum())


class Bands:
    """Compression verdicts under (bytes below, least, largest) bands."""

    def __init__(self, bands=BANDS, chunk=CHUNK, chunk_band=CHUNK_BAND, chunk_share=CHUNK_SHARE, level: int = 3):
        self.bands, self.chunk, self.chunk_band, self.chunk_share = bands, chunk, chunk_band, chunk_share
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def ratio(self, text: bytes) -> float:
        return len(text) / len(self.compress(text)) if text else 1.0

    def inside(self, text: bytes) -> tuple[float, bool]:
        """The ratio of a text and whether it lies in the band of its length."""
        ratio = self.ratio(text)
        least, most = next((lo, hi) for below, lo, hi in self.bands if len(text) < below)
        return ratio, least <= ratio <= most

    def verdict(self, text: bytes) -> tuple[float, int, int, bool]:
        """(whole ratio, chunks, chunks outside their band, within limits)."""
        whole, fine = self.inside(text)
        if len(text) <= self.chunk:  # the text is its only chunk
            return whole, int(bool(text)), int(bool(text) and not fine), fine
        full = len(text) // self.chunk * self.chunk
        bad = sum(not self.chunk_band[0] <= self.ratio(text[i : i + self.chunk]) <= self.chunk_band[1] for i in range(0, full, self.chunk))
        if full < len(text):
            bad += not self.inside(text[full:])[1]
        chunks = -(-len(text) // self.chunk)
        return whole, chunks, bad, fine and bad <= self.chunk_share * chunks


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row for every document: base counts, the base rule, the compression figures and the verdict `kept`."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])
    limits = dict(bands=(bands or Bands()).bands) if bands is None else {k: getattr(bands, k) for k in ("bands", "chunk", "chunk_band", "chunk_share")}

    def run(batches):
        judge = Bands(**limits)
        for rows, data, offsets in blocks(batches, "text"):
            starts, ends, row = word_spans(data, offsets)
            hashes = span_hashes(data, starts, ends)
            first = np.searchsorted(row, np.arange(rows.num_rows + 1))
            whole, out = data.tobytes(), {n: [] for n in names[1:]}
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = whole[a:b]
                n = int(first[i + 1] - first[i])
                lines = [x for x in text.split(b"\n") if x.strip()]
                repeat = repeated_window_words(hashes[first[i] : first[i + 1]])
                failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                ratio, chunks, bad, fine = judge.verdict(text)
                characters = len(text.decode()) - sum(text.count(c) for c in ASCII_SPACE)
                for key, value in zip(out, (n, characters, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat, failed, not failed and fine, ratio, chunks, bad)):
                    out[key].append(value)
            yield record(schema, rows.column(0), *out.values())

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)

"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts every text into chunks that recur wherever the same passage recurs, in whatever document. A chunk is
encoded by itself, once for each Python worker, and looked up afterwards (a table of bounded size). What a chunk's encoding
says near its ends is wrong where a piece goes on in the next chunk, so chunk joins are repaired: a window from a place in
the chunk before to a place in the chunk after is encoded anew, and holds if it begins with the identifiers that the left
encoding has there and ends with those of the right one; else it widens, to the right over further places and whole chunks,
to the left over what was settled before, and is encoded again until both sides agree exactly. Windows begin and end only at
places before a blank and after an ASCII character that is not white space, where the pre-tokeniser must split and what
stands beyond has no say; so where both sides agree, the joined identifiers are those of the whole text.

Identifiers are the ones the tokenizers library gives for the byte-level BPE file; the ranks come from the same
vocabulary's .tiktoken file, and tests hold both against that library. The file's special string is one identifier
wherever it stands in a text.

Nulls and edges: a null text is an empty one (no identifiers); texts without any blank become one window; windows over
`LONG` bytes (a text may be millions of blanks, or of one letter) are cut into pieces here, as the library's matcher
overflows its stack on them, and long pieces are merged in n log n. Repeated rows stay, columns besides id and text are not
looked at, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import blocks, map_arrow, record
from lodeline.llm.chunking import boundaries
from lodeline.llm.token_counts import PIECES

#: The vocabulary's special string and its identifier.
SPECIAL, SPECIAL_ID = b"<|endoftext|>", 50256
DEFAULT_RANKS = "byte_bpe_50k.tiktoken"


#: Bytes of a text that is encoded without being cut into pieces first.
LONG = 4096


class Encoded(NamedTuple):
    """A chunk and its own identifiers (as little-endian unsigned 32-bit integers) between its first two places a and b, from
    b to y, and between its last two places y and z."""

    text: bytes
    a: int
    b: int
    y: int
    first: bytes
    middle: bytes
    last: bytes


def _places(chunk: bytes) -> tuple[int, int, int, int] | None:
    """The first two and the last two places of a chunk, a < b <= y < z; None if it has less than three."""
    if (a := _next(chunk, 1)) < 0 or (b := _next(chunk, a + 1)) < 0:
        return None
    ends = []
    at = len(chunk)
    while len(ends) < 2:
        at = chunk.rfind(b" ", 0, at)
        if at <= a:
            return None
        if 0x21 <= chunk[at - 1] <= 0x7E:
            ends.append(at)
    return a, b, ends[1], ends[0]


def _next(chunk: bytes, start: int) -> int:
    """The first place from `start` on: a blank after an ASCII character that is not white space; -1 if there is none."""
    at = chunk.find(b" ", max(1, start))
    while at >= 0 and not 0x21 <= chunk[at - 1] <= 0x7E:
        at = chunk.find(b" ", at + 1)
    return at


class Codec:
    def __init__(self, path: str | None = None, average: int = 256, longest: int = 2048, cache_bytes: int = 48 << 20):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(DEFAULT_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL.decode(): SPECIAL_ID})
        self.average, self.longest, self.limit = average, longest, cache_bytes
        self.chunks: dict[bytes, Encoded | None] = {}
        self.windows: dict[bytes, bytes] = {}
        self.held = 0
        self.encoded = self.reused = self.joined = self.widened = 0

    def _plain(self, text: bytes) -> bytes:
        if len(text) <= LONG:
            return np.array(self.model.encode_ordinary(text.decode()), "<u4").tobytes()
        out = []
        for m in regex.finditer(PIECES, text.decode()):
            piece = m[0].encode()
            out.append(self._window(piece) if len(piece) <= 48 else np.array(self.model._encode_single_piece(piece), "<u4").tobytes())
        return b"".join(out)

    def _window(self, text: bytes) -> bytes:
        if len(text) > 48:
            return self._plain(text)
        ids = self.windows.get(text)
        if ids is None:
            if len(self.windows) > 100_000:
                self.windows.clear()
            ids = self.windows[text] = self._plain(text)
        return ids

    def _chunk(self, chunk: bytes) -> Encoded | None:
        """The chunk encoded by itself; None if it has less than three places, as then windows go over it."""
        got = self.chunks.get(chunk, False)
        if got is not False:
            self.reused += 1
            return got
        self.encoded += 1
        at, got = _places(chunk), None
        if at is not None:
            a, b, y, z = at
            got = Encoded(chunk, a, b, y, self._window(chunk[a:b]), self._plain(chunk[b:y]) if y > b else b"", self._window(chunk[y:z]))
        if self.held > self.limit:
            self.chunks.clear()
            self.held = 0
        self.chunks[chunk] = got
        self.held += len(chunk) + 400 + (len(got.middle) if got else 0)
        return got

    def join(self, chunks: list[bytes]) -> bytes:
        """Identifiers of the concatenated chunks."""
        done: list[tuple[bytes, bytes]] = []  # settled stretches and their identifiers
        open_: list[bytes] = []  # the text of the window to come, as far as the next chunk
        known = b""  # what its identifiers must begin with; at a text's start nothing
        for chunk in chunks:
            c = self._chunk(chunk)
            at, known = self._repair(done, open_, known, c) if c else (-1, known)
            if at < 0:
                open_.append(chunk)
            elif at > c.y:
                open_[:], known = [chunk[at:]], b""
            else:
                if at < c.y:
                    done.append((chunk[at : c.y], c.middle if at == c.b else self._plain(chunk[at : c.y])))
                open_[:], known = [chunk[c.y :]], c.last
        if open_:
            self._repair(done, open_, known, None)
        return b"".join([ids for _, ids in done])

    def _repair(self, done: list[tuple[bytes, bytes]], open_: list[bytes], known: bytes, c: Encoded | None) -> tuple[int, bytes]:
        """Settles the window from open_ into chunk c (None: to the text's end), widening it until both sides agree.

        Returns where in c it ends (-1: the window must go over all of c) and what it must still begin with.
        """
        self.joined += 1
        left = b"".join(open_)
        begin, end, right = (c.a, c.b, c.first) if c else (0, 0, b"")
        while True:
            window = left + c.text[:end] if c else left
            ids = self._window(window)
            if not ids.startswith(known):
                self.widened += 1
                before, known = done.pop() if done else (b"", b"")
                left, known = before + left, known[:4]
            elif ids.endswith(right):
                done.append((window, ids))
                return end, b""
            else:
                self.widened += 1
                begin, end = end, _next(c.text, end + 1)
                if end < 0:
                    open_[:] = [left]
                    return -1, known
                right = self._window(c.text[begin:end])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        whole, ends = data.tobytes(), boundaries(data, offsets, self.average, self.longest, characters=True).tolist()
        out, i, n = [], 0, len(ends)
        for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            at, chunks = start, []
            while i < n and ends[i] <= stop:
                chunks.append(whole[at : ends[i]])
                at = ends[i]
                i += 1
            if whole.find(SPECIAL, start, stop) >= 0:
                parts = whole[start:stop].split(SPECIAL)
                out.append(np.array([SPECIAL_ID], "<u4").tobytes().join(self.join(self.cut(p)) for p in parts))
            else:
                out.append(self.join(chunks))
        return out

    def cut(self, text: bytes) -> list[bytes]:
        ends = boundaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]), self.average, self.longest, characters=True).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return np.frombuffer(self.encode_all(data, np.array([0, len(data)]))[0], "<u4").tolist()

    def decode(self, ids: bytes) -> bytes:
        return self.model.decode_bytes(np.frombuffer(ids, "<u4").tolist()).decode(errors="replace").encode()


@lru_cache(2)
def codec(path: str | None = None) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row; `ranks` is the path of the vocabulary's .tiktoken file."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        c = codec(ranks)
        for rows, data, offsets in blocks(batches, "text"):
            packed = c.encode_all(data, offsets)
            ends = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield record(schema, rows.column(0), pa.ListArray.from_arrays(pa.array(ends), flat))

    return map_arrow(_source(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the identifiers and of the text decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = codec(ranks)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for rows, data, offsets in blocks(batches, "text"):
            packed = c.encode_all(data, offsets)
            yield record(schema, rows.column(0), [len(p) // 4 for p in packed], [sha(p) for p in packed], [sha(c.decode(p)) for p in packed])

    return map_arrow(_source(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

The pre-tokeniser of a byte-level BPE file cuts a text into pieces. A piece starts as a linked list of byte symbols; a
heap holds every adjacent pair that has a merge rank; the lowest rank (leftmost first) is popped and merged until no pair
is left. The count is the initial symbols minus the merges. Counts of pieces are kept in a table of bounded size for each
Python worker, so a common word is merged once.

Nulls and edges: a null text counts as empty (0 bytes, 0 tokens); a piece of any length costs n log n; the special
strings of the file that stand in a text are one token each, as the library's default has it.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import map_arrow, record, texts

#: Fixed value: the pre-tokeniser's pattern, with white space as Unicode's White_Space property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Counts the tokens of texts under one byte-level BPE file."""

    def __init__(self, path: str, cache: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser or prefix space is asked for")
        symbol: dict[str, int] = byte_alphabet()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pair: list[int] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            key = symbol[left] << 32 | symbol[right]
            self.rank[key] = r
            self.made.append(symbol.setdefault(left + right, 256 + r))
            self.pair.append(key)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_heads = special
        self.findall = regex.compile(PIECES).findall
        merger, limit = self, cache

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= limit:
                    self.clear()
                n = merger.piece(piece.encode())
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self.counts = Counts()

    def piece(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        rank, symbols = self.rank, list(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            r, i = pop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[i] << 32 | symbols[j] != self.pair[r]:
                continue  # one of its symbols has been merged since
            symbols[i], symbols[j] = self.made[r], -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (q := rank.get(symbols[i] << 32 | symbols[k])) is not None:
                    push(heap, (q, i))
            h = before[i]
            if h >= 0 and (q := rank.get(symbols[h] << 32 | symbols[i])) is not None:
                push(heap, (q, h))
        return n - merges

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.special_heads):
            return sum(map(self.counts.__getitem__, self.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.findall(p))) for p in parts)


@lru_cache(2)
def merger(path: str | None) -> Merger:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)
    return Merger(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; `vocabulary` is the path of a byte-level BPE .json file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        bpe = merger(vocabulary)
        for rows, bodies in texts(batches, "text"):
            tokens = [bpe.count(b.decode()) for b in bodies]
            yield record(schema, rows.column(0), [len(b) for b in bodies], tokens, [t > limit for t in tokens])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(source, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

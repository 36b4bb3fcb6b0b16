"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification, components.

Every text gets a 64-bit fingerprint (one vote per 3-word shingle). Fingerprints are embedded by the popcounts of their
32 two-bit segments. One differing bit moves one coordinate by at most one, so the Manhattan distance of two embeddings
is a lower bound of the Hamming distance of the fingerprints. The popcounts are held in thermometer code (0: 00, 1: 01,
2: 11), in which that Manhattan distance is the bit count of an XOR.

The range-join lays the embedded points on projected grids. The segments form `GROUPS` groups; at Manhattan distance
<= `distance` at least GROUPS - distance groups agree in every coordinate, so two close points share a cell in the grid
over those groups. Candidates meet in a cell, are kept where the lower bound allows, then verified on the fingerprints,
all inside the join condition: a pair leaves the join once (from the first grid that holds it) and only if it is a link.

Only different fingerprints are joined, copies are never paired. Their number of links is bounded: a fingerprint has at most
43744 others within three bits, however many documents there are, and at most 128 lie within three bits of each other.

Nulls and edges: a null text is an empty one, whose fingerprint is zero and is linked like any other; a null id keeps its
row (it joins the component of its fingerprint, and is never the smallest id unless all are null); repeated rows stay in
`near_duplicates`, and `keep_one` keeps one of them; columns besides id and text, whatever their names, pass through
`keep_one`; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm._batches import cut, lower_ascii, map_arrow, packed, record, texts
from lodeline.llm.components import connected_components

#: Fixed values of the fingerprint: shingle width and hash seed.
WIDTH, SEED = 3, 42
GROUPS, DISTANCE = 8, 3

_LANES = np.zeros(256, np.uint64)
for _bit in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of one text; zero without words."""
    words = lower_ascii(text).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    lanes = _LANES[hashes.view(np.uint8).reshape(-1, 8)]
    for i in range(0, len(lanes), 255):  # a lane counts to 255
        votes += lanes[i : i + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])
    for rows, bodies in texts(batches, "text"):
        seen: dict[bytes, int] = {}
        values = []
        for body in bodies:
            value = seen.get(body)
            if value is None:
                value = seen[body] = fingerprint(body)
            values.append(value)
        yield record(schema, rows.column(0), rows.column(1), np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, fp): the text's hash and a signed 64-bit fingerprint for every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return map_arrow(source, _fingerprints, "doc_id long, th long, fp long")


def embed(fp: Column) -> Column:
    """Thermometer code of the popcounts of the 32 two-bit segments."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(high).bitwiseAND(odd), fp.bitwiseAND(high).bitwiseAND(odd)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _masks(groups: int) -> list[int]:
    width = 64 // groups
    return [((1 << width) - 1) << (width * g) for g in range(groups)]


def links(points: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints of `points(fp)` that differ at 1 to `distance` bits, each pair once."""
    if not 0 < distance < groups or 64 % groups or (64 // groups) % 2:
        raise ValueError("0 < distance < groups, and a group holds whole two-bit segments")
    masks, keep = _masks(groups), groups - distance
    grids = list(combinations(range(groups), keep))
    number = {g: i for i, g in enumerate(grids)}
    cells = F.array(*[F.struct(F.lit(i).cast("short").alias("grid"), F.col("e").bitwiseAND(F.lit(_signed(sum(masks[g] for g in grid)))).alias("cell")) for i, grid in enumerate(grids)])
    # dealt anew, as few tasks may hold the points and each gives a row a grid
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = dealt.select("fp", embed(F.col("fp")).alias("e")).select("fp", F.explode(cells).alias("c")).select("fp", "c.grid", "c.cell")
    # for each set of agreeing groups (as bits) the grid that reports the pair: the one over the first agreeing groups
    first = [-1] * (1 << groups)
    for bits in range(1 << groups):
        agree = [g for g in range(groups) if bits >> g & 1]
        if len(agree) >= keep:
            first[bits] = number[tuple(agree[:keep])]
    # the hint: before the grids are laid out Spark takes a side for as small as the points, and would broadcast all its rows
    a, b = placed.alias("a"), placed.hint("merge").alias("b")
    apart = embed(F.col("a.fp")).bitwiseXOR(embed(F.col("b.fp")))
    agree = sum((F.when(apart.bitwiseAND(F.lit(_signed(m))) == 0, 1 << g).otherwise(0) for g, m in enumerate(masks)), F.lit(0))
    return a.join(
        b,
        (F.col("a.grid") == F.col("b.grid"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(apart) <= distance)
        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
        & (F.element_at(F.array(*[F.lit(x) for x in first]), agree + 1) == F.col("a.grid")),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, th, fp, component, component_id): component is the smallest fingerprint that chains of links reach from each
    row, component_id the smallest id among its rows."""
    marked = cut(fingerprints(docs, id_col, text_col))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = cut(links(classes.select("fp"), distance))
    member = connected_components(pairs)
    named = classes.join(member, classes.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = cut(named.join(smallest, "component").select(F.col("fp").alias("of"), "component", "component_id"))
    return marked.join(by_fp, marked.fp == by_fp.of).select("doc_id", "th", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs with one document of each component, the one with the smallest id (null last); columns unchanged."""
    last, text = F.lit(2**63 - 1), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    best = near_duplicates(docs, id_col, text_col, distance).groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "th")).alias("k"))
    kept = best.select(F.col("k.id").alias("of"), F.col("k.th").alias("of_th"))
    keyed = packed(docs, id=F.coalesce(F.col(f"`{id_col}`").cast("long"), last), th=F.xxhash64(text))
    joined = keyed.join(kept, (F.col("id") == F.col("of")) & (F.col("th") == F.col("of_th")))
    return joined.withColumn("nth", F.row_number().over(W.partitionBy("id", "th").orderBy("of"))).where("nth = 1").select("row.*")

"""Filter interaction audit: every order of a set of filters, visited by swaps of neighbours over the cells of failure masks.

A document's failures are a bit mask, one bit a filter. All that any order of filters can say follows from the number of
documents a mask (a cell), so documents are read once and counted into cells; what an order removes at a step is then a
difference of two entries of the table `alive`: documents that fail none of a set of filters. The orders are visited so
that each differs from the one before by one swap of neighbours (`swaps`): the swap leaves all other steps as they were, so
only the two affected steps are computed anew, and each filter's Shapley sum grows along the walk.

Equal texts (the last filter) meet by their SHA-256 as counts: a digest's rows are pre-aggregated by (part, mask, labels), with
the smallest id and the rows that carry it, so no copy travels alone and no group of copies lies in one task.

Nulls and edges: a null text is an empty one; a null part is the empty string; a null id comes after all others, has no labels
and so fails the copy filter wherever any id has its text; rows that repeat id and text are documents of their own, neither
a copy of the other; several label rows of an id count once, a null label is none; columns besides those named are not read,
whatever their names; no documents: no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm._batches import map_arrow

_SPACE = r"[\x20\x09-\x0D]+"
#: The letter of the filter that looks at the whole table; it has the highest bit.
COPIES = "E"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The production filters of one text: letter to failure condition; `words` is the array of its words."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def swaps(n: int) -> Iterator[int]:
    """Places i whose items i and i + 1 change places, so that each order of n items comes up once."""
    order, step = list(range(n)), [-1] * n
    while True:
        movable = [x for at, x in enumerate(order) if 0 <= at + step[x] < n and order[at + step[x]] < x]
        if not movable:
            return
        x = max(movable)
        at = order.index(x)
        to = at + step[x]
        order[at], order[to] = order[to], order[at]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield min(at, to)


def alive(cells: dict[int, tuple[int, ...]], n: int, width: int) -> list[tuple[int, ...]]:
    """For each set of filters the sums over the documents that fail none of them; cells: failure mask to counts."""
    full = (1 << n) - 1
    within = [list(cells.get(mask, (0,) * width)) for mask in range(1 << n)]
    for bit in range(n):
        for mask in range(1 << n):
            if mask >> bit & 1:
                within[mask] = [a + b for a, b in zip(within[mask], within[mask ^ (1 << bit)])]
    return [tuple(within[full ^ chosen]) for chosen in range(1 << n)]


def walk(cells: dict[int, tuple[int, int, int]], letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders and steps.

    cells: failure mask (bit k: letters[k] fails) to (documents, good ones, toxic ones).
    """
    n = len(letters)
    left = alive(cells, n, 3)
    fails = [left[0][0] - left[1 << f][0] for f in range(n)]
    alone = [cells.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    order, before = list(range(n)), [0] * (n + 1)
    for k in range(n):
        before[k + 1] = before[k] | 1 << order[k]
    lost = [tuple(a - b for a, b in zip(left[before[k]], left[before[k + 1]])) for k in range(n)]
    shapley, visited = [0] * n, []

    def visit():
        for k, f in enumerate(order):
            shapley[f] += lost[k][0]
        visited.append((tuple(order), tuple(left[b][0] for b in before[1:]), tuple(lost)))

    visit()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before[i + 1] = before[i] | 1 << order[i]
        for k in (i, i + 1):
            lost[k] = tuple(a - b for a, b in zip(left[before[k]], left[before[k + 1]]))
        visit()
    for order, kept, lost in visited:
        name = "".join(letters[f] for f in order)
        for k, f in enumerate(order):
            yield name, k + 1, kept[k], lost[k][0], fails[f] - lost[k][0], alone[f], lost[k][1], lost[k][2], shapley[f]


_KINDS = [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())] + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by their failures (bit k: the k-th filter) and labels."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = read.select("id", "part", "text", F.array_remove(F.split("text", _SPACE), "").alias("words"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_filters(F.col("text"), F.col("words")).values())), F.lit(0))
    judged = split.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    mark = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    off = F.lit(False)
    marked = judged.join(labelled, judged.id == labelled.of, "left").select(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "part", "digest", "mask", F.coalesce("good", off).alias("good"), F.coalesce("toxic", off).alias("toxic"))
    kind = ["part", "mask", "good", "toxic"]
    rows = marked.groupBy("id", "digest", *kind).agg(F.count("*").alias("n"))
    kinds = rows.groupBy("digest", *kind).agg(F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum("n").alias("n"))
    first = F.when(F.col("least") == F.min("least").over(W.partitionBy("digest")), F.col("at_least")).otherwise(0)
    counted = kinds.withColumn("first", first).groupBy(*kind).agg(F.sum("first").alias("first"), F.sum("n").alias("n"))
    bit = 1 << len(text_filters(F.col("text"), F.col("words")))
    both = F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n")))
    return counted.select("part", "good", "toxic", F.inline(both)).select("part", "mask", "good", "toxic", "n")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    letters, schema = "".join(text_filters(F.lit(""), F.split(F.lit(""), " "))) + COPIES, pa.schema(_KINDS)
    # one row a part, of at most 4 cells a mask
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    by_mask = cells(docs, labels, id_col, text_col, part_col).groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good").alias("good"), when("toxic").alias("toxic"))
    by_part = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for b in batches:
            for part, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [(part, *r) for r in walk({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in held}, letters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

    return map_arrow(by_part, run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")

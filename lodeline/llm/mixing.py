"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame and SQL functions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words of the corpus; a
source's target stops at `repeat` times its own words and the excess is shared again by weight until none is above (each
round is one aggregation of the sources, of which the driver sees three sums).

Schedule: 2**bits slots stand for equal stretches of the mix. Slot s has the van der Corput point of s (its bits reversed,
as a fraction), which the cumulative targets map to a source; the slots of a source are ranked in slot order. All 2**bits
points together are an even grid, so a source gets its share of slots to within one, and any run of slots holds each source
by its share. `bits` grows with the corpus, so that a slot is at most 2**SLOT_WORDS words.

Blocks: a source's documents are shuffled by a hash and laid end to end on a tape that repeats `repeat` times; block r of a
source is the r-th stretch of corpus words / 2**bits words (boundaries rounded down). Slot rank joins block number: a
document takes the words of the blocks it shares, and the first slot among them is its place in the mix. The blocks after a
source's last slot follow the schedule until the target is reached, and the block that holds the target's end is cut there:
a source takes its target to within a word, however few slots it has.

Hot sources: running sums go over (source, stretch of the hash) first and within a stretch after, so that a source that
holds a third of all rows is never one task; the order on the tape is that of the hashes, whatever the stretches. The
sources themselves are dealt by range and summed range by range, so that domains may be sources.

Nulls and edges: a null text has size 0 and takes 0 words; a null source is a source; an empty table gives no rows;
repeated rows are told apart by a running number within equal (id, text hash), so every row takes its own words; columns
besides id, text and source are not looked at by `mix` and pass through `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm._batches import ascending, cut, packed

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rounds of the tape; bits of the schedule at least; bits of the words of a slot at most; stretches of hashes at least.
REPEAT, BITS, SLOT_WORDS, STRETCHES = 3, 16, 24, 256


def size_of(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+ of a text; null: 0. A word is a place where a non-blank follows a blank or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _before(dealt: DataFrame, total: str) -> DataFrame:
    """dealt(part, ...) with `before`: the sum of `total` over all rows of lower parts."""
    sums = dealt.groupBy("part").agg(F.sum(total).alias("sum"))
    run = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    return dealt.join(F.broadcast(sums.select("part", F.coalesce(F.sum("sum").over(run), F.lit(0)).alias("before"))), "part")


def targets(sizes: DataFrame, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, weight, target, start, end, low, high, all_words) of sizes(source, source_size), a row a source.

    The source has the words from start to end (rounded) of the line of all targets, whose shares are low and high.
    """
    by_source = W.partitionBy("part").orderBy(ascending("source"))
    dealt = sizes.select("source", "source_size").repartitionByRange(max(1, _tasks(sizes) // 8), ascending("source")).withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1))
    nth = F.col("before") + F.row_number().over(by_source) - 1
    listed = _before(cut(dealt), "one").withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int")))
    listed = listed.select("part", "source", "source_size", "weight", (F.col("source_size") * repeat).alias("cap"))
    all_words, rest = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words, capped = all_words, -1
    while True:
        full = F.col("cap") * F.lit(rest) <= F.col("weight").cast("decimal(38,0)") * F.lit(words)
        n, held, weight = listed.where(full).agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == capped:
            break
        capped, words, rest = n, all_words - held, listed.where(~full).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        if not rest:
            break
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(words / rest)) if rest else F.col("cap").cast("double")
    aimed = listed.withColumn("target", target).withColumn("aim", F.round("target").cast("long"))
    within = F.sum("aim").over(by_source.rowsBetween(W.unboundedPreceding, 0))
    lined = _before(aimed, "aim").withColumn("end", F.col("before") + within).withColumn("start", F.col("end") - F.col("aim")).drop("part", "before")
    line = max(1, lined.agg(F.coalesce(F.max("end"), F.lit(1))).first()[0])
    return lined.select("source", "source_size", "weight", "target", "start", "end", (F.col("start") / line).alias("low"), (F.col("end") / line).alias("high"), F.lit(line).alias("line"), F.lit(all_words).cast("long").alias("all_words"))


def _points(aims: DataFrame, bits: int) -> DataFrame:
    """(source, first, end): the grid points inside a source's stretch of the target line, first included, end not."""
    up = lambda c: F.expr(f"(cast({c} as decimal(30,0)) * {1 << bits} + line - 1) div line")
    return aims.select("source", "target", "all_words", up("start").alias("first"), up("end").alias("end"))


def _slot(point: str, bits: int) -> Column:
    """The slot of a grid point: its bits reversed."""
    return F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("long")


def schedule(aims: DataFrame, bits: int = BITS) -> DataFrame:
    """(slot, source, rank): the source of every slot and the slot's rank among its source's, from 0.

    The points inside a source's stretch of the target line are grid points j / 2**bits; their slots are the reversed bits
    of j, so no join is needed to place them.
    """
    point = _points(aims, bits).where("end > first").select("source", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("point"))
    drawn = point.select(_slot("point", bits).alias("slot"), "source")
    return drawn.select("slot", "source", (F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1).cast("long").alias("rank"))


def _remainders(aims: DataFrame, bits: int) -> DataFrame:
    """(slot, source, rank): the blocks from a source's number of slots on, up to the one that holds its target's end.

    They go with the slots of the grid points from the one before the source's stretch on, which lie as evenly in the mix.
    """
    counted = _points(aims, bits).where("target > 0").withColumn("slots", F.greatest(F.lit(0), F.col("end") - F.col("first")))
    upto = F.floor(F.col("target") * float(1 << bits) / F.col("all_words")).cast("long") + 2
    ranks = counted.select("source", "first", "slots", F.explode(F.sequence("slots", F.greatest("slots", upto))).alias("rank"))
    point = F.pmod(F.col("first") - 1 + F.col("rank") - F.col("slots"), F.lit(1 << bits))
    return ranks.withColumn("point", point).select(_slot("point", bits).alias("slot"), "source", "rank")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, repeat: int, bits: int | None) -> tuple[DataFrame, int]:
    """(doc_id, h, nth, source, size, source_size, target, taken, slots) for every row of docs, and the schedule's bits.

    h hashes id and text, nth tells rows with one h apart; slots are the first slots of the rounds that it is taken in.
    """
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    tasks = _tasks(docs)
    kept = (max(STRETCHES, 4 * tasks) - 1).bit_length()
    rows = docs.select(doc_id.alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size_of(text).alias("size"), F.xxhash64(doc_id, text).alias("h"))
    rows = cut(rows.withColumn("stretch", F.shiftright("h", 64 - kept).cast("int")))  # the texts are read once
    sums = rows.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    aims = cut(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeat))
    if bits is None:
        bits = max(BITS, (aims.agg(F.coalesce(F.max("all_words"), F.lit(0))).first()[0]).bit_length() - SLOT_WORDS)
    n = 1 << bits
    tape = W.partitionBy("source", "stretch").orderBy("h", "doc_id", "size")
    placed = rows.withColumn("to", F.sum("size").over(tape.rowsBetween(W.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(tape))
    run = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(run), F.lit(0))).alias("s").join(aims.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("s.source").alias("of"), F.col("s.stretch").alias("in"), "base", "source_size", "target", "all_words")
    document = ["doc_id", "h", "nth", "source", "size", "source_size", "target"]
    laid = placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("in"))).select(*document, "all_words", (F.col("base") + F.col("to") - F.col("size")).alias("at"))
    # the blocks of all rounds of the tape that a document shares, as far as the source's target can reach
    edge = lambda r: F.expr(f"(all_words div {n}) * ({r}) + ((all_words % {n}) * ({r})) div {n}")
    about = lambda c: F.floor(c * (n * 1.0) / F.nullif(F.col("all_words"), F.lit(0)))
    each = laid.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("begin", F.col("at") + F.col("round") * F.col("source_size")).where("begin < round(target)")
    spread = each.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), about(F.col("begin")) - 1), about(F.col("begin") + F.col("size")) + 1)))
    overlap = F.least(edge("block + 1"), F.col("begin") + F.col("size"), F.round("target").cast("long")) - F.greatest(edge("block"), F.col("begin"))
    shared = spread.withColumn("words", overlap).where("words > 0")
    drawn = schedule(aims, bits).unionByName(_remainders(aims, bits)).select("slot", F.col("source").alias("of"), "rank")
    met = shared.join(drawn, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("rank"))).select(*document, "round", "words", "slot")
    every = met.unionByName(laid.select(*document, F.lit(0).alias("round"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot")))
    slots = F.array_sort(F.array_compact(F.array(*[F.min(F.when(F.col("round") == r, F.col("slot"))) for r in range(repeat)])))
    return every.groupBy(*document).agg(F.sum("words").alias("taken"), slots.alias("slots")), bits


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeat: int = REPEAT, bits: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot) for every row of docs; slot is its first place in the mix, null
    if it takes no words."""
    got, _ = _mix(docs, id_col, text_col, source_col, weights, repeat, bits)
    return got.select("doc_id", "source", "size", "source_size", "target", "taken", F.array_min("slots").alias("slot"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, repeat: int = REPEAT, bits: int | None = None) -> DataFrame:
    """The mix as whole documents in the order of the schedule: every row as often as the words taken from it make up its text,
    rounded, each time at the slot of that round; columns unchanged.

    Only the document that the end of its source's target cuts is rounded, and rows equal in id, text and source, which share
    what is taken of them alike; a document without words takes none and is left out.
    """
    taken, bits = _mix(docs, id_col, text_col, source_col, weights, repeat, bits)
    times = F.round(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).cast("int")
    rounds = F.array_sort(F.array_compact(F.array(*[F.min(F.get("slots", F.lit(r))) for r in range(repeat)])))
    plan = taken.groupBy(F.col("h").alias("of"), F.col("source").alias("from")).agg(times.alias("times"), rounds.alias("slots")).where("times > 0")
    keyed = packed(docs, h=F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), source=F.col(f"`{source_col}`"))
    joined = keyed.join(plan, (F.col("h") == F.col("of")) & F.col("source").eqNullSafe(F.col("from")))
    each = joined.select("row", "h", "slots", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    slot = F.element_at("slots", F.least("copy", F.size("slots")))
    tasks = _tasks(docs)
    ordered = each.withColumn("slot", slot).repartitionById(tasks, F.expr(f"cast(slot * {tasks} div {1 << bits} as int)"))
    return ordered.sortWithinPartitions("slot", "h", "copy").select("row.*")

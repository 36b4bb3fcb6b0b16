"""Substring dedup by content-defined chunking with a gear rolling hash.

Every text is cut into variable chunks at places that depend on the last 16 bytes alone, so a passage is cut alike wherever
it stands and insertions before it do not matter. Chunks are deduplicated by digest (96 bits: among 10**12 different chunks
an equal pair has a chance of some 10**-5) over all documents: the first occurrence, by document id and place, stays; later
ones are duplicates. Duplicate chunks that touch within a text are merged to spans.

A passage that repeats begins somewhere in the chunk before its span and ends somewhere in the chunk after it. A span is
reported if from the start of the chunk before to the end of the chunk after there are `least_words` words, so no passage of
that length is lost for where its chunks end; with least_words=0 every span is reported.

The digests are aggregated before they meet (a passage that a third of all documents hold is one row a task), and the
occurrences are then joined to the digests that occur more than once, a plain join whose hot keys Spark can split; no group
is gathered.

Nulls and edges: a null text is an empty one (no chunks). Documents with null ids come after all others, in the order of
their texts' hashes, and are reported with null ids; rows with null ids and different texts are documents of their own. Rows
that repeat an id count as one document, so they do not make each other duplicates, and a text's hash (th: 32 bits of it, as
it only tells rows of one id apart, or 64 where the id is null) tells their spans apart; identical rows have their spans
once. Columns besides id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.llm._batches import blocks, cut, map_arrow, packed, record, span_hashes, word_spans
from lodeline.llm.chunking import boundaries

AVERAGE, LONGEST, WINDOW, LEAST_WORDS = 28, 192, 16, 51
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def _text(text_col: str):
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _id(id_col: str):
    return F.col(f"`{id_col}`").cast("long")


def _hash(id_col: str, text_col: str):
    th = F.xxhash64(_text(text_col))
    return F.when(_id(id_col).isNull(), th).otherwise(th.bitwiseAND(F.lit(2**31 - 1)))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, longest: int = LONGEST) -> DataFrame:
    """(d1, d2, key, tag, span, words): one row for every chunk.

    d1 and d2 are its digest; key and tag are the document's id and text hash, or its text hash and null where the id is null;
    span is its first byte * 2**17 + 2**16 if the text has had the chunk before + its bytes; words is the words before the
    chunk before it * 2**16 + the words from there to the end of the chunk after it.
    """
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int32()), ("key", pa.int64()), ("tag", pa.int32()), ("span", pa.int64()), ("words", pa.int64())])

    def run(batches):
        for rows, data, offsets in blocks(batches, "text"):
            ends = boundaries(data, offsets, average, longest, characters=True, window=WINDOW)
            if not len(ends):
                continue
            starts = np.concatenate(([0], ends[:-1]))
            row = np.searchsorted(offsets, starts, "right") - 1
            digest, second = span_hashes(data, starts, ends), span_hashes(data, starts, ends, _SECOND)
            order = np.lexsort((starts, second, digest, row))
            again = np.zeros(len(starts), np.int64)
            same = np.ones(len(starts) - 1, bool)
            for c in (digest, second, row):
                same &= c[order][1:] == c[order][:-1]
            again[order[1:]] = same
            begun, ended, _ = word_spans(data, offsets)
            place = np.arange(len(starts))
            before, after = place - (starts != offsets[row]), place + (ends != offsets[row + 1])
            left, right = np.searchsorted(ended, starts, "right")[before], np.searchsorted(begun, ends, "left")[after]
            own = np.searchsorted(begun, offsets[row], "left")  # the words of the texts before
            at = pa.array(row)
            yield record(
                schema, digest.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32), rows.column(0).take(at), rows.column(1).take(at),
                (starts - offsets[row]) * 131072 + again * 65536 + (ends - starts), (left - own) * 65536 + (right - left),
            )

    th = _hash(id_col, text_col)
    source = docs.select(F.coalesce(_id(id_col), th).alias("key"), F.when(_id(id_col).isNotNull(), th.cast("int")).alias("tag"), _text(text_col).alias("text"))
    return map_arrow(source, run, "d1 long, d2 int, key long, tag int, span long, words long")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = AVERAGE, longest: int = LONGEST, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, start_byte, n_bytes, n_chunks, first_doc_id): the spans that repeat earlier text.

    first_doc_id holds the first occurrence of the span's first chunk.
    """
    every = chunks(docs, id_col, text_col, average, longest)
    named = F.col("tag").isNotNull()
    known = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.when(named, F.col("key"))).alias("first_id"), F.min(F.when(~named, F.col("key"))).alias("first_th"))
    known = cut(known.where("n > 1").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "first_id", "first_th"))
    again = F.col("span").bitwiseAND(F.lit(65536)) != 0
    first = F.when(named, F.col("key") == F.col("first_id")).otherwise(F.col("first_id").isNull() & (F.col("key") == F.col("first_th")))
    met = every.join(known, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).where(~first | again)
    start, words = F.shiftright("span", 17), F.col("words")
    later = met.select("key", "tag", "first_id", start.alias("start"), (start + F.col("span").bitwiseAND(F.lit(65535))).alias("end"), "words")
    order = W.partitionBy("key", "tag").orderBy("start")
    opens = F.coalesce((F.lag("end").over(order) < F.col("start")).cast("int"), F.lit(1))
    runs = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    left = F.shiftright(words, 16)
    about = F.max(left + words.bitwiseAND(F.lit(65535))) - F.min(left)
    merged = runs.groupBy("key", "tag", "run").agg(F.min("start").alias("start_byte"), (F.max("end") - F.min("start")).alias("n_bytes"), F.count_distinct("start").alias("n_chunks"), F.min(F.struct("start", "first_id")).alias("f"), about.alias("about"))
    return merged.where(F.col("about") >= least_words).select(F.when(named, F.col("key")).alias("doc_id"), F.coalesce(F.col("tag").cast("long"), "key").alias("th"), "start_byte", "n_bytes", "n_chunks", F.col("f.first_id").alias("first_doc_id"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the spans cut out of their texts; all columns and their order are kept, rows without spans unchanged."""
    cuts = spans.groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "n_bytes"))).alias("cuts"))
    keyed = packed(docs, id=_id(id_col), th=_hash(id_col, text_col))
    joined = keyed.join(cuts, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left").select("row", "cuts")
    kept, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            columns, out = b.column(0).flatten(), []
            for text, parts in zip(columns[at].to_pylist(), b.column(1).to_pylist()):
                if text is not None and parts:
                    body, left, pieces = text.encode(), 0, []
                    for p in parts:
                        pieces.append(body[left : p["start_byte"]])
                        left = p["start_byte"] + p["n_bytes"]
                    text = b"".join([*pieces, body[left:]]).decode()
                out.append(text)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=kept.names)

    return map_arrow(joined, run, kept)

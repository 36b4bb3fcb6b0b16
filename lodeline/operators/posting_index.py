"""A stored inverted index for BM25 whose blocks carry bounds, kept up by generations.

The documents of a generation are cut into ranges of `span` consecutive places. A block holds postings of one word in one range,
with the greatest frequency and the least length in it; both bound what any document of the block can score, whatever the corpus
statistics become later. A task writes blocks of the documents that it reads (a run of them at a time; postings name documents
by their place in it), so neither texts nor postings are shuffled, and a bucket has a file for each of these tasks. Blocks lie in folders
by word bucket, so a ranking reads the buckets of its own words only, and of those first the bounds. The bounds of all words of a
request add up by range, as ranges are alike for all words; the ranges with the highest sums are scored, and only ranges that can
still reach the k-th score found there are read at all. The blocks of a range meet, and no more than the k best of a request leave it.

An update writes one more generation: blocks of the new rows, the ids that are gone, and how often words came and went. What
was written before is never rewritten, and no document is split into words twice.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import text as t
from lodeline.operators.retrieval import EPSILON, K1, B, top_k
from lodeline.plans.joins import small
from lodeline.plans.lineage import cut

BUCKETS, SPAN = 64, 4096
#: Ranges of each request that are scored to find a bar for the others.
FIRST = 2
#: Postings that a task holds before it gives them out as blocks, and blocks given out at a time.
HELD, GIVEN = 1 << 19, 1 << 15
#: The bucket of a range's documents, beside those of its words.
ALL = -1
_PLACE = ["generation", "part"]


def _blocks(rows: DataFrame, held: int | None) -> DataFrame:
    """(word, part, run, n, most, least, postings, documents) of rows(symbol_id, ordinal, part, text), split into words where they are.

    A row holds the postings of a word, or (word null) the documents, of a part in a run. held: postings of a run; None: words
    come with their counts only, beside the documents.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in ("symbol_id", "ordinal")}

    def split(batches):
        find, run = re.compile("[a-z0-9]+").findall, TaskContext.get().partitionId() << 32
        ids, ordinals, parts, lengths = [], [], [], []
        codes, code, of, tf, counts = {}, [], [], [], Counter()

        def rows(columns):
            n = len(columns[3])
            whole = pa.RecordBatch.from_arrays([c if c is not None else pa.nulls(n, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))
            yield from (whole.slice(i, GIVEN) for i in range(0, n, GIVEN))

        def firsts(*keys):
            """Where values of the keys begin, and the ends of their lists."""
            new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            at = np.nonzero(np.concatenate([[True], new]))[0]
            return at, pa.array(np.append(at, len(keys[0])), pa.int32())

        def given():
            part, dl = np.concatenate(parts), np.array(lengths, np.int32)
            order = np.argsort(part, kind="stable")
            at, ends = firsts(part[order])
            n, place = np.diff(np.append(at, len(part))), np.empty(len(part), np.int32)
            place[order] = np.arange(len(part)) - np.repeat(at, n)
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.concat_arrays(ids).take(pa.array(order)), pa.concat_arrays(ordinals).take(pa.array(order)), pa.array(dl[order]))]
            yield from rows([None, pa.array(part[order][at]), pa.array(np.full(len(at), run)), pa.array(n), None, None, None, pa.StructArray.from_arrays(lists, fields=list(fields[7].type))])
            if not code:
                return
            word, doc, often = np.array(code, np.int64), np.array(of, np.int64), np.array(tf, np.int32)
            order = np.lexsort((place[doc], part[doc], word))
            word, doc, often = word[order], doc[order], often[order]
            at, ends = firsts(word, part[doc])
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(place[doc]), pa.array(often))]
            postings = pa.StructArray.from_arrays(lists, fields=list(fields[6].type))
            words, n = pa.array(list(codes), pa.string()).take(pa.array(word[at])), np.diff(np.append(at, len(word)))
            yield from rows([words, pa.array(part[doc[at]]), pa.array(np.full(len(at), run)), pa.array(n), pa.array(np.maximum.reduceat(often, at)), pa.array(np.minimum.reduceat(dl[doc], at)), postings, None])

        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            ints = pa.list_(pa.int32())
            documents = pa.struct([("ids", pa.list_(batch.column(0).type)), ("ordinals", pa.list_(batch.column(1).type)), ("dls", ints)])
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.struct([("places", ints), ("tfs", ints)]), documents]
            fields = [pa.field(c, x) for c, x in zip(["word", "part", "run", "n", "most", "least", "postings", "documents"], kinds)]
            ids.append(batch.column(0))
            ordinals.append(batch.column(1))
            parts.append(batch.column(2).to_numpy())
            for text in batch.column(3).to_pylist():
                tokens, at = find(text), len(lengths)
                own = Counter(tokens)
                lengths.append(len(tokens))
                if held is None:
                    counts.update(own.keys())
                else:
                    code += [codes.setdefault(w, len(codes)) for w in own]
                    of += [at] * len(own)
                    tf += own.values()
            if len(code) + len(counts) + len(lengths) >= (held or HELD):
                yield from given()
                ids, ordinals, parts, lengths = [], [], [], []
                codes, code, of, tf, run = {}, [], [], [], run + 1
            if len(counts) >= HELD:
                yield from rows([pa.array(list(counts), pa.string()), None, None, pa.array(list(counts.values()), pa.int64()), None, None, None, None])
                counts.clear()
        if lengths:
            yield from given()
        if counts:
            yield from rows([pa.array(list(counts), pa.string()), None, None, pa.array(list(counts.values()), pa.int64()), None, None, None, None])

    of = f"struct<ids: array<{types['symbol_id']}>, ordinals: array<{types['ordinal']}>, dls: array<int>>"
    return rows.mapInArrow(split, f"word string, part long, run long, n long, most int, least int, postings struct<places: array<int>, tfs: array<int>>, documents {of}")


def _best(k: int, average: float):
    """The function that scores a range: its documents and its words' blocks with the requests that say them, beside the requests that want it and the ids that are gone."""

    def score(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        kind = pa.schema([("request_id", asked.schema.field("request_id").type), ("symbol_id", asked.schema.field("gone_id").type), ("ordinal", blocks.schema.field("ordinals").type.value_type), ("score", pa.float64())])
        of_docs, blocks = blocks.filter(pc.is_valid(blocks["ids"])), blocks.filter(pc.is_valid(blocks["places"]))
        wanted = asked.filter(asked["is_request"])
        if not blocks.num_rows or not wanted.num_rows:
            return kind.empty_table()

        def flat(table, c):
            return pc.list_flatten(table[c].combine_chunks())

        def sizes(table, c):
            return pc.list_value_length(table[c]).to_numpy()

        # the range's documents, run by run
        ids, ordinals, dl = flat(of_docs, "ids"), flat(of_docs, "ordinals"), flat(of_docs, "dls").to_numpy()
        runs, order = of_docs["run"].to_numpy(), np.argsort(of_docs["run"].to_numpy())
        starts = np.concatenate([[0], np.cumsum(sizes(of_docs, "ids"))])[order]
        n, base = sizes(blocks, "tfs"), starts[np.searchsorted(runs[order], blocks["run"].to_numpy())]
        ends = np.concatenate([[0], np.cumsum(n)])
        doc, tf = flat(blocks, "places").to_numpy() + np.repeat(base, n), flat(blocks, "tfs").to_numpy()
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / average))
        here = ~pc.is_in(ids, value_set=asked.filter(pc.invert(asked["is_request"]))["gone_id"].combine_chunks(), skip_nulls=True).to_numpy(zero_copy_only=False)
        place = ordinals.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        # the blocks of each request that wants this range
        requests = wanted["request_id"].combine_chunks()
        who = pc.index_in(flat(blocks, "who"), value_set=requests).fill_null(-1).to_numpy()
        order = np.argsort(who, kind="stable")
        who, block, weight = who[order], np.repeat(np.arange(len(n)), sizes(blocks, "who"))[order], flat(blocks, "weights").to_numpy()[order]
        bars = wanted["bar"].combine_chunks().fill_null(0.0).to_numpy()
        out: list[tuple] = []
        for r in np.unique(who[who >= 0]).tolist():
            said = slice(*np.searchsorted(who, [r, r + 1]))
            pieces = [(slice(ends[b], ends[b + 1]), w) for b, w in zip(block[said].tolist(), weight[said].tolist())]
            scores = np.round(np.bincount(np.concatenate([doc[x] for x, _ in pieces]), np.concatenate([impact[x] * w for x, w in pieces]), len(ids)), 9)
            good = np.nonzero((scores > 0) & (scores >= bars[r]) & here)[0]
            if len(good) > k:
                good = good[np.lexsort((place[good], -scores[good]))]
                # what ties with the k-th stays, as ids decide there
                good = good[(np.arange(len(good)) < k) | ((scores[good] == scores[good[k - 1]]) & (place[good] == place[good[k - 1]]))]
            if len(good):
                out.append((np.full(len(good), r), good, scores[good]))
        if not out:
            return kind.empty_table()
        r, row, scores = (np.concatenate(x) for x in zip(*out))
        return pa.table([requests.take(pa.array(r)), ids.take(pa.array(row)), ordinals.take(pa.array(row)), pa.array(scores)], schema=kind)

    return score


class PostingIndex:
    """An index in a folder that all executors see; one writer at a time. Rows are (symbol_id, ordinal, and what documents are made of)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, span: int = SPAN):
        self.spark, self.folder, self.buckets, self.span = spark, folder.rstrip("/"), buckets, span

    def generations(self) -> list[int]:
        """Numbers of the whole generations: documents are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/documents")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in found if n.startswith("generation=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS")))

    def add(self, symbols: DataFrame, gone: DataFrame | None = None, document: Column | None = None) -> int:
        """Writes a generation of new rows; `gone` are the rows, as they were added, that leave. A changed row is in both."""
        known = self.generations()
        generation = (known[-1] if known else -1) + 1
        document = t.bm25_document(F.col("name"), F.col("docstring_first_line"), F.col("source")) if document is None else document
        texts = lambda rows: rows.select("symbol_id", "ordinal", F.coalesce(F.floor(F.col("ordinal") / self.span), F.lit(0)).alias("part"), t.bm25_text(document).alias("text"))
        blocks = _blocks(texts(symbols), HELD).withColumn("bucket", F.when(F.col("word").isNull(), ALL).otherwise(self._bucket(F.col("word"))))
        left = None if gone is None else cut(_blocks(texts(gone), None))
        # a file a task and bucket, sorted by word, so that other words' row groups are skipped
        at = f"{self.folder}/blocks/generation={generation}"
        blocks.sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(blocks.schema).parquet(at)
        came = written.where(F.col("bucket") != ALL).select("word", F.col("n").alias("change"))
        if left is not None:
            came = came.union(left.where("part is null").select("word", -F.col("n")))
        came.groupBy("word").agg(F.sum("change").alias("change")).where("change <> 0").write.mode("overwrite").parquet(f"{self.folder}/words/generation={generation}")
        documents = lambda held: held.select(F.explode(F.arrays_zip("documents.ids", "documents.dls")).alias("d"), "part").select(F.col("d.ids").alias("symbol_id"), F.col("d.dls").alias("dl"), "part")
        every = written.where(F.col("bucket") == ALL)
        out = documents(every.limit(0) if left is None else left.where("part is not null"))
        out.write.mode("overwrite").parquet(f"{self.folder}/gone/generation={generation}")
        documents(every).drop("part").write.mode("overwrite").parquet(f"{self.folder}/documents/generation={generation}")
        return generation

    def _bucket(self, word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(self.buckets)).cast("int")

    def _read(self, name: str) -> DataFrame:
        whole = self.generations()
        if not whole:
            raise ValueError(f"no index in {self.folder}")
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/generation={g}" for g in whole])

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """((n, avgdl), (word, df, idf)) of the rows that are there now, from counts only."""
        sizes = self._read("documents").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).crossJoin(self._read("gone").agg(F.count("*").alias("less"), F.coalesce(F.sum("dl"), F.lit(0)).alias("shorter")))
        corpus = cut(sizes.select((F.col("n") - F.col("less")).alias("n"), ((F.col("length") - F.col("shorter")) / (F.col("n") - F.col("less"))).alias("avgdl")))
        counts = self._read("words").groupBy("word").agg(F.sum("change").alias("df")).where("df > 0")
        raw = counts.crossJoin(F.broadcast(corpus)).select("word", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
        return corpus, raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("word", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def _bounds(self, weighed: DataFrame, corpus: DataFrame) -> DataFrame:
        """(request_id, generation, part, bound): what a document of a range can score at most; the postings are not read."""
        buckets = [r[0] for r in weighed.select(self._bucket(F.col("word")).alias("b")).distinct().collect()]  # at most `buckets`
        held = self._read("blocks").where(F.col("bucket").isin(buckets)).join(small(weighed.select("word").distinct()), "word")
        whole = held.groupBy("word", *_PLACE).agg(F.max("most").alias("most"), F.min("least").alias("least"))
        blocks = whole.join(small(weighed), "word").crossJoin(F.broadcast(corpus))
        best = F.col("weight") * self._impact(F.col("most"), F.col("least"))
        return blocks.groupBy("request_id", *_PLACE).agg(F.sum(F.greatest(best, F.lit(0.0))).alias("bound"))

    @staticmethod
    def _impact(tf: Column, dl: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))

    def _scores(self, ranges: DataFrame, weighed: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
        """(request_id, symbol_id, ordinal, score) of the rows that are still there, the best of ranges(request_id, generation, part, bar).

        A range's blocks meet once for all requests; of each request at most k rows of a range leave, none below its bar.
        """
        ranges = cut(ranges)
        read = small(ranges.select(*_PLACE).distinct())
        said = small(weighed.groupBy("word").agg(F.collect_list(F.struct("request_id", "weight")).alias("said")))
        buckets = [r[0] for r in weighed.select(self._bucket(F.col("word")).alias("b")).distinct().collect()]
        words = self._read("blocks").where(F.col("bucket").isin(buckets)).join(said, "word").select(*_PLACE, "run", "postings.*", F.col("said.request_id").alias("who"), F.col("said.weight").alias("weights"))
        documents = self._read("blocks").where(F.col("bucket") == ALL).select(*_PLACE, "run", "documents.*")
        blocks = words.unionByName(documents, allowMissingColumns=True).join(read, _PLACE, "left_semi")
        out = self._read("gone").groupBy("part", "symbol_id").agg(F.max("generation").alias("left_in")).join(read, "part").where("generation < left_in")
        id_, ordinal, request = out.schema["symbol_id"].dataType.simpleString(), blocks.schema["ordinals"].dataType.elementType.simpleString(), ranges.schema["request_id"].dataType
        asked = ranges.select(*_PLACE, "request_id", F.col("bar").cast("double").alias("bar"), F.lit(None).cast(id_).alias("gone_id"), F.lit(True).alias("is_request"))
        asked = asked.unionByName(out.select(*_PLACE, F.lit(None).cast(request).alias("request_id"), F.lit(None).cast("double").alias("bar"), F.col("symbol_id").alias("gone_id"), F.lit(False).alias("is_request")))
        best = _best(k, corpus.first()["avgdl"])
        return blocks.groupBy(*_PLACE).cogroup(asked.groupBy(*_PLACE)).applyInArrow(best, f"request_id {request.simpleString()}, symbol_id {id_}, ordinal {ordinal}, score double")

    def plan(self, requests: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(ranges with `read`, scores of the first ranges, weighed words, corpus)."""
        corpus, idf = self.stats()
        asked = requests.select("request_id", F.explode(t.bm25_tokens(F.col("text"))).alias("word")).groupBy("request_id", "word").agg(F.count("*").alias("qf"))
        weighed = cut(asked.join(idf, "word").select("request_id", "word", (F.col("qf") * F.col("idf")).alias("weight")))
        bounds = self._bounds(weighed, corpus).withColumn("nth", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("bound"), *_PLACE)))
        bounds = cut(bounds)
        first = cut(self._scores(bounds.where(F.col("nth") <= FIRST).select("request_id", *_PLACE, F.lit(None).cast("double").alias("bar")), weighed, corpus, k))
        bar = top_k(first, k).where(F.col("rank") == k).select("request_id", F.col("score").alias("bar"))
        ranges = bounds.join(bar, "request_id", "left").withColumn("read", (F.col("nth") <= FIRST) | F.col("bar").isNull() | (F.round("bound", 9) >= F.col("bar")))
        return ranges, first, weighed, corpus

    def ranking(self, requests: DataFrame, symbols: DataFrame | None = None, k: int = 10) -> DataFrame:
        """(request_id, symbol_id, score, rank), equal to bm25_ranking over the rows that are there; `symbols` is not looked at."""
        ranges, first, weighed, corpus = self.plan(requests, k)
        more = self._scores(ranges.where(F.col("read") & (F.col("nth") > FIRST)).select("request_id", *_PLACE, "bar"), weighed, corpus, k)
        return top_k(first.union(more), k).select("request_id", "symbol_id", "score", "rank")

    __call__ = ranking

"""Targets that a request names: deletions, renames, exact symbols, and single-file localisation."""

from __future__ import annotations

import difflib
import heapq
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import text as t
from lodeline.functions.predicates import delete_intent, trivial_delegate
from lodeline.operators import retrieval
from lodeline.operators.graph import local_called_by
from lodeline.plans.joins import SMALL_BYTES, small
from lodeline.plans.lineage import cut

# Close matches per word and their least ratio; what parts a list of targets; a rename request.
CLOSE_MATCHES, CLOSE_RATIO = 3, 0.75
# Letters from the most to the least frequent in English text; any order gives the same answers.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: Names of a block (of words four times as many), and bins of their characters and bigrams.
_BLOCK, _BINS = 1024, 256
#: Requests that go to every symbol, as they meet most of many documents by some word anyway.
FEW = 1024
#: Symbols, and requests, that are given out together.
PACK = 128
LIST_SEPARATOR = r"(?i),|\band\b|&|;"
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
RENAME = (
    r"(?i)^(?:rename|replace)\b(?:\s+(?:the\s+)?name\s+of)?(?:\s+(?:the\s+)?(?:function|method|class|variable))?(?:\s+of)?"
    rf"\s+[\"']?({_NAME})[\"']?\s+(?:to|with|by)\s+[\"']?({_NAME})[\"']?\s*[.!]?\s*$"
)


def request_targets(requests: DataFrame) -> DataFrame:
    """(request_id, word): the content words of each request."""
    return retrieval.request_words(requests, t.content_words(F.col("text")))


def delete_candidates(requests: DataFrame, symbols: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(request_id, symbol_id, method): symbols of whose name a content word is a part; else close matches by difflib's ratio.

    requests may carry `file`: then only that file's symbols count, for close matches too. Requests that say the same words
    are one until the last joins, which expand them and need no shuffle of what they give. The substring test runs over the
    distinct words and the distinct names, through the trigram of the word that is rarest in the names; close names meet in
    blocks (close_matches), or within a file by rare characters (close_pairs).
    """
    scope = ["file"] if "file" in requests.columns else []
    said = requests.select("request_id", *scope, t.content_words(F.col("text")).alias("w")).groupBy("request_id", *scope).agg(F.concat_ws(" ", F.array_sort(F.array_distinct(F.flatten(F.collect_list("w"))))).alias("said")).where("said <> ''")
    key = [*scope, "said"]
    asked = said.select(*key).distinct().withColumn("word", F.explode(F.split("said", " ")))
    names = symbols.select(*scope, F.lower("name").alias("low")).distinct()
    named = symbols.select("symbol_id", F.lower("name").alias("low"), *scope)
    exact = asked.join(_inside(asked.select(*scope, "word").distinct(), names, scope), [*scope, "word"]).join(named, ["low", *scope]).select(*key, "symbol_id").distinct()
    if not fuzzy:
        return _expanded(exact.withColumn("method", F.lit("substring")), said, key)
    exact = cut(exact)
    if scope:  # a request of several files is missed if all of them miss it
        hit = said.join(exact.select(*key).distinct(), key).select("request_id").distinct()
        missed = said.join(hit, "request_id", "left_anti").select(*key).distinct()
    else:
        missed = said.select(*key).distinct().join(exact.select(*key).distinct(), key, "left_anti")
    missed = missed.withColumn("word", F.explode(F.split("said", " ")))
    words = missed.select(*scope, "word").distinct()
    close = close_pairs(words, names, scope).mapInPandas(_close, ", ".join([f"{c} string" for c in scope] + ["word string, low string, ratio double"])) if scope else close_matches(words, names)
    best = close.withColumn("k", F.row_number().over(W.partitionBy(*scope, "word").orderBy(F.desc("ratio"), F.desc("low")))).where(F.col("k") <= CLOSE_MATCHES)
    near = missed.join(best.select(*scope, "word", "low"), [*scope, "word"]).join(named, ["low", *scope]).select(*key, "symbol_id").distinct()
    return _expanded(exact.withColumn("method", F.lit("substring")).unionByName(near.withColumn("method", F.lit("fuzzy"))), said, key)


def _inside(words: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, word, low) of words(scope, word) that are parts of names(scope, low), distinct both."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    by_gram = names.select(*scope, "low", F.explode(grams(F.col("low"))).alias("gram"))
    held = by_gram.groupBy(*scope, "gram").agg(F.count("*").alias("held"))
    every = words.select(*scope, "word", F.explode(grams(F.col("word"))).alias("gram")).join(held, [*scope, "gram"], "left")
    rarest = every.groupBy(*scope, "word").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("g")).where("g.held > 0").select(*scope, "word", "g.gram")
    return rarest.join(by_gram, [*scope, "gram"]).where(F.contains("low", "word")).select(*scope, "word", "low")


def _expanded(found: DataFrame, said: DataFrame, key: list[str]) -> DataFrame:
    """(request_id, symbol_id, method): what was found for some words, for each request that says them."""
    if len(key) > 1:  # within files, where a request may have several
        return found.join(said, key).select("request_id", "symbol_id", "method").distinct()
    # packs of symbols meet packs of the requests that say the same: of each two only the numbers are dealt to tasks, evenly, and the packs go to
    # all, if they are small enough. A task holds the rows of two packs at a time, and as a request stands before a run of the same symbols
    # as others of its words, the rows are stored in a fraction of the bytes that they take a symbol at a time
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packs(df, by, c, name):
        df = cut(df)
        tasks = max(1, min(parts, df.count() // (16 * PACK)))
        placed = df.repartition(tasks, *by, c).sortWithinPartitions(*by, c).withColumn("run", F.floor(F.monotonically_increasing_id() / PACK))
        return cut(placed.groupBy(*by, "run").agg(F.collect_list(c).alias(f"{name}s")).drop("run").withColumn(name, F.monotonically_increasing_id()))

    symbols, asking = packs(found, [*key, "method"], "symbol_id", "symbol"), packs(said, key, "request_id", "request")
    cells = symbols.select(*key, "method", "symbol").join(small(asking.select(*key, "request")), key).repartitionByRange(parts, *key, "method", "symbol", "request")
    met = cells.join(small(symbols.select("symbol", "symbols"), 4 * SMALL_BYTES), "symbol").join(small(asking.select("request", "requests"), 4 * SMALL_BYTES), "request")
    return met.select(F.explode("requests").alias("request_id"), "symbols", "method").select("request_id", F.explode("symbols").alias("symbol_id"), "method")


def _counted(c: str) -> Column:
    """The characters of a string, each with how often it came before, those that are rare in English names first."""
    there = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: i <= F.length(c))
    char = lambda i: F.substring(F.col(c), i, F.lit(1))
    before = lambda i: F.length(F.substring(F.col(c), F.lit(1), i)) - F.length(F.replace(F.substring(F.col(c), F.lit(1), i), char(i), F.lit("")))
    order = lambda i: F.struct((-before(i)).alias("o"), (-F.instr(F.lit(_COMMON), char(i))).alias("r"), char(i).alias("char"), before(i).alias("nth"))
    return F.transform(F.array_sort(F.transform(there, order)), lambda x: F.concat_ws(" ", x["char"], x["nth"].cast("string")))


def close_pairs(words: DataFrame, names: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(word, low) of words(word) and names(low), distinct both: a superset of the pairs with a ratio of CLOSE_RATIO and more.

    The ratio is twice the matched characters by both lengths, and no more can match than the two multisets of characters
    share. So a pair shares at least `both` characters, and by the prefix filter one of the first (length - both + 1)
    in any common order, rare ones first; the pairs that meet are checked for `both`, all in one join on (character, which
    one of its kind, length of the name). Strings are not empty. scope: columns of both in which the two have to agree.
    """
    least = lambda x, y: F.ceil(CLOSE_RATIO / 2 * (x + y)).cast("int")
    shortest = lambda n: F.ceil(n * (CLOSE_RATIO / (2 - CLOSE_RATIO))).cast("int")
    long = F.col("n") - least(F.col("n"), shortest(F.col("n"))) + 1  # whatever word comes
    index = names.where("low <> ''").select(*scope, "low", F.length("low").alias("n"), _counted("low").alias("has")).select(*scope, "low", "n", "has", F.explode(F.slice("has", F.lit(1), long)).alias("token"))
    w = words.where("word <> ''").select(*scope, "word", F.length("word").alias("m"), _counted("word").alias("asked"))
    w = w.withColumn("n", F.explode(F.sequence(shortest(F.col("m")), F.floor(F.col("m") * ((2 - CLOSE_RATIO) / CLOSE_RATIO)).cast("int")))).withColumn("both", least(F.col("m"), F.col("n")))
    # some lengths leave no prefix: then no name of that length is close
    asked = w.where("both <= m and both <= n").select(*scope, "word", "n", "both", "asked", F.explode(F.slice("asked", F.lit(1), F.col("m") - F.col("both") + 1)).alias("token"))
    met = asked.join(index, [*scope, "token", "n"]).where(F.size(F.array_intersect("asked", "has")) >= F.col("both"))
    return met.select(*scope, "word", "low").distinct()


def _packed(strings: DataFrame, name: str, most: int) -> DataFrame:
    """(<name>_least, <name>_most, <name>) of one column of strings: blocks of up to `most`, alike in length, and their lengths."""
    def run(frames):
        held: list[str] = []
        for f in frames:
            held += f["s"].tolist()
            while len(held) >= most:
                yield packed(held[:most])
                held = held[most:]
        if held:
            yield packed(held)

    def packed(held):
        return pd.DataFrame({f"{name}_least": [len(held[0])], f"{name}_most": [len(held[-1])], name: [json.dumps(held).encode()]})

    ordered = strings.select(F.col(strings.columns[0]).alias("s")).where("s <> ''").sortWithinPartitions(F.length("s"))
    return ordered.mapInPandas(run, f"{name}_least int, {name}_most int, {name} binary")


@lru_cache(maxsize=32)
def _features(block: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The strings of a block, their lengths, and how many characters (by which one of its kind) and bigrams fall into each bin."""
    strings = json.loads(block)
    chars, pairs = np.zeros((len(strings), _BINS), np.uint16), np.zeros((len(strings), _BINS), np.uint16)
    for i, s in enumerate(strings):
        seen: dict[str, int] = {}
        for c in s:
            nth = seen[c] = seen.get(c, -1) + 1
            chars[i, (ord(c) - 48 + 80 * nth) % _BINS] += 1
        for a, b in zip(s, s[1:]):
            pairs[i, (ord(a) * 37 + ord(b)) % _BINS] += 1
    return strings, np.array([len(s) for s in strings], np.int64), chars, pairs


def close_matches(words: DataFrame, names: DataFrame, most: int = CLOSE_MATCHES) -> DataFrame:
    """(word, low, ratio): of words(word) and names(low), distinct both, at least each word's `most` names of the best ratios from
    CLOSE_RATIO on.

    What difflib matches is at most the characters that both share, a product of two matrices for two blocks; and in M
    matched characters stand at least 3 M - (both lengths) - 1 bigrams that both share, which is asked of the pairs that
    are left. Bins only add to what is shared, so no pair is lost. A word's pairs are judged from the highest bound down,
    until the next bound is below the `most` best of the block.
    """
    w, n = small(_packed(words.select("word"), "w", 4 * _BLOCK)), _packed(names.select("low"), "n", _BLOCK)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = (F.col("n_most") >= F.col("w_least") * (CLOSE_RATIO / (2 - CLOSE_RATIO)) - 1e-6) & (F.col("n_least") <= F.col("w_most") * ((2 - CLOSE_RATIO) / CLOSE_RATIO) + 1e-6)

    def run(frames):
        for f in frames:
            for wb, nb in zip(f["w"], f["n"]):
                yield pd.DataFrame(_judged(_features(bytes(wb)), _features(bytes(nb)), most), columns=["word", "low", "ratio"])

    return n.repartition(parts).join(w, fits).select("w", "n").mapInPandas(run, "word string, low string, ratio double")


def _judged(w: tuple, n: tuple, most: int) -> list[tuple[str, str, float]]:
    words, m, wc, wp = w
    names, k, nc, np_ = n
    both = m[:, None] + k[None, :]
    shared = wc.astype(np.float32) @ nc.astype(np.float32).T
    i, j = np.nonzero(2 * shared >= CLOSE_RATIO * both)
    shared, both = shared[i, j].astype(np.int64), both[i, j]
    pairs = np.concatenate([np.minimum(wp[i[x : x + 65536]], np_[j[x : x + 65536]]).sum(axis=1) for x in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
    bound = 2 * np.minimum(shared, (pairs + both + 1) // 3) / both
    keep = bound >= CLOSE_RATIO
    i, j, bound = i[keep], j[keep], bound[keep]
    order = np.lexsort((-bound, i))
    out, matcher, now, best = [], difflib.SequenceMatcher(), -1, []
    for x, y, b in zip(i[order].tolist(), j[order].tolist(), bound[order].tolist()):
        if x != now:
            out += [(words[now], low, ratio) for ratio, low in best]
            now, best = x, []
            matcher.set_seq2(words[x])
        if len(best) == most and b < best[0][0]:
            continue
        matcher.set_seq1(names[y])
        ratio = matcher.ratio()
        if ratio >= CLOSE_RATIO:
            (heapq.heappush if len(best) < most else heapq.heappushpop)(best, (ratio, names[y]))
    return out + [(words[now], low, ratio) for ratio, low in best]


def _close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ratios, matcher = [], difflib.SequenceMatcher()
        for word, low in zip(f["word"], f["low"]):
            matcher.set_seq2(word)
            matcher.set_seq1(low)
            ratios.append(matcher.ratio())
        f["ratio"] = ratios
        yield f[f["ratio"] >= CLOSE_RATIO]


def multi_delete(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, phrase_ord, symbol_id) for lists of two and more targets each of which is exactly one symbol's name; else nothing."""
    verb = delete_intent(F.col("text"))
    rest = F.when(verb, F.regexp_replace(F.trim("text"), r"^\S+\s*", "")).otherwise(F.trim("text"))
    phrases = F.filter(F.transform(F.split(rest, LIST_SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")
    listed = requests.select("request_id", phrases.alias("p")).where("size(p) >= 2").select("request_id", F.size("p").alias("n"), F.posexplode("p").alias("phrase_ord", "phrase"))
    kept = F.array_except(t.words(F.col("phrase")), t.words_array(t.LEADING_VERBS + t.TYPE_WORDS))
    met = listed.select("request_id", "n", "phrase_ord", F.explode(kept).alias("low")).join(symbols.select("symbol_id", F.lower("name").alias("low")), "low")
    one = met.groupBy("request_id", "n", "phrase_ord").agg(F.count("*").alias("c"), F.min("symbol_id").alias("symbol_id")).where("c = 1")
    whole = one.withColumn("got", F.count("*").over(W.partitionBy("request_id"))).where("got = n")
    return whole.select("request_id", "phrase_ord", "symbol_id")


def rename_target(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, old_name, new_name) where the request is a rename of a name that is defined exactly once."""
    asked = requests.select("request_id", F.regexp_extract(F.trim("text"), RENAME, 1).alias("old_name"), F.regexp_extract(F.trim("text"), RENAME, 2).alias("new_name")).where("old_name <> ''")
    once = symbols.groupBy(F.col("name").alias("old_name")).agg(F.count("*").alias("c")).where("c = 1")
    return asked.join(once, "old_name", "left_semi").select("request_id", "old_name", "new_name")


def find_symbol(wanted: DataFrame, symbols: DataFrame, lines: Column | None = None) -> DataFrame:
    """wanted(key, file, symbol_type, symbol_name, prefer_line, allow_delegate) with status FOUND, MISSING or AMBIGUOUS and symbol_id.

    One symbol of the type and name is it; else the one that starts at prefer_line; else, of two, the one that a trivial
    module-level delegate forwards to. symbols may carry `lines`, the lines of their file, for that test. A key stands once. Symbols
    are counted by place before wanted ones meet them, so that many of one name in a file make no pairs.
    """
    has_lines = "lines" in symbols.columns
    place = ["file", "symbol_type", "symbol_name"]
    pool = symbols.select("symbol_id", "file", "symbol_type", F.col("name").alias("symbol_name"), "start_line", "parent_class", *(["lines", "end_line", "indent"] if has_lines else []))
    counted = pool.groupBy(*place).agg(F.count("symbol_id").alias("n"), F.max("symbol_id").alias("only"), F.max("parent_class").alias("parent"))
    at = pool.groupBy(*place, "start_line").agg(F.count("*").alias("n_preferred"), F.max("symbol_id").alias("preferred"))
    met = wanted.join(counted, place, "left").join(at.withColumnRenamed("start_line", "prefer_line"), [*place, "prefer_line"], "left")
    if has_lines:  # of two
        two = pool.join(counted.where("n = 2").select(*place, "parent"), place)
        forwards = F.coalesce(trivial_delegate(F.col("lines"), F.col("start_line"), F.col("end_line"), F.col("indent"), F.col("parent"), F.col("symbol_name")) & F.col("parent_class").isNull(), F.lit(False))
        via = two.groupBy(*place).agg(F.sum(forwards.cast("int")).alias("n_forwards"), F.max(F.when(~forwards, F.col("symbol_id"))).alias("meant"))
        met = met.join(via.where("n_forwards = 1").select(*place, "meant"), place, "left")
    else:
        met = met.withColumn("meant", F.lit(None).cast(symbols.schema["symbol_id"].dataType))
    n = F.coalesce("n", F.lit(0))
    hit = F.when(n == 1, F.col("only")).when(F.col("n_preferred") == 1, F.col("preferred")).when(F.col("allow_delegate"), F.col("meant"))
    found = met.select("key", n.alias("n"), hit.alias("symbol_id")).groupBy("key").agg(F.max("n").alias("n"), F.max("symbol_id").alias("symbol_id"))
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("symbol_id").isNotNull(), "FOUND").otherwise("AMBIGUOUS")
    return found.select("key", status.alias("status"), "symbol_id")


def backed_pairs(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, symbol_id): all pairs that locate_candidates may count, and few others.

    A pair counts by a name or class that stands in the request, by a word of the doc line, or by two words of the name; of
    two shared words one is not the name's most common word, so that one meets nobody.
    """
    tagged = lambda words, token: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(token).alias("token")))
    told = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    tokens = requests.select("request_id", F.explode(F.concat(tagged(F.array_distinct(told), True), tagged(t.words(F.col("text")), False))).alias("q")).select("request_id", "q.*")
    whole = symbols.select("symbol_id", F.explode(F.concat(tagged(F.array_distinct(F.array(F.lower("name"), F.lower(F.coalesce("parent_class", F.lit(""))))), True), tagged(t.words(F.col("docstring_first_line")), False))).alias("o")).select("symbol_id", "o.*")
    words = symbols.select("symbol_id", F.explode(t.words(F.col("name"))).alias("word"))
    held = words.join(words.groupBy("word").agg(F.count("*").alias("held")), "word").groupBy("symbol_id").agg(F.array_sort(F.collect_set(F.struct("held", "word"))).alias("h")).where("size(h) > 1")
    parts = held.select("symbol_id", F.explode(F.slice("h", F.lit(1), F.size("h") - 1)).alias("o")).select("symbol_id", "o.word", F.lit(False).alias("token"))
    return whole.unionByName(parts).join(tokens, ["word", "token"]).select("request_id", "symbol_id").distinct()


def locate_candidates(requests: DataFrame, symbols: DataFrame, calls: DataFrame | None = None, vectors: DataFrame | None = None, k: int = 2, least: int = 1) -> DataFrame:
    """(request_id, symbol_id, score, rank): the best symbols of one file, one for each name.

    A symbol counts if its name stands in the request, or if its doc line, two words of its name or its class corroborate it;
    a name that is just the request's opening generic verb needs that corroboration. Of several symbols of one name the one
    with the highest score wins, then the only one with the most callers, then the nearest vector, then the first. Up to FEW
    requests go to the symbols, whose words are taken once; more meet them by words (backed_pairs).
    """
    told = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    opening = F.lower(F.regexp_extract(F.trim("text"), r"^(\S+)", 1))
    verb = F.when(opening.isin(*t.LEADING_VERBS), opening)
    asked = cut(requests.select("request_id", t.words(F.col("text")).alias("rw"), told.alias("told"), F.coalesce(verb, F.lit("")).alias("verb")))
    known = symbols.select("symbol_id", "ordinal", "name", F.lower("name").alias("low"), F.lower("parent_class").alias("class"), t.words(F.col("name")).alias("nw"), t.words(F.col("docstring_first_line")).alias("dw"))
    if asked.count() <= FEW:
        every = asked.agg(F.array_distinct(F.flatten(F.collect_list("rw"))).alias("every"))
        met = known.crossJoin(F.broadcast(every)).withColumn("dw", F.array_intersect("dw", "every")).drop("every").crossJoin(F.broadcast(asked))
    else:
        met = backed_pairs(requests, symbols).join(asked, "request_id").join(known, "symbol_id")
    overlap, doc = F.size(F.array_intersect("rw", "nw")), F.size(F.array_intersect("rw", "dw"))
    literal, in_class = F.array_contains("told", F.col("low")), F.coalesce(F.array_contains("told", F.col("class")), F.lit(False))
    backed = (doc > 0) | (overlap > 1) | in_class
    verb = (F.col("low") == F.col("verb")) & (F.col("verb") != "")
    scored = met.where((literal | backed) & ~(verb & ~backed)).select("request_id", "symbol_id", "ordinal", "name", (F.when(literal, 5).otherwise(0) + overlap + doc + F.when(in_class, 5).otherwise(0)).cast("double").alias("score")).where(F.col("score") >= least)
    if calls is None and vectors is None:  # of each name the best, then the first, which is told before anything is shuffled
        first = scored.groupBy("request_id", "name").agg(F.min(F.struct((-F.col("score")).alias("less"), "ordinal", "symbol_id")).alias("b"))
        one = first.select("request_id", "b.symbol_id", "b.ordinal", (-F.col("b.less")).alias("score"))
        return retrieval.top_k(one, k).select("request_id", "symbol_id", "score", "rank")
    scored = scored.join(local_called_by(calls, symbols), "symbol_id", "left") if calls is not None else scored.withColumn("called_by_count", F.lit(None).cast("long"))
    scored = scored.join(vectors.select("request_id", "symbol_id", F.col("score").alias("near")), ["request_id", "symbol_id"], "left") if vectors is not None else scored.withColumn("near", F.lit(None).cast("double"))
    name = W.partitionBy("request_id", "name")
    best = scored.withColumn("best", F.max("score").over(name)).where("score = best").withColumn("most", F.max(F.coalesce("called_by_count", F.lit(0))).over(name))
    at_most = F.sum((F.coalesce("called_by_count", F.lit(0)) == F.col("most")).cast("int")).over(name)
    best = best.withColumn("sole", (F.col("most") > 0) & (at_most == 1) & (F.coalesce("called_by_count", F.lit(0)) == F.col("most")))
    one = best.withColumn("k", F.row_number().over(name.orderBy(F.desc("sole"), F.desc_nulls_last("near"), "ordinal"))).where("k = 1")
    return retrieval.top_k(one, k).select("request_id", "symbol_id", "score", "rank")

"""Typed edits: parsing, validation and application of deltas as set-based line algebra, renames and diffs.

An operation names a symbol; after resolution it is (file_id, op_ord, operation, start_line, end_line, indent, content),
where an INSERT has its anchor's last line as end_line (or the file's last line). Outcomes are columns, never exceptions.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lodeline import schemas
from lodeline.functions import text as t
from lodeline.operators.targets import find_symbol
from lodeline.plans.joins import small
from lodeline.plans.lineage import cut
from lodeline.sources.code import snippet_name

#: Places behind line ends, those that split_lines knows, so that a line keeps its end.
KEPT_ENDS = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"


def parse(deltas: DataFrame, default_file: str | None = None) -> DataFrame:
    """deltas(run_id, body) with `delta`, `valid` and `error`: JSON read against the schema, enumerations checked, names bared.

    Missing schema_version, base_version and target.file are filled in; null fields are dropped by to_json.
    """
    read = deltas.withColumn("delta", F.from_json("body", schemas.DELTA, {"mode": "PERMISSIVE"}))
    ops = F.col("delta.operations")
    bad_op = F.exists(ops, lambda o: o["operation"].isNull() | ~o["operation"].isin(*schemas.OPERATIONS))
    bad_target = F.exists(ops, lambda o: o["target"].isNull() | o["target"]["symbol_name"].isNull() | o["target"]["symbol_type"].isNull() | ~o["target"]["symbol_type"].isin(*schemas.SYMBOL_TYPES))
    kind = F.col("delta.escalate.kind")
    bad_kind = F.col("delta.escalate").isNotNull() & (kind.isNull() | ~kind.isin(*schemas.ESCALATIONS))
    error = (
        F.when(F.col("delta").isNull() | ops.isNull(), "schema validation failed: operations")
        .when(bad_op, "schema validation failed: operation")
        .when(bad_target, "schema validation failed: target")
        .when(bad_kind, "schema validation failed: escalate")
    )
    filled = F.transform(
        ops,
        lambda o: F.struct(
            o["operation"].alias("operation"),
            F.struct(F.coalesce(o["target"]["file"], F.lit(default_file)).alias("file"), o["target"]["symbol_type"].alias("symbol_type"), t.bare_name(o["target"]["symbol_name"]).alias("symbol_name"), t.bare_name(o["target"]["anchor"]).alias("anchor")).alias("target"),
            o["content"].alias("content"),
        ),
    )
    whole = F.struct(F.coalesce("delta.schema_version", F.lit("1.0")).alias("schema_version"), F.coalesce("delta.base_version", F.lit("")).alias("base_version"), filled.alias("operations"), F.col("delta.escalate").alias("escalate"))
    return read.withColumn("error", error).withColumn("valid", F.col("error").isNull()).withColumn("delta", F.when(F.col("valid"), whole))


def operations(parsed: DataFrame) -> DataFrame:
    """The operations of valid deltas, one row each."""
    flat = parsed.where("valid").select("run_id", F.posexplode("delta.operations").alias("op_ord", "o"))
    return flat.select("run_id", "op_ord", "o.operation", "o.target.file", "o.target.symbol_type", "o.target.symbol_name", "o.target.anchor", "o.content")


@F.pandas_udf(StringType())
def _snippet_names(content: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([snippet_name(c, p) for c, p in zip(content, path)], dtype=object)


def definition(content: Column, path: Column | None = None) -> Column:
    """The name of the only definition at the top of a snippet for a file, or null; a parser has to say, so it runs on the workers."""
    return _snippet_names(content, F.lit(None).cast("string") if path is None else path)


def annotated(checked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Validated operations with line_range(start, end, after_line), and an INSERT's name corrected to what its content defines.

    checked: as validate_targets gives it; sizes(file, n_lines). An INSERT without an anchor goes after the last line.
    """
    insert = F.col("operation") == "INSERT"
    after = F.when(insert, F.coalesce("end_line", "n_lines"))
    span = F.struct(F.when(~insert, F.col("start_line")).alias("start"), F.when(~insert, F.col("end_line")).alias("end"), after.alias("after_line"))
    name = F.when(insert, F.coalesce(definition(F.col("content"), F.col("file")), "symbol_name")).otherwise(F.col("symbol_name"))
    return checked.join(sizes, "file", "left").withColumn("line_range", span).withColumn("symbol_name", name).drop("n_lines")


def validate_targets(ops: DataFrame, symbols: DataFrame, shown: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """ops with status, error, symbol_id and the target's span.

    REPLACE and DELETE need one target, and INSERT's anchor must exist: the only symbol of its type and name, or the one at the
    operation's prefer_line (where ops have that column), or, except for DELETE, of two the one that a trivial delegate, told by
    its lines, forwards to. A REPLACE needs a symbol that was shown (shown(run_id, symbol_name)) and must keep every decorator
    line of lines(file, n, line); an INSERT must not define a name of its type again.
    """
    name = F.when(F.col("operation") == "INSERT", F.col("anchor")).otherwise(F.col("symbol_name"))
    met = cut(ops.withColumn("wanted", name))
    prefer = F.col("prefer_line") if "prefer_line" in ops.columns else F.lit(None)
    own = symbols if "parent_class" in symbols.columns else symbols.withColumn("parent_class", F.lit(None).cast("string"))
    if lines is not None:
        several = own.groupBy("file", "symbol_type", "name").agg(F.count("*").alias("n")).where("n = 2").join(met.select("file", "symbol_type", F.col("wanted").alias("name")), ["file", "symbol_type", "name"], "left_semi")
        texts = lines.join(several.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
        own = own.drop("lines").join(texts, "file", "left")
    asked = met.where("wanted is not null").select(F.struct("run_id", "op_ord").alias("key"), "file", "symbol_type", F.col("wanted").alias("symbol_name"), prefer.cast("int").alias("prefer_line"), (F.col("operation") != "DELETE").alias("allow_delegate"))
    found = find_symbol(asked, own).select(F.col("key.run_id").alias("run_id"), F.col("key.op_ord").alias("op_ord"), F.col("status").alias("found"), F.col("symbol_id").alias("hit_id"))
    spans = symbols.select(F.col("symbol_id").alias("hit_id"), F.struct("symbol_id", "start_line", "end_line", "indent").alias("hit"))
    met = met.join(found, ["run_id", "op_ord"], "left").join(spans, "hit_id", "left")
    defined = definition(F.col("content"), F.col("file"))
    taken = symbols.select("file", "symbol_type", F.col("name").alias("defined")).distinct().withColumn("taken", F.lit(True))
    met = met.withColumn("defined", F.when(F.col("operation") == "INSERT", defined)).join(taken, ["file", "symbol_type", "defined"], "left")
    if shown is not None:
        met = met.join(shown.select("run_id", "symbol_name").distinct().withColumn("was_shown", F.lit(True)), ["run_id", "symbol_name"], "left")
    else:
        met = met.withColumn("was_shown", F.lit(True))
    if lines is not None:
        inside = (F.col("m.file") == F.col("l.file")) & F.col("l.n").between(F.col("m.hit.start_line"), F.col("m.hit.end_line")) & F.startswith(F.trim("l.line"), F.lit("@"))
        need = met.where("operation = 'REPLACE'").alias("m").join(lines.alias("l"), inside).groupBy("m.run_id", "m.op_ord").agg(F.collect_set(F.trim("l.line")).alias("decorators"))
        met = met.join(need, ["run_id", "op_ord"], "left")
    else:
        met = met.withColumn("decorators", F.lit(None).cast("array<string>"))
    kept = F.size(F.array_except(F.coalesce("decorators", F.array().cast("array<string>")), F.transform(t.split_lines(F.col("content")), lambda x: F.trim(x)))) == 0
    target = F.col("operation").isin("REPLACE", "DELETE")
    status = (
        F.when(target & (F.col("operation") == "REPLACE") & F.col("was_shown").isNull(), "UNSEEN_REPLACE")
        .when(F.col("found") == "MISSING", "MISSING")
        .when(F.col("found") == "AMBIGUOUS", "AMBIGUOUS")
        .when((F.col("operation") == "REPLACE") & ~kept, "DECORATORS_LOST")
        .when((F.col("operation") == "INSERT") & F.col("taken"), "ALREADY_DEFINED")
        .otherwise("OK")
    )
    return met.withColumn("status", status).select("run_id", "op_ord", "operation", "file", "symbol_type", "symbol_name", "anchor", "content", "status", F.col("hit.symbol_id").alias("symbol_id"), F.col("hit.start_line").alias("start_line"), F.col("hit.end_line").alias("end_line"), F.coalesce("hit.indent", F.lit(0)).alias("indent"))


def overlapping(ops: DataFrame) -> DataFrame:
    """(file_id) of the files two of whose REPLACE or DELETE spans overlap; those need `apply_sequential`."""
    order = W.partitionBy("file_id").orderBy("start_line", "op_ord")
    spans = ops.where("operation <> 'INSERT'")
    before = F.max("end_line").over(order.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("before", before).where("start_line <= before").select("file_id").distinct()


def pieces(files: DataFrame) -> DataFrame:
    """(file_id, n, line, line_end) of files(file_id, source): every line with the end that it has, the last perhaps none."""
    kept = files.select("file_id", F.posexplode(F.filter(F.split(F.coalesce("source", F.lit("")), KEPT_ENDS, -1), lambda x: x != "")).alias("i", "piece"))
    ends = F.regexp_extract("piece", r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])\z", 1)
    return kept.select("file_id", (F.col("i") + 1).alias("n"), F.substr("piece", F.lit(1), F.length("piece") - F.length(ends)).alias("line"), ends.alias("line_end"))


def apply_lines(lines: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_id, source): files after their operations, for files whose spans do not overlap.

    lines(file_id, n, line), as `pieces` gives them with the line_end of each, which stays as it is, or else with \\n behind each; ops(file_id, op_ord, operation, start_line, end_line, indent, content). Every line has an order
    key, so edits need no bottom-up sequence: replaced and deleted lines leave by an anti-join, new ones join at
    their place. A DELETE also takes the blank lines behind it; an INSERT puts a blank line before its content.
    """
    lines = lines if "line_end" in lines.columns else lines.withColumn("line_end", F.lit("\n"))
    blank = F.regexp_replace("line", r"\s", "") == ""
    gone = ops.where("operation in ('REPLACE', 'DELETE')").select("file_id", "start_line", "end_line", "operation")
    order = W.partitionBy("file_id").orderBy("n")
    # the last worded line up to each blank line: the blanks behind a deletion are those whose last worded line it deletes
    worded = lines.withColumn("is_blank", blank).withColumn("anchor", F.last(F.when(~F.col("is_blank"), F.col("n")), ignorenulls=True).over(order))
    l, g = worded.alias("l"), gone.alias("g")
    taken = (F.col("l.file_id") == F.col("g.file_id")) & (
        F.col("l.n").between(F.col("g.start_line"), F.col("g.end_line"))
        | ((F.col("g.operation") == "DELETE") & F.col("l.is_blank") & (F.col("l.n") > F.col("g.end_line")) & (F.coalesce("l.anchor", F.lit(0)) <= F.col("g.end_line")))
    )
    kept = l.join(g, taken, "left_anti").select("file_id", F.col("n").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.concat("line", "line_end").alias("line"))
    body = F.posexplode(t.split_lines(t.dedent_to(F.col("content"), F.col("indent"))))
    fresh = ops.where("operation in ('REPLACE', 'INSERT')").select("file_id", "op_ord", "operation", "start_line", "end_line", body.alias("i", "line"))
    last = lines.groupBy("file_id").agg(F.max("n").alias("last"))
    fresh = fresh.join(last, "file_id", "left").withColumn("line", F.concat("line", F.lit("\n")))
    replaced = fresh.where("operation = 'REPLACE'").select("file_id", F.col("start_line").alias("k1"), (F.col("op_ord") + 1).alias("k2"), F.col("i").alias("k3"), "line")
    at = F.coalesce("end_line", "last", F.lit(0))
    # later inserts at one place stand before earlier ones, as when each is put there in turn
    inserted = fresh.where("operation = 'INSERT'").select("file_id", at.alias("k1"), (F.lit(1_000_000) - F.col("op_ord")).alias("k2"), (F.col("i") + 1).alias("k3"), "line")
    placed = ops.join(last, "file_id", "left").select("file_id", "op_ord", "operation", F.when(F.col("operation") == "INSERT", at).otherwise(F.col("start_line")).alias("at"), "end_line")
    gaps = placed.where("operation = 'INSERT'").join(_swept_gaps(placed, worded), ["file_id", "op_ord"], "left_anti")
    gaps = gaps.select("file_id", F.col("at").alias("k1"), (F.lit(1_000_000) - F.col("op_ord")).alias("k2"), F.lit(0).alias("k3"), F.lit("\n").alias("line"))
    every = kept.unionByName(replaced).unionByName(inserted).unionByName(gaps)
    joined = every.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k1", "k2", "k3", "line"))), lambda x: x["line"]), "").alias("source"))
    files = lines.select("file_id").distinct()
    return files.join(joined, "file_id", "left").select("file_id", F.coalesce("source", F.lit("")).alias("source"))


def _swept_gaps(placed: DataFrame, worded: DataFrame) -> DataFrame:
    """(file_id, op_ord) of the INSERTs whose blank line goes with the blank lines behind a DELETE: only such stand between the two."""
    i, g, o = placed.where("operation = 'INSERT'").alias("i"), placed.where("operation = 'DELETE'").alias("g"), placed.where("operation <> 'DELETE'").alias("o")
    w = worded.select("file_id", "n", F.coalesce(F.when(F.col("is_blank"), F.col("anchor")).otherwise(F.col("n")), F.lit(0)).alias("anchor")).alias("w")
    near = i.join(g, (F.col("i.file_id") == F.col("g.file_id")) & (F.col("g.end_line") <= F.col("i.at"))).join(w, (F.col("w.file_id") == F.col("i.file_id")) & (F.col("w.n") == F.col("i.at")) & (F.col("w.anchor") <= F.col("g.end_line")))
    between = (F.col("o.file_id") == F.col("i.file_id")) & (
        ((F.col("o.operation") == "INSERT") & (F.col("o.at") >= F.col("g.end_line")) & ((F.col("o.at") < F.col("i.at")) | ((F.col("o.at") == F.col("i.at")) & (F.col("o.op_ord") > F.col("i.op_ord")))))
        | ((F.col("o.operation") == "REPLACE") & (F.col("o.at") > F.col("g.end_line")) & (F.col("o.at") <= F.col("i.at")))
    )
    return near.join(o, between, "left_anti").select("i.file_id", "i.op_ord").distinct()


@F.pandas_udf(ArrayType(IntegerType()))
def _swept_up(blank: pd.Series, at: pd.Series, end: pd.Series, kind: pd.Series, bare: pd.Series) -> pd.Series:
    return pd.Series([sweep_up(list(b), list(zip(*o))) for b, *o in zip(blank, at, end, kind, bare)], dtype=object)


def sweep_up(blank: list[bool], ops: list[tuple[int, int, str, bool]]) -> list[int]:
    """What stands in a file after its operations: n for its nth line, 0 for an empty line, -k for the content of the kth operation.

    blank tells the blank lines; ops are (at, end, kind, whether the content is blank), the lowest place in the file first; an
    INSERT's end counts for nothing. Lines
    are laid on a pile from the last one up to the operation at hand, which takes from the pile's top what it replaces or
    deletes, so the time is linear in lines and operations.
    """
    pile, left = [], len(blank)

    def is_blank(piece: int) -> bool:
        return piece == 0 or (blank[piece - 1] if piece > 0 else ops[-piece - 1][3])

    for k, (at, end, kind, _) in enumerate(ops, 1):
        first = max(at + (kind == "INSERT"), 1)
        while left >= first:
            pile.append(left)
            left -= 1
        top = max(len(pile) - (first - 1 - left), 0)  # pieces over it stand above the operation
        keep = top
        if kind != "INSERT":
            keep = max(top - max(end - first + 1, 0), 0)
        while kind == "DELETE" and keep and is_blank(pile[keep - 1]):
            keep -= 1
        pile[keep:top] = {"INSERT": [-k, 0], "REPLACE": [-k], "DELETE": []}[kind]
    pile.extend(range(left, 0, -1))
    return pile[::-1]


def apply_sequential(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_id, source) of the files that have operations, which count one after the other from the bottom up; spans may overlap.

    files(file_id, source), one row an id; ops(file_id, op_ord, operation, start_line, end_line, indent, content). A line keeps
    its end. To the operations above, content counts as one line. Equal places keep the order of op_ord. One job: a file meets
    its operations in one row, `sweep_up` gives the order of lines and contents by number, and the texts are put together by
    expressions. Null and empty sources have no lines; operations of files that are not there or without a place are left out.
    """
    insert = F.col("operation") == "INSERT"
    body = t.dedent_to(F.col("content"), F.coalesce("indent", F.lit(0)))
    is_blank = lambda x: F.regexp_replace(x, r"\s", "") == ""
    placed = ops.where(insert | (F.col("operation").isin("REPLACE", "DELETE") & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()))
    listed = placed.groupBy("file_id").agg(F.collect_list(F.struct(F.when(insert, F.col("end_line")).otherwise(F.col("start_line")).alias("at"), "op_ord", "operation", "end_line", body.alias("body"))).alias("ops"))
    met = files.select("file_id", F.filter(F.split(F.coalesce("source", F.lit("")), KEPT_ENDS, -1), lambda x: x != "").alias("lines")).join(listed, "file_id")
    # an INSERT without a place goes to the file's end
    up = F.transform("ops", lambda o: F.struct((-F.coalesce(o["at"], F.size("lines"))).alias("up"), o["op_ord"].alias("op_ord"), o["operation"].alias("operation"), o["end_line"].alias("end_line"), o["body"].alias("body")))
    met = met.withColumn("ops", F.sort_array(up))
    each = lambda f: F.transform("ops", f)
    order = _swept_up(F.transform("lines", is_blank), each(lambda o: -o["up"]), each(lambda o: F.coalesce(o["end_line"], F.lit(0))), each(lambda o: o["operation"]), each(lambda o: is_blank(o["body"])))
    piece = lambda i: F.when(i > 0, F.get("lines", i - 1)).when(i == 0, "\n").otherwise(F.get("ops", -i - 1)["body"])
    return met.withColumn("order", order).select("file_id", F.array_join(F.transform("order", piece), "").alias("source"))


def splice_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, source): files with blocks(file_id, start_line, end_line, content) put in place of those lines, several at once."""
    return apply_lines(lines, blocks.select("file_id", F.row_number().over(W.partitionBy("file_id").orderBy("start_line")).alias("op_ord"), F.lit("REPLACE").alias("operation"), "start_line", "end_line", F.lit(0).alias("indent"), "content"))


def parse_block_response(response: Column) -> Column:
    """array<struct<name, content>> of ===BLOCK: name=== ... ===END BLOCK=== sections."""
    pattern = r"(?s)===BLOCK: ([^\n]*?)===\n(.*?)\n?===END BLOCK==="
    names, bodies = (F.regexp_extract_all(response, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(names.alias("n"), bodies.alias("b")), lambda x: F.struct(F.trim(x["n"]).alias("name"), x["b"].alias("content")))


def block_outcomes(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, status, missing, blocks) of answers(run_id, response) against expected(run_id, name): a block that the response
    never has makes the run GENERATION_INCOMPLETE, else it is ok and blocks(run_id) hold the new contents by name."""
    got = answers.select("run_id", F.explode(parse_block_response(F.col("response"))).alias("b")).select("run_id", "b.*").groupBy("run_id", "name").agg(F.last("content").alias("content"))
    met = expected.join(got, ["run_id", "name"], "left")
    gone = F.array_join(F.sort_array(F.collect_list(F.when(F.col("content").isNull(), F.col("name")))), ", ")
    every = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("name", "content")))))
    return met.groupBy("run_id").agg(gone.alias("missing"), every.alias("blocks")).select("run_id", F.when(F.col("missing") == "", "ok").otherwise("GENERATION_INCOMPLETE").alias("status"), "missing", "blocks")


def rename_words(source: Column, old: str, new: str) -> Column:
    """Whole-word occurrences of an identifier replaced; the same word boundaries in Java and RE2."""
    edge = r"[^\p{L}\p{N}_]"
    once = lambda c: F.regexp_replace(c, rf"(^|{edge}){re.escape(old)}({edge}|$)", f"$1{new}$2")
    return once(once(source))  # twice: neighbours share the character between them


def rename(files: DataFrame) -> DataFrame:
    """files(file_id, source, old_name, new_name) with `renamed`: whole words, or where there are none, parts of identifiers.

    Whole words are replaced by an expression; only files that have none, but hold the name's letters, go through Python. A
    null source stays null.
    """
    edge = r"[^\p{L}\p{N}_]"
    pattern = F.concat(F.lit(rf"(^|{edge})\Q"), "old_name", F.lit(rf"\E({edge}|$)"))
    put = F.concat(F.lit("$1"), F.regexp_replace("new_name", r"([\\$])", r"\\$1"), F.lit("$2"))
    once = lambda c: F.regexp_replace(c, pattern, put)
    marked = files.select("file_id", "source", "old_name", "new_name", once(once(F.col("source"))).alias("renamed"))
    letters = lambda c: F.lower(F.translate(c, "_", ""))
    partly = F.coalesce((F.col("renamed") == F.col("source")) & F.contains(letters(F.col("source")), letters(F.col("old_name"))), F.lit(False))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(renamed=[rename_parts(s, o, n) for s, o, n in zip(f["source"], f["old_name"], f["new_name"])])[["file_id", "renamed"]]

    parts = marked.where(partly).select("file_id", "source", "old_name", "new_name").mapInPandas(run, "file_id long, renamed string")
    return marked.where(~partly).select(F.col("file_id").cast("long").alias("file_id"), "renamed").unionByName(parts)


#: The words of an identifier: a run of capitals before a capitalised word, a word with its capitals, capitals alone.
_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]*[a-z0-9]+|[A-Z]+")


def rename_parts(source: str, old: str, new: str) -> str:
    return re.sub(r"[A-Za-z_][A-Za-z0-9_]*", lambda m: rename_part(m[0], old, new), source)


def rename_part(identifier: str, old: str, new: str) -> str:
    """The identifier with the fewest neighbouring words that spell `old` replaced, in their case; else unchanged.

    Words are what stands between underscores, or in an identifier without any what changes of case set apart. The letters
    of all words are laid end to end, so a run spells `old` where old's letters stand from one word's start to another's end.
    """
    snake = "_" in identifier
    words = identifier.split("_") if snake else _WORD.findall(identifier)
    ends = list(accumulate(map(len, words)))
    spelt, wanted, best = "".join(words).lower(), old.lower(), None
    for i, start in enumerate([0, *ends[:-1]]):
        if wanted and spelt.startswith(wanted, start) and (end := start + len(wanted)) in ends:
            j = ends.index(end, i)
            if best is None or j - i < best[1] - best[0]:
                best = (i, j)
    if best is None:
        return identifier
    i, j = best
    like = words[i] if snake else "".join(words[i : j + 1])
    put = new.upper() if like.isupper() else (new[:1].upper() if like[:1].isupper() else new[:1].lower()) + new[1:]
    return ("_" if snake else "").join([*words[:i], put, *words[j + 1 :]])


def rename_sweep(files: DataFrame, ops: DataFrame) -> DataFrame:
    """(file_id, old_name, new_name): REPLACE operations that define another name while the old one still stands outside the span.

    files(file_id, source); ops with file_id, symbol_name, start_line, end_line, content.
    """
    asked = ops.where("operation = 'REPLACE'").withColumn("new_name", definition(F.col("content"), F.col("file") if "file" in ops.columns else None)).where("new_name <> symbol_name").join(files, "file_id")
    lines = t.split_lines(F.col("source"))
    outside = F.array_join(F.concat(t.line_slice(lines, F.lit(1), F.col("start_line") - 1), t.line_slice(lines, F.col("end_line") + 1, F.size(lines))), "\n")
    still = F.array_contains(F.regexp_extract_all(outside, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.col("symbol_name"))
    return asked.where(still).select("file_id", F.col("symbol_name").alias("old_name"), "new_name")


def swept(changed: DataFrame, sweeps: DataFrame) -> DataFrame:
    """changed(file_id, source) after the renames of sweeps(file_id, old_name, new_name), one after the other by old name."""
    order = W.partitionBy("file_id").orderBy("old_name", "new_name")
    turns = cut(sweeps.distinct().withColumn("turn", F.row_number().over(order)))
    for k in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        now = rename(changed.join(turns.where(F.col("turn") == k).drop("turn"), "file_id"))
        changed = cut(changed.join(now, "file_id", "left").select("file_id", F.coalesce("renamed", "source").alias("source")))
    return changed


#: Pairs of texts, and their diffs, that are Python objects at a time.
_DIFFED = 64


def diffs(pairs: DataFrame) -> DataFrame:
    """pairs(file_id, path, before, after) with the unified diff and the change ratio: changed lines over lines before (1 at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in (whole.slice(i, _DIFFED) for i in range(0, whole.num_rows, _DIFFED)):
                _, paths, before, after = (rows.column(i).to_pylist() for i in range(4))
                texts = [unified_diff(p, a or "", b or "") for p, a, b in zip(paths, before, after)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), pa.array([change_ratio(d, a or "") for d, a in zip(texts, before)], pa.float64())], names=["file_id", "diff", "change_ratio"])

    return pairs.select(F.col("file_id").cast("long").alias("file_id"), "path", "before", "after").mapInArrow(run, "file_id long, diff string, change_ratio double")


def unified_diff(path: str, before: str, after: str) -> str:
    return "".join(difflib.unified_diff(before.splitlines(keepends=True), after.splitlines(keepends=True), f"a/{path}", f"b/{path}"))


def change_ratio(diff: str, before: str) -> float:
    changed = sum(x[:1] in "+-" and x[:3] not in ("+++", "---") for x in diff.splitlines() if x)
    return changed / max(1, len(before.splitlines()))


def parse_diff(diffs_: DataFrame) -> DataFrame:
    """(file_id, pos, hunk, kind, text, new_line) of diffs(file_id, diff): add, del and ctx lines with their line in the new file.

    A deletion has the line that follows it in the new file.
    """
    rows = diffs_.select("file_id", F.posexplode(F.split("diff", "\n")).alias("pos", "line"))
    start = F.when(F.startswith("line", F.lit("@@")), F.try_to_number(F.regexp_extract("line", r"\+(\d+)", 1), F.lit("9999999999")).cast("int"))
    order = W.partitionBy("file_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("start", start).withColumn("hunk", F.count("start").over(order)).withColumn("base", F.last("start", ignorenulls=True).over(order))
    head = F.substring("line", 1, 1)
    kind = F.when(head == "+", "add").when(head == "-", "del").when(head == " ", "ctx")
    body = marked.where("hunk > 0 and start is null").withColumn("kind", kind).where("kind is not null")
    within = W.partitionBy("file_id", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    cursor = F.col("base") + F.coalesce(F.sum((F.col("kind") != "del").cast("int")).over(within), F.lit(0))
    return body.select("file_id", "pos", "hunk", "kind", F.substr("line", F.lit(2)).alias("text"), cursor.cast("int").alias("new_line"))


def ghost_blocks(parsed: DataFrame) -> DataFrame:
    """(file_id, new_line, text): the deleted lines of a parsed diff, joined, at the line of the new file that they stand before."""
    gone = parsed.where("kind = 'del'").groupBy("file_id", "new_line").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    return gone.select("file_id", "new_line", F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("text"))


def orphaned_imports(before: Column, after: Column, rest: Column) -> Column:
    """Names bound before and no longer after that the rest of the file still uses."""
    return F.filter(F.array_except(before, after), lambda n: F.array_contains(F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), n))


def cross_file_impact(renames: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, old_name, caller_id, caller_file): callers in other files of the renamed names of renames(file_id, file, old_name).

    Calls meet their callers before the renames, which go to all calls, dealt evenly, if they are few enough: what many renames of
    a name find does not move.
    """
    parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    renamed = small(renames.select("file_id", "file", "old_name"))
    asked = edges.join(small(renamed.select(F.col("old_name").alias("callee_name")).distinct()), "callee_name", "left_semi")
    callers = symbols.select(F.col("symbol_id").alias("caller_id"), F.col("file").alias("caller_file"))
    made = asked.join(callers, "caller_id").repartition(parts)
    return made.join(renamed, (F.col("old_name") == F.col("callee_name")) & (F.col("caller_file") != F.col("file"))).select("file_id", "old_name", "caller_id", "caller_file")

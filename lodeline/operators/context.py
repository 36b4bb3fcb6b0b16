"""Minimal contexts and prompts for an edit, as pure column work over located candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeline.functions import predicates as p
from lodeline.functions import text as t

# Fixed value: up to so many remaining symbols are listed with their parameters.
DETAILED_SYMBOLS = 20


def file_summary(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """(path, summary): `type name(params)` for each symbol in order, or the file itself where it has none."""
    entry = F.concat(F.col("symbol_type"), F.lit(" "), p.symbol_entry(F.col("name"), F.col("parameters"), F.array().cast("array<string>"), F.lit(True)))
    listed = metadata.groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", entry.alias("e")))), lambda x: x["e"]), "\n").alias("listed"))
    return files.join(listed, "path", "left").select("path", F.coalesce("listed", "source").alias("summary"))


def remaining_names(metadata: DataFrame, shown: DataFrame, most: int = DETAILED_SYMBOLS) -> DataFrame:
    """(request_id, file, names): the symbols of each request's file that are not shown, once a name, in order.

    shown: (request_id, file, name). Parameters are listed while no more than `most` symbols remain.
    """
    asked = shown.select("request_id", "file").distinct()
    first = metadata.groupBy("file", "name").agg(F.min(F.struct("start_line", "parameters", "decorators")).alias("m"))
    rest = asked.join(first, "file").join(shown.select("request_id", "file", "name"), ["request_id", "file", "name"], "left_anti")
    counted = rest.withColumn("left", F.count("*").over(W.partitionBy("request_id", "file")))
    entry = p.symbol_entry(F.col("name"), F.col("m.parameters"), F.col("m.decorators"), F.col("left") <= most)
    return counted.groupBy("request_id", "file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("m.start_line"), entry.alias("e")))), lambda x: x["e"]), ", ").alias("names"))


def build(candidates: DataFrame, bodies: DataFrame, symbols: DataFrame, files: DataFrame, imports: DataFrame | None = None, names: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """(request_id, file, context, context_lines, total_lines, shown): the smallest text that an edit needs.

    candidates and bodies are rankings (request_id, symbol_id, rank) of one file for each request; files: (request_id, path,
    source). A body hit that overlaps a candidate, or has its name, is left out. The context is the imports (path,
    imports), the symbols' sources, the line of other names (request_id, file, names) and a module-level block (request_id,
    block); without any candidate it is the whole source.
    """
    spans = symbols.select("symbol_id", "name", "start_line", "end_line", F.col("source").alias("body"))
    first = candidates.join(spans, "symbol_id").withColumn("tier", F.lit(0))
    second = bodies.join(spans, "symbol_id").withColumn("tier", F.lit(1))
    c, b = first.alias("c"), second.alias("b")
    near = (F.col("c.request_id") == F.col("b.request_id")) & (p.spans_overlap(F.col("c.start_line"), F.col("c.end_line"), F.col("b.start_line"), F.col("b.end_line")) | (F.col("c.name") == F.col("b.name")))
    columns = ["request_id", "symbol_id", "name", "body", "tier", "rank"]
    chosen = first.select(*columns).unionByName(b.join(c, near, "left_anti").select(*columns))
    shown = chosen.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("tier", "rank", "name", "body"))).alias("s"))
    rows = files.join(shown, "request_id", "left")
    for extra, key in ((imports, "path"), (gaps, "request_id")):
        if extra is not None:
            rows = rows.join(extra, key, "left")
    rows = rows.join(names.withColumnRenamed("file", "path"), ["request_id", "path"], "left") if names is not None else rows.withColumn("names", F.lit(None).cast("string"))
    rows = rows if imports is not None else rows.withColumn("imports", F.lit(None).cast("string"))
    rows = rows if gaps is not None else rows.withColumn("block", F.lit(None).cast("string"))
    others = F.concat(F.lit("Other symbols: "), F.col("names"))
    picked = F.concat_ws("\n\n", F.nullif(F.col("imports"), F.lit("")), F.array_join(F.transform("s", lambda x: x["body"]), "\n\n"), F.nullif(others, F.lit("")), F.col("block"))
    context = F.when(F.col("s").isNull() & F.col("block").isNull(), F.col("source")).otherwise(picked)
    return rows.select("request_id", F.col("path").alias("file"), context.alias("context"), F.size(t.split_lines(context)).alias("context_lines"), F.size(t.split_lines(F.col("source"))).alias("total_lines"), F.coalesce(F.transform("s", lambda x: x["name"]), F.array().cast("array<string>")).alias("shown"))


def prompt(*parts: tuple[str, Column]) -> Column:
    """Titled sections, empty ones left out."""
    return F.concat_ws("\n\n", *[F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), body)) for title, body in parts])


def edit_prompt(request: Column, file: Column, context: Column, names: Column | None = None) -> Column:
    return prompt(("File", file), ("Request", request), ("Code", context), *((("Other symbols", names),) if names is not None else ()))


def repair_prompt(request: Column, context: Column, failure: Column, previous: Column) -> Column:
    """The failure's detail is cut to its first 2000 characters."""
    return prompt(("Request", request), ("Code", context), ("Previous answer", previous), ("Failure", F.substring(failure, 1, 2000)))


def block_prompt(request: Column, name: Column, block: Column, before: Column, after: Column) -> Column:
    return prompt(("Request", request), ("Before", before), ("Block", F.concat(F.lit("===BLOCK: "), name, F.lit("===\n"), block, F.lit("\n===END BLOCK==="))), ("After", after))


def question_prompt(question: Column, context: Column) -> Column:
    return prompt(("Question", question), ("Code", context))


def create_prompt(request: Column, path: Column) -> Column:
    """A binary target asks for a script that writes it."""
    script = F.concat(F.lit("Write a complete Python script that creates "), path, F.lit(" when run, and does nothing else."))
    return prompt(("Request", request), ("Path", path), ("Note", F.when(p.binary_target(path), script)))


def responses(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """prompts(request_id, prompt) with the answer of answers(hash, answer), matched by the prompt's hash; the model itself is outside."""
    return prompts.withColumn("hash", F.sha2("prompt", 256)).join(answers, "hash", "left")


def confirmed_deletes(picks: DataFrame) -> DataFrame:
    """DELETE operations for picks(run_id, file, symbol_type, symbol_name, start_line); the line tells equal names apart."""
    order = W.partitionBy("run_id").orderBy("start_line")
    return picks.select("run_id", (F.row_number().over(order) - 1).alias("op_ord"), F.lit("DELETE").alias("operation"), "file", "symbol_type", "symbol_name", F.lit(None).cast("string").alias("anchor"), F.lit(None).cast("string").alias("content"), F.col("start_line").alias("prefer_line"))


def run_summary(runs: DataFrame) -> DataFrame:
    """(run_id, line_no, line): a report of runs(run_id, status, strategy, version_id, change_ratio, context_lines, total_lines, n_ops, input_tokens, output_tokens, cost_usd, latency_ms, retry_count)."""
    shown = ["status", "strategy", "version_id", "change_ratio", "context_lines", "total_lines", "n_ops", "input_tokens", "output_tokens", "cost_usd", "latency_ms", "retry_count"]
    lines = F.array(*[F.concat(F.rpad(F.lit(c), 16, " "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in shown])
    return runs.select("run_id", F.posexplode(lines).alias("line_no", "line"))

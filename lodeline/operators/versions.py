"""Append-only versions, runs and their cost, telemetry and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# US dollars for 1000 input, output and cached tokens.
PRICES = {"openai/gpt-5.4": (0.0025, 0.015, 0.00025), "gpt-5.4": (0.0025, 0.015, 0.00025)}


def chain(commits: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """commits(project_id, created_at, ...) with version_n, parent_n and version_id, numbered in commit order after start(project_id, head).

    Ties in time go by `commit_id`. Numbers come from the order of commits, so appends cannot give one number twice.
    """
    order = W.partitionBy("project_id").orderBy("created_at", "commit_id")
    base = commits.join(start, "project_id", "left").withColumn("head", F.coalesce("head", F.lit(0))) if start is not None else commits.withColumn("head", F.lit(0))
    n = (F.row_number().over(order) + F.col("head")).cast("int")
    return base.withColumn("version_n", n).withColumn("parent_n", F.when(F.col("version_n") > 1, F.col("version_n") - 1)).withColumn("version_id", F.concat(F.lit("v"), "version_n")).drop("head")


def head(versions: DataFrame) -> DataFrame:
    return versions.groupBy("project_id").agg(F.max("version_n").alias("head"))


def as_of(checkpoints: DataFrame, version: Column | int) -> DataFrame:
    """(project_id, filename, content) as of a version: the last write of each file up to it, unless that deletes it (an extension)."""
    order = W.partitionBy("project_id", "filename").orderBy(F.desc("version_n"))
    last = checkpoints.where(F.col("version_n") <= version).withColumn("k", F.row_number().over(order)).where("k = 1 and not deleted")
    return last.select("project_id", "filename", "content", "version_n")


def price_table(spark, override: str | None = None) -> DataFrame:
    """Prices with those of a JSON object {model: [input, output, cached]} on top; no third price: input's; bad JSON: none."""
    base = spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, input double, output double, cached double")
    if not override:
        return base
    parsed = spark.range(1).select(F.explode(F.from_json(F.lit(override), "map<string, array<double>>")).alias("model", "p")).where("size(p) >= 2")
    over = parsed.select("model", F.col("p")[0].alias("input"), F.col("p")[1].alias("output"), F.coalesce(F.get("p", 2), F.col("p")[0]).alias("cached"))
    return base.join(over, "model", "left_anti").unionByName(over)


def cost(input_tokens: Column, output_tokens: Column, cached_tokens: Column, input_price: Column, output_price: Column, cached_price: Column) -> Column:
    """US dollars, rounded to six places; cached tokens are clamped to the input; an unknown model costs nothing."""
    cached = F.greatest(F.lit(0), F.least(cached_tokens, input_tokens))
    paid = (input_tokens - cached) / 1000 * F.coalesce(input_price, F.lit(0.0)) + cached / 1000 * F.coalesce(cached_price, F.lit(0.0)) + output_tokens / 1000 * F.coalesce(output_price, F.lit(0.0))
    return F.round(paid, 6)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls(run_id, attempt, model, input_tokens, cached_tokens, output_tokens, latency_ms) with cost_usd; prices is a small dimension."""
    priced = calls.join(prices, "model", "left")
    return priced.withColumn("cost_usd", cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("input"), F.col("output"), F.col("cached"))).drop("input", "output", "cached")


def fold_runs(costs: DataFrame) -> DataFrame:
    """One row for each run: tokens, latency and cost of all its calls, and retries."""
    return costs.groupBy("run_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency_ms").alias("latency_ms"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"), (F.count("*") - 1).alias("retry_count"),
    )


def best_attempt(attempts: DataFrame, most_repairs: int = 2) -> DataFrame:
    """attempts(run_id, attempt, status, ...): the first that is ok within the allowed repairs, else the last of them."""
    order = W.partitionBy("run_id").orderBy(F.desc(F.col("status") == "ok"), F.when(F.col("status") == "ok", F.col("attempt")).otherwise(-F.col("attempt")))
    return attempts.where(F.col("attempt") <= most_repairs + 1).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def fingerprint(files: DataFrame, by: str = "project_id") -> DataFrame:
    """One hash for each group over its files' sorted (path, mtime_ns, size)."""
    entry = F.concat_ws(":", "path", F.col("mtime_ns").cast("string"), F.col("size").cast("string"))
    return files.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), "\n"), 256).alias("fingerprint"), F.count("*").alias("n_files"))


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not among known(path, hash): those to index again."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key."""
    best = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key"), F.col(order).alias("order"))
    return best.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.desc("order")))).where("nth = 1").select("row.*")


def run_id(*parts: Column) -> Column:
    """A reproducible id from a run's inputs."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 12)


def symbol_counts(metadata: DataFrame, by: str = "project_id") -> DataFrame:
    """(project, n_files, n_symbols): a project's distinct files and its symbols."""
    return metadata.groupBy(by).agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_symbols"))


def run_records(runs: DataFrame, deltas: DataFrame) -> DataFrame:
    """(project_id, key, body): what is kept of runs(project_id, run_id, ...) and of deltas(project_id, run_id, attempt, body), of
    which runs without a delta have none; attempts are numbered where there are several."""
    record = runs.select("project_id", F.concat(F.lit("benchmarks/"), "run_id").alias("key"), F.to_json(F.struct(*runs.columns)).alias("body"))
    suffix = F.when(F.col("attempt").isNull(), F.lit("")).otherwise(F.concat(F.lit("-attempt"), F.col("attempt").cast("string")))
    return record.unionByName(deltas.where("body is not null").select("project_id", F.concat(F.lit("deltas/"), "run_id", suffix).alias("key"), "body"))


def persist_runs(records: DataFrame, location: str) -> None:
    """Appends records to a store that is partitioned by project; of a key that is written again the last counts."""
    records.withColumn("written_at", F.current_timestamp()).write.mode("append").partitionBy("project_id").parquet(location)


def persisted_runs(spark, location: str) -> DataFrame:
    """(project_id, key, body) as last written."""
    order = W.partitionBy("project_id", "key").orderBy(F.desc("written_at"))
    rows = spark.read.parquet(location).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return rows.select(F.col("project_id").cast("string").alias("project_id"), "key", "body")

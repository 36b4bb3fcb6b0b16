"""The engine's front door: find, edit, create, confirm, metadata and tree over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import predicates, text
from lodeline.operators import blocks, delta, graph, retrieval, targets, versions
from lodeline.plans.lineage import cut
from lodeline.plans.settings import Settings
from lodeline.plans.settings import project_id as name_of
from lodeline.sources import code, files, pages


class Engine:
    """One project's files; symbols and call edges are derived once and reused. Requests come as (request_id, text).

    on_step(step, detail) is called by the driver as a plan is put together; nothing waits for it.
    """

    def __init__(self, spark: SparkSession, project: DataFrame | str, project_id: str | None = None, settings: Settings | None = None, on_step: Callable[[str, str], None] | None = None):
        self.spark, self.settings = spark, settings or Settings.of(spark)
        self.on_step = on_step or (lambda step, detail: None)
        self.project_id = name_of(project_id, project if isinstance(project, str) else None, self.settings)
        if isinstance(project, str):
            self.files = files.scan(spark, project, self.settings.ignore_file)
        else:
            self.files = project if "language" in project.columns else files.detect_language(project)
        self._symbols: DataFrame | None = None
        self._edges: DataFrame | None = None

    @property
    def symbols(self) -> DataFrame:
        if self._symbols is None:
            self._symbols = code.symbols(self.files).persist()
        return self._symbols

    @property
    def edges(self) -> DataFrame:
        if self._edges is None:
            self._edges = graph.call_edges(code.calls(self.symbols), self.symbols).persist()
        return self._edges

    def close(self) -> None:
        for df in (self._symbols, self._edges):
            if df is not None:
                df.unpersist()

    def find(self, requests: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
        self.on_step("LOCALIZE", "ranking symbols")
        if vectors is None:
            vectors = retrieval.optional_vectors(requests, self.symbols, self.settings.embeddings, retrieval.WIDTH * k)
        return retrieval.locate(requests, self.symbols, self.edges, vectors, k, sites=code.call_lines(self.files))

    def best_file(self, requests: DataFrame) -> DataFrame:
        return retrieval.locate_best_file(requests, self.symbols)

    def text_blocks(self) -> DataFrame:
        rows = self.files.where("not has_symbols").select(F.xxhash64("path").alias("file_id"), "path", "source", "language")
        return blocks.text_blocks(rows, pages.html_blocks(rows.where("language = 'html'")))

    def routes(self, requests: DataFrame) -> DataFrame:
        """(request_id, file, route): the first that applies of rename, multi_delete, delete, needs_selection, delete_file, blocks, structured_edit.

        requests: (request_id, text, file, kind, kind_confidence); the last two may be null.
        """
        scoped = self.symbols
        renames = targets.rename_target(requests, scoped).select("request_id", F.lit(True).alias("is_rename"))
        deletes = requests.where(predicates.delete_intent(F.col("text")))
        many = targets.multi_delete(deletes, scoped).select("request_id").distinct().withColumn("is_many", F.lit(True))
        found = targets.delete_candidates(deletes, scoped).groupBy("request_id").agg(F.count_distinct("symbol_id").alias("n_candidates"))
        rows = requests.join(renames, "request_id", "left").join(many, "request_id", "left").join(found, "request_id", "left")
        rows = rows.join(self.files.select(F.col("path").alias("file"), "has_symbols"), "file", "left")
        route = (
            F.when(F.col("is_rename"), "rename")
            .when(F.col("is_many"), "multi_delete")
            .when(F.col("n_candidates") == 1, "delete")
            .when(F.col("n_candidates") > 1, "needs_selection")
            .when(predicates.whole_file_delete(F.col("text"), F.col("file")), "delete_file")
            .when(~F.coalesce("has_symbols", F.lit(True)), "blocks")
            .otherwise(F.coalesce(predicates.accepted_kind(F.col("kind"), F.col("kind_confidence")), F.lit("structured_edit")))
        )
        return rows.select("request_id", "file", route.alias("route"))

    def edit(self, deltas: DataFrame, shown: DataFrame | None = None, prefer: DataFrame | None = None) -> DataFrame:
        """(run_id, file, status, error, source, diff, change_ratio, syntax_errors, operations, orphaned, impact) of deltas(run_id, file, body).

        Deltas are parsed and validated; the files of runs all of whose operations hold are rewritten. Where a REPLACE defines
        another name and the old one still stands elsewhere in the file, it is swept through the file. The result is diffed
        and checked; `operations` have their line ranges, `orphaned` the imported names that are gone and still used, `impact`
        the callers of renamed symbols in other files. A run whose delta is sound but empty is a no-op. prefer(run_id,
        symbol_name, prefer_line) tells symbols of one type and name in a file apart.
        """
        self.on_step("VALIDATE", "reading deltas")
        parsed = delta.parse(deltas.select("run_id", F.regexp_replace("body", "^\\s+", "").alias("body")))
        own = deltas.select("run_id", F.col("file").alias("own_file"))
        ops = delta.operations(parsed).join(own, "run_id").withColumn("file", F.coalesce("file", "own_file")).drop("own_file")
        if prefer is not None:
            ops = ops.join(prefer.select("run_id", F.col("symbol_name").alias("preferred"), "prefer_line"), (ops.run_id == prefer.run_id) & (F.coalesce("anchor", ops.symbol_name) == F.col("preferred")), "left").select(*[ops[c] for c in ops.columns], "prefer_line")
        sources = self.files.select(F.col("path").alias("file"), "source", "language")
        edited = sources.join(ops.select("file").distinct(), "file", "left_semi")
        numbered = ops.select("run_id", "file").distinct().join(sources, "file").withColumn("file_id", F.xxhash64("run_id", "file"))
        checked = delta.validate_targets(ops, self.symbols, shown, blocks.line_table(edited.withColumnRenamed("file", "file_id")).withColumnRenamed("file_id", "file")).withColumn("file_id", F.xxhash64("run_id", "file"))
        checked = cut(checked)  # what follows reads it many times
        bad = checked.where("status <> 'OK'").groupBy("run_id").agg(F.min("status").alias("failed"))
        good = checked.join(bad, "run_id", "left_anti")
        changed = delta.apply_sequential(numbered.select("file_id", "source"), good)
        self.on_step("APPLY", "rewriting files")
        sweeps = cut(delta.rename_sweep(numbered.select("file_id", "source"), good))
        changed = delta.swept(cut(changed), sweeps)
        pairs = numbered.join(changed.withColumnRenamed("source", "after"), "file_id").select("file_id", "run_id", F.col("file").alias("path"), F.col("source").alias("before"), "after", "language")
        pairs = cut(pairs)
        diffed = delta.diffs(pairs)
        errors = code.syntax_errors(pairs.select(F.col("file_id").cast("string").alias("path"), F.col("after").alias("source"), "language")).select(F.col("path").cast("long").alias("file_id"), "errors")
        python = pairs.where("language = 'python'")
        bound = lambda c: code.imports(python.select(F.col("file_id").cast("string").alias("path"), F.col(c).alias("source"), "language")).groupBy(F.col("path").cast("long").alias("file_id")).agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias(f"bound_{c}"))
        none = F.array().cast("array<string>")
        kept = python.select("file_id", "after").join(bound("before"), "file_id").join(bound("after"), "file_id", "left")
        orphans = kept.select("file_id", F.sort_array(delta.orphaned_imports(F.col("bound_before"), F.coalesce("bound_after", none), F.col("after"))).alias("orphaned"))
        ranges = delta.annotated(good, sources.select("file", F.size(text.split_lines(F.col("source"))).alias("n_lines")))
        listed = ranges.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("op_ord", "operation", "symbol_name", "line_range"))).alias("operations"))
        own_file = numbered.select("file_id", F.col("file").alias("own"))
        hit = delta.cross_file_impact(sweeps.join(own_file, "file_id").select("file_id", F.col("own").alias("file"), "old_name"), self.edges, self.symbols)
        impact = hit.groupBy("file_id").agg(F.sort_array(F.collect_set("caller_file")).alias("impact"))
        done = pairs.join(diffed, "file_id").join(errors, "file_id").join(orphans, "file_id", "left").join(listed, "file_id", "left").join(impact, "file_id", "left")
        done = done.select("run_id", F.col("path").alias("file"), "after", "diff", "change_ratio", "errors", "operations", F.coalesce("orphaned", none).alias("orphaned"), F.coalesce("impact", none).alias("impact"))
        rows = parsed.select("run_id", "valid", "error", F.size("delta.operations").alias("n_ops")).join(bad, "run_id", "left").join(done, "run_id", "left")
        status = (
            F.when(~F.col("valid"), "SCHEMA_ERROR")
            .when(F.col("n_ops") == 0, "NO_OP")
            .when(F.col("failed") == "UNSEEN_REPLACE", "WHOLE_FILE_BLOCKED")
            .when(F.col("failed").isNotNull(), "REFERENCE_ERROR")
            .when(F.size("errors") > 0, "SYNTAX_ERROR")
            .otherwise("ok")
        )
        return rows.select("run_id", "file", status.alias("status"), F.coalesce("error", "failed").alias("error"), F.col("after").alias("source"), "diff", "change_ratio", F.col("errors").alias("syntax_errors"), "operations", "orphaned", "impact")

    def plan_create(self, requests: DataFrame) -> DataFrame:
        """(request_id, path, status, source) of requests(request_id, path, content): a path that exists is refused, fences are stripped."""
        known = self.files.select("path", F.lit(True).alias("known"))
        checked = requests.join(known, "path", "left").withColumn("source", text.strip_fences(F.col("content")))
        # each request's own content is judged, by a key of its own; the path tells the language
        keyed = files.detect_language(checked.select(F.to_json(F.struct("request_id", "path")).alias("key"), "path", "source")).drop("path").withColumnRenamed("key", "path").distinct()
        errors = code.syntax_errors(keyed).groupBy("path").agg(F.max(F.size("errors") > 0).alias("bad")).withColumnRenamed("path", "key")
        rows = checked.withColumn("key", F.to_json(F.struct("request_id", "path"))).join(errors, "key", "left")
        status = F.when(F.col("known"), "EXISTS").when(predicates.binary_target(F.col("path")), "BINARY").when(F.col("bad"), "SYNTAX_ERROR").otherwise("ok")
        return rows.select("request_id", "path", status.alias("status"), "source").dropDuplicates(["request_id", "path"])

    def commit(self, accepted: DataFrame, start: DataFrame | None = None) -> DataFrame:
        """Version rows for accepted(project_id, commit_id, created_at, ...)."""
        return versions.chain(accepted, start)

    def metadata(self) -> DataFrame:
        """Symbol metadata with callers, and block metadata for files that have no symbols."""
        rows = code.metadata(self.files)
        callers = graph.called_by(self.edges)
        found = rows.join(callers, "name", "left").withColumn("called_by_count", F.coalesce("called_by_count", F.lit(0)))
        plain = self.files.join(rows.select(F.col("file").alias("path")).distinct(), "path", "left_anti").select(F.xxhash64("path").alias("file_id"), "path", "source", "language")
        blocks_ = blocks.text_blocks(plain, pages.html_blocks(plain.where("language = 'html'")))
        extra = code.block_metadata(blocks_, blocks.line_table(plain), plain.select("file_id", "path", "language")).withColumn("called_by_count", F.lit(0).cast("long"))
        return found.unionByName(extra)

    def outcomes(self, requests: DataFrame, answers: DataFrame | None = None) -> DataFrame:
        """(request_id, file, route, outcome, target, answer) for requests whose route needs no delta.

        delete_file: the file goes, `target` null; whole_file with a target extension: the file's path with it, CONVERT;
        question: the answer of answers(request_id, answer), ANSWERED or UNANSWERED. Other routes: EDIT. requests:
        (request_id, text, file, kind, kind_confidence, extension), the last three may be null.
        """
        self.on_step("ROUTE", "choosing a path")
        routed = self.routes(requests).join(requests.select("request_id", "extension"), "request_id")
        rows = routed.join(answers, "request_id", "left") if answers is not None else routed.withColumn("answer", F.lit(None).cast("string"))
        convert = (F.col("route") == "whole_file") & F.col("extension").isNotNull()
        outcome = (
            F.when(F.col("route") == "delete_file", "DELETE_FILE").when(convert, "CONVERT")
            .when(F.col("route") == "question", F.when(F.col("answer").isNotNull(), "ANSWERED").otherwise("UNANSWERED")).otherwise("EDIT")
        )
        target = F.when(convert, predicates.conversion_target(F.col("file"), F.col("extension")))
        return rows.select("request_id", "file", "route", outcome.alias("outcome"), target.alias("target"), "answer")

    def tree(self) -> DataFrame:
        return files.listing(self.files)

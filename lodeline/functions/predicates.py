"""Predicates and small classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as t

# Words whose presence makes a change risky.
HIGH_RISK_WORDS = (
    "auth", "password", "secret", "token", "crypto", "encrypt", "decrypt", "serialize", "deserialize", "pickle", "thread", "lock", "concurrent", "async",
    "session", "permission", "admin", "sql", "query",
)
# Extensions of binary artefacts, and the library that writes each.
BINARY_WRITERS = {
    ".xlsx": "openpyxl", ".xls": "openpyxl", ".docx": "python-docx (import docx)", ".pptx": "python-pptx (import pptx)", ".pdf": "reportlab",
    ".db": "sqlite3 (standard library)", ".sqlite": "sqlite3 (standard library)", ".sqlite3": "sqlite3 (standard library)",
}
# Kinds of requests that are dispatched, and the confidence that takes.
DISPATCHED_KINDS, KIND_CONFIDENCE = ("question", "whole_file"), 0.80


def risk(name: Column, kind: Column, source: Column) -> Column:
    """HIGH for risky words or a public class, LOW for a private name, else MEDIUM."""
    risky = F.concat_ws(" ", name, source).rlike("(?i)" + t.word_bound("|".join(HIGH_RISK_WORDS)))
    private = F.startswith(name, F.lit("_"))
    return F.when(risky | ((kind == "class") & ~private), "HIGH").when(private, "LOW").otherwise("MEDIUM")


def delete_intent(request: Column) -> Column:
    """Whether the request's first word is a delete verb."""
    return F.coalesce(F.regexp_extract(F.lower(request), r"^\s*(\S+)", 1).isin(*t.DELETE_VERBS), F.lit(False))


def whole_file_delete(request: Column, path: Column) -> Column:
    """A delete request all of whose other words stand in the file's name; none left: true."""
    verb = F.regexp_extract(F.lower(request), r"^\s*(\S+)", 1)
    rest = F.array_except(t.words(request), F.array(verb, F.lit("file")))
    base, stem = F.lower(t.base_name(path)), F.lower(t.stem(path))
    return delete_intent(request) & F.forall(rest, lambda w: F.contains(base, w) | F.contains(stem, w))


def binary_target(path: Column) -> Column:
    return F.coalesce(t.suffix(path).isin(*BINARY_WRITERS), F.lit(False))


def conversion_target(path: Column, extension: Column) -> Column:
    """The path with another extension."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("."), F.regexp_replace(extension, r"^\.+", ""))


def accepted_kind(choice: Column, confidence: Column, threshold: float = KIND_CONFIDENCE) -> Column:
    """The pre-classified kind where it is confident and dispatched, else null."""
    return F.when((confidence >= threshold) & choice.isin(*DISPATCHED_KINDS), choice)


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def strictly_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end) & ((a_start != b_start) | (a_end != b_end))


def failure_class(error: Column, message: Column) -> Column:
    """The failure class of an error by its kind and message."""
    return (
        F.when(error == "SyntaxCheckError", "SYNTAX_ERROR")
        .when(error == "ApplyError", "PATCH_CONFLICT")
        .when(error == "TestFailure", "TEST_FAILURE")
        .when(error.isin("DeltaValidationError", "AmbiguousSymbolError", "UnseenReplaceTargetError"), F.when(F.contains(message, F.lit("schema validation failed")), "SCHEMA_ERROR").otherwise("REFERENCE_ERROR"))
        .otherwise("UNKNOWN")
    )


def test_summary(output: Column, return_code: Column) -> Column:
    """struct(passed, failed, errors, tests_passed, no_tests_collected) of a test runner's output."""
    count = lambda word: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(output, rf"(\d+) {word}", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(count("passed").alias("passed"), count("failed").alias("failed"), count("error").alias("errors"), return_code.isin(0, 5).alias("tests_passed"), (return_code == 5).alias("no_tests_collected"))


def unrelated_collection_error(detail: Column, path: Column) -> Column:
    """The file a test runner could not collect, unless it is the edited one; else null."""
    found = F.regexp_extract(detail, r"ERROR collecting (\S+)", 1)
    own = (found == path) | F.endswith(found, F.concat(F.lit("/"), path)) | F.endswith(path, F.concat(F.lit("/"), found))
    return F.when((found != "") & ~own, found)


def test_candidates(path: Column) -> Column:
    """Where the tests of a file may stand, in order of preference."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    under = F.when(parent == "", F.lit("")).otherwise(F.concat(parent, F.lit("/")))
    base, stem = t.base_name(path), t.stem(path)
    test, after = F.concat(F.lit("test_"), base), F.concat(stem, F.lit("_test"), F.regexp_extract(base, r".(\.[^.]*)$", 1))
    return F.array(F.concat(under, test), F.concat(under, after), F.concat(under, F.lit("tests/"), test), F.concat(under, F.lit("tests/"), after), F.concat(F.lit("tests/"), under, test), F.concat(F.lit("tests/"), test))


def narrowed_test_target(edits: DataFrame, files: DataFrame) -> DataFrame:
    """edits(run_id, file, test_target) with `target`: the default "." becomes the first test file of the edited one that is there
    among files(path), else its folder; a target that was asked for stays."""
    asked = edits.where("test_target = '.'").select("run_id", "file", F.posexplode(test_candidates(F.col("file"))).alias("preference", "path"))
    found = asked.join(files.select("path").distinct(), "path", "left_semi").groupBy("run_id", "file").agg(F.min_by("path", "preference").alias("found"))
    folder = F.nullif(F.regexp_extract("file", r"^(.*)/[^/]*$", 1), F.lit(""))
    narrowed = F.when(F.col("test_target") == ".", F.coalesce("found", folder, "test_target")).otherwise(F.col("test_target"))
    return edits.join(found, ["run_id", "file"], "left").select(*edits.columns, narrowed.alias("target"))


def trivial_delegate(lines: Column, start: Column, end: Column, indent: Column, parent: Column, name: Column) -> Column:
    """A module-level symbol of two or three worded lines whose body calls parent.name( ."""
    body = F.filter(t.line_slice(lines, start, end), lambda x: F.trim(x) != "")
    inner = F.array_join(F.slice(body, 2, F.greatest(F.size(body), F.lit(1))), "\n")
    return (indent == 0) & F.size(body).between(2, 3) & F.contains(inner, F.concat(parent, F.lit("."), name, F.lit("(")))


def path_within(path: Column, root: Column) -> Column:
    """Whether a normalised path stays under root: no step upwards and root as its head."""
    return (F.startswith(path, F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))) | (path == root)) & ~path.rlike(r"(^|/)\.\.(/|$)")


def operation_line(operation: Column, name: Column, anchor: Column, start: Column, end: Column) -> Column:
    """A fixed-width line for one operation: name, anchor and line range."""
    lines = F.when(start.isNull(), F.lit("")).when(end.isNull(), F.format_string("after line %d", start)).otherwise(F.format_string("lines %d-%d", start, end))
    return F.rtrim(F.concat(F.rpad(operation, 8, " "), F.rpad(F.concat(name, F.coalesce(F.concat(F.lit(" after "), anchor), F.lit(""))), 40, " "), lines))


def symbol_entry(name: Column, parameters: Column, decorators: Column, detailed: Column) -> Column:
    """name(params) @decorators; parameters only where `detailed`."""
    shown = F.when(detailed, F.concat(name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))).otherwise(name)
    return F.concat(shown, F.when(F.size(decorators) > 0, F.concat(F.lit(" @"), F.array_join(decorators, " @"))).otherwise(""))

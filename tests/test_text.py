import re
import textwrap

import pytest
from pyspark.sql import functions as F

from lodeline.functions import predicates as p
from lodeline.functions import text as t


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "x\n\ny\r\n"])
def test_lines_are_pythons(spark, text):
    assert one(spark, t.split_lines(F.col("s")), s=text) == text.splitlines()


def test_words(spark):
    assert set(one(spark, t.words(F.col("s")), s="Add the OAuth2 check_password to the file")) == {"add", "oauth2", "check", "password", "file"}
    assert one(spark, t.content_words(F.col("s")), s="add validation to the divide function x1") == ["validation", "divide"]
    assert one(spark, t.bm25_tokens(F.col("s")), s="getUserName getUserName v2") == ["get", "user", "name", "get", "user", "name", "v2"]


def test_compress_keeps_negations(spark):
    text = "Really, the model must not just drop a the word; it simply can't."
    got = one(spark, t.compress(F.col("s")), s=text)
    assert got == ", model must not drop word; it can't."
    assert one(spark, t.words_preserved(F.col("a"), F.col("b")), a=text, b=got)
    assert not one(spark, t.words_preserved(F.col("a"), F.col("b")), a="do not", b="do")


def test_small_projections(spark):
    assert one(spark, t.bare_name(F.col("s")), s="load_key(path)") == "load_key"
    assert one(spark, t.strip_fences(F.col("s")), s="```python\nx = 1\n```") == "x = 1\n"
    assert [one(spark, t.match_case(F.lit("newName"), F.col("s")), s=s) for s in ("OLD", "Old", "old")] == ["NEWNAME", "NewName", "newName"]
    assert [one(spark, t.stem(F.col("s")), s=s) for s in ("a/b.tar.gz", "a/.env", "b")] == ["b.tar", ".env", "b"]
    assert [one(spark, t.suffix(F.col("s")), s=s) for s in ("a/b.PY", "a.b/c", ".env")] == [".py", "", ""]


@pytest.mark.parametrize("content", ["def f():\n    return 1\n", "    def f():\n        return 1\n\n        # x", "", "x"])
def test_dedent(spark, content):
    want = "\n".join("  " + r if r.strip() else "" for r in textwrap.dedent(content.rstrip("\n")).split("\n")) + "\n"
    got = one(spark, t.dedent_to(F.col("s"), F.lit(2)), s=content)
    assert got == (want if content else "\n")


def test_predicates(spark):
    assert one(spark, p.risk(F.lit("f"), F.lit("function"), F.col("s")), s="x = check_password()") == "MEDIUM"
    assert one(spark, p.risk(F.lit("f"), F.lit("function"), F.col("s")), s="the Password is") == "HIGH"
    assert one(spark, p.risk(F.lit("Big"), F.lit("class"), F.col("s")), s="") == "HIGH"
    assert one(spark, p.risk(F.lit("_f"), F.lit("function"), F.col("s")), s="") == "LOW"
    assert one(spark, p.delete_intent(F.col("s")), s="  Remove x") and not one(spark, p.delete_intent(F.col("s")), s="")
    assert one(spark, p.whole_file_delete(F.col("s"), F.lit("src/calculator.py")), s="delete the calculator file")
    assert one(spark, p.whole_file_delete(F.col("s"), F.lit("src/calculator.py")), s="delete this file")
    assert not one(spark, p.whole_file_delete(F.col("s"), F.lit("src/calculator.py")), s="delete the add function")
    assert one(spark, p.binary_target(F.col("s")), s="out/Report.XLSX") and not one(spark, p.binary_target(F.col("s")), s="a.py")
    assert one(spark, p.conversion_target(F.col("s"), F.lit("..py")), s="x/SHA.go") == "x/SHA.py"
    summary = one(spark, p.test_summary(F.col("s"), F.lit(1)), s="== 2 failed, 3 passed, 1 error in 0.1s ==")
    assert (summary["passed"], summary["failed"], summary["errors"], summary["tests_passed"]) == (3, 2, 1, False)
    assert one(spark, p.unrelated_collection_error(F.col("s"), F.lit("a.py")), s="ERROR collecting tests/b.py - x") == "tests/b.py"
    assert one(spark, p.unrelated_collection_error(F.col("s"), F.lit("a.py")), s="ERROR collecting src/a.py - x") is None
    assert one(spark, p.test_candidates(F.col("s")), s="pkg/mod.py")[:3] == ["pkg/test_mod.py", "pkg/mod_test.py", "pkg/tests/test_mod.py"]
    assert one(spark, p.accepted_kind(F.col("s"), F.lit(0.8)), s="question") == "question" and one(spark, p.accepted_kind(F.col("s"), F.lit(0.79)), s="question") is None
    assert one(spark, p.path_within(F.col("s"), F.lit("/a")), s="/a/b") and not one(spark, p.path_within(F.col("s"), F.lit("/a")), s="/a/../b")
    assert re.search("lines 3-4", one(spark, p.operation_line(F.col("s"), F.lit("f"), F.lit(None).cast("string"), F.lit(3), F.lit(4)), s="REPLACE"))

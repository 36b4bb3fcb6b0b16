from pyspark.sql import functions as F

from lodeline.operators import context


def test_build(spark):
    symbols = spark.createDataFrame([(1, "f", 3, 5, "def f(): 1"), (2, "g", 7, 8, "def g(): 2"), (3, "A", 1, 9, "class A: all")], "symbol_id long, name string, start_line int, end_line int, source string")
    files = spark.createDataFrame([(0, "m.py", "a\nb\nc\n"), (1, "n.py", "x\n")], "request_id long, path string, source string")
    ranks = "request_id long, symbol_id long, rank int"
    got = {r["request_id"]: r for r in context.build(spark.createDataFrame([(0, 1, 1)], ranks), spark.createDataFrame([(0, 3, 1), (0, 2, 2)], ranks), symbols, files, spark.createDataFrame([("m.py", "import os")], "path string, imports string")).collect()}
    assert got[0]["context"] == "import os\n\ndef f(): 1\n\ndef g(): 2" and got[0]["shown"] == ["f", "g"] and got[0]["total_lines"] == 3
    assert got[1]["context"] == "x\n" and got[1]["context_lines"] == 1


def test_names_and_summary(spark):
    meta = spark.createDataFrame([("m.py", "f", "function", 1, ["a"], ["dec"]), ("m.py", "g", "function", 4, [], []), ("m.py", "g", "function", 9, ["z"], [])], "file string, name string, symbol_type string, start_line int, parameters array<string>, decorators array<string>")
    shown = spark.createDataFrame([(0, "m.py", "g")], "request_id long, file string, name string")
    assert context.remaining_names(meta, shown).first()["names"] == "f(a) @dec"
    assert context.remaining_names(meta, shown, most=0).first()["names"] == "f @dec"
    files = spark.createDataFrame([("m.py", "src"), ("x.txt", "text")], "path string, source string")
    assert {r["path"]: r["summary"] for r in context.file_summary(meta, files).collect()} == {"m.py": "function f(a)\nfunction g()\nfunction g(z)", "x.txt": "text"}


def test_prompts_and_reports(spark):
    one = spark.createDataFrame([("fix it", "a.xlsx", "")], "r string, path string, empty string")
    assert one.select(context.edit_prompt(F.col("r"), F.col("path"), F.col("empty"))).first()[0] == "File:\na.xlsx\n\nRequest:\nfix it"
    assert "Python script" in one.select(context.create_prompt(F.col("r"), F.col("path"))).first()[0]
    picks = spark.createDataFrame([("r", "m.py", "function", "f", 9), ("r", "m.py", "function", "f", 2)], "run_id string, file string, symbol_type string, symbol_name string, start_line int")
    assert [(r["op_ord"], r["prefer_line"]) for r in context.confirmed_deletes(picks).orderBy("op_ord").collect()] == [(0, 2), (1, 9)]
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "request_id long, prompt string")
    answers = prompts.where("request_id = 1").select(F.sha2("prompt", 256).alias("hash"), F.lit("yes").alias("answer"))
    assert {r["request_id"]: r["answer"] for r in context.responses(prompts, answers).collect()} == {1: "yes", 2: None}

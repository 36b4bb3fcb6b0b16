"""Rankings that common words do not blow up, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as t
from lodeline.operators import blocks, graph, retrieval, targets


def phrases(rng, n, most):
    words = ["head", "tail", "part", "the", "é"] + [f"w{i}" for i in range(12)]
    return [rng.choice([" ", "_"]).join(rng.choices(words, [8, 5, 5, 3, 1] + [1] * 12, k=rng.randint(1, most))) for _ in range(n)]


@pytest.fixture()
def few(monkeypatch):
    monkeypatch.setattr(retrieval, "COMMON", 4)


def test_best_named_blocks(spark, few):
    rng = random.Random(3)
    named = spark.createDataFrame([(i, rng.randint(0, 5), n) for i, n in enumerate([*phrases(rng, 150, 3), "", "é", "the"])], "symbol_id long, ordinal int, name string")
    asked = spark.createDataFrame(list(enumerate(phrases(rng, 60, 6))), "request_id long, text string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    for k in (1, 2, 5):
        got = rows(blocks.name_ranking(asked, named, k))
        assert got == rows(blocks.name_ranking(asked, named).where(F.col("rank") <= k)) and len(got) > 50 * k
    assert rows(blocks.locate_block(asked, named)) == rows(blocks.untied(blocks.name_ranking(asked, named)))


def test_best_module_blocks(spark, few):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 5), f"f{i}", "gap", "block", 1, 2, 0, None, None, s, "text") for i, s in enumerate(phrases(rng, 150, 5))]
    gaps = spark.createDataFrame(rows, "symbol_id long, ordinal int, file string, name string, symbol_type string, start_line int, end_line int, indent int, parent_class string, docstring_first_line string, source string, language string")
    asked = spark.createDataFrame(list(enumerate([*phrases(rng, 60, 6), *[f"head tail part part{i} w{i % 12} w{i % 5}" for i in range(40)]])), "request_id long, text string")
    got = {tuple(r) for r in blocks.locate_module_block(asked, gaps).collect()}
    assert got == {tuple(r) for r in blocks.untied(retrieval.body_ranking(asked, gaps, None, drop_containers=False)).collect()} and got


def test_common_words_meet_by_class(spark, few):
    """300 requests and 300 symbols of one common word: pairs follow the rows, not their product."""
    n = spark.range(300).select(F.col("id"), F.explode(F.array(F.lit("head"), F.col("id").cast("string"))).alias("word"))
    asked, offered = n.withColumnRenamed("id", "request_id"), n.select(F.col("id").alias("symbol_id"), F.lit(0).alias("ordinal"), "word")
    assert retrieval.shared_candidates(asked, offered, 2).count() <= 3 * 300


def test_single_file_candidates_meet_by_what_counts(spark):
    rng = random.Random(6)
    rows = [(i, n.replace(" ", "_"), rng.choice([None, "Holder", "w3"]), rng.choice([None, "", *phrases(rng, 3, 3)])) for i, n in enumerate(phrases(rng, 120, 3))]
    symbols = spark.createDataFrame(rows, "symbol_id long, name string, parent_class string, docstring_first_line string").withColumn("ordinal", F.col("symbol_id"))
    asked = spark.createDataFrame([(i, p if i % 2 else f"change {p} in Holder") for i, p in enumerate(phrases(rng, 40, 5))], "request_id long, text string")
    every = asked.crossJoin(symbols).withColumn("rw", t.words(F.col("text")))
    in_class = F.coalesce(t.literal_hit(F.col("parent_class"), F.col("text")), F.lit(False))
    counts = t.literal_hit(F.col("name"), F.col("text")) | in_class | (F.size(F.array_intersect("rw", t.words(F.col("docstring_first_line")))) > 0) | (F.size(F.array_intersect("rw", t.words(F.col("name")))) > 1)
    want = {tuple(r) for r in every.where(counts).select("request_id", "symbol_id").collect()}
    assert want <= {tuple(r) for r in targets.backed_pairs(asked, symbols).collect()} and want
    # a word of all names brings no pair by itself
    many = spark.range(200).select(F.col("id").alias("symbol_id"), F.concat(F.lit("helper_"), "id").alias("name"), F.lit(None).cast("string").alias("parent_class"), F.lit(None).cast("string").alias("docstring_first_line"))
    said = spark.range(200).select(F.col("id").alias("request_id"), F.concat(F.lit("change helper_"), "id", F.lit(" now")).alias("text"))
    assert targets.backed_pairs(said, many).count() == 200


def test_best_ranks_leave_the_task(spark):
    """With k only the best rows come back; they are those of all rows, ties by ordinal."""
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, rng.randint(0, 9)) for i in range(60)], "node long, ordinal int")
    edges = spark.createDataFrame([(rng.randint(0, 59), rng.randint(0, 20), 1.0) for _ in range(90)], "src long, dst long, weight double")
    personal = spark.createDataFrame([(r, rng.randint(0, 59)) for r in range(5) for _ in range(2)], "request_id long, node long").distinct()
    asked = spark.range(6).select(F.col("id").alias("request_id"))
    every = graph.pagerank(nodes, edges, personal, asked, iterations=10, tolerance=None).join(nodes, "node").toPandas()
    got = graph.pagerank(nodes, edges, personal, asked, iterations=10, tolerance=None, k=7).toPandas()
    best = every.assign(score=every["rank"].round(9)).sort_values(["request_id", "score", "ordinal", "node"], ascending=[True, False, True, True]).groupby("request_id").head(7)
    assert len(got) == 42 and sorted(zip(got["request_id"], got["node"])) == sorted(zip(best["request_id"], best["node"]))
    assert graph._best(np.array([0.1, 0.5000000005, 0.500000001, 0.2]), 1).tolist() == [1]  # half up, then the first place

"""The stored index against a ranking that reads all documents."""

import random

import pytest
from pyspark.sql import functions as F

from lodeline.operators import posting_index, retrieval
from lodeline.operators.posting_index import PostingIndex

SYMBOLS = "symbol_id long, ordinal int, name string, docstring_first_line string, source string"


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return [(i, i, rng.choice(words), rng.choice([None, "", "doc w3"]), " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60])))) for i in range(n)]


def ranked(df):
    return sorted(map(tuple, df.select("request_id", "symbol_id", "score", "rank").collect()))


def asks(spark):
    return spark.createDataFrame([(0, "w50 w3"), (1, "w0 w0 w1 w59"), (2, "nothing here"), (3, "w7"), (4, "")], "request_id long, text string")


@pytest.mark.parametrize("span", [16, 64, 4096])
def test_index_equals_scan(spark, tmp_path, span):
    rows, requests = spark.createDataFrame(corpus(1), SYMBOLS), asks(spark)
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=4, span=span)
    index.add(rows)
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, rows, 5))
    n, idf = index.stats()
    want, of = retrieval.bm25_stats(rows)
    assert n.first() == want.first()
    assert {r["word"]: (r["df"], round(r["idf"], 9)) for r in idf.collect()} == {r["word"]: (r["df"], round(r["idf"], 9)) for r in of.collect()}


def test_updates_and_removals(spark, tmp_path):
    old, new = corpus(2), corpus(3)
    index, requests = PostingIndex(spark, str(tmp_path / "index"), buckets=4, span=32), asks(spark)
    index.add(spark.createDataFrame(old, SYMBOLS))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    changed = [i for i in range(400) if i % 7 == 0]
    index.add(spark.createDataFrame([new[i] for i in changed], SYMBOLS), spark.createDataFrame([old[i] for i in changed] + [old[1], old[2]], SYMBOLS))
    now = {i: r for i, r in enumerate(old) if i not in (1, 2)} | {i: new[i] for i in changed}
    rows = spark.createDataFrame(list(now.values()), SYMBOLS)
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, rows, 5))
    index.add(spark.createDataFrame([old[7], old[1]], SYMBOLS), spark.createDataFrame([new[7]], SYMBOLS))
    now |= {7: old[7], 1: old[1]}
    rows = spark.createDataFrame(list(now.values()), SYMBOLS)
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, rows, 5))
    assert all(p.stat().st_mtime_ns == at for p, at in files.items())  # nothing is rewritten
    assert index.generations() == [0, 1, 2]


def test_ranges_out_of_reach_are_not_read(spark, tmp_path):
    rows = [(i, i, "f", None, "common " * (1 + i % 3) + ("rare " * 3 if 100 <= i < 110 else "") + "filler " * 20) for i in range(1000)]
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=2, span=50)
    df = spark.createDataFrame(rows, SYMBOLS)
    index.add(df)
    requests = spark.createDataFrame([(0, "rare common")], "request_id long, text string")
    ranges = index.plan(requests, 5)[0]
    assert ranges.count() == 20 and ranges.where("read").count() == posting_index.FIRST
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, df, 5))
    plan = index._bounds(requests.select("request_id", F.lit("rare").alias("word"), F.lit(1.0).alias("weight")), index.stats()[0])._jdf.queryExecution().toString()
    assert "postings" not in plan.split("== Physical Plan ==")[1]


def test_unfinished_generations_are_not_seen(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError):
        index.stats()
    index.add(spark.createDataFrame(corpus(5, 20), SYMBOLS))
    (tmp_path / "index/documents/generation=1").mkdir()
    assert index.generations() == [0]


def test_best_of_a_range_leave_it(spark, tmp_path, monkeypatch):
    """Documents in no order in three tasks and several runs; scores that leave the ranges number k a request and range, not a document."""
    monkeypatch.setattr(posting_index, "HELD", 2000)
    old = [(i, i // 2, *rest) for i, _, *rest in corpus(6, 1500)]  # two documents a place
    rows, requests = spark.createDataFrame(old, SYMBOLS).repartition(3, F.hash("symbol_id", F.lit(7))), asks(spark)
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=4, span=50)
    index.add(rows)
    held = index._read("blocks").where("word is not null")
    assert held.groupBy("word", "part", "run").count().where("count > 1").isEmpty() and 3 < held.select("run").distinct().count() < 40
    assert held.count() < held.agg(F.sum("n")).first()[0] / 2
    first = index.plan(requests, 5)[1]
    assert 0 < first.groupBy("request_id").count().agg(F.max("count")).first()[0] <= posting_index.FIRST * 6  # ties at the last place stay
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, rows, 5))
    left = rows.where("symbol_id % 3 = 0")
    index.add(rows.where("false"), left)
    assert ranked(index.ranking(requests, k=5)) == ranked(retrieval.bm25_ranking(requests, rows.where("symbol_id % 3 <> 0"), 5))

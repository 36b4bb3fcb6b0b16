"""Each stage of the pipeline against its brute-force version, its edge cases, and the whole run."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeline.llm import mixing, simhash
from tests.llm.test_llm import CLASHING, ODD, SCHEMA, brute_components, brute_fingerprint, brute_lines, brute_mix

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def words(text):
    return len((text or "").encode().split())


def brute_copies(spark, docs, bits=mixing.BITS):
    """How often each document of docs (ids are unique) stands in the mix, and its first slot."""
    laid = [(r["doc_id"], r["h"], r["source"], words(r["text"])) for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).orderBy("h").collect()]
    size = {i: n for i, _, _, n in laid}
    return {i: (int(taken / size[i] + 0.5), slot) for i, (taken, slot) in brute_mix(laid, bits).items() if size[i]}


def brute_round_trip(texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = corpus_pipeline.quality(spark, docs, DIR)
    assert kept.schema == docs.schema
    kept = kept.cache()
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    gone, total = brute_lines(rows)
    lined = corpus_pipeline.lines(spark, kept, DIR)
    assert lined.schema == docs.schema
    lined = lined.cache()
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows if not gone[i] or len(gone[i]) < total[i]]
    assert sorted((r["doc_id"], r["text"]) for r in lined.collect()) == want
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in want])
    one = corpus_pipeline.near(spark, lined, DIR)
    assert one.schema == docs.schema
    one = one.cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))
    mixed = corpus_pipeline.mix(spark, one, DIR)
    assert mixed.schema == docs.schema
    texts, copies = dict(want), brute_copies(spark, one)
    mixed = mixed.cache()
    got = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert Counter(got) == Counter({(i, texts[i]): n for i, (n, _) in copies.items() if n})
    first = list(dict.fromkeys(i for i, _ in got))
    assert [copies[i][1] for i in first] == sorted(copies[i][1] for i in first)
    trips = sorted(brute_round_trip(got))
    assert sorted(map(tuple, corpus_pipeline.encode(spark, mixed, DIR).collect())) == trips
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).collect())) == trips


def test_run_takes_up_its_stages(spark, tmp_path):
    want = sorted(map(tuple, corpus_pipeline.run(spark, DIR, "named", str(tmp_path)).collect()))
    assert sorted(p.name for p in (tmp_path / "pipeline-named").iterdir()) == ["0", "1", "2", "3"]
    one = spark.read.parquet(str(tmp_path / "pipeline-named" / "3")).limit(7)
    one.write.parquet(str(tmp_path / "few"))
    (tmp_path / "pipeline-named" / "3").rename(tmp_path / "whole")
    (tmp_path / "few").rename(tmp_path / "pipeline-named" / "3")
    got = corpus_pipeline.run(spark, DIR, "named", str(tmp_path)).collect()
    assert len(got) == 7 and set(map(tuple, got)) <= set(want)
    bare = tmp_path / "bare"
    assert corpus_pipeline.run(spark, DIR, None, str(bare)).count() == len(want)
    assert [p.name for folder in bare.iterdir() for p in folder.iterdir()] == ["3"]


def test_near_stage_sends_no_grid_rows_through_the_driver(spark, monkeypatch):
    met, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: met.append(links(*a)) or met[0])
    corpus_pipeline.near(spark, spark.read.parquet(f"{DIR}/documents.parquet"), DIR)
    met[0].collect()
    assert "Broadcast" not in met[0]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_edges_of_stages(spark, stage):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, and a column for every inner name."""
    f = dict(corpus_pipeline.STAGES)[stage]
    plain = spark.createDataFrame(ODD, SCHEMA)
    named = plain
    for c in CLASHING:
        named = named.withColumn(c, F.lit(f"own {c}"))
    a, b = f(spark, plain, DIR), f(spark, named, DIR)
    if stage == corpus_pipeline.STAGES[-1][0]:
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect())) and a.count() == len(ODD)
    else:
        assert a.schema == plain.schema and b.schema == named.schema
        rows = b.collect()
        assert Counter(map(tuple, a.collect())) == Counter(tuple(r[c] for c in plain.columns) for r in rows)
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHING)
    assert f(spark, named.limit(0), DIR).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert f(spark, nothing, DIR).count() <= 3


@pytest.mark.parametrize("name", ["base_license_counts", "base_quality_counts", "base_mix_targets"])
def test_base_columns_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from lodeline.llm import queries

    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)

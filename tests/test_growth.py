"""Work that follows the rows where it followed their product, with the answers of the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as t
from lodeline.operators import blocks, delta, graph, retrieval, targets, tree_patterns


@pytest.mark.parametrize("iterations", [None, 10])
def test_symbols_of_one_name_are_one_node(spark, iterations):
    """Ranks equal those of a walk over all symbols: names that many define and call, recursive, null and double ones."""
    rng = random.Random(5)
    names = [rng.choice(["load_a", "load_b", "save_c", "only_d", f"own_{i}"]) for i in range(60)]
    rows = [(i, rng.randint(0, 9), n) for i, n in enumerate(names)] + [(60, 3, None), (3, 2, "second_e"), (3, 2, names[3])]
    symbols = spark.createDataFrame(rows, "symbol_id long, ordinal int, name string")
    calls = [(rng.randint(0, 63), rng.choice(["load_a", "save_c", "only_d", "second_e", rng.choice(names), "gone"])) for _ in range(90)] + [(1, names[1]), (2, names[2])]
    edges = spark.createDataFrame([c for c in calls if iterations or c[1] != "load_a" or c[0] != 5], "caller_id long, callee_name string")
    asked = spark.createDataFrame([(0, "load it"), (1, "nothing here"), (2, "save own 17"), (3, "only second")], "request_id long, text string")
    links = edges.join(symbols.select(F.col("name").alias("callee_name"), F.col("symbol_id").alias("dst")), "callee_name").where("caller_id <> dst").select(F.col("caller_id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    named = symbols.select("symbol_id", F.explode(t.words(F.col("name"))).alias("word")).join(retrieval.request_words(asked, t.content_words(F.col("text"))), "word").select("request_id", F.col("symbol_id").alias("node")).distinct()
    nodes = symbols.groupBy(F.col("symbol_id").alias("node")).agg(F.min("ordinal").alias("ordinal"))
    plain = graph.pagerank(nodes, links, named, asked, iterations=iterations or 300, tolerance=None)
    plain = retrieval.top_k(plain.select("request_id", F.col("node").alias("symbol_id"), F.round("rank", 9).alias("score")).join(nodes.withColumnRenamed("node", "symbol_id"), "symbol_id"), None)
    want = {(r["request_id"], r["symbol_id"]): (r["score"], r["rank"]) for r in plain.collect()}
    for k in (1, 7, 100):
        got = retrieval.graph_ranking(asked, symbols, edges, k, iterations).collect()
        assert len(got) == 4 * min(k, 61)
        for r in got:
            score, rank = want[(r["request_id"], r["symbol_id"])]
            assert abs(r["score"] - score) < 5e-9 and (r["rank"] == rank or not iterations)
    members, cells, made = graph.alike(symbols, edges)
    assert members.select("symbol_id").distinct().count() == 61
    if iterations:
        small = graph.pagerank(cells, made, named.where("false"), asked, iterations=10, tolerance=None, small=0).collect()
        near = {(r["request_id"], r["node"]): r["rank"] for r in graph.pagerank(cells, made, named.where("false"), asked, iterations=10, tolerance=None).collect()}
        assert len(small) == len(near) and all(abs(r["rank"] - near[(r["request_id"], r["node"])]) < 1e-12 for r in small)


def test_links_follow_calls(spark):
    """300 definers and 300 callers of one name are one link, not 90,000."""
    symbols = spark.range(600).select(F.col("id").alias("symbol_id"), F.col("id").alias("ordinal"), F.when(F.col("id") < 300, "many").otherwise("caller").alias("name"))
    edges = spark.range(300, 600).select(F.col("id").alias("caller_id"), F.lit("many").alias("callee_name"))
    assert graph.alike(symbols, edges)[2].count() == 1


def test_found_symbols_without_pairs(spark):
    """Random places against the rule; then 30,000 symbols of one place, whose pairs with as many wanted ones would be 900 million."""
    rng = random.Random(9)
    lines = ["class Tool:", "    def go(self, x):", "        return x", "def go(x):", "    return Tool.go(x)", "def go(x):", "    return x"]
    kinds = [(2, 3, 4, "Tool"), (4, 5, 0, None), (6, 7, 0, None)]
    rows = []
    for f in range(60):
        for start, end, indent, parent in rng.choices(kinds, k=rng.randint(0, 3)):
            rows.append((len(rows), f"f{f}", "function", "go", start, end, indent, parent, lines))
    symbols = spark.createDataFrame(rows, "symbol_id long, file string, symbol_type string, name string, start_line int, end_line int, indent int, parent_class string, lines array<string>")
    wanted = [(i, f"f{i % 60}", "function", "go", rng.choice([None, 2, 4, 9]), rng.random() < 0.5) for i in range(240)]
    want = {}
    for key, file, _, _, line, may in wanted:
        own = [r for r in rows if r[1] == file]
        at = [r for r in own if line is not None and r[4] == line]
        parent = any(r[7] for r in own)
        through = [r for r in own if parent and r[7] is None and r[4] == 4]
        hit = own[0] if len(own) == 1 else at[0] if len(at) == 1 else next(r for r in own if r not in through) if may and len(own) == 2 and len(through) == 1 else None
        want[key] = ("MISSING" if not own else "FOUND" if hit else "AMBIGUOUS", hit and hit[0])
    asked = spark.createDataFrame(wanted, "key long, file string, symbol_type string, symbol_name string, prefer_line int, allow_delegate boolean")
    assert {r["key"]: (r["status"], r["symbol_id"]) for r in targets.find_symbol(asked, symbols).collect()} == want and len({s for s, _ in want.values()}) == 3
    many = spark.range(30_000).select(F.col("id").alias("symbol_id"), F.lit("f").alias("file"), F.lit("function").alias("symbol_type"), F.lit("go").alias("name"), F.col("id").cast("int").alias("start_line"), F.lit(None).cast("string").alias("parent_class"))
    asked = many.select(F.col("symbol_id").alias("key"), "file", "symbol_type", F.col("name").alias("symbol_name"), F.when(F.col("symbol_id") % 2 == 0, F.col("start_line")).alias("prefer_line"), F.lit(False).alias("allow_delegate"))
    assert {(r["status"], r["same"]): r["count"] for r in targets.find_symbol(asked, many).groupBy("status", (F.col("symbol_id") == F.col("key")).alias("same")).count().collect()} == {("FOUND", True): 15_000, ("AMBIGUOUS", None): 15_000}


def test_sources_are_parsed_by_all_tasks(spark):
    """A table of one partition: its sources are dealt out, and many of them make one batch; nodes are as of each source alone."""
    sources = [(i, f"def f{i}(x):\n    return g(x, {i})\n" if i % 7 else "def (") for i in range(200)]
    tree = tree_patterns.nodes(spark.createDataFrame(sources, "source_id long, source string").coalesce(1))
    got = sorted((r["source_id"], r["pre"], r["kind"], r["text"], r["shape"], r["line"]) for r in tree.collect())
    assert got == sorted((i, r["pre"], r["kind"], r["text"], r["shape"], r["line"]) for i, s in sources for r in tree_patterns.tree_rows(s))
    assert tree.select(F.spark_partition_id()).distinct().count() > 1


def test_bm25_scores_stay_where_documents_are(spark, monkeypatch):
    """Equal to the joined ranking, in small pieces too, with ties, empty and null texts; no posting is shuffled by its symbol."""
    rng = random.Random(2)
    words = ["red", "blue", "camelCase", "İx", "the", "a1"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, rng.randint(0, 20), "n_" + rng.choice(words), rng.choice(["", None, text(3)]), rng.choice([None, "", text(5), text(40)])) for i in range(200)] + [(200 + i, 5, "same", "", "red blue") for i in range(9)]
    symbols = spark.createDataFrame(rows, "symbol_id long, ordinal long, name string, docstring_first_line string, source string").repartition(3)
    asked = spark.createDataFrame([(i, text(rng.randint(1, 6))) for i in range(25)] + [(30, "red blue"), (31, "unknown"), (32, "")], "request_id long, text string")
    for scored, counted in ((1 << 20, 500_000), (40, 5)):
        monkeypatch.setattr(retrieval, "_SCORED", scored)
        monkeypatch.setattr(retrieval, "_COUNTED", counted)
        for k in (1, 6):
            got = retrieval.bm25_ranking(asked, symbols, k)
            want = retrieval.bm25_ranking(asked, symbols, k, stats=retrieval.bm25_stats(symbols))
            assert [tuple(r) for r in got.orderBy("request_id", "rank").collect()] == [tuple(r) for r in want.orderBy("request_id", "rank").collect()]
    assert "hashpartitioning(symbol_id" in want._jdf.queryExecution().toString() and "hashpartitioning(symbol_id" not in got._jdf.queryExecution().toString()
    assert retrieval.bm25_ranking(asked, symbols.limit(0), 3).count() == 0


def test_bm25_of_many_requests(spark, monkeypatch):
    """More requests than a task holds: those of the same common words meet documents as one, with the ranking of all pairs."""
    rng = random.Random(12)
    words = ["helper", "shared", "now"] * 4 + ["the", "add"] * 2 + [f"w{i}" for i in range(40)]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    symbols = spark.createDataFrame([(i, i // 3, phrase(2), rng.choice([None, phrase(3)]), phrase(rng.randint(0, 9))) for i in range(90)], "symbol_id long, ordinal long, name string, docstring_first_line string, source string")
    asked = spark.createDataFrame([(i, phrase(rng.randint(1, 6)) + rng.choice([" helper helper", "", " gone"])) for i in range(60)] + [(90, ""), (91, "gone"), (92, None)], "request_id long, text string")
    stats = retrieval.bm25_stats(symbols)
    monkeypatch.setattr(retrieval, "SMALL_BYTES", 0)
    ranked = lambda *a, **b: [tuple(r) for r in retrieval.bm25_ranking(asked, *a, **b).orderBy("request_id", "rank").collect()]
    for common, k in ((6, 1), (6, 5), (0, 5), (10_000, 5)):
        monkeypatch.setattr(retrieval, "COMMON", common)
        assert ranked(symbols, k) == ranked(symbols, k, stats=stats)
    assert ranked(symbols.limit(0), 3) == []
    # one word in all documents and requests: no row for each pair
    many = spark.range(3000).select(F.col("id").alias("symbol_id"), F.col("id").alias("ordinal"), F.lit("helper").alias("name"), F.lit("").alias("docstring_first_line"), F.concat(F.lit("own"), "id").alias("source"))
    asks = spark.range(3000).select(F.col("id").alias("request_id"), F.concat(F.lit("helper own"), "id").alias("text"))
    monkeypatch.setattr(retrieval, "COMMON", 256)
    got = retrieval.bm25_ranking(asks, many, 1)
    assert got.where("request_id = symbol_id and rank = 1").count() == got.count() == 3000
    got.collect()
    plan = got._jdf.queryExecution().executedPlan()
    assert max(_row_counts(plan)) < 100_000


def _row_counts(plan):
    """Rows that each operator of an executed plan gave out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return ([own.get().value()] if own.isDefined() else [0]) + [n for x in below for n in _row_counts(x)]


def test_strips_and_slices(spark, monkeypatch):
    """Vectors scored a few requests at a time, and diffs made a few pairs at a time, are those of one piece."""
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(90)], "symbol_id long, embedding array<float>")
    asked = v.where("symbol_id % 3 = 0").withColumnRenamed("symbol_id", "request_id")
    ranked = lambda k: sorted(tuple(r) for r in retrieval.vector_ranking(asked, v, k, exclude_self=True).collect())
    want = {k: ranked(k) for k in (5, None)}
    monkeypatch.setattr(retrieval, "STRIP", 4)
    assert {k: ranked(k) for k in want} == want and len(want[None]) == 30 * 89
    pairs = [(i, f"p{i}", rng.choice([None, "", "a\nb\n", "a\nb"]), rng.choice([None, "", "a\nc\n", "x" * i])) for i in range(50)]
    monkeypatch.setattr(delta, "_DIFFED", 7)
    got = {r["file_id"]: (r["diff"], r["change_ratio"]) for r in delta.diffs(spark.createDataFrame(pairs, "file_id long, path string, before string, after string").coalesce(1)).collect()}
    assert got == {i: (d, delta.change_ratio(d, a or "")) for i, p, a, b in pairs for d in [delta.unified_diff(p, a or "", b or "")]}


@pytest.mark.parametrize("exclude_self", [True, False])
def test_vectors_meet_in_cells(spark, monkeypatch, exclude_self):
    """Copies, repeated ids, other lengths and rows without a vector, in blocks of a few vectors and many cells: the ranking of all pairs."""
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 5), [float(rng.randint(-1, 2)) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(150)]
    rows += [(i, 1, [1.0, 2.0, 2.0]) for i in range(150, 190)] + [(7, 3, [2.0, 4.0, 4.0])] * 6 + [(8, 2, [1.0, 2.0, 2.0 + i / 1e6]) for i in range(9)]
    odd = [(200, 0, None), (201, 0, []), (202, 0, [1.0, None, 2.0]), (203, 0, [float("nan"), 1.0, 1.0]), (None, 0, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows + odd, "symbol_id long, ordinal long, embedding array<double>").repartition(5)
    unit = lambda e: [x / (sum(y * y for y in e) ** 0.5 or 1) for x in e]
    whole = [(i, o, unit(e)) for i, o, e in rows]

    def want(i, e, k):
        met = [(-round(sum(a * b for a, b in zip(e, f)), 9) + 0.0, o, j) for j, o, f in whole if len(f) == len(e) and not (exclude_self and i == j)]
        return [(j, -s) for s, _, j in sorted(met)[:k]]

    for name, value in (("BLOCK_BYTES", 24 * 12), ("STRIP", 5), ("ASKED", 3), ("STORED", 2)):
        monkeypatch.setattr(retrieval, name, value)
    asked = v.where("symbol_id <> 7 and symbol_id <> 8 or symbol_id is null").select(F.col("symbol_id").alias("request_id"), "embedding")
    for k in (1, 4, 30, None):
        got = {}
        for r in retrieval.vector_ranking(asked, v, k, exclude_self).orderBy("request_id", "rank").collect():
            got.setdefault(r["request_id"], []).append((r["symbol_id"], r["score"]))
        plain = {i: w for i, _, e in whole if i not in (7, 8) and (w := want(i, e, k))}
        assert {i: [(j, round(s, 6)) for j, s in x] for i, x in got.items()} == {i: [(j, round(s, 6)) for j, s in x] for i, x in plain.items()}
    twice = v.where("symbol_id = 8").select(F.col("symbol_id").alias("request_id"), "embedding")
    got = [(r["symbol_id"], round(r["score"], 6)) for r in retrieval.vector_ranking(twice.limit(1), v, 4, exclude_self).orderBy("rank").collect()]
    assert len(got) == 4 and not (exclude_self and 8 in [j for j, _ in got])
    assert retrieval.vector_ranking(asked.limit(0), v, 4).count() == 0 and retrieval.vector_ranking(asked, v.limit(0), 4).count() == 0


def test_few_requests_go_to_the_symbols(spark, monkeypatch):
    """The same best symbols whichever way they meet; for few requests neither pairs nor doc lines are shuffled by symbol."""
    rng = random.Random(7)
    words = ["head", "tail", "part", "the", "é", "add"] + [f"w{i}" for i in range(12)]
    phrase = lambda n, by=" ": by.join(rng.choices(words, k=n))
    rows = [(i, i // 2, phrase(rng.randint(1, 3), "_"), rng.choice([None, "Holder", "w3"]), rng.choice([None, "", phrase(4)])) for i in range(150)]
    symbols = spark.createDataFrame(rows, "symbol_id long, ordinal long, name string, parent_class string, docstring_first_line string").where("symbol_id % 2 = 0")
    asked = spark.createDataFrame([(i, rng.choice(["add ", "", "in Holder "]) + phrase(rng.randint(1, 5))) for i in range(40)] + [(99, "")], "request_id long, text string")
    few = targets.locate_candidates(asked, symbols, k=3)
    assert "hashpartitioning(symbol_id" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(targets, "FEW", 0)
    many = targets.locate_candidates(asked, symbols, k=3)
    none = spark.createDataFrame([], "request_id long, symbol_id long, score double")
    windows = targets.locate_candidates(asked, symbols, vectors=none, k=3)
    got = sorted(tuple(r) for r in few.collect())
    assert got == sorted(tuple(r) for r in many.collect()) == sorted(tuple(r) for r in windows.collect()) and len(got) > 60


def _met_in_place(df):
    """Whether the last join is a broadcast one, without being small by chance, and nothing is shuffled behind it."""
    conf, key = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(key)
    conf.set(key, -1)
    try:
        above = df.select("*")._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
    finally:
        conf.set(key, before)
    return above.endswith("BroadcastHash") and "Exchange" not in above


def test_pairs_of_requests_and_blocks_do_not_move(spark):
    words = ["alpha", "beta", "gamma", "beta gamma"]
    rows = [(i, i, f"f{i // 2}", f"{words[i % 4]} {i if i % 3 else ''}", f"alpha holds {words[i % 3]} number{i}", i) for i in range(40)]
    b = spark.createDataFrame(rows, "symbol_id long, ordinal long, file string, name string, source string, file_id long")
    said = {1: "move beta gamma 7 along", 2: "alpha number11", 3: "nothing of them", 4: "delta beta"}
    asked = spark.createDataFrame(list(said.items()), "request_id long, text string")
    is_in = lambda name, text: f" {name} " in f" {text} "  # noqa: E731  (a name's last blank counts)
    by_name = {(r, i): len(set(t.split()) & set(n.split())) + 5.0 * bool(is_in(n, t)) for r, t in said.items() for i, _, _, n, _, _ in rows if set(t.split()) & set(n.split())}
    got = blocks.name_ranking(asked, b, also=["file_id"]).select("request_id", "file_id", "score")
    assert _met_in_place(got)
    assert {(x[0], x[1]): x[2] for x in got.collect()} == by_name and got.count() == len(by_name)
    place = {"move", "along", "beta", "gamma", "alpha", "number11", "nothing", "delta"}
    by_body = {(r, i): float(len(set(t.split()) & set(s.split()) & place)) for r, t in said.items() for i, _, _, _, s, _ in rows}
    best = {k: max(by_name.get(k, 0.0), v) for k, v in by_body.items() if max(by_name.get(k, 0.0), v) > 0}
    got = blocks.locate_blocks(asked, b, also=["file_id"]).select("request_id", "file_id", "score")
    assert _met_in_place(got)
    assert {(x[0], x[1]): x[2] for x in got.collect()} == best and got.count() == len(best)


def test_callers_of_renamed_names_do_not_move(spark):
    symbols = spark.createDataFrame([(i, f"f{i}") for i in range(30)], "symbol_id long, file string")
    edges = spark.createDataFrame([(i, "shared") for i in range(30)] + [(3, "own")], "caller_id long, callee_name string")
    renames = spark.createDataFrame([(i, f"f{i}", "shared") for i in range(5)] + [(7, "f7", "own"), (8, "f8", "none")], "file_id long, file string, old_name string")
    got = delta.cross_file_impact(renames, edges, symbols)
    assert _met_in_place(got)
    want = {(r, "shared", i, f"f{i}") for r in range(5) for i in range(30) if i != r} | {(7, "own", 3, "f3")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_best_symbols_without_all_that_share_a_common_word(spark, monkeypatch):
    """With k, words of many symbols bring classes; names, doc lines and BM25 rank as over all pairs, and requests of one meaning are one walk."""
    monkeypatch.setattr(retrieval, "COMMON", 3)
    rng = random.Random(8)
    words = ["load", "save", "user", "order", "cache", "x1", "x2", "x3"]
    rows = [(i, rng.randint(0, 5), "_".join(rng.sample(words, rng.randint(1, 3))), " ".join(rng.sample(words, 2)), " ".join(rng.choices(words[: rng.randint(1, 8)], k=rng.randint(1, 12)))) for i in range(90)]
    symbols = spark.createDataFrame(rows, "symbol_id long, ordinal int, name string, docstring_first_line string, source string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices([*words, "load_user", rows[i][2]], k=4))) for i in range(25)], "request_id long, text string")
    for ranking in (retrieval.symbol_ranking, retrieval.bm25_ranking):
        whole = {tuple(r) for r in ranking(asked, symbols, None).where("rank <= 4").select("request_id", "symbol_id", F.round("score", 6), "rank").collect()}
        assert {tuple(r) for r in ranking(asked, symbols, 4).select("request_id", "symbol_id", F.round("score", 6), "rank").collect()} == whole
    held = spark.createDataFrame([(i, w) for i in range(6) for w in ("helper", f"k{i}", "same")], "node long, word string")
    said = spark.createDataFrame([(i, w) for i in range(6) for w in ("helper", f"k{i}", "same", "gone")] + [(7, "k1"), (7, "k2")], "request_id long, word string")
    assert {tuple(r) for r in retrieval._telling(said, held).collect()} == {(i, "helper") for i in range(6)} | {(7, "k1"), (7, "k2")}


def test_stated_steps_take_nodes_with_exits_only(spark, monkeypatch):
    """Ranks after stated steps equal those in arrays; before the last step no state of a node without an exit is written."""
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(40)], "node string")
    edges = spark.createDataFrame([(f"n{i}", f"n{(7 * i + j) % 40}", 1.0 + j) for i in range(6) for j in range(5)], "src string, dst string, weight double")
    named = spark.createDataFrame([(1, "n3"), (1, "n30"), (2, "gone")], "request_id long, node string")
    asked = spark.createDataFrame([(1,), (2,)], "request_id long")
    want = {tuple(r) for r in graph.pagerank(nodes, edges, named, asked, iterations=4, tolerance=None).select("request_id", "node", F.round("rank", 10)).collect()}
    written, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(plain(df)) or written[-1])
    got = graph.pagerank(nodes, edges, named, asked, iterations=4, tolerance=None, small=0)
    assert {tuple(r) for r in got.select("request_id", "node", F.round("rank", 10)).collect()} == want and len(want) == 80
    assert max(df.count() for df in written if "rank" in df.columns) == 12

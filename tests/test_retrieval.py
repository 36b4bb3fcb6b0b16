import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeline.operators import blocks, graph, retrieval, targets

SYMBOLS = [
    (1, 0, "calculator.py", "add", "function", 1, 2, 0, None, None, "def add(a, b):\n    return a + b", "python"),
    (2, 1, "calculator.py", "_internal_helper", "function", 5, 6, 0, None, None, "def _internal_helper():\n    return add(1, 2)", "python"),
    (3, 0, "auth.py", "check_password", "function", 1, 3, 0, None, "Check that a password matches.", "def check_password(p):\n    if not isinstance(p, str):\n        raise ValueError(p)", "python"),
    (4, 1, "auth.py", "SessionManager", "class", 5, 9, 0, None, None, "class SessionManager:\n    def create_session(self):\n        check_password('x')", "python"),
]
SCHEMA = "symbol_id long, ordinal int, file string, name string, symbol_type string, start_line int, end_line int, indent int, parent_class string, docstring_first_line string, source string, language string"


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame(SYMBOLS, SCHEMA).cache()


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")


def test_symbol_ranking(spark, symbols):
    got = retrieval.symbol_ranking(ask(spark, "make add stricter", "validate the password", "nothing here"), symbols).orderBy("request_id", "rank").collect()
    assert [(r["request_id"], r["symbol_id"], r["score"]) for r in got] == [(0, 1, 6.0), (1, 3, 2.0)]


def test_bm25_formula(spark, symbols):
    import re

    docs = {r[0]: re.findall("[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", f"{r[3].replace('_', ' ')} {r[9] or ''} {r[10]}").lower()) for r in SYMBOLS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    query = ["check", "password", "password", "return"]
    want = {}
    for i, d in docs.items():
        tf = Counter(d)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query if w in idf)
        if round(s, 9) > 0:
            want[i] = round(s, 6)
    got = {r["symbol_id"]: round(r["score"], 6) for r in retrieval.bm25_ranking(ask(spark, "check password password return"), symbols).collect()}
    assert got == want


def test_fusion_and_confidence(spark):
    first = spark.createDataFrame([(0, 1, 5.0, 1), (0, 2, 1.0, 2)], "request_id long, symbol_id long, score double, rank int")
    second = spark.createDataFrame([(0, 1, 3.0, 1), (1, 9, 1.0, 1)], "request_id long, symbol_id long, score double, rank int")
    fused = retrieval.fuse([first, second])
    got = {(r["request_id"], r["symbol_id"]): (round(r["score"], 6), r["rank"]) for r in fused.collect()}
    assert got == {(0, 1): (round(2 / 61, 6), 1), (0, 2): (round(1 / 62, 6), 2), (1, 9): (round(1 / 61, 6), 1)}
    assert max(s for s, _ in got.values()) <= 2 / 61 + 1e-6
    conf = {r["request_id"]: r["confidence"] for r in retrieval.confidence(fused).collect()}
    assert conf == {0: round(min(0.5 + 0.5 * (2 / 61 - 1 / 62) / (2 / 61), 0.99), 2), 1: 0.9}


def test_fusion_ties_keep_first_seen(spark):
    a = spark.createDataFrame([(0, 7, 1.0, 1)], "request_id long, symbol_id long, score double, rank int")
    b = spark.createDataFrame([(0, 3, 1.0, 1)], "request_id long, symbol_id long, score double, rank int")
    assert [r["symbol_id"] for r in retrieval.fuse([a, b]).orderBy("rank").collect()] == [7, 3]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0])], "symbol_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [3.0, 0.0])], "request_id long, embedding array<float>")
    got = [(r["symbol_id"], round(r["score"], 4)) for r in retrieval.vector_ranking(q, v).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.7071), (3, 0.0)]


def power(nodes, edges, restart, steps):
    n, rank = len(nodes), {v: 1 / len(nodes) for v in nodes}
    out = Counter()
    for a, _, w in edges:
        out[a] += w
    for _ in range(steps):
        new = {v: 0.15 * restart[v] + 0.85 * sum(rank[u] for u in nodes if not out[u]) / n for v in nodes}
        for a, b, w in edges:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    return rank


def test_pagerank(spark):
    nodes, edges = ["a", "b", "c", "d"], [("a", "b", 1.0), ("c", "b", 1.0), ("b", "a", 2.0), ("a", "c", 3.0)]
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame([*edges, ("a", "ghost", 1.0)], "src string, dst string, weight double")
    got = {r["node"]: r["rank"] for r in graph.pagerank(n, e).collect()}
    want = power(nodes, edges, dict.fromkeys(nodes, 0.25), 100)
    assert all(abs(got[v] - want[v]) < 1e-5 for v in nodes) and abs(sum(got.values()) - 1) < 1e-9
    p = spark.createDataFrame([(5, "d")], "request_id long, node string")
    q = spark.createDataFrame([(5,), (6,)], "request_id long")
    both = {(r["request_id"], r["node"]): r["rank"] for r in graph.pagerank(n, e, p, q).collect()}
    want = power(nodes, edges, {"a": 0, "b": 0, "c": 0, "d": 1}, 100)
    assert all(abs(both[5, v] - want[v]) < 1e-5 and abs(both[6, v] - got[v]) < 1e-5 for v in nodes)
    assert graph.pagerank(n.limit(1), e).count() == 0
    for steps in (1, 4):  # the same steps, distributed
        far = {(r["request_id"], r["node"]): r["rank"] for r in graph.pagerank(n, e, p, q, iterations=steps, tolerance=None, small=0).collect()}
        near = {(r["request_id"], r["node"]): r["rank"] for r in graph.pagerank(n, e, p, q, iterations=steps, tolerance=None).collect()}
        assert far.keys() == near.keys() and all(abs(far[k] - near[k]) < 1e-12 for k in far)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_settled_ranks_by_push(spark, seed, monkeypatch):
    """Within 1e-6 of long power iteration on random graphs, hubs in chunks, nodes without exits, requests without names."""
    monkeypatch.setattr(graph, "_OUT", 3)
    rng = random.Random(seed)
    nodes = list(range(40))
    edges = [(rng.choice(nodes[: 40 - 10 * (seed % 3)]), rng.choice(nodes), float(rng.randint(1, 4))) for _ in range(90)] + [(0, v, 1.0) for v in nodes[1:20]]
    named = {0: {3}, 1: {1, 2, 30}, 2: set(), 3: {39}}
    n = spark.createDataFrame([(v, 100 - v) for v in nodes], "node long, ordinal int")
    e = spark.createDataFrame([*edges, (1, 77, 5.0)], "src long, dst long, weight double")
    p = spark.createDataFrame([(r, v) for r, some in named.items() for v in some] + [(1, 77), (9, 3)], "request_id long, node long")
    got = graph.settled_top(n, e, p, spark.createDataFrame([(r,) for r in named], "request_id long"), 7).collect()
    for r, some in named.items():
        want = power(nodes, edges, {v: (v in some) / len(some) if some else 1 / 40 for v in nodes}, 400)
        mine = sorted((x["rank"], x["node"], x["score"]) for x in got if x["request_id"] == r)
        assert len(mine) == 7 and all(abs(score - want[v]) < 1e-6 for _, v, score in mine)
        assert [v for _, v, _ in mine] == sorted(nodes, key=lambda v: (-round(want[v], 9), 100 - v))[:7]
    assert graph.settled_top(n.limit(1), e, p, n.select(F.col("node").alias("request_id"))).count() == 0


def test_edges_and_locate(spark, symbols):
    calls = spark.createDataFrame([(2, "add"), (4, "check_password"), (4, "print"), (1, "add")], "symbol_id long, name string")
    edges = graph.call_edges(calls, symbols)
    assert sorted(map(tuple, edges.collect())) == [(2, "add"), (4, "check_password")]
    got = retrieval.locate(ask(spark, "raise an exception when the password type is wrong"), symbols, edges, iterations=10).orderBy("rank").collect()
    assert got[0]["name"] == "check_password" and got[0]["risk"] == "MEDIUM" and got[0]["called_by_count"] == 1
    best = retrieval.locate_best_file(ask(spark, "check the password", "zzz qqq"), symbols).collect()
    assert [(r["request_id"], r["file"]) for r in best] == [(0, "auth.py")]


def test_structural_score(spark, symbols):
    asked = ask(spark, "validate types and raise errors", "sort rows")
    got = retrieval.structural_scores(asked, asked.select("request_id").crossJoin(symbols)).join(symbols.select("symbol_id", "name"), "symbol_id").collect()
    assert [(r["request_id"], r["name"], r["score"]) for r in got] == [(0, "check_password", 2.0)]


def test_local_callers_and_single_file(spark):
    rows = [
        (1, 0, "m.py", "tan", "function", 2, 3, 4, "Trig", None, "def tan(self): return self.sin()", "python"),
        (2, 1, "m.py", "tan", "function", 8, 9, 4, "Hyperbolic", None, "def tan(self): pass", "python"),
        (3, 2, "m.py", "sin", "function", 4, 5, 4, "Trig", None, "def sin(self): pass", "python"),
        (4, 3, "m.py", "use", "function", 12, 13, 4, "Hyperbolic", None, "def use(self): self.tan()", "python"),
    ]
    s = spark.createDataFrame(rows, SCHEMA)
    calls = spark.createDataFrame([(1, "sin"), (4, "tan")], "symbol_id long, name string")
    assert sorted(map(tuple, graph.local_called_by(calls, s).collect())) == [(2, 1), (3, 1)]
    got = targets.locate_candidates(ask(spark, "fix tan", "fix Trig tan"), s, calls).orderBy("request_id", "rank").collect()
    assert [(r["request_id"], r["symbol_id"]) for r in got if r["rank"] == 1] == [(0, 2), (1, 1)]


def test_body_containment(spark):
    rows = [(1, 0, "m.py", "A", "class", 1, 10, 0, None, None, "alpha beta", "python"), (2, 1, "m.py", "f", "function", 2, 4, 4, "A", None, "alpha beta", "python")]
    got = retrieval.body_ranking(ask(spark, "alpha beta"), spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["symbol_id"] for r in got] == [2]


def test_targets(spark, symbols):
    fuzzy = targets.delete_candidates(ask(spark, "remove chek_pasword", "delete password", "delete add"), symbols)
    got = {(r["request_id"], r["symbol_id"], r["method"]) for r in fuzzy.collect()}
    assert got == {(1, 3, "substring")}  # add is a generic verb, and pasword is too short for the whole name
    s = spark.createDataFrame([(1, "tan"), (2, "sec"), (3, "cos"), (4, "cos2"), (5, "substract")], "symbol_id long, name string")
    many = targets.multi_delete(ask(spark, "delete tan, sec and cos", "delete tan and nothing", "delete tan"), s)
    assert sorted((r["request_id"], r["symbol_id"]) for r in many.collect()) == [(0, 1), (0, 2), (0, 3)]
    near = targets.delete_candidates(ask(spark, "remove subtract"), s).collect()
    assert [(r["symbol_id"], r["method"]) for r in near] == [(5, "fuzzy")]
    renames = targets.rename_target(ask(spark, "Rename the function tan to tangent.", "rename zzz to y", "replace name of class sec with secant"), s)
    assert sorted(map(tuple, renames.collect())) == [(0, "tan", "tangent"), (2, "sec", "secant")]
    wanted = spark.createDataFrame([(1, "calculator.py", "function", "add", None, False), (2, "auth.py", "function", "nope", None, False)], "key long, file string, symbol_type string, symbol_name string, prefer_line int, allow_delegate boolean")
    assert {r["key"]: (r["status"], r["symbol_id"]) for r in targets.find_symbol(wanted, symbols).collect()} == {1: ("FOUND", 1), 2: ("MISSING", None)}


def test_blocks(spark):
    f = spark.createDataFrame([(1, "pre\n# One\na\n## Two\nb\nc", "markdown"), (2, "x\ny\n\n\nz", "text"), (3, "", "text"), (4, "[a]\nk=1\n[b]\n", "toml")], "file_id long, source string, language string")
    got = sorted((r["file_id"], r["name"], r["start_line"], r["end_line"]) for r in blocks.text_blocks(f).collect())
    assert got == [(1, "One", 2, 3), (1, "Two", 4, 6), (2, "x", 1, 2), (2, "z", 5, 5), (4, "a", 1, 2), (4, "b", 3, 3)]
    lines = blocks.line_table(f.where("file_id = 1"))
    spans = spark.createDataFrame([(1, 2, 3)], "file_id long, start_line int, end_line int")
    gaps = sorted((r["name"], r["start_line"], r["end_line"]) for r in blocks.module_gaps(lines, spans).collect())
    assert gaps == [("## Two", 4, 6), ("pre", 1, 1)]
    symbols = blocks.as_symbols(blocks.text_blocks(f), blocks.line_table(f))
    assert blocks.locate_block(ask(spark, "change section two"), symbols).count() == 1
    assert blocks.locate_block(ask(spark, "one two"), symbols).count() == 0
    assert {r["request_id"] for r in blocks.locate_blocks(ask(spark, "one two"), symbols).collect()} == {0}

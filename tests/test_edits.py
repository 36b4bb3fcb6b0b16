import random
import textwrap
from itertools import dropwhile

import pytest
from pyspark.sql import functions as F

from lodeline.operators import blocks, delta, versions


def in_turn(source, ops):
    """One operation after the other: what stands above it, its own lines, what stands below."""
    rows = source.splitlines(keepends=True)
    last = len(rows)
    where = {o["op_ord"]: o["start_line"] if o["operation"] != "INSERT" else last if o["end_line"] is None else o["end_line"] for o in ops}
    for o in sorted(ops, key=lambda o: (-where[o["op_ord"]], o["op_ord"])):
        at, put = where[o["op_ord"]], []
        above, below = (rows[:at], rows[at:]) if o["operation"] == "INSERT" else (rows[: at - 1], rows[o["end_line"] :])
        if o["operation"] == "DELETE":
            below = list(dropwhile(lambda x: not x.strip(), below))
        else:
            text = textwrap.indent(textwrap.dedent(o["content"].rstrip("\n")), " " * o["indent"]) + "\n"
            put = ["\n", text] if o["operation"] == "INSERT" else [text]
        rows = above + put + below
    return "".join(rows)


def test_apply_equals_sequential(spark):
    rng, files, ops = random.Random(4), [], []
    for i in range(30):
        n = rng.randint(1, 12)
        ends = ["\n"] if i % 2 else ["\n", "\r\n", "\r"]
        files.append((i, "".join(rng.choice(["a", "  b", "", "c d"]) + rng.choice(ends) for _ in range(n)) + ("end" if i % 4 == 0 else "")))
        n, at, k = len(files[-1][1].splitlines()), 1, 0
        while at <= n:
            end = min(n, at + rng.randint(0, 2))
            kind = rng.choice(["REPLACE", "DELETE", "INSERT", None])
            if kind == "INSERT":
                ops.append((i, k, kind, None, end, rng.choice([0, 2]), "new %d\n  in" % k))
            elif kind:
                ops.append((i, k, kind, at, end, rng.choice([0, 2]), "put %d\n" % k))
            k += kind is not None
            at = end + 2
    f = spark.createDataFrame(files, "file_id long, source string")
    o = spark.createDataFrame(ops, "file_id long, op_ord int, operation string, start_line int, end_line int, indent int, content string")
    got = {r["file_id"]: r["source"] for r in delta.apply_lines(delta.pieces(f), o).collect()}
    turn = {r["file_id"]: r["source"] for r in delta.apply_sequential(f, o).collect()}
    keys = ("op_ord", "operation", "start_line", "end_line", "indent", "content")
    for i, source in files:
        own = [dict(zip(keys, x[1:])) for x in ops if x[0] == i]
        assert got.get(i, "") == (in_turn(source, own) if own else source), (source, own)
        assert not own or turn[i] == in_turn(source, own)


def test_overlapping_operations_in_turn(spark):
    rng, files, ops = random.Random(14), [], []
    for i in range(12):
        n = rng.randint(2, 9)
        files.append((i, "".join(rng.choice(["a\n", "  b\n", "\n", "c d\r\n"]) for _ in range(n)) + rng.choice(["", "end"])))
        n = len(files[-1][1].splitlines())
        for k in range(rng.randint(0, 4)):
            at, kind = rng.randint(1, n), rng.choice(["REPLACE", "DELETE", "INSERT"])
            end = rng.choice([None, at]) if kind == "INSERT" else min(n, at + rng.randint(0, 3))
            ops.append((i, k, kind, None if kind == "INSERT" else at, end, rng.choice([0, 2]), "put %d\n  in\n" % k))
    ops.append((99, 0, "DELETE", 1, 1, 0, ""))  # a file that is not there
    f = spark.createDataFrame([*files, (50, None)], "file_id long, source string")
    o = spark.createDataFrame(ops, "file_id long, op_ord int, operation string, start_line int, end_line int, indent int, content string")
    keys = ("op_ord", "operation", "start_line", "end_line", "indent", "content")
    want = {i: in_turn(source, own) for i, source in files if (own := [dict(zip(keys, x[1:])) for x in ops if x[0] == i])}
    assert {r["file_id"]: r["source"] for r in delta.apply_sequential(f, o).collect()} == want
    assert delta.apply_sequential(f, o.limit(0)).count() == 0


def test_a_thousand_operations_in_one_file(spark):
    rng = random.Random(5)
    source = "".join(rng.choice(["a", "  b", "", " "]) + rng.choice(["\n", "\r\n"]) for _ in range(400)) + "end"
    ops = []
    for k in range(1000):
        kind, at = rng.choice(["REPLACE", "DELETE", "INSERT"]), rng.randint(1, 401)
        end = min(401, at + rng.randint(0, 5))
        ops.append((1, k, kind, None if kind == "INSERT" else at, rng.choice([end, None]) if kind == "INSERT" else end, rng.choice([0, 2]), rng.choice(["put %d\n" % k, "a\n  b", "", None])))
    f = spark.createDataFrame([(1, source), (2, None), (3, "kept\n")], "file_id long, source string")
    o = spark.createDataFrame([*ops, (2, 0, "INSERT", None, None, 0, "x"), (2, 1, "DELETE", None, 1, 0, None), (9, 0, "DELETE", 1, 1, 0, None)], "file_id long, op_ord int, operation string, start_line int, end_line int, indent int, content string")
    keys = ("op_ord", "operation", "start_line", "end_line", "indent", "content")
    want = in_turn(source, [dict(zip(keys, [*x[1:-1], x[-1] or ""])) for x in ops])
    assert {r["file_id"]: r["source"] for r in delta.apply_sequential(f, o).collect()} == {1: want, 2: "\nx\n"}


def test_replace_with_same_text_is_identity(spark):
    f = spark.createDataFrame([(1, "def f():\n    return 1\n\n\ndef g():\n    return 2\n")], "file_id long, source string")
    o = spark.createDataFrame([(1, 0, "REPLACE", 1, 2, 0, "def f():\n    return 1\n")], "file_id long, op_ord int, operation string, start_line int, end_line int, indent int, content string")
    assert delta.apply_lines(blocks.line_table(f), o).first()["source"] == f.first()["source"]
    assert delta.overlapping(o.union(o)).count() == 1 and delta.overlapping(o).count() == 0


def test_parse_and_validate(spark):
    body = '{"operations":[{"operation":"REPLACE","target":{"file":"a.py","symbol_type":"function","symbol_name":"f(x)"},"content":"def f(): pass"}]}'
    rows = [("ok", body), ("op", body.replace("REPLACE", "UPDATE")), ("none", "{}"), ("bad", "not json"), ("kind", '{"operations":[],"escalate":{"kind":"dance"}}'), ("esc", '{"operations":[],"escalate":{"kind":"question"}}')]
    parsed = delta.parse(spark.createDataFrame(rows, "run_id string, body string"))
    assert {r["run_id"]: r["valid"] for r in parsed.collect()} == {"ok": True, "op": False, "none": False, "bad": False, "kind": False, "esc": True}
    ops = delta.operations(parsed)
    assert ops.first()["symbol_name"] == "f"
    symbols = spark.createDataFrame([(1, "a.py", "f", "function", 2, 3, 0), (2, "a.py", "g", "function", 5, 6, 0), (3, "a.py", "g", "function", 8, 9, 0)], "symbol_id long, file string, name string, symbol_type string, start_line int, end_line int, indent int")
    lines = spark.createDataFrame([("a.py", 2, "@app.route('/')"), ("a.py", 3, "def f(): pass")], "file string, n int, line string")
    want = [("REPLACE", "f", None, "@app.route('/')\ndef f(): pass", "OK"), ("REPLACE", "f", None, "def f(): pass", "DECORATORS_LOST"), ("DELETE", "g", None, None, "AMBIGUOUS"), ("DELETE", "h", None, None, "MISSING"), ("INSERT", "x", "f", "def g(): pass", "ALREADY_DEFINED"), ("INSERT", "x", "h", "def n(): pass", "MISSING"), ("INSERT", "x", None, "def n(): pass", "OK")]
    o = spark.createDataFrame([("r", i, op, "a.py", "function", name, anchor, content) for i, (op, name, anchor, content, _) in enumerate(want)], "run_id string, op_ord int, operation string, file string, symbol_type string, symbol_name string, anchor string, content string")
    got = {r["op_ord"]: r["status"] for r in delta.validate_targets(o, symbols, None, lines).collect()}
    assert got == {i: w[4] for i, w in enumerate(want)}
    shown = spark.createDataFrame([("r", "other")], "run_id string, symbol_name string")
    assert delta.validate_targets(o.where("op_ord = 0"), symbols, shown, lines).first()["status"] == "UNSEEN_REPLACE"


@pytest.mark.parametrize(
    ("source", "old", "new", "want"),
    [
        ("tan(x) + tangent", "tan", "tg", "tg(x) + tangent"),
        ("buildOpenAIClient()", "openai", "bifrost", "buildBifrostClient()"),
        ("load_api_key", "api", "gateway", "load_gateway_key"),
        ("LOAD_API_KEY", "apikey", "token", "LOAD_TOKEN"),
        ("nothing", "zzz", "y", "nothing"),
    ],
)
def test_rename(spark, source, old, new, want):
    f = spark.createDataFrame([(1, source, old, new), (2, None, old, new)], "file_id long, source string, old_name string, new_name string")
    assert {r["file_id"]: r["renamed"] for r in delta.rename(f).collect()} == {1: want, 2: None}


@pytest.mark.parametrize(("name", "old", "want"), [("HTTPServerName", "server", "HTTPClientName"), ("_my_api_key", "apikey", "_my_client"), ("parseHTTP2Frame", "http2", "parseCLIENTFrame"), ("aBc", "bc", "aClient"), ("abc", "bc", "abc"), ("api_api_key", "api_key", "api_api_key"), ("a__b", "ab", "client")])
def test_rename_part(name, old, want):
    assert delta.rename_part(name, old, "client") == want


def test_diff_round_trip(spark):
    before, after = "a\nb\nc\nd\n", "a\nB\nc\nd\ne\n"
    pairs = spark.createDataFrame([(1, "x", before, after)], "file_id long, path string, before string, after string")
    d = delta.diffs(pairs)
    assert d.first()["change_ratio"] == 3 / 4
    rows = delta.parse_diff(d).orderBy("pos").collect()
    assert [r["text"] for r in rows if r["kind"] != "del"] == after.splitlines()
    assert [(r["text"], r["new_line"]) for r in rows if r["kind"] == "add"] == [("B", 2), ("e", 5)]


def test_block_response(spark):
    text = "noise\n===BLOCK: a===\nx\ny\n===END BLOCK===\n===BLOCK: b===\nz\n===END BLOCK==="
    got = spark.createDataFrame([(text,)], "t string").select(delta.parse_block_response(F.col("t")).alias("b")).first()["b"]
    assert [(b["name"], b["content"]) for b in got] == [("a", "x\ny"), ("b", "z")]


def test_cost_and_versions(spark):
    prices = versions.price_table(spark, '{"m": [0.001, 0.002]}')
    calls = spark.createDataFrame([("r", 1, "gpt-5.4", 1000, 5000, 1000, 10), ("r", 2, "m", 1000, 500, 0, 5), ("s", 1, "unknown", 9, 0, 9, 1)], "run_id string, attempt int, model string, input_tokens long, cached_tokens long, output_tokens long, latency_ms long")
    got = {r["run_id"]: (r["cost_usd"], r["retry_count"], r["latency_ms"]) for r in versions.fold_runs(versions.call_costs(calls, prices)).collect()}
    assert got == {"r": (round(0.00025 + 0.015 + 0.001, 6), 1, 15), "s": (0.0, 0, 1)}
    assert versions.price_table(spark, "not json").count() == 2
    commits = spark.createDataFrame([("p", "2026-01-01", "a"), ("p", "2026-01-02", "b"), ("q", "2026-01-01", "c")], "project_id string, created_at string, commit_id string")
    first = versions.chain(commits)
    assert {(r["project_id"], r["version_id"], r["parent_n"]) for r in first.collect()} == {("p", "v1", None), ("p", "v2", 1), ("q", "v1", None)}
    assert versions.chain(commits.where("commit_id = 'c'"), versions.head(first)).first()["version_n"] == 2
    points = spark.createDataFrame([("p", 1, "f", "1", False), ("p", 2, "f", "2", False), ("p", 3, "f", None, True)], "project_id string, version_n int, filename string, content string, deleted boolean")
    assert [versions.as_of(points, n).count() for n in (0, 1, 3)] == [0, 1, 0] and versions.as_of(points, 2).first()["content"] == "2"
    tries = spark.createDataFrame([("r", 1, "bad"), ("r", 2, "ok"), ("r", 3, "ok"), ("s", 1, "bad"), ("s", 2, "bad")], "run_id string, attempt int, status string")
    assert sorted((r["run_id"], r["attempt"]) for r in versions.best_attempt(tries).collect()) == [("r", 2), ("s", 2)]


def test_the_only_definition(spark):
    two = "def _inner(x):\n    return x\n\ndef helper(x):\n    return _inner(x)\n"
    rows = [(two, "a.py", None), ("    @x\n    def f():\n        def g(): pass\n", "a.py", "f"), ("class A:\n    def m(self): pass", None, "A"), ("function f() {\n  function g() {}\n}", None, "f"), ("function f() {}\nfunction g() {}", None, None), ("x = 1", "a.py", None), (None, "a.py", None), ("def (", "a.py", None)]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "k int, c string, p string").select("k", delta.definition(F.col("c"), F.col("p")).alias("d"))
    assert {r["k"]: r["d"] for r in got.collect()} == {i: r[2] for i, r in enumerate(rows)}


def test_edits_keep_what_they_do_not_name(spark):
    """A helper before the function renames nothing, line ends stay, equal names need a line, and requests do not mix."""
    from lodeline.plans.engine import Engine

    twins = "class A:\n    def go(self):\n        return 1\n\n\nclass B:\n    x = 1\n\n    def go(self):\n        return 2\n"
    shim = "class C:\n    def run(self):\n        return 3\n\n\ndef run():\n    return C.run(C())\n"
    project = spark.createDataFrame([("h.py", "def helper(x):\n    return x\n\n\ny = helper(1)\n"), ("crlf.py", "def f():\r\n    return 1\r\n\r\n\r\ndef g():\r\n    return 2"), ("twins.py", twins), ("shim.py", shim)], "path string, source string")
    op = lambda kind, name, content="null": '{"operations":[{"operation":"%s","target":{"symbol_type":"function","symbol_name":"%s"},"content":%s}]}' % (kind, name, content)
    deltas = [
        ("helper", "h.py", op("REPLACE", "helper", '"def _inner(x):\\n    return x\\n\\ndef helper(x):\\n    return _inner(x)\\n"')),
        ("crlf", "crlf.py", op("REPLACE", "f", '"def f():\\n    return 7\\n"')), ("open", "twins.py", op("DELETE", "go")), ("pinned", "twins.py", op("DELETE", "go")),
        ("via", "shim.py", op("REPLACE", "run", '"def run(self):\\n    return 4\\n"')), ("ask", "shim.py", op("DELETE", "run")),
    ]
    engine = Engine(spark, project)
    prefer = spark.createDataFrame([("pinned", "go", 9)], "run_id string, symbol_name string, prefer_line int")
    got = {r["run_id"]: r for r in engine.edit(spark.createDataFrame(deltas, "run_id string, file string, body string"), prefer=prefer).collect()}
    assert got["helper"]["source"] == "def _inner(x):\n    return x\n\ndef helper(x):\n    return _inner(x)\n\n\ny = helper(1)\n"
    assert got["crlf"]["source"] == "def f():\n    return 7\n\r\n\r\ndef g():\r\n    return 2"
    assert (got["open"]["status"], got["open"]["error"]) == ("REFERENCE_ERROR", "AMBIGUOUS")
    assert got["pinned"]["status"] == "ok" and got["pinned"]["source"] == twins[: twins.index("    def go(self):\n        return 2")]
    assert got["via"]["source"] == shim.replace("return 3", "return 4") and got["ask"]["error"] == "AMBIGUOUS"
    made = engine.plan_create(spark.createDataFrame([(1, "n.py", "x = 1"), (2, "n.py", "def (")], "request_id long, path string, content string")).collect()
    assert {r["request_id"]: r["status"] for r in made} == {1: "ok", 2: "SYNTAX_ERROR"}
    engine.close()

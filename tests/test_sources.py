import json
import random
import time
from datetime import datetime, timedelta

from pyarrow.fs import LocalFileSystem
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeline.operators import retrieval, versions
from lodeline.plans.engine import Engine
from lodeline.plans.settings import Settings, project_id
from lodeline.sources import code, files, pages
from lodeline.streaming import events as streams

CALCULATOR = '''import math
from os import path as p


def add(a, b):
    """Add two numbers.

    More."""
    return a + b


class Tools:
    @staticmethod
    async def run(x: int, *rest, key=None, **more) -> int:
        return add(x, math.sin(x))
'''


def frame(spark, *rows):
    return files.detect_language(spark.createDataFrame(rows, "path string, source string"))


def test_python_symbols_and_metadata(spark):
    f = frame(spark, ("calc.py", CALCULATOR), ("bad.py", "def ("), ("notes.txt", "x"))
    got = {r["name"]: r for r in code.symbols(f.where("language = 'python'")).collect()}
    assert set(got) == {"add", "Tools", "run"}
    assert (got["add"]["start_line"], got["add"]["end_line"], got["add"]["docstring_first_line"]) == (5, 9, "Add two numbers.")
    assert (got["run"]["start_line"], got["run"]["parent_class"], got["run"]["indent"]) == (13, "Tools", 4)
    assert [got[n]["ordinal"] for n in ("add", "Tools", "run")] == [0, 1, 2]
    meta = {r["name"]: r for r in code.metadata(f.where("language = 'python'")).collect()}["run"]
    assert meta["parameters"] == ["x", "*rest", "key", "**more"] and meta["decorators"] == ["staticmethod"] and meta["return_type_hint"] == "int" and meta["is_async"] and meta["calls"] == ["add", "sin"]
    imports = code.imports(f).orderBy("start_line").collect()
    assert [i["names"] for i in imports] == [["math"], ["p"]] and code.import_span(code.imports(f)).first()["end_line"] == 2
    errors = {r["path"]: len(r["errors"]) for r in code.syntax_errors(f).collect()}
    assert errors == {"calc.py": 0, "bad.py": 1, "notes.txt": 0}
    looks = f.select("path", code.looks_like_python(F.col("source")).alias("x")).collect()
    assert {r["path"]: r["x"] for r in looks} == {"calc.py": True, "bad.py": False, "notes.txt": False}


def test_other_languages():
    java = "public class A {\n  private int f(int x) {\n    return g(x);\n  }\n}\n"
    assert [(s["name"], s["symbol_type"], s["start_line"], s["end_line"]) for s in code.other_symbols("A.java", java, "java")] == [("A", "class", 1, 5), ("f", "function", 2, 4)]
    assert [(s["name"], s["end_line"]) for s in code.other_symbols("m.rs", "pub fn go(a: u8) -> u8 {\n a\n}\nstruct S { x: u8 }\n", "rust")] == [("go", 3), ("S", 4)]
    assert [(s["name"], s["end_line"]) for s in code.other_symbols("m.rb", "def hi\n  1\nend\n", "ruby")] == [("hi", 3)]
    assert code._errors("f(a[0)]", "javascript") and not code._errors("f('(')", "javascript")
    assert code.defined_name("def f(): pass") == "f" and code.defined_name("x = 1") is None


def test_html():
    html = '<html><body>\n<header id="top">a</header>\n<main class="big wide">\n<p>x</p>\n</main>\n<br>\n</body></html>'
    assert pages.element_blocks(html) == [("header#top", 2, 2), ("main.big", 3, 5), ("br", 6, 7)]
    assert pages.element_blocks("") == []


def test_scan_and_listing(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "sub/b.md": "# B", ".git/c": "no", "node_modules/d.js": "no", "skip/e.py": "no", "sub/__init__.py": "y = 1", ".engineignore": "# c\nskip\n", "bin.dat": None}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\xff\xfe\x00" if text is None else text.encode())
    got = {r["path"]: r["language"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "sub/b.md": "markdown", "sub/__init__.py": "python", ".engineignore": None}
    # stores that only Spark reads, and stores that a function opens
    rules = files.ignore_rules(spark, str(tmp_path))
    whole = {(r["path"], bytes(r["content"]), r["size"], r["mtime"].replace(microsecond=0)) for r in files._spark_files(spark, str(tmp_path), rules).collect()}
    opened = lambda: (LocalFileSystem(), str(tmp_path))
    walked = files.walk(spark, opened, rules)
    assert whole == {(r["path"], bytes(r["content"]), r["size"], r["mtime"].replace(microsecond=0)) for r in files.contents(walked, opened).collect()} and len(whole) == 5
    (tmp_path / "sub/b.md").unlink()
    assert {r["path"] for r in files.contents(walked, opened).collect()} == {w[0] for w in whole} - {"sub/b.md"}
    (tmp_path / "empty").mkdir()
    assert files.scan(spark, str(tmp_path / "empty")).count() == 0
    rows = files.listing(spark.createDataFrame([("b/x.py",), ("A.py",), ("b/c/y.py",), ("p.egg-info",)], "path string")).where("parent = ''").collect()
    assert [(r["name"], r["is_file"]) for r in rows] == [("b", False), ("A.py", True)]
    store = files.Store(spark, str(tmp_path / "store"))
    store.put(spark.createDataFrame([("k/1", "a"), ("k/2", "b"), ("k/1", "A")], "key string, body string"), "t")
    assert store.get("t", "k/1").first()["body"] == "a"
    store.put(spark.createDataFrame([("k/1", "c")], "key string, body string"), "t")
    assert store.get("t", "k/1").first()["body"] == "c" and store.exists("t", "k/2") and not store.exists("t", "z") and store.list("t", "k/").count() == 2


def test_engine(spark):
    e = Engine(spark, spark.createDataFrame([("calc.py", CALCULATOR), ("notes.md", "# One\ntext\n# Two\nmore\n")], "path string, source string"))
    ask = spark.createDataFrame([(1, "change the add function")], "request_id long, text string")
    assert e.find(ask).orderBy("rank").first()["name"] == "add" and e.best_file(ask).first()["file"] == "calc.py"
    routes = spark.createDataFrame([(1, "Rename add to plus", "calc.py", None, None), (2, "delete Tools", "calc.py", None, None), (3, "delete notes", "notes.md", None, None), (4, "change one", "notes.md", None, None), (5, "what is this", "calc.py", "question", 0.9), (6, "speed up", "calc.py", "question", 0.5)], "request_id long, text string, file string, kind string, kind_confidence double")
    assert {r["request_id"]: r["route"] for r in e.routes(routes).collect()} == {1: "rename", 2: "delete", 3: "delete_file", 4: "blocks", 5: "question", 6: "structured_edit"}
    op = '{"operations":[{"operation":"%s","target":{"symbol_type":"function","symbol_name":"%s"},"content":%s}]}'
    deltas = [("good", "calc.py", op % ("REPLACE", "add", '"def add(a, b):\\n    return b + a"')), ("gone", "calc.py", op % ("DELETE", "nope", "null")), ("broken", "calc.py", op % ("REPLACE", "add", '"def add(:"')), ("empty", "calc.py", '{"operations":[]}'), ("bad", "calc.py", "{}")]
    got = {r["run_id"]: r for r in e.edit(spark.createDataFrame(deltas, "run_id string, file string, body string")).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"good": "ok", "gone": "REFERENCE_ERROR", "broken": "SYNTAX_ERROR", "empty": "NO_OP", "bad": "SCHEMA_ERROR"}
    assert "return b + a" in got["good"]["source"] and "class Tools" in got["good"]["source"] and got["good"]["change_ratio"] > 0
    made = e.plan_create(spark.createDataFrame([(1, "calc.py", "x"), (2, "new.py", "```python\nx = 1\n```"), (3, "bad.py", "def (")], "request_id long, path string, content string"))
    assert {r["request_id"]: r["status"] for r in made.collect()} == {1: "EXISTS", 2: "ok", 3: "SYNTAX_ERROR"}
    assert e.metadata().where("name = 'add'").first()["called_by_count"] == 2  # the method and the class around it
    assert [r["name"] for r in e.text_blocks().orderBy("ordinal").collect()] == ["One", "Two"]
    e.close()


def test_confirmations(spark, tmp_path):
    at = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    rows = [("a", "stash", at(0), None), ("a", "resolve", at(10), True), ("b", "stash", at(0), None), ("b", "resolve", at(20), False), ("c", "stash", at(0), None), ("d", "stash", at(5), None), ("d", "resolve", at(200), True)]
    e = spark.createDataFrame(rows, "run_id string, kind string, ts timestamp, accept boolean")
    want = {"a": "accepted", "b": "rejected", "c": "expired", "d": "expired"}
    assert {r["run_id"]: r["outcome"] for r in streams.confirmations_batch(e.where("kind = 'stash'"), e.where("kind = 'resolve'"), 100).collect()} == want
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("z", "stash", at(10_000), None)], e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.confirmations_stream(streams.read_events(spark, str(tmp_path / "in")), 100)
    q = stream.writeStream.format("memory").queryName("confirmed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from confirmed").collect()
    assert sorted((r["run_id"], r["outcome"]) for r in got) == sorted(want.items())


def test_event_streams(spark, tmp_path):
    rows = [(1, datetime(2026, 1, 1), 7, "click", 1.0), (2, datetime(2026, 1, 1, 0, 10), 7, "click", 2.0), (3, datetime(2026, 1, 1, 5), 7, "view", 4.0)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    assert sorted((r["n"], r["total"]) for r in streams.tumbling(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r["n"] for r in streams.sessions(e).collect()) == [1, 2]
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.tumbling(streams.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from tumbled").where("event_type = 'click'").first()["n"] == 2
    frames = streams.step_frames(e.select("event_id")).select(F.concat_ws("", F.collect_list("frame").over(Window.partitionBy())).alias("buffer")).limit(1)
    assert [r["body"] for r in streams.parse_frames(frames.sparkSession.createDataFrame([('data: {"a":1}\n\ndata: {"b"',)], "buffer string")).collect()] == ['{"a":1}']
    assert streams.parse_frames(frames).count() == 3


def test_metadata_sinks(spark, tmp_path):
    at = str(tmp_path / "meta")
    rows = spark.createDataFrame([("a.py", "f", 1), ("sub/b.py", "g", 2)], "file string, name string, start_line int")
    files.write_metadata(rows, at)
    files.write_metadata(spark.createDataFrame([("a.py", "f2", 1)], rows.schema), at)
    assert {(r["file"], r["name"]) for r in spark.read.json(at).collect()} == {("a.py", "f2"), ("sub/b.py", "g")}
    assert files.delete_metadata(spark, at, ["sub/b.py", "none.py"]) == 1
    assert [r["file"] for r in spark.read.json(at).collect()] == ["a.py"]
    meta = spark.createDataFrame([("p", "f"), ("q", "g")], "project_id string, name string")
    prints = spark.createDataFrame([("p", "1"), ("q", "1")], "project_id string, fingerprint string")
    whole = str(tmp_path / "projects")
    assert files.write_project_metadata(meta, prints, whole) and not files.write_project_metadata(meta, prints, whole)
    changed = spark.createDataFrame([("p", "f3"), ("q", "not read")], meta.schema)
    assert files.write_project_metadata(changed, spark.createDataFrame([("p", "2"), ("q", "1")], prints.schema), whole)
    assert {(r["project_id"], r["name"]) for r in spark.read.json(f"{whole}/symbols").collect()} == {("p", "f3"), ("q", "g")}


def test_optional_inputs_and_settings(spark, tmp_path):
    assert not files.available(spark, "") and not files.available(spark, str(tmp_path / "none")) and files.available(spark, str(tmp_path))
    (tmp_path / "python.json").write_text('{"caller": "a", "file": "x.py", "callee": "b", "line": 3}\n')
    got = files.call_graphs(spark, str(tmp_path), ("python", "java")).collect()
    assert [tuple(r) for r in got] == [("python", "a", "x.py", "b", 3)]
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "request_id long, text string")
    known = spark.createDataFrame([(7, 0), (8, 1)], "symbol_id long, ordinal long")
    assert retrieval.optional_vectors(asked, known, str(tmp_path / "none")) is None
    spark.createDataFrame([("request", 1, [1.0, 0.0]), ("symbol", 7, [0.0, 2.0]), ("symbol", 8, [3.0, 0.1]), ("symbol", 9, None)], "kind string, id long, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    assert [(r["request_id"], r["symbol_id"], r["rank"]) for r in retrieval.optional_vectors(asked, known, str(tmp_path / "vectors")).orderBy("rank").collect()] == [(1, 8, 1), (1, 7, 2)]
    spark.conf.set("lodeline.max_repairs", "5")
    try:
        settings = Settings.of(spark)
    finally:
        spark.conf.unset("lodeline.max_repairs")
    assert settings.max_repairs == 5 and settings.kind_confidence == 0.8 and Settings.of(spark).max_repairs == 2
    assert [project_id(*x, settings) for x in ((None, None), ("p", "/a/b"), (None, "/a/b/"))] == ["default", "p", "b"]


def test_runs_are_kept(spark, tmp_path):
    at = str(tmp_path / "runs")
    runs = spark.createDataFrame([("p", "r1", "ok"), ("q", "r2", "failed")], "project_id string, run_id string, status string")
    deltas = spark.createDataFrame([("p", "r1", None, "{}"), ("q", "r2", 2, None)], "project_id string, run_id string, attempt int, body string")
    versions.persist_runs(versions.run_records(runs, deltas), at)
    versions.persist_runs(versions.run_records(runs.where("run_id = 'r2'").withColumn("status", F.lit("ok")), deltas.limit(0)), at)
    got = {(r["project_id"], r["key"]): r["body"] for r in versions.persisted_runs(spark, at).collect()}
    assert got.keys() == {("p", "benchmarks/r1"), ("p", "deltas/r1"), ("q", "benchmarks/r2")} and '"ok"' in got["q", "benchmarks/r2"]


def test_steps_are_told(spark):
    told = []
    e = Engine(spark, spark.createDataFrame([("a.py", CALCULATOR)], "path string, source string"), on_step=lambda step, detail: told.append(step))
    e.find(spark.createDataFrame([(1, "add")], "request_id long, text string"))
    assert told == ["LOCALIZE"] and e.project_id == "default"
    found = e.find(spark.createDataFrame([(1, "change the add function")], "request_id long, text string")).orderBy("rank").first()
    assert [(x["file"], x["line"]) for x in found["call_sites"]] == [("a.py", 15)]
    e.close()


def test_frames_stream_by_any_cut(spark, tmp_path):
    """Bytes cut anywhere, chunks in any order over several batches and some twice, give the frames of the whole buffer."""
    rng, whole, batches = random.Random(3), {}, [[], [], []]
    for run in range(6):
        tags = [rng.choice(["é", "b c", None]) for _ in range(rng.randint(1, 6))]
        bodies = [json.dumps({"type": "step", "tag": t}, ensure_ascii=False) for t in tags] + ["no json", "[1]"][: run % 3] + ['{"type": "done"}'] * (run % 2)
        whole[run] = "".join(f"data: {b}\n\n" for b in bodies) + ": comment\n\n" * (run % 2) + 'data: {"type": "st'
        raw, cuts = whole[run].encode(), [0]
        while cuts[-1] < len(raw):
            cuts.append(min(len(raw), cuts[-1] + rng.randint(1, 9)))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for batch in {rng.randrange(3), rng.randrange(3)} if i % 4 == 0 else {rng.randrange(3)}:
                batches[batch].append((run, i, raw[a:b]))
    for rows in [*batches, [(None, 0, b"data: x\n\n"), (1, None, b"y"), (2, 10_000, None)]]:
        rng.shuffle(rows)
        spark.createDataFrame(rows, "run_id long, seq long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    try:
        frames = streams.frames_stream(streams.read_events(spark, str(tmp_path / "in")))
        frames.writeStream.format("memory").queryName("frames_by_any_cut").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.table("frames_by_any_cut").collect()
    assert [r["body"] for r in rows if r["run_id"] is None] == ["x"]
    for run, text in whole.items():
        got = sorted((r for r in rows if r["run_id"] == run), key=lambda r: r["pos"])
        want = streams.parse_frames(spark.createDataFrame([(text,)], "buffer string")).orderBy("pos").collect()
        assert [r["body"] for r in got] == [r["body"] for r in want]
        read = [json.loads(r["body"]) if r["body"].startswith("{") else {} for r in want]
        taken = [x.get("tag") for x in read if x.get("type") == "step"]
        assert (got[-1]["n_steps"], got[-1]["last_tag"], got[-1]["done"]) == (len(taken), taken[-1], bool(run % 2))


def test_state_is_asked_by_stretches():
    """300 chunks that wait over batches take a call of the state a stretch, not a chunk, and give what they give in order."""
    calls = []

    class State:
        def __init__(self):
            self.value, self.held = None, {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                return {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "exists": lambda: self.value is not None, "containsKey": lambda k: k in self.held,
                        "getValue": lambda k: self.held.get(k), "updateValue": self.held.__setitem__, "removeKey": lambda k: self.held.pop(k)}[name](*args)

            return call

    class Handle:
        getValueState = getMapState = lambda self, *a, **b: State()

    text = "".join(f'data: {{"type":"step","tag":"{i}"}}\n\n' for i in range(100)).encode()
    chunks = [{"seq": i, "chunk": text[i * 10 : i * 10 + 10]} for i in range(-(-len(text) // 10))]
    assert len(chunks) > 300
    frames, out = streams._Frames("run_id", None), []
    frames.init(Handle())
    for batch in (chunks[2::3], chunks[1::3], chunks[1:40:3], chunks[0:90:3], chunks[0::3]):
        out += list(frames.handleInputRows((7,), iter(batch), None))
    assert [(r["run_id"], r["pos"], r["n_steps"], r["last_tag"]) for r in out] == [(7, i, i + 1, str(i)) for i in range(100)]
    assert not frames.early.__dict__["held"] and len(calls) < 60


def test_a_silent_run_is_forgotten(spark, tmp_path):
    def put(body):
        spark.createDataFrame([(1, 0, body)], "run_id long, seq long, chunk binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(b"data: a\n\ndata: unfi")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    try:
        frames = streams.frames_stream(streams.read_events(spark, str(tmp_path / "in")), silence_ms=1000)
        run = frames.writeStream.format("memory").queryName("frames_of_silent_runs").option("checkpointLocation", str(tmp_path / "state")).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    try:
        for want in (["a"], ["a", "b"]):
            until = time.time() + 40
            while len(got := [r["body"] for r in spark.table("frames_of_silent_runs").collect()]) < len(want) and time.time() < until:
                time.sleep(0.5)
            assert got == want
            time.sleep(2)
            put(b"data: b\n\n")  # numbered from 0 again: only a run that was forgotten takes it
    finally:
        run.stop()


def test_commit_sink(spark, tmp_path):
    write = streams.commit_sink(str(tmp_path / "versions"))
    batch = lambda *ids: spark.createDataFrame([(i, "accepted" if i != "no" else "rejected", datetime(2026, 1, 1)) for i in ids], "run_id string, outcome string, resolved_at timestamp")
    write(batch("a", "no", "b"), 0)
    write(batch("c"), 1)
    write(batch("c"), 1)  # an epoch that is written again is replaced
    got = spark.read.parquet(str(tmp_path / "versions")).orderBy("version_n").collect()
    assert [(r["commit_id"], r["version_n"], r["parent_n"]) for r in got] == [("a", 1, None), ("b", 2, 1), ("c", 3, 2)]
    write(batch("no"), 2)  # a batch without versions hands the number on
    write(batch("d"), 3)
    write(batch("e"), 7)  # the batch before left no number
    write(batch("d"), 3)
    got = spark.read.parquet(str(tmp_path / "versions")).orderBy("version_n").collect()
    assert [(r["commit_id"], r["version_n"]) for r in got] == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    assert [r["head"] for r in spark.read.parquet(str(tmp_path / "versions.heads/epoch=7")).collect()] == [5]


def test_written_files_are_scanned(spark, tmp_path):
    """The workers write what the workers read, and all tasks of them do."""
    rows = [(f"k={i}/a b.txt", f"é{i}\r\nx\n") for i in range(300)] + [("deep/er/.hid.py", "x = 1"), ("none.txt", None)]
    made = spark.createDataFrame(rows, "path string, source string").coalesce(1)
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert files.write(spark, f"file://{tmp_path}/new/root", made)
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == spark.sparkContext.defaultParallelism > 1
    got = {r["path"]: r["source"] for r in files.scan(spark, f"{tmp_path}/new/root").collect()}
    assert got == {p: x or "" for p, x in rows}

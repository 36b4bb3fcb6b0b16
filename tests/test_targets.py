"""Close names against all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from lodeline.operators import targets


def ratio(word, low):
    m = difflib.SequenceMatcher()
    m.set_seq2(word)
    m.set_seq1(low)
    return m.ratio()


def named(rng):
    return "_".join("".join(rng.choices("etaoinsrdlqzé", k=rng.randint(2, 6))) for _ in range(rng.randint(1, 3)))


def test_close_pairs_lose_none(spark):
    rng = random.Random(21)
    names = {named(rng) for _ in range(400)} | {"a", "aa", "aaa", "aaaa", "é", "x" * 230}
    words = {named(rng) for _ in range(60)} | {"a", "aaa", "zzzz", "x" * 240}
    for n in rng.sample(sorted(names), 80):  # names with letters lost, added and moved
        x = list(n)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([[], [rng.choice("etaq")], [x[i], "z"], []]) or []
            if not x:
                x = ["q"]
        words.add("".join(x))
    words, names = sorted(words), sorted(names)
    want = {(w, n) for w in words for n in names if ratio(w, n) >= targets.CLOSE_RATIO}
    frames = spark.createDataFrame([(w,) for w in [*words, ""]], "word string"), spark.createDataFrame([(n,) for n in [*names, ""]], "low string")
    met = {tuple(r) for r in targets.close_pairs(*frames).collect()}
    assert want <= met and len(want) > 80
    # every pair that meets shares enough characters, and those are few of the pairs of fitting lengths
    fit = sum(0.6 * len(w) <= len(n) <= len(w) / 0.6 for w in words for n in names)
    shared = lambda w, n: sum(min(w.count(c), n.count(c)) for c in set(w))
    assert all(2 * shared(w, n) >= targets.CLOSE_RATIO * (len(w) + len(n)) for w, n in met) and len(met) < 0.5 * fit


def test_close_candidates(spark):
    names = ["computetotal", "computetotals", "compute_total", "computetota", "renderpage", "rendrpage", "Parse"]
    symbols = spark.createDataFrame(list(enumerate(names)), "symbol_id long, name string")
    requests = spark.createDataFrame([(1, "delete computetotel"), (2, "remove renderpgae"), (3, "delete parse"), (4, "drop whollyunlike")], "request_id long, text string")
    got = targets.delete_candidates(requests, symbols).groupBy("request_id", "method").agg(F.sort_array(F.collect_set("symbol_id")).alias("ids")).collect()
    want = set()
    for i, word in ((1, "computetotel"), (2, "renderpgae")):
        close = difflib.get_close_matches(word, sorted({n.lower() for n in names}), n=3, cutoff=0.75)
        want.add((i, "fuzzy", tuple(sorted(k for k, n in enumerate(names) if n.lower() in close))))
    assert {(r["request_id"], r["method"], tuple(r["ids"])) for r in got} == want | {(3, "substring", (6,))}


def test_close_matches_are_the_best_of_all_pairs(spark):
    """Blocks of few strings, alike names (many beyond the bound's reach) and unlike ones: the best of each word, as difflib ranks all."""
    rng = random.Random(5)
    names = sorted({named(rng) for _ in range(300)} | {f"supplier{i}" for i in range(120)} | {"x" * 230, "a\nb", "é" * 5})
    words = sorted({named(rng) for _ in range(50)} | {f"suplier{i}" for i in range(0, 120, 7)} | {"x" * 240, "ééé"} | {n[1:] + "q" for n in names[::9]})
    frames = spark.createDataFrame([(w,) for w in [*words, ""]], "word string"), spark.createDataFrame([(n,) for n in [*names, ""]], "low string")
    got = targets.close_matches(*frames).toPandas()
    best = lambda pairs: sorted(pairs, reverse=True)[: targets.CLOSE_MATCHES]
    want = {w: best([(r, n) for n in names if (r := ratio(w, n)) >= targets.CLOSE_RATIO]) for w in words}
    assert {w: best(zip(g["ratio"], g["low"])) for w, g in got.groupby("word")} == {w: b for w, b in want.items() if b}
    # judged from the highest bound down, most alike names are never compared: 18 words and 120 names leave few rows
    assert len(got) < 1000


def test_deletions_within_a_file_and_by_many_requests(spark):
    """Close names of other files take no places of a file's own; requests of the same words share what they find."""
    symbols = spark.createDataFrame([(i, f"computetota{c}", "other.py") for i, c in enumerate("klmn")] + [(9, "compute_tot", "own.py")], "symbol_id long, name string, file string")
    requests = spark.createDataFrame([(1, "delete computetotal", "own.py"), (2, "delete computetotal", "other.py"), (3, "delete computetotal", "none.py")], "request_id long, text string, file string")
    got = {tuple(r) for r in targets.delete_candidates(requests, symbols).collect()}
    assert got == {(1, 9, "fuzzy"), (2, 1, "substring")}
    many = spark.range(500).select(F.col("id").alias("request_id"), F.lit("delete the computetota function").alias("text"))
    plan = targets.delete_candidates(many, symbols.drop("file"), fuzzy=False)
    assert {tuple(r) for r in plan.collect()} == {(i, k, "substring") for i in range(500) for k in range(4)}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("Exchange") > text.index("Join")  # the expansion is the last step: no shuffle behind it


def test_deletions_of_many_requests_are_stored_small(spark, tmp_path):
    """Symbols leave in packs, each request with a run of them: 5.5 million rows, all there, take under half a byte each."""
    symbols = spark.range(512).select((F.col("id") * 7919).alias("symbol_id"), F.concat(F.lit("widget"), F.col("id") % 37).alias("name"))
    many = spark.range(20_000).select((F.col("id") * 104729).alias("request_id"), F.when(F.col("id") % 2 == 0, "delete the widget function").otherwise("remove wigdet5").alias("text"))
    targets.delete_candidates(many, symbols).write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    close = [k for k, n in enumerate(f"widget{i % 37}" for i in range(512)) if n in difflib.get_close_matches("wigdet5", sorted(f"widget{i}" for i in range(37)), n=3, cutoff=0.75)]
    assert got.count() == got.distinct().count() == 10_000 * (512 + len(close)) and close
    assert {r[0] // 7919 for r in got.where("method = 'fuzzy'").select("symbol_id").distinct().collect()} == set(close)
    assert {(r[0] // 104729 % 2, r[1], r[2]) for r in got.groupBy("request_id", "method").count().collect()} == {(0, "substring", 512), (1, "fuzzy", len(close))}
    size = sum(p.stat().st_size for p in (tmp_path / "rows").glob("*.parquet"))
    assert 2 * size < got.count()

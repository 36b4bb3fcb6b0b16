"""Operators 11 to 13 against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import permutations, product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import conversation_repair, filter_audit, minhash, queries
from tests.llm.test_llm import ODD, documents, extra

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


# --- 11 --------------------------------------------------------------------------------------------------------------

def brute_audit(rows, labels):
    """rows: (doc_id, text, lang)."""
    last, first = 2**63, {}
    for i, text, _ in rows:
        i, text = last if i is None else i, text or ""
        first[text] = min(first.get(text, last + 1), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": (last if i is None else i) > first[text]}
        parts[lang or ""].append((frozenset(k for k, v in fails.items() if v), i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                fail = [d for d in docs if f in d[0]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(fail) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                total[f] += len(gone)
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audited(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_filter_audit(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(150):
        words = rng.choices([f"w{k}" for k in range(rng.choice([40, 400]))], k=rng.choice([0, 5, 99, 100, 130]))
        text = rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < rng.choice([0, 0.5]) else w for w in words) + rng.choice(["", "#", "|", " "])
        rows.append((i, rng.choice(rows)[1] if rows and rng.random() < 0.3 else text, rng.choice(["en", "de", "", None]), "s", 0))
        if rng.random() < 0.6:
            labels.append((i, rng.choice([0, 1, None]), rng.choice([0, 1])))
    labels += [labels[0], (None, 1, 1), (labels[1][0], 1, 1)]
    got = filter_audit.audit(extra(documents(spark, rows)), spark.createDataFrame(labels, LABELS))
    assert audited(got) == brute_audit([r[:3] for r in rows], labels)
    assert {k: t for k, t in got.dtypes} == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys("kept removed redundant unique_fails good_lost toxic_lost shapley".split(), "bigint")


def test_filter_audit_edges(spark, odd):
    labels = [(4, 1, 0), (None, 1, 1)]
    assert audited(filter_audit.audit(odd, spark.createDataFrame(labels, LABELS))) == brute_audit([r[:3] for r in ODD], labels)
    none = filter_audit.audit(odd.limit(0), spark.createDataFrame([], LABELS))
    assert none.count() == 0
    copies = [(None, "a", "en", "s", 1), (None, "a", "en", "s", 1), (2, "a", "de", "s", 1), (2, "a", "de", "s", 1), (2, "a", "en", "s", 1), (9, "a", "en", "s", 1)]
    assert audited(filter_audit.audit(documents(spark, copies), spark.createDataFrame([], LABELS))) == brute_audit([r[:3] for r in copies], [])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), []
    seen.append(tuple(order))
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


# --- 12 --------------------------------------------------------------------------------------------------------------

def brute_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                least[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def near_texts(seed=5, groups=12, copies=14):
    """Groups of near copies about the threshold, exact copies, chains of edits and short texts."""
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(rng.choice([3, 4, 5, 9, 40, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5]) if len(words) >= 40 else rng.choice([0, 0, 0, 1])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            if g % 3 == 0:
                base = words  # a chain
            texts.append(rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    texts += ["", None, " \t", "one", "One", "one two"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"SHARE": 4, "CLOSEST": 1}, {"SHARE": 3, "CLOSEST": 1, "GROUP": 5, "SHINGLES": 300}], ids=["usual", "small", "tiny"])
def test_minhash_components(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    rows = near_texts()
    docs = extra(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert got == want
    assert len(want) - len({c for _, c, _ in want.values()}) > 50


def test_every_pair_within_the_distance_meets(spark):
    """Signatures at every distance up to the bound, the errors spread as evenly over the chunks as can be, and beyond it."""
    rng = np.random.default_rng(8)
    symbols = [rng.integers(0, 1 << 16, minhash.POSITIONS, dtype=np.uint64) for _ in range(40)]
    for base in symbols[:20]:
        for d in (1, 7, 8, minhash.DISTANCE, minhash.DISTANCE + 1, 20):
            other, places = base.copy(), [(5 * k + k // 8) % minhash.POSITIONS for k in range(d)]
            other[places] ^= np.uint64(1 + rng.integers(0, 1000))
            symbols.append(other)
    names = [bytes([0, i % 256, i // 256]) + bytes(13) for i in range(len(symbols))]
    rows = [(n, *map(int, s.astype(np.uint16).view(np.int64))) for n, s in zip(names, symbols)]
    classes = spark.createDataFrame(rows, "cls binary, " + ", ".join(f"s{i} long" for i in range(minhash.POSITIONS // 4)))
    shared = minhash.members(classes)
    met = shared.join(classes, "cls").withColumn("comp", F.col("cls")).withColumn("n", F.lit(1))
    got = {(bytes(r["a"]), bytes(r["b"])) for r in minhash.closest(minhash.all_cells(met), None).collect()}
    want = {(min(x, y), max(x, y)) for i, (x, s) in enumerate(zip(names, symbols)) for y, t in zip(names[:i], symbols[:i]) if np.count_nonzero(s != t) <= minhash.DISTANCE}
    assert got == want and len(want) > 80


def test_shingle_sets_are_exact():
    rows = near_texts(seed=9)
    texts = [(t or "").encode() for _, t in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    lowered = np.frombuffer(data.tobytes().lower(), np.uint8)
    got, want = minhash._Sets(lowered, offsets), brute_sets(rows)
    mine = [frozenset(got.values[f : f + n].tolist()) for f, n in zip(got.first.tolist(), got.size.tolist())]
    assert [len(m) for m in mine] == [len(want[i]) for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            assert len(mine[i] & mine[j]) == len(want[i] & want[j])


def test_minhash_edges(spark, odd):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert got == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1, (None, 2, None, True): 1, (3, 1, 3, True): 1, (4, 6, 4, True): 2, (5, 0, 5, True): 1, (6, 1, 6, True): 1, (7, 0, 7, True): 1})
    assert sum(got.values()) == len(ODD)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    twins = documents(spark, [(None, "a b c d e f", "en", "s", 0), (5, "A b C d e f", "en", "s", 0), (5, "other words here", "en", "s", 0)])
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(twins).collect()) == Counter({(None, 5, False): 1, (5, 5, True): 2})


# --- 13 --------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
FORM = re.compile("(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(c, t, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) of one conversation's (role, text, must go, truncated), by best (cost, audit) from each place on."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}

    def solve(i, state, inserts):
        key = (i, state, inserts)
        if key not in best:
            options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if inserts < 3:
                for role in ("user", "assistant"):
                    if (state, role[0]) in steps:
                        cost, audit, turns = solve(i, role[0], inserts + 1)
                        options.append((cost + 3, "I" + audit, (f"{role}:", *turns)))
            if i < len(rows):
                role, text, go, cut = rows[i]
                cost, audit, turns = solve(i + 1, state, 0)
                options.append((cost + 4, "D" + audit, turns))
                if not go:
                    for letter, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                        if (state, new[:1]) in steps:
                            cost, audit, turns = solve(i + 1, new[:1], 0)
                            options.append((cost + price + 3 * cut, letter + audit, (f"{new}:{text}", *turns)))
            best[key] = min(options, default=(10**9, "", ()))
        return best[key]

    return solve(0, "", 0)


def brute_repair(rows):
    groups = {c: [] for c, *_ in rows}
    for r in brute_damage(rows):
        groups[r[0]].append(r)
    out = {}
    for c, mine in groups.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        seen, counts, edits = set(), Counter(), []
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, repaired = cheapest(edits)
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            role = rng.choice(["system", "tool", "", None, "usher"]) if rng.random() < 0.12 else role
            text = rng.choice(["Yes.", "No!", "What? ", "cut off", "", " \n", None, "Line one.\nLine two", "é…"]) if rng.random() < 0.7 else f"turn {rng.randint(0, 9)}."
            rows.append((c if rng.random() < 0.98 else None, rng.choice([t, t, t, t + 2, None]) if rng.random() < 0.2 else t, role, text))
    return rows


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame(rows, TURNS).repartition(parts).withColumn("kind", F.lit("x")).withColumn("none", F.lit(1)).withColumn("a.b", F.lit(2))
    return {r[0]: tuple(r[1:]) for r in conversation_repair.repair(df, conversation_repair.damaged(df)).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conversation_repair(spark, seed):
    rows = conversations(seed)
    assert repaired(spark, rows) == brute_repair(rows)


def test_long_conversation_in_stretches(spark):
    """One conversation over all ranges, most of whose rows are damaged further."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), f"turn {rng.randint(0, 300)}" + rng.choice([".", ".", ""])) for t in range(700)]
    rows += [(8, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(5)]
    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        want = brute_repair(rows)
    finally:
        sys.setrecursionlimit(depth)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few rows are one range
    try:
        assert repaired(spark, rows, 7) == want
        df = spark.createDataFrame(rows, TURNS)
        tight = conversation_repair._tight_rows(conversation_repair._faults(conversation_repair.damaged(df)))
        assert tight.where("c = 7").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edits_are_cheapest_of_all(spark):
    """Every edit string up to two inserts a gap, for short conversations without damage."""
    rng = random.Random(11)
    for _ in range(25):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), f"{k}.", rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randint(0, 3))]
        gap, found = ["", "u", "a", "ua", "au"], []
        for inserts in product(gap, repeat=len(rows) + 1):
            for edits in product("DKUA", repeat=len(rows)):
                roles, cost, audit = inserts[0], 3 * len(inserts[0]), "I" * len(inserts[0])
                for (role, _, go, cut), e, more in zip(rows, edits, inserts[1:]):
                    if go and e != "D":
                        break
                    roles += ("" if e == "D" else role[0] if e == "K" else e.lower()) + more
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if cut and e != "D" else 0) + 3 * len(more)
                    audit += {"D": "D", "K": "K"}.get(e, "R") + "I" * len(more)
                else:
                    if FORM.fullmatch(roles):
                        found.append((cost, audit))
        assert cheapest(rows)[:2] == min(found)


def test_conversation_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_repair.repair(empty, conversation_repair.damaged(empty)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    twice = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "Gone."), (None, None, None, None), (twice, 0, "user", "Same."), (twice, 0, "user", "Same."), (twice, 0, "user", "Same."), (twice + 1000, 0, "user", "x" * 300_000 + ".")]
    got = repaired(spark, rows)
    assert got == brute_repair(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_minhash"])
def test_queries_equal_sql(spark, name):
    from tests.test_catalog import rows

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, folder).toPandas()) == rows(con.sql(queries.ORACLE[name]).df())


def test_repair_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got == brute_repair(rows)

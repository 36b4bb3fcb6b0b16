"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.llm import bpe_codec, chunking, compression_rules, components, edit_fingerprint, license_scan, line_dedup, mixing, ordinal, simhash, substring_dedup, token_counts

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [(1, "", "en", "a", 0), (2, None, None, None, None), (None, "the null id\nthe null id", "en", "b", 11), (3, "x" * 200_000, "en", "a", 200_000), (4, "a b c d e\na b c d e f", "en", "", 5), (4, "a b c d e\na b c d e f", "en", "", 5), (5, " \t\n ", "de", "a", 4), (6, "word " * 5000, "en", "b", 25_000), (7, None, "en", "a", None)]


def documents(spark, rows=None, n=120, seed=7):
    if rows is None:
        rng = random.Random(seed)
        vocabulary = ["".join(rng.choices("abcdeéüñ", k=rng.randint(1, 7))) for _ in range(400)] + ["The", "a", "of", "MIT", "license"]
        rows, lines = [], []
        for i in range(n):
            mine = []
            for _ in range(rng.randint(0, 6)):
                old = rng.choice(lines) if lines and rng.random() < 0.45 else None
                words = old.split() if old else rng.choices(vocabulary, k=rng.randint(1, 25))
                for _ in range(rng.choice([0, 0, 1, 2]) if old else 0):
                    if words:
                        words[rng.randrange(len(words))] = rng.choice(vocabulary)
                mine.append(" ".join(words))
            lines += mine
            text = "\n".join(mine) if rng.random() > 0.15 or not rows else rng.choice(rows)[1]
            rows.append((i, text, "en", rng.choice(["s1", "s2", "s3", None]) if i % 3 else "s1", len(text)))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


CLASHING = (
    "id th h kind size number line fp count n at a b place row of of_th cuts d1 d2 k1 k2 span words first_id first_th removed whole all i k nth times slot slots copies copy bucket source_size target taken base begin block round "
    "rank weight grade word part body member component component_id least best near n_links n_lines __id __th __h __i __n __k __nth __removed __times __cuts __of __all a.b"
).split()


def extra(df):
    """A column name for every name that operators use inside."""
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# --- 1 ---------------------------------------------------------------------------------------------------------------

def brute_lines(rows, least=Fraction(4, 5)):
    seen, gone, total = [], defaultdict(list), Counter()
    for i, text in rows:
        for k, line in enumerate(text.encode().split(b"\n")):
            words = frozenset(line.split())
            if not words:
                continue
            total[i] += 1
            if any(len(words & o) * least.denominator >= least.numerator * len(words | o) for o in seen):
                gone[i].append(k)
            seen.append(words)
    return gone, total


@pytest.mark.parametrize("least", [0.8, 0.6])
def test_line_dedup(docs, rows, least):
    gone, total = brute_lines(rows, Fraction(least).limit_denominator(100))
    got = {r["doc_id"]: r for r in line_dedup.report(extra(docs), least=least).collect()}
    assert set(got) == {i for i, _ in rows}
    assert {i: r["removed"] for i, r in got.items() if r["removed"]} == {i: ",".join(map(str, v)) for i, v in gone.items()}
    assert all(got[i]["n_lines"] == total[i] for i in got)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs, least=least).collect()}
    for i, text in rows:
        left = [x for k, x in enumerate(text.split("\n")) if k not in gone[i]]
        assert kept.get(i) == (None if gone[i] and len(gone[i]) == total[i] else "\n".join(left))


def test_line_links(docs, rows):
    kinds = {}
    for _, text in rows:
        for line in text.encode().split(b"\n"):
            if line.split():
                kinds[tuple(sorted(Counter(line.split()).items()))] = frozenset(line.split())
    sets = list(kinds.values())
    want = sum(len(a & b) * 5 >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    got = line_dedup.line_matches(docs)
    by_doc = sum(r["n_links"] for r in got.collect())
    held = Counter(kind for _, text in rows for kind in {tuple(sorted(Counter(x.split()).items())): 0 for x in text.encode().split(b"\n") if x.split()} for _ in range(sum(tuple(sorted(Counter(x.split()).items())) == kind for x in text.encode().split(b"\n") if x.split())))
    links = {k: sum(len(w & o) * 5 >= 4 * len(w | o) for q, o in kinds.items() if q != k) for k, w in kinds.items()}
    assert sum(links.values()) == 2 * want and by_doc == sum(links[k] * n for k, n in held.items())


@pytest.mark.parametrize("limits", [line_dedup.Limits(), line_dedup.Limits(large=4, neighbours=2, held=3000, fair=5), line_dedup.Limits(large=7, neighbours=5, fair=1)], ids=["usual", "small", "odd"])
def test_hot_words(spark, limits):
    rng = random.Random(31)
    rows = []
    base = [f"r{k}" for k in range(12)]
    for i in range(70):  # one large group of near copies, and lines that share hot words without being alike
        line = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            line[rng.randrange(12)] = f"x{rng.randrange(40)}"
        other = ["hot1", "hot2", "hot3", *(f"y{rng.randrange(400)}" for _ in range(rng.randint(0, 6)))]
        rows.append((i, " ".join(line) + "\n" + " ".join(other), "en", "s", 0))
    docs = documents(spark, rows)
    gone, _ = brute_lines([r[:2] for r in rows])
    got = line_dedup.line_matches(docs, limits=limits).collect()
    assert {r["id"]: r["removed"] for r in got if r["removed"]} == dict(gone)
    every = [(i, frozenset(x.split())) for i, t, *_ in rows for x in t.split("\n")]
    kinds = {tuple(sorted(x.split())) for _, t, *_ in rows for x in t.split("\n")}
    want = Counter()
    for i, t, *_ in rows:
        for x in t.split("\n"):
            want[i] += sum(k != tuple(sorted(x.split())) and 5 * len(set(k) & set(x.split())) >= 4 * len(set(k) | set(x.split())) for k in kinds)
    assert {r["id"]: r["n_links"] for r in got} == {i: want[i] for i, *_ in rows} and len(every) == 140 and sum(want.values()) > 500


def test_line_dedup_edges(odd, spark):
    got = [(r["doc_id"], r["n_lines"], r["removed"]) for r in line_dedup.report(odd).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, ""), (2, 0, ""), (None, 2, "1"), (3, 1, ""), (4, 2, "1"), (5, 0, ""), (6, 1, ""), (7, 0, "")], key=repr)
    assert line_dedup.deduplicate(odd).count() == len(ODD) and line_dedup.report(odd.limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text, width=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    group = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, p in prints:
            for j, q in prints:
                if group[i] < group[j] and (p ^ q).bit_count() <= distance:
                    group[j], changed = group[i], True
    return group


def test_simhash(docs, rows):
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(extra(docs)).collect()}
    assert all(got[i]["fp"] % 2**64 == brute_fingerprint(t) and got[i]["component_id"] == want[i] for i, t in rows)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab C\té\n", max_size=12), min_size=1, max_size=8))
def test_fingerprint(parts):
    text = " ".join(parts)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_simhash_links_lose_nothing(spark):
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(40)}
    for p in list(points):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
            points.add(p)
    signed = [(p - 2**64 if p >= 2**63 else p) for p in points]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_grids_are_not_broadcast(spark):
    """Each point has a row in 56 grids; Spark takes them for as small as the points and would send them all through the driver."""
    met = simhash.links(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    met.collect()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [tuple(sorted(rng.sample(range(100, 200), 2))) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    group = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert got == group


def test_simhash_edges(odd):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (None, None), (3, 3), (4, 4), (4, 4), (5, 1), (6, 6), (7, 1)], key=repr)
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(odd).collect()) == ["1", "3", "4", "6", "None"] and simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 3 and 5 ---------------------------------------------------------------------------------------------------------

P = pytest.importorskip("public_tokenizers")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "é", "ß", "漢", "😀", "½", "²", "٣", ".", "_", "'s", "'ll", "word", "<|endoftext|>", "<|", "Ⅷ", "́", "12"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60))
def test_tokens_are_the_librarys(parts):
    from tokenizers import Tokenizer

    library = test_tokens_are_the_librarys.__dict__.setdefault("t", None) or Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    test_tokens_are_the_librarys.t = library
    text = "".join(parts)
    ids = library.encode(text, add_special_tokens=False).ids
    codec = bpe_codec.codec()
    assert token_counts.merger(None).count(text) == len(ids)
    assert codec.encode(text) == ids
    assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["x" * 9000, "漢字" * 3000, " " * 5000, "\n" * 3000 + "a", "a" * 3000 + " b" + " " * 2000 + "c", "word " * 4000])
def test_long_pieces(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe_codec.codec().encode(text) == ids and token_counts.merger(None).count(text) == len(ids)


def test_codec_queries(docs, odd, rows, library):
    for frame, texts in ((extra(docs), rows), (odd, [(r[0], r[1] or "") for r in ODD])):
        ids = [library.encode(t, add_special_tokens=False).ids for _, t in texts]
        want = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(texts, ids)), key=repr)
        assert sorted(map(tuple, bpe_codec.round_trip(frame).collect()), key=repr) == want
        assert sorted(((r["doc_id"], r["ids"]) for r in bpe_codec.encode(frame).collect()), key=repr) == sorted(((i, x) for (i, _), x in zip(texts, ids)), key=repr)
        assert sorted(map(tuple, token_counts.token_counts(frame, limit=40).collect()), key=repr) == sorted(((i, len(t.encode()), len(x), len(x) > 40) for (i, t), x in zip(texts, ids)), key=repr)
    assert bpe_codec.round_trip(odd.limit(0)).count() == token_counts.token_counts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, " " * 1_500_000 + "a", "\n" * 1_100_000 + "x  ", "x" * 3_000_000, "漢字 かな" * 400_000, "a\t\u2003" * 500_000, ("word " * 3000 + " " * 200_000) * 4], ids=["blanks", "blanks a", "line ends", "letters", "han", "white", "mixed"])
def test_millions_of_characters(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe_codec.Codec().encode(text) == ids and token_counts.merger(None).count(text) == len(ids)


def test_long_white_space_in_spark(spark):
    got = bpe_codec.round_trip(spark.createDataFrame([(1, " " * 1_000_000, "en", "s", 0), (2, " " * 1_000_000 + "a", "en", "s", 0)], SCHEMA)).orderBy("doc_id").collect()
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b" " * 1_000_000, b" " * 1_000_000 + b"a")]


def test_joins_widen_until_both_sides_agree(library):
    rng = random.Random(21)
    words = [" ".join(rng.choices(["tion", "the", "12", "it's", "a", "über", "--", "x\n"], k=rng.randint(2, 9))) for _ in range(200)]
    text = " ".join(words)
    codec = bpe_codec.Codec(average=16, longest=64)
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want and codec.joined > 20 and codec.widened == 0
    lying = bpe_codec.Codec(average=16, longest=64)
    honest = lying._chunk

    def chunk(piece):  # now and then an encoding that is wrong beside its first or its last place
        c = honest(piece)
        if c is None or rng.random() < 0.4:
            return c
        return c._replace(**{rng.choice(["first", "last"]): b"\x07\0\0\0"})

    lying._chunk = chunk
    assert lying.encode(text) == want and lying.widened > 10


def test_chunks_are_reused():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(2000))
    codec = bpe_codec.Codec()
    codec.encode(passage)
    encoded = codec.encoded
    codec.encode("something new before it " + passage)
    assert codec.encoded - encoded < 0.2 * encoded and codec.reused > 0.7 * encoded


# --- 4 ---------------------------------------------------------------------------------------------------------------

def brute_sketch(text):
    """The fingerprint of a text, one step after another, with the module's random numbers only."""
    e, long_ = edit_fingerprint, 0xFFFFFFFFFFFFFFFF

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & long_
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & long_
        return x ^ x >> 33

    classes, out = [(mix(ord(c)) >> 32) % 255 for c in text], [0] * e.COORDINATES
    for w in range(e.WALKS):
        symbols, at = [], 0
        while at < len(text):
            symbols.append(classes[at])
            at += int(e._MOVE[(len(symbols) - 1) % e.PERIOD][256 * w + classes[at]])
        for step, k in zip(e._STEP.tolist(), e._WHO.tolist()):
            if k % e.WALKS == w and step < len(symbols):
                out[k] = mix(step * 65536 + k * 256 + symbols[step]) >> 56
    return bytes(out).hex()


def hexed(texts, **more):
    return [p.hex() for p in edit_fingerprint.sketches(texts, **more)]


def test_sketches_against_brute_force(rows, monkeypatch):
    rng = random.Random(24)
    texts = [t for _, t in rows[:25]] + ["", "a", "x" * 300, "漢字かな" * 40, "".join(rng.choices("abcdefgh \n", k=9000))]
    want = [brute_sketch(t) for t in texts]
    assert hexed(texts) == want and hexed(texts, budget=50) == want and hexed([]) == []
    monkeypatch.setattr(edit_fingerprint, "ALONE", 0)  # all side by side to the end
    assert hexed(texts) == want


def test_edited_fingerprints(docs, rows, spark):
    order, prints = sorted(rows, reverse=True), {}
    sketch = lambda t: prints.get(t) or prints.setdefault(t, brute_sketch(t))
    want = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        f, e, q = map(sketch, (text, new, after))
        apart = lambda a, b: sum(a[j : j + 2] != b[j : j + 2] for j in range(0, 256, 2))
        want[i] = (i, len(text), hashlib.sha256(new.encode()).hexdigest(), f, e, 1 - apart(f, e) / 128, 1 - apart(f, q) / 128, apart(f, e), apart(f, q))
    for ranges in (1, 3, 50):
        got = {r["doc_id"]: tuple(r) for r in edit_fingerprint.edited_fingerprints(extra(docs), ranges=ranges).collect()}
        assert got == want
    one = spark.createDataFrame([(9, "abc def ghi", "en", "a", 1)], SCHEMA)
    assert edit_fingerprint.edited_fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abc def abc").hexdigest()


def test_edited_fingerprints_of_one_id(spark):
    rng = random.Random(25)
    texts = ["".join(rng.choices("abcdef ", k=rng.randint(0, 60))) for _ in range(120)]
    rows = [(None if k % 3 else 7, t, "en", "s", 0) for k, t in enumerate(texts)] + [(i, f"text {i}", "en", "s", 0) for i in range(20, 30)] + [(-(2**63), "least", "en", "s", 0), (2**63 - 1, "most", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    hashed = docs.withColumn("tie", F.xxhash64("text")).collect()
    order = sorted(((2**63 - 1 if r["doc_id"] is None else ~r["doc_id"], r["tie"], r["text"]) for r in hashed))
    after = lambda k: order[(k + 1) % len(order)][2]
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 3] + after(k)[: len(t) // 3]).encode()).hexdigest() for k, (_, _, t) in enumerate(order))
    for ranges in (2, 16):
        assert Counter(r["edited_sha256"] for r in edit_fingerprint.edited_fingerprints(docs, ranges=ranges).collect()) == want
    bounds = np.array([5, 9, 9, 9, 12])
    at = edit_fingerprint._range_of(bounds, np.array([4, 5, 9, 9, 9, 10, 13]), np.array([0, 0, -(2**63), 0, 2**63 - 1, 0, 0]))
    assert at.tolist() == [0, 1, 2, 3, 4, 4, 5]


def noisy(rng, text, n):
    """The text after n single-character edits."""
    x = list(text)
    for _ in range(n):
        i, new = rng.randrange(len(x)), rng.choice("abcdefghij ")
        x[i : i + 1] = rng.choice([[], [new], [x[i], new]])
    return "".join(x)


def made(rng, words):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(words))


def test_hamming_distance_follows_edits():
    rng = random.Random(2)
    texts = [made(rng, rng.randint(150, 600)) for _ in range(60)]
    base, means = hexed(texts), []
    apart = lambda others: np.array([edit_fingerprint.hamming(a, b) for a, b in zip(base, hexed(others))])
    shares = (0, 0.001, 0.005, 0.02, 0.05, 0.1, 0.2)
    for share in shares:
        means.append(apart([noisy(rng, t, int(np.ceil(share * len(t)))) for t in texts]).mean() / 128)
    assert means[0] == 0 and all(a < b for a, b in zip(means, means[1:])) and means[1] < 0.1 and means[2] < 0.25
    # edits cost about as much as they change at least, and unrelated texts are farther than any edited ones
    other = apart(texts[1:] + texts[:1]).mean() / 128
    assert all(m >= 0.8 * s for m, s in zip(means, shares)) and other > 0.85 and other > means[-1]
    # what stays in place stays equal: a third replaced at the end costs a third, a text that goes on costs its share
    third = apart([edit_fingerprint.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1])]).mean() / 128
    longer = apart([t + " " + made(rng, len(t) // 6) for t in texts]).mean() / 128
    assert 0.22 < third < 0.36 and 0.4 < longer < 0.55


def linked_rows(rows, least=0.8):
    """(links, least first) of each row, all pairs."""
    e, prints = edit_fingerprint, [bytes.fromhex(p) for p in hexed([r[1] or "" for r in rows])]
    ids = [2**63 - 1 if r[0] is None else r[0] for r in rows]
    alike = lambda p, q: sum(a == b for a, b in zip(p, q)) >= least * e.COORDINATES
    band = lambda p, q: any(p[e.WIDTH * b :][: e.WIDTH] == q[e.WIDTH * b :][: e.WIDTH] for b in range(e.BANDS))
    out, missed, met = [], 0, 0
    for i, p in enumerate(prints):
        near = [j for j, q in enumerate(prints) if j != i and alike(p, q)]
        linked = [j for j in near if band(p, prints[j])]
        missed, met = missed + len(near) - len(linked), met + len(linked)
        first = min([ids[i], *(ids[j] for j in linked)])
        out.append((rows[i][0], prints[i].hex(), len(linked), None if first == 2**63 - 1 else first))
    return out, met, missed


def test_link_counts(spark, monkeypatch):
    rng = random.Random(16)
    rows = []
    for group in range(12):
        own = made(rng, 120)
        rows += [(100 * group + k, noisy(rng, own, k % 4), "en", "s", 0) for k in range(9)]
    rows += [(None, rows[3][1], "en", "s", 0), (rows[0][0], rows[1][1] + " end", "en", "s", 0), (None, "alone", "en", "s", 0), (None, "alone", "en", "s", 0), (5000, None, "en", "s", 0), (5001, "", "en", "s", 0)]
    want, met, missed = linked_rows(rows)
    assert met > 200 and met / (met + missed) >= 0.97  # recall of the banding
    for size in (1024, 3):
        monkeypatch.setattr(edit_fingerprint, "SHARE", size)
        got = edit_fingerprint.linked_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "fingerprint", "n_links", "near_first").collect()
        assert Counter(map(tuple, got)) == Counter(want)


def test_links_of_odd_rows(docs, odd, spark):
    for frame in (extra(docs), odd):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        got = edit_fingerprint.linked_fingerprints(frame).select("doc_id", "fingerprint", "n_links", "near_first").collect()
        assert Counter(map(tuple, got)) == Counter(linked_rows(rows)[0])
    assert edit_fingerprint.linked_fingerprints(odd.limit(0)).count() == 0


def test_edited_edges(odd):
    got = edit_fingerprint.edited_fingerprints(odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 7)}) == 1 and edit_fingerprint.edited_fingerprints(odd.limit(0)).count() == 0
    assert edit_fingerprint.fingerprints(odd).count() == len(ODD)


# --- 6 ---------------------------------------------------------------------------------------------------------------

def brute_rules(text):
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    marked = {k for i, w in enumerate(windows) if many[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(c not in SPACE for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def brute_bands(text):
    """(ratio, chunks, bad chunks, fine) under the stated bands, text after text."""
    import zstandard

    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b)) if b else 1.0
    band = lambda n: next((lo, hi) for below, lo, hi in compression_rules.BANDS if n < below)
    ok = lambda b, limits: limits[0] <= ratio(b) <= limits[1]
    body, size = text.encode(), compression_rules.CHUNK
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    bad = sum(not ok(x, compression_rules.CHUNK_BAND if len(x) == size < len(body) else band(len(x))) for x in parts)
    return ratio(body), len(parts), bad, ok(body, band(len(body))) and bad <= 0.2 * len(parts)


def test_quality_rules(docs, odd, rows, spark):
    rng = random.Random(18)
    noise = lambda n: "".join(chr(rng.randrange(0x21, 0x7E)) for _ in range(n))
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(2000))
    mixed = [(i, (prose[i * 7 :][:n] + noise(m))[: n + m], "en", "s", 0) for i, (n, m) in enumerate([(100, 0), (2048, 0), (2047, 1), (4000, 90), (4096, 1500), (5000, 900), (9000, 1500), (300, 300), (0, 600), (10_000, 0)])]
    for frame, texts in ((extra(docs), rows), (odd, [(r[0], r[1] or "") for r in ODD]), (spark.createDataFrame(mixed, SCHEMA), [r[:2] for r in mixed])):
        got = sorted((tuple(r) for r in compression_rules.quality_rules(frame).collect()), key=repr)
        want = []
        for i, t in texts:
            base, (ratio, n, bad, fine) = brute_rules(t), brute_bands(t)
            want.append((i, *base, not base[-1] and fine, ratio, n, bad))
        assert got == sorted(want, key=repr)
    assert compression_rules.quality_rules(odd.limit(0)).count() == 0


def test_tails_are_judged():
    rng = random.Random(19)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(700))[:2500].encode()
    judge = compression_rules.Bands()
    junk = bytes(rng.randrange(0x21, 0x7E) for _ in range(1500))
    assert judge.verdict(prose)[1:] == (2, 0, True)
    assert not judge.verdict(prose[:2048] + junk)[3] and judge.verdict(prose[:2048] + junk)[2] == 1
    assert not judge.verdict(prose[:2048] + b"ab" * 700)[3]


def test_compression_bands(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(rng.choices(vocabulary, weights=[1 / (i + 3) for i in range(3000)], k=3000))
    noise = "".join(chr(rng.randrange(0x21, 0x2FFF)) + (" " if i % 9 == 0 else "") for i in range(6000))
    judge = compression_rules.Bands()
    assert judge.verdict(prose.encode())[3] and not judge.verdict(noise.encode())[3]
    assert not judge.verdict(("one two three four five six. " * 300).encode())[3] and not judge.verdict((prose[:6000] + "ab " * 4000).encode())[3]
    strict = compression_rules.Bands(bands=((1 << 62, 0.0, 0.1),))
    assert not compression_rules.quality_rules(spark.createDataFrame([(1, prose, "en", "s", 1)], SCHEMA), bands=strict).first()["kept"]


# --- 7 ---------------------------------------------------------------------------------------------------------------

def ratings(spark, n=900):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        words, grade = rng.choices(vocabulary, k=rng.randint(30, 150)), rng.choice([0, 1, 2, 2, 2])
        if grade == 0:
            words = [w + "***" for w in words]
        elif grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["awfulone", "nastytwo"])
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(grade > 0), int(grade == 1), grade))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, grade int")


def test_classifier_held_out(spark):
    docs, labels = ratings(spark)
    model = ordinal.fit(docs, ordinal.graded(labels.where("doc_id < 600")))
    assert model.thresholds[0] < model.thresholds[1] and model.rows == 600
    got = ordinal.score(extra(docs), model).join(labels, "doc_id").where("doc_id >= 600").collect()
    kept = {g: np.mean([r["kept"] for r in got if r["grade"] == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[1] < 0.1 and kept[0] < 0.05
    means = [np.mean([r["expected_grade"] for r in got if r["grade"] == g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2] and all(0 <= r["tail_probability"] <= 1 for r in got)
    again = ordinal.fit(docs.repartition(5), ordinal.graded(labels.where("doc_id < 600")))
    assert np.array_equal(model.weights, again.weights)
    assert ordinal.fit(docs, ordinal.graded(labels), sample=50).rows == 50
    picked = ordinal.select(docs, model)
    assert picked.schema == docs.schema and picked.count() == ordinal.score(docs, model).where("kept").count()


def test_classifier_gradient():
    rng = np.random.default_rng(1)
    grades, width = rng.integers(0, 4, 60), 4
    column = np.concatenate([np.sort(rng.choice(16, width, replace=False)) for _ in range(60)])
    evaluate = ordinal.objective(grades, column, np.full(60, width), 16, 3, np.full(16, 0.01))
    x = rng.normal(0, 0.5, 19)
    got, step = evaluate(x)[1], 1e-6
    for k in range(19):
        e = np.eye(19)[k] * step
        assert abs((evaluate(x + e)[0] - evaluate(x - e)[0]) / (2 * step) - got[k]) < 1e-6
    weights, edges = x[:16], np.cumsum([x[16], np.exp(x[17]), np.exp(x[18])])  # the loss, row by row
    tails = [[1.0, *(1 / (1 + np.exp(-(weights[column[4 * i : 4 * i + 4]].sum() - t))) for t in edges), 0.0] for i in range(60)]
    count = Counter(grades.tolist())
    loss = -sum(np.log(t[g] - t[g + 1]) / count[g] / len(count) for t, g in zip(tails, grades.tolist())) + 0.005 * (weights**2).sum()
    assert abs(loss - evaluate(x)[0]) < 1e-9
    fitted = ordinal.fit_arrays(np.minimum(grades, 2), column, np.arange(0, 240, width), bits=4, telling=np.ones(16, bool))
    assert fitted.loss <= np.log(3) + 0.05 and fitted.thresholds[0] < fitted.thresholds[1]


def test_classifier_features():
    rng = random.Random(23)
    texts = ["".join(rng.choices("abAB19.,# é\n", k=rng.choice([0, 1, 5, 60, 400]))) for _ in range(50)]
    body = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in body]))).astype(np.int64)
    places, first = ordinal.features(np.frombuffer(b"".join(body), np.uint8), offsets)
    for i, b in enumerate(body):
        alone, _ = ordinal.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        own = places[first[i] : first[i + 1] if i + 1 < len(body) else None]
        assert own.tolist() == alone.tolist() == sorted(set(own.tolist()))
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
        import re

        words = set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", low))
        assert len(own) <= len(words) + 7 and len(own) >= len(words)


def test_classifier_sample_bounds_rows(spark):
    docs = documents(spark, [(1, f"text {i} of one id", "en", "s", 0) for i in range(300)] + [(2, "other", "en", "s", 0)] * 40 + [(3, None, "en", "s", 0)])
    grades = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id long, grade int")
    assert ordinal.fit(docs, grades).rows == 3 and ordinal.fit(docs, grades, sample=2).rows == 2


def test_classifier_rare_words():
    count, have = np.array([4000, 3000, 25000]), np.zeros((3, 4))
    have[:, 0], have[:, 1], have[:, 2], have[:, 3] = (1, 17, 0), (0, 15, 0), (40, 30, 250), (2000, 1500, 12500)
    assert ordinal.telling_places(have, count).tolist() == [True, True, False, False]  # proven, though rare among many rows
    count, have = np.array([3000, 500, 500]), np.array([[90.0], [40.0], [0.0]])
    below = 4 * np.sqrt(131 / 4001 * (1 - 131 / 4001) * (1 / 3000 + 1 / 1000))
    assert 40 / 1000 - 90 / 3000 < below and ordinal.telling_places(have, count).all()  # the middle grade against the rest


def test_classifier_edges(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in ordinal.score(odd, ordinal.fit(odd, ordinal.graded(none))).collect())
    odd_labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (4, 1, None), (4, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, ordinal.graded(odd_labels).collect())) == [(4, 0), (99, 2)]
    model = ordinal.fit(odd, ordinal.graded(odd_labels))
    assert ordinal.score(odd, model).count() == len(ODD) and ordinal.score(odd.limit(0), model).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------

def gear_ends(body, average=substring_dedup.AVERAGE, longest=substring_dedup.LONGEST, window=substring_dedup.WINDOW):
    """Ends of a text's chunks, byte after byte, by a sequential gear hash."""
    ends, last, hashes = [], 0, [int(x) for x in chunking._GEAR]
    for i in range(1, len(body) + 1):
        h = 0
        for k in range(max(0, i - window), i):
            h = ((h << 32 // window) + hashes[body[k]]) & 0xFFFFFFFF
        whole = i == len(body) or body[i] & 0xC0 != 0x80
        if i >= window and h < 2**32 // average and whole or i == len(body):
            while i - last > longest:  # too long a chunk: cut after `longest` bytes, moved on to a character's start
                start = last
                for n in range(1, (i - start - 1) // longest + 1):
                    forced = start + n * longest
                    while forced < len(body) and body[forced] & 0xC0 == 0x80:
                        forced += 1
                    if last < forced < i:
                        ends.append(forced)
                        last = forced
                break
            ends.append(i)
            last = i
    return ends


def brute_spans(rows, least=substring_dedup.LEAST_WORDS):
    first, out, cut = {}, [], {}
    for i, text in rows:
        body = text.encode()
        ends = gear_ends(body)
        cut[i] = list(zip([0, *ends], ends))
        for a, b in cut[i]:
            first[body[a:b]] = min(i, first.get(body[a:b], i))
    for i, text in rows:
        body, own, marks = text.encode(), set(), []
        for a, b in cut[i]:
            marks.append(first[body[a:b]] != i or body[a:b] in own)
            own.add(body[a:b])
        k = 0
        while k < len(marks):
            if marks[k]:
                j = k
                while j + 1 < len(marks) and marks[j + 1]:
                    j += 1
                left, right = cut[i][max(0, k - 1)][0], cut[i][min(len(marks) - 1, j + 1)][1]
                begun = lambda at: sum(1 for p in range(at) if body[p] not in b" \t\n\x0b\x0c\r" and (p == 0 or body[p - 1] in b" \t\n\x0b\x0c\r"))
                ended = lambda at: sum(1 for p in range(at) if body[p] not in b" \t\n\x0b\x0c\r" and p + 1 <= at and (p + 1 == len(body) or body[p + 1] in b" \t\n\x0b\x0c\r"))
                if begun(right) - ended(left) >= least:
                    out.append((i, cut[i][k][0], cut[i][j][1] - cut[i][k][0]))
                k = j
            k += 1
    return out


@pytest.mark.parametrize("least", [0, 12])
def test_substring_dedup(docs, rows, least):
    spans = substring_dedup.duplicate_spans(extra(docs), least_words=least)
    got = sorted((r["doc_id"], r["start_byte"], r["n_bytes"]) for r in spans.collect())
    assert got == sorted(brute_spans(rows, least)) and len(got) > 10
    texts = dict(rows)
    for r in substring_dedup.remove_spans(extra(docs), spans).collect():
        body, left, pieces = texts[r["doc_id"]].encode(), 0, b""
        for _, a, n in [g for g in got if g[0] == r["doc_id"]]:
            pieces, left = pieces + body[left:a], a + n
        assert r["text"].encode() == pieces + body[left:] and r["id"] == "x"


def test_planted_passages(spark):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    passages, short = [text(55) for _ in range(60)], [text(14) for _ in range(40)]
    rows = [(i, text(40) + " " + p + " " + text(40), "en", "s", 0) for i, p in enumerate(passages)] + [(100 + i, text(rng.randint(5, 60)) + "\n" + p + ". " + text(30), "en", "s", 0) for i, p in enumerate(passages)] + [(300 + i, text(150) + " " + short[i % 40] + " " + text(60), "en", "s", 0) for i in range(80)]
    got = {r["doc_id"] for r in substring_dedup.duplicate_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got & set(range(100, 160))) >= 59 and len(got - set(range(100, 160))) <= 1


def test_substring_null_ids(spark):
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    passage = text(80)
    rows = [(None, text(20) + " " + passage + " " + text(20), "en", "s", 0) for _ in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = substring_dedup.duplicate_spans(docs)
    assert [r["doc_id"] for r in spans.collect()] == [None] * 4
    left = [r["text"] for r in substring_dedup.remove_spans(docs, spans).collect()]
    assert sum(passage in t for t in left) == 1 and len(left) == 5
    again = substring_dedup.duplicate_spans(spark.createDataFrame([*rows, rows[0], (3, rows[1][1], "en", "s", 0)], SCHEMA)).collect()
    assert len(again) == 5 and all(r["doc_id"] is None and r["first_doc_id"] == 3 for r in again)  # a named document comes first


def test_boundaries_do_not_depend_on_neighbours():
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdé 漢\n", k=rng.randint(0, 900))).encode() for _ in range(30)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    for window in (16, 32):
        ends = chunking.boundaries(data, offsets, 24, 100, True, window)
        for t, a, b in zip(texts, offsets, offsets[1:]):
            alone = chunking.boundaries(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 24, 100, True, window)
            inside = ends[(ends > a) & (ends <= b)] - a
            assert inside.tolist() == alone.tolist() and (not t or alone[-1] == len(t))
            assert all(t[x : x + 1].decode(errors="replace") != "�" or x == len(t) or (t[x] & 0xC0) != 0x80 for x in alone.tolist()[:-1])
    h = chunking.gear(np.frombuffer(b"q" * 40, np.uint8))
    assert len(set(h[32:].tolist())) == 1


def test_substring_edges(odd):
    got = substring_dedup.duplicate_spans(odd).collect()
    assert {r["doc_id"] for r in got} <= {3, 6} and {r["doc_id"] for r in substring_dedup.duplicate_spans(odd, least_words=0).collect()} >= {3, 6} and substring_dedup.duplicate_spans(odd.limit(0)).count() == 0
    assert substring_dedup.remove_spans(odd, substring_dedup.duplicate_spans(odd)).count() == len(ODD)


# --- 9 ---------------------------------------------------------------------------------------------------------------

def brute_licences(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "MIT License. The mit-license, MIT\nlicense mit license", "Apache License 2.0 or the GNU General Public License, version 3", "amit license", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nrest",
    "Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License", "éMIT license", "mit licenseé", "spdx-license-identifier: ((MIT", "nothing at all", "\x00MIT\x7fLicense",
]


def test_license_scan(spark, docs, odd, rows):
    planted = [(i, t) for i, t in enumerate(TEXTS)]
    for frame, texts in ((spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], SCHEMA), planted), (extra(docs), rows), (odd, [(r[0], r[1] or "") for r in ODD])):
        got = license_scan.license_scan(frame).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((i, *brute_licences(t)) for i, t in texts), key=repr)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    labels = {i: license_scan.scan(t.encode())["labels"] for i, t in planted}
    assert labels[3] >= {"mit", "apache-2.0", "gpl-2.0-only"} and labels[4] == {"cc-by-nc"} and labels[5] == {"lgpl", "gpl"}
    assert license_scan.license_scan(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("license = \"MIT OR Apache-2.0\"", {"mit", "apache-2.0"}, 1.0), ("License: see the file", set(), 0.5), ("\"license\": \"GPL-3.0-only\",", {"gpl-3.0-only"}, 0.25), ("# SPDX-License-Identifier: Own-1.0 */ x", {"own-1.0"}, 0.3),
        ("under Apache 2.0 terms", {"apache"}, 0.95), ("mit anderen Worten", set(), 0.5), ("BSD-3-Clause and cc-by-sa 4.0", {"bsd", "cc-by-sa"}, 0.4), ("License-Expression: (LGPL-2.1-only OR MIT) AND MPL-2.0", {"lgpl-2.1-only", "mit", "mpl-2.0"}, 0.6),
        ("cc by nc, then cc by", {"cc-by-nc", "cc-by"}, 0.1), ("MIT License: x", {"mit"}, 1.0), ("spdx-license-identifier", set(), 0.5), ("licence", set(), 0.5),
    ],
)
def test_license_labels(text, labels, score):
    got = license_scan.scan(text.encode())
    assert got["labels"] == labels and got["score"] == score


def test_license_scan_is_linear():
    import time

    took = {}
    for text in ("cc by ", "mit license ", "license: mit\n", "license: (", "license: mit "):
        for n in (20_000, 80_000):
            began = time.process_time()
            got = license_scan.scan((text * n).encode())
            took[text, n] = time.process_time() - began
            assert got["n_words"] == len(text.replace(":", "").replace("(", "").split()) * n
        assert took[text, 80_000] < 12 * took[text, 20_000] + 0.2
    assert len(license_scan.scan(b"mit license " * 80_000)["base"]) == 80_000


@pytest.mark.parametrize(
    ("expression", "names", "value"),
    [
        ("MIT", ["mit"], 1.0), ("MIT OR GPL-3.0", ["mit", "gpl-3.0"], 1.0), ("MIT AND GPL-3.0", ["mit", "gpl-3.0"], 0.25), ("MIT OR GPL-3.0 AND AGPL-3.0", ["mit", "gpl-3.0", "agpl-3.0"], 1.0),
        ("(MIT OR GPL-3.0) AND AGPL-3.0", ["mit", "gpl-3.0", "agpl-3.0"], 0.1), ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0"], 0.25), ("(MIT", ["mit"], 1.0), ("MIT)", ["mit"], 1.0), ("", [], license_scan.UNKNOWN), ("AND", [], license_scan.UNKNOWN), ("cc-by-nc-4.0", ["cc-by-nc-4.0"], 0.1),
    ],
)
def test_expressions(expression, names, value):
    assert license_scan.parse(expression) == (names, value)


# --- 10 --------------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), repeat=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = Fraction(sum(sizes.values())), {}
    while True:
        rest = {s: w[s] for s in order if s not in full}
        left = total - sum(full.values())
        share = {s: left * x / sum(rest.values()) for s, x in rest.items()}
        over = {s for s in rest if share[s] > repeat * sizes[s]}
        if not over:
            return {**full, **share}
        full |= {s: Fraction(repeat * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200, 3000])), "en", rng.choice([None, "", "a", "B", "é", "𝔘", "hot", "hot", "hot"]), 0) for i in range(250)]
    docs = documents(spark, rows)
    got = mixing.mix(extra(docs.drop("n_chars"))).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = brute_targets({s: sizes[s] for s in {r[3] for r in rows}})
    taken = Counter()
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert abs(r["target"] - float(want[r["source"]])) < 1e-6 * max(1, float(want[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    block = sum(sizes.values()) / 2**16
    assert all(abs(taken[s] - float(want[s])) <= 2 * block + 2 for s in want)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted((tuple(r) for r in mixing.mix(docs).collect()), key=repr)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r["doc_id"]] == int(r["taken"] / r["size"] + 0.5) for r in got if r["size"])


@pytest.mark.parametrize("bits", [4, 16])
def test_mixing_small_sources(spark, bits):
    rows = [(i, "w " * 3000, "en", "hot", 0) for i in range(60)] + [(100 + i, "w " * 3, "en", f"s{i:04}", 0) for i in range(1000)] + [(2000 + i, "w " * 900, "en", "mid", 0) for i in range(3)]
    docs = documents(spark, rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = brute_targets({s: sizes[s] for s in {r[3] for r in rows}})
    for r in mixing.mix(docs, bits=bits).collect():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - float(want[s])) <= 0.51 for s in want)
    assert {r["source"] for r in mixing.mixed_documents(docs, bits=bits).collect()} == {s for s in want if sizes[s]}


def test_schedule_is_low_discrepancy(spark):
    aims = mixing.targets(spark.createDataFrame([("a", 500), ("b", 500), ("c", 500)], "source string, source_size long"))
    slots = mixing.schedule(aims, bits=10).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1024))
    seen, shares = Counter(), {r["source"]: r["high"] - r["low"] for r in aims.collect()}
    for n, r in enumerate(slots, 1):
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * x) < 6 for s, x in shares.items())


def brute_mix(rows, bits, weights=(5, 2, 1), repeat=3):
    """doc_id -> (taken, first slot) with the operator's hashes, the schedule and blocks laid out word by word.

    rows: (doc_id, h, source, size) in the order of h.
    """
    sizes = Counter()
    for _, _, s, n in rows:
        sizes[s] += n
    order, total, n = sorted(sizes, key=lambda s: (s is None, (s or "").encode())), sum(sizes.values()), 1 << bits
    aim = {s: round(float(t)) for s, t in brute_targets(sizes, weights, repeat).items()}
    line, edges, at = sum(aim.values()), {}, 0
    for s in order:
        edges[s] = (at, at + aim[s])
        at += aim[s]
    queue = {s: [] for s in order}
    for slot in range(n):
        point = int(format(slot, f"0{bits}b")[::-1], 2)
        for s in order:
            if edges[s][0] * n <= point * line < edges[s][1] * n:
                queue[s].append(slot)
    for s in order:
        first = -(-edges[s][0] * n // line)
        queue[s] += [int(format((first - 1 + k) % n, f"0{bits}b")[::-1], 2) for k in range(aim[s] * n // total + 3)]
    out = {i: [0, None] for i, *_ in rows}
    for s in order:
        tape = [i for i, _, q, m in rows if q == s for _ in range(m)] * repeat
        block = 0
        for word, i in enumerate(tape[: aim[s]]):
            while (block + 1) * total // n <= word:
                block += 1
            slot = queue[s][block]
            out[i][0] += 1
            out[i][1] = slot if out[i][1] is None else min(out[i][1], slot)
    return {i: tuple(x) for i, x in out.items()}


@pytest.mark.parametrize("bits", [5, 9])
def test_mix_follows_the_schedule(spark, bits):
    rng = random.Random(bits)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200])), "en", rng.choice([None, "", "a", "é", "hot", "hot", "hot"]), 0) for i in range(90)]
    docs = documents(spark, rows)
    laid = [(r["doc_id"], r["h"], r["source"], len(r["text"].split())) for r in docs.withColumn("h", F.xxhash64("doc_id", "text")).orderBy("h").collect()]
    want = brute_mix(laid, bits)
    got = {r["doc_id"]: (r["taken"], r["slot"]) for r in mixing.mix(docs, bits=bits).collect()}
    assert got == want and len({x for _, x in got.values()}) > 10
    mixed = [r["doc_id"] for r in mixing.mixed_documents(docs, bits=bits).collect()]
    once = [i for k, i in enumerate(mixed) if i not in mixed[:k]]
    assert [want[i][1] for i in once] == sorted(want[i][1] for i in once) and len(mixed) > len(once) > 20  # in the order of the schedule


def test_mixing_edges(odd, spark):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in got)
    empty = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", None, 0)], SCHEMA)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd.limit(0)).count() == 0

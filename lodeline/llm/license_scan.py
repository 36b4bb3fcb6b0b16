"""Licence scans: an Aho-Corasick automaton for identifiers, phrases and tags, a shunting-yard parser for expressions.

Texts are reduced to lower-case words joined by single blanks, so a phrase is found wherever its words stand consecutively,
whatever separates them. The automaton reports every place of every phrase, identifier and tag in one pass, and words are
counted along with it, so a text costs in proportion to its length and its hits. Behind a tag and a colon or equals sign,
the raw line is parsed as a licence expression (with binds closest, then and, then or; brackets) and its identifiers become
labels; the expression's permissiveness is the largest of an or's sides and the smallest of an and's. Behind the loose tags
("license: ...") only expressions of known licences count, as prose may follow.

Of the identifiers and notices that begin at one word, the longest gives its label; base phrases always give theirs. A
single word such as "mit" is a word of prose and no identifier outside an expression.

Nulls and edges: a null text is an empty one (0 words, null positions, empty labels); a malformed expression yields the
identifiers it names and counts as their and. Labels are distinct, sorted and comma-joined; repeated rows stay, columns
besides id and text are not looked at, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm._batches import map_arrow, record, texts

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases beyond the base and their labels.
NOTICES = {
    "cc by nc": "cc-by-nc", "creative commons attribution noncommercial": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by": "cc-by",
    "creative commons attribution": "cc-by", "cc0": "cc0", "public domain": "public-domain", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit", "licensed under the apache license": "apache", "isc license": "isc", "all rights reserved": "all-rights-reserved",
}
#: Identifiers with a version or variant, as words, and the labels of their families.
IDENTIFIERS = {
    "apache 2 0": "apache", "apache 1 1": "apache", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "mpl 1 1": "mpl", "mpl 2 0": "mpl",
    "epl 1 0": "epl", "epl 2 0": "epl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd 4 clause": "bsd", "cc0 1 0": "cc0", "cc by 3 0": "cc-by", "cc by 4 0": "cc-by", "cc by sa 3 0": "cc-by-sa", "cc by sa 4 0": "cc-by-sa",
    "cc by nd 4 0": "cc-by-nd", "cc by nc 4 0": "cc-by-nc", "cc by nc sa 4 0": "cc-by-nc", "cc by nc nd 4 0": "cc-by-nc",
}
#: Tags before an expression, and whether any identifier counts behind them.
TAGS = {"spdx license identifier": True, "license expression": True, "license": False, "licence": False}
#: Permissiveness from 0 to 1 by label or by the longest label that starts an identifier; others have UNKNOWN.
PERMISSIVE = {"mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 0.95, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "zlib": 1.0, "cc-by": 0.9, "mpl": 0.6, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.25, "agpl": 0.1, "cc-by-nd": 0.1, "cc-by-nc": 0.1, "all-rights-reserved": 0.0}
UNKNOWN, NO_LICENCE = 0.3, 0.5

#: Lower-cases A-Z and turns every other ASCII character that is not a digit or a letter into a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+:\-]+")


def known(identifier: str) -> str | None:
    """The longest known label that an identifier is or starts with."""
    name = identifier.lower()
    return max((k for k in PERMISSIVE if name == k or name.startswith(k + "-")), key=len, default=None)


def permissiveness(identifier: str) -> float:
    return PERMISSIVE.get(known(identifier), UNKNOWN)


def parse(expression: str) -> tuple[list[str], float]:
    """(identifiers in lower case, permissiveness) of a licence expression; no identifiers: ([], UNKNOWN)."""
    return _parse(t[0].decode() for t in _TOKEN.finditer(expression.encode()))


def _parse(tokens: Iterable[str]) -> tuple[list[str], float]:
    strength = {"or": 1, "and": 2, "with": 3}
    values: list[float] = []
    operators: list[str] = []
    names: list[str] = []
    fine, expect = True, True

    def reduce() -> None:
        nonlocal fine
        op = operators.pop()
        if op == "(" or len(values) < 2:
            fine = False
            return
        right, left = values.pop(), values.pop()
        values.append(max(left, right) if op == "or" else min(left, right) if op == "and" else left)

    for token in tokens:
        low = token.lower()
        if token == "(":
            operators.append("(")
        elif token == ")":
            while operators and operators[-1] != "(":
                reduce()
            if operators:
                operators.pop()
            else:
                fine = False
        elif low in strength and not expect:
            while operators and operators[-1] != "(" and strength[operators[-1]] >= strength[low]:
                reduce()
            operators.append(low)
            expect = True
        elif low in strength or not expect:
            fine = False  # an operator without a left side, or two identifiers in a row: what follows is prose
            break
        else:
            if not (operators and operators[-1] == "with"):
                names.append(low)
            values.append(permissiveness(low))
            expect = False
    while operators:
        reduce()
    if not fine or len(values) != 1:
        return names, min(map(permissiveness, names), default=UNKNOWN)
    return names, values[0]


@lru_cache(1)
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, label in {**IDENTIFIERS, **NOTICES, **BASE, **TAGS}.items():
        automaton.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1, label))
    automaton.make_automaton()
    return automaton


#: What may stand between a tag and its expression, what ends the expression, and the words of a reduced text.
_ASSIGNED, _ENDS, _SPANS = re.compile(rb"[\"'`]?[ \t]*[:=][ \t]*[\"'`(]?"), re.compile(rb"[^A-Za-z0-9.+:()\- \t]|--"), re.compile(rb"[^ ]+")


def expressions(text: bytes, reduced: bytes, tags: list[tuple[int, bool]]) -> list[tuple[list[str], float, int, int]]:
    """(identifiers, permissiveness, first word, word after) of the expressions behind tags.

    Tags are given as (the word after the tag, any identifier counts), in order; tags inside an expression are part of it.
    """
    ends, wanted = {}, {w for w, _ in tags}
    for i, m in enumerate(_SPANS.finditer(reduced), 1):
        if i in wanted:
            ends[i] = m.end()
    out, stop, done = [], -1, 0
    for word, any_ in tags:
        m = _ASSIGNED.match(text, ends[word])
        if m is None or m.start() < done:
            continue
        start = m.end() - m[0].endswith(b"(")
        if start > stop:
            end = _ENDS.search(text, start)
            stop = end.start() if end else len(text)
        names, value = _parse(t[0].decode() for t in _TOKEN.finditer(text, start, stop))
        if names and (any_ or all(known(n) for n in names)):
            out.append((names, value, word, word + len(reduced[start:stop].split())))
            done = stop
    return out


def scan(text: bytes) -> dict:
    """Everything found in one text; spans are (first word, words, phrase, label)."""
    reduced = text.translate(_WORDS)
    words = reduced.split()
    line = " " + b" ".join(words).decode() + " "
    found, tags, longest, at, passed = [], [], {}, 0, 0
    for end, (phrase, size, label) in _automaton().iter(line):
        passed += line.count(" ", at, end + 1)  # ends come in order, so each blank is counted once
        at = end + 1
        if isinstance(label, bool):
            tags.append((passed - 1, label))
            continue
        start = passed - 1 - size
        found.append((start, size, phrase, label))
        longest[start] = max(size, longest.get(start, 0))
    base = [f for f in found if f[2] in BASE]
    parsed = expressions(text, reduced, tags) if tags else []
    inside = {w for _, _, first, after in parsed for w in range(first, after)}  # an expression speaks for its identifiers
    labels = {label for start, size, phrase, label in found if phrase in BASE or size == longest[start] and start not in inside}
    named = {n for names, *_ in parsed for n in names}
    weights = [permissiveness(f) for f in labels - named] + [v for _, v, *_ in parsed]
    return {"n_words": len(words), "base": base, "found": found, "expressions": parsed, "labels": labels | named, "score": min(weights, default=NO_LICENCE)}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every document: counts, positions and labels of the base phrases, all labels, the score, and all spans."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string())]))),
    ])

    def run(batches):
        for rows, bodies in texts(batches, "text"):
            got = [scan(b) for b in bodies]
            starts = [[f[0] for f in g["base"]] for g in got]
            yield record(
                schema, rows.column(0), [g["n_words"] for g in got], [len(s) for s in starts], [min(s, default=None) for s in starts], [max(s, default=None) for s in starts],
                [",".join(sorted({f[3] for f in g["base"]})) for g in got], [",".join(sorted(g["labels"])) for g in got], [g["score"] for g in got],
                [[{"first_word": f[0], "n_words": f[1], "label": f[3]} for f in g["found"]] for g in got],
            )

    out = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word: long, n_words: long, label: string>>"
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, out)

"""Text conventions that all operators share, as column expressions that stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning for locating, verbs that open a request, and nouns for kinds of targets.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "in", "on", "to", "for", "with", "is", "are", "be", "it", "this", "that", "as", "at", "by", "from", "so", "do", "does", "did",
    "has", "have", "had", "can", "will", "would", "should", "could", "its", "into", "than", "then", "there", "here", "you", "your", "we", "our", "i", "me", "my",
)
LEADING_VERBS = (
    "add", "remove", "delete", "update", "create", "make", "build", "fix", "change", "modify", "edit", "insert", "append", "get", "set", "check", "verify", "test",
    "write", "read", "load", "save", "clear", "reset", "run",
)
TYPE_WORDS = ("function", "method", "class", "def", "file")
DELETE_VERBS = ("remove", "delete")
# Words whose count no compression may change (and every word in n't), and the fillers it drops.
PROTECTED_WORDS = ("not", "no", "never", "only", "except", "must", "always", "none", "unless", "cannot", "n't")
ARTICLES = ("a", "an", "the")
FILLERS = ("just", "really", "basically", "actually", "simply", "essentially")

#: Line ends that str.splitlines knows.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def words_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: no empty line after the last line end; null or empty text: []."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, 1-based inclusive, clamped to what is there."""
    first = F.greatest(start, F.lit(1))
    return F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0)))


def alnum(text: Column) -> Column:
    """All runs of [a-z0-9] of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """The distinct locator words: alphanumeric runs without stop words."""
    return F.array_except(F.array_distinct(alnum(text)), words_array(STOP_WORDS))


def content_words(text: Column) -> Column:
    """Locator words that are neither opening verbs nor nouns for kinds of targets, of three characters and more."""
    return F.filter(F.array_except(words(text), words_array(LEADING_VERBS + TYPE_WORDS)), lambda w: F.length(w) >= 3)


def _camel_split(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")


def bm25_tokens(text: Column) -> Column:
    """Retrieval tokens: camelCase is split, then alphanumeric runs, repeats kept."""
    return alnum(_camel_split(text))


def bm25_text(text: Column) -> Column:
    """The text whose runs of [a-z0-9] are the retrieval tokens."""
    return F.lower(_camel_split(text))


def bm25_document(name: Column, doc: Column, source: Column) -> Column:
    """Name (underscores as blanks), first doc line and source, empty parts left out."""
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", blank(F.translate(name, "_", " ")), blank(doc), blank(source))


def vector_document(name: Column, doc: Column, source: Column) -> Column:
    """The text to embed: name, first doc line and the first 2000 characters of the source, a line each."""
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", blank(name), blank(doc), blank(F.substring(source, 1, 2000)))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def word_bound(pattern: str) -> str:
    """The pattern as a whole word with Unicode-aware edges, the same in Java and RE2."""
    return rf"(^|[^\p{{L}}\p{{N}}_])({pattern})([^\p{{L}}\p{{N}}_]|$)"


def literal_hit(name: Column, request: Column) -> Column:
    """Whether the identifier stands in the request as a whole word, in any case."""
    return F.array_contains(F.regexp_extract_all(F.lower(request), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower(name))


def compress_patterns() -> list[tuple[str, str]]:
    """(pattern, replacement with $1, $2) in order; no lookaround and no ASCII-only boundary, so Java and RE2 agree."""
    word, fill = r"[\p{L}\p{N}_]", "|".join(FILLERS)
    before = rf"(?i)(^|[^{word[1:-1]}])"
    alone = (rf"{before}(?:{fill})([^{word[1:-1]}\s]|$)", "$1$2")
    return [(rf"{before}(?:(?:{'|'.join(ARTICLES)})\s+)+", "$1"), (rf"{before}(?:(?:{fill})\s+)+", "$1"), alone, alone, (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")]


def compress(text: Column) -> Column:
    """Articles, then fillers, are dropped with the blanks behind them, blanks and tabs collapsed, ends trimmed.

    A text that would lose or gain a protected word by that stays as it is.
    """
    short = text
    for pattern, put in compress_patterns():
        short = F.regexp_replace(short, pattern, put)
    return F.when(words_preserved(text, short), short).otherwise(text)


def protected_words(text: Column) -> Column:
    """The protected words of a text, sorted, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    return F.sort_array(F.filter(found, lambda w: w.isin(*PROTECTED_WORDS) | w.endswith("n't")))


def words_preserved(original: Column, compressed: Column) -> Column:
    """Whether every protected word occurs as often in both texts."""
    return protected_words(original) == protected_words(compressed)


def bare_name(name: Column) -> Column:
    """The name without a call signature."""
    return F.trim(F.substring_index(name, "(", 1))


def strip_fences(text: Column) -> Column:
    """The text without Markdown code fences, ending in one line end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, "(?m)^```[a-zA-Z]*\n|```$", ""), r"^\s+|\s+$", ""), F.lit("\n"))


def match_case(replacement: Column, like: Column) -> Column:
    """The replacement in the case of `like`: all capitals, first capital, or first small."""
    head, rest = F.substring(replacement, 1, 1), F.substr(replacement, F.lit(2))
    first = F.substring(like, 1, 1)
    return (
        F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(replacement))
        .when((F.upper(first) == first) & (F.lower(first) != first), F.concat(F.upper(head), rest))
        .otherwise(F.concat(F.lower(head), rest))
    )


def suffix(path: Column) -> Column:
    """Extension with its dot in lower case, or empty; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    base = base_name(path)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def dedent_to(content: Column, indent: Column) -> Column:
    """The content with its common leading blanks replaced by `indent` blanks; blank lines are emptied; ends in a line end.

    Common leading white space is counted in blanks; content indented by tabs is kept as it is apart from the prefix.
    """
    lines = split_lines(F.regexp_replace(F.coalesce(content, F.lit("")), "\n+$", ""))
    depth = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, "^ *", 0))))
    moved = F.transform(lines, lambda x: F.when(F.regexp_replace(x, r"\s", "") == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), indent), F.substr(x, F.coalesce(depth, F.lit(0)) + 1))))
    return F.concat(F.array_join(moved, "\n"), F.lit("\n"))

"""SQL functions of the engine, for spark.sql: scalar ones are SQL expressions that Catalyst inlines, tables come from UDTFs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lodeline.functions import text as t


def _list(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


_RUNS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+', 0)"
_WORDS = f"array_except(array_distinct({_RUNS}), {_list(t.STOP_WORDS)})"
SCALARS = {
    "bm25_tokens": ("t STRING", "ARRAY<STRING>", "regexp_extract_all(lower(regexp_replace(coalesce(t, ''), '([a-z0-9])([A-Z])', '$1 $2')), '[a-z0-9]+', 0)"),
    "locator_words": ("t STRING", "ARRAY<STRING>", _WORDS.format("t")),
    "content_words": ("t STRING", "ARRAY<STRING>", f"filter(array_except({_WORDS.format('t')}, {_list(t.LEADING_VERBS + t.TYPE_WORDS)}), w -> length(w) >= 3)"),
    "content_hash": ("t STRING", "STRING", "substring(sha2(coalesce(t, ''), 256), 1, 16)"),
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"),
}


@udtf(returnType="name string, symbol_type string, start_line int, end_line int, indent int, parent_class string, docstring_first_line string, source string")
class PythonSymbols:
    """py_symbols(source): the symbols of one Python text, in its order; a text that doesn't parse has none."""

    def eval(self, source: str):
        from lodeline.sources.code import python_symbols

        for s in python_symbols("", source or ""):
            yield s["name"], s["symbol_type"], s["start_line"], s["end_line"], s["indent"], s["parent_class"], s["docstring_first_line"], s["source"]


@udtf(returnType="ordinal int, name string, start_line int, end_line int")
class TextBlocks:
    """text_blocks(source, language): marker blocks, HTML elements or paragraphs of one text."""

    def eval(self, source: str, language: str):
        import re

        from lodeline.operators.blocks import MARKERS, NAME_LENGTH
        from lodeline.sources.pages import element_blocks

        lines, found = (source or "").splitlines(), []
        if language == "html":
            found = element_blocks(source)
        elif language in MARKERS:
            pattern, group = MARKERS[language]
            starts = [(i, m[group].strip()) for i, x in enumerate(lines, 1) if (m := re.match(pattern, x))]
            found = [(name, i, (starts[k + 1][0] - 1 if k + 1 < len(starts) else len(lines))) for k, (i, name) in enumerate(starts)]
        if not found:
            start = None
            for i, x in enumerate([*lines, ""], 1):
                if x.strip() and start is None:
                    start = i
                elif not x.strip() and start is not None:
                    found.append((lines[start - 1].strip()[:NAME_LENGTH], start, i - 1))
                    start = None
        for n, (name, a, b) in enumerate(found, 1):
            yield n, name, a, b


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for this session and returns their names."""
    for name, (arguments, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    spark.udtf.register("py_symbols", PythonSymbols)
    spark.udtf.register("text_blocks", TextBlocks)
    return [*SCALARS, "py_symbols", "text_blocks"]

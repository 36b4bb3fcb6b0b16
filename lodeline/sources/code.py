"""Symbols, calls, imports and metadata of source files: a real parser for Python, line patterns for other languages.

Parsing needs Python, so these run as mapInPandas over files, filtered before to the language they read; all else is
expressions. Files that do not parse give no rows. The patterns for other languages are an approximation: they know
declarations that open on a line of their own, and end a symbol at its closing brace, `end`, or the next declaration.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodeline import schemas
from lodeline.functions.text import STOP_WORDS, content_hash, words

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_STOP = frozenset(STOP_WORDS)


def _words(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.lower())) - _STOP


def parse(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _begin(node: ast.AST) -> int:
    return min([node.lineno, *[d.lineno for d in node.decorator_list]])


def _walk(node: ast.AST, parent: str | None = None) -> Iterator[tuple[ast.AST, str | None]]:
    """Definitions in the order of the text, each with the class around it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _DEFINITIONS):
            yield child, parent
            yield from _walk(child, child.name if isinstance(child, ast.ClassDef) else parent)
        else:
            yield from _walk(child, parent)


def called_names(node: ast.AST) -> list[str]:
    """Names of all calls: a name, or the last part of an attribute."""
    funcs = [n.func for n in ast.walk(node) if isinstance(n, ast.Call)]
    return [f.id if isinstance(f, ast.Name) else f.attr for f in funcs if isinstance(f, (ast.Name, ast.Attribute))]


def python_symbols(path: str, source: str) -> list[dict]:
    tree = parse(source)
    if tree is None:
        return []
    lines = source.splitlines()
    breadth = {id(n): i for i, n in enumerate(n for n in ast.walk(tree) if isinstance(n, _DEFINITIONS))}
    out = []
    for node, parent in _walk(tree):
        doc = (ast.get_docstring(node) or "").strip().splitlines()
        out.append({
            "file": path, "ordinal": breadth[id(node)], "depth_ordinal": len(out), "name": node.name, "symbol_type": "class" if isinstance(node, ast.ClassDef) else "function",
            "start_line": _begin(node), "end_line": node.end_lineno, "indent": node.col_offset, "parent_class": parent, "docstring_first_line": doc[0] if doc else None,
            "source": "\n".join(lines[_begin(node) - 1 : node.end_lineno]), "language": "python",
        })
    return out


#: How declarations open, in languages without a parser here.
_DECLARATIONS = {
    "function": re.compile(
        r"^\s*(?:(?:export|default|public|private|protected|static|async|final|abstract|override|inline|extern|virtual|pub(?:\([^)]*\))?|unsafe|const)\s+)*"
        r"(?:function\s*\*?\s*(?P<a>\w+)|func\s+(?:\([^)]*\)\s*)?(?P<b>\w+)|fn\s+(?P<c>\w+)|fun\s+(?:[\w.<>]+\.)?(?P<d>\w+)|def\s+(?:self\.)?(?P<e>\w+[?!]?)|sub\s+(?P<f>\w+)"
        r"|(?!return\b|else\b|new\b|throw\b|if\b|for\b|while\b|switch\b)[\w:<>\[\],*&~]+(?:\s+[\w:<>\[\],*&]+)*?\s+[*&]*(?P<g>\w+)\s*\([^;{}=]*\)\s*(?:const\s*)?(?:throws\s+[\w,\s.]+)?\{)"
    ),
    "class": re.compile(r"^\s*(?:(?:export|default|public|private|protected|static|final|abstract|sealed|data|open|pub(?:\([^)]*\))?)\s+)*(?:class|struct|interface|trait|enum)\s+(?P<a>\w+)"),
}


def other_symbols(path: str, source: str, language: str) -> list[dict]:
    """Declarations by line patterns, in the order of the text; a class is the parent of what lies inside it."""
    lines, out, around = source.splitlines(), [], []
    for i, line in enumerate(lines):
        for kind, pattern in _DECLARATIONS.items():
            if m := pattern.match(line):
                name = next(v for v in m.groupdict().values() if v)
                indent = len(line) - len(line.lstrip())
                end = _end(lines, i, indent)
                while around and around[-1][1] < i + 1:
                    around.pop()
                out.append({
                    "file": path, "ordinal": len(out), "depth_ordinal": len(out), "name": name, "symbol_type": kind, "start_line": i + 1, "end_line": end, "indent": indent,
                    "parent_class": around[-1][0] if around else None, "docstring_first_line": None, "source": "\n".join(lines[i:end]), "language": language,
                })
                if kind == "class":
                    around.append((name, end))
                break
    return out


def _end(lines: list[str], first: int, indent: int) -> int:
    depth, opened = 0, False
    for i in range(first, len(lines)):
        depth += lines[i].count("{") - lines[i].count("}")
        opened |= "{" in lines[i]
        if opened and depth <= 0:
            return i + 1
        if not opened and i > first and re.match(rf"^\s{{0,{indent}}}end\b", lines[i]):
            return i + 1
        if not opened and lines[i].rstrip().endswith(";"):
            return i + 1
    return len(lines)


_SYMBOL_COLUMNS = "file string, ordinal int, depth_ordinal int, name string, symbol_type string, start_line int, end_line int, indent int, parent_class string, docstring_first_line string, source string, language string"


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files(path, source, language): ordinal is breadth-first order, depth_ordinal the order of the text."""
    names = [c.split()[0] for c in _SYMBOL_COLUMNS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [s for p, x, l in zip(f["path"], f["source"], f["language"]) for s in (python_symbols(p, x or "") if l == "python" else other_symbols(p, x or "", l))]
            yield pd.DataFrame(rows, columns=names)

    found = _dealt(files.where("language is not null and source is not null").select("path", "source", "language")).mapInPandas(run, _SYMBOL_COLUMNS)
    return found.withColumn("symbol_id", F.xxhash64("file", "name", "symbol_type", "start_line"))


def _dealt(files: DataFrame) -> DataFrame:
    """Files given out to all tasks by path: many short ones may lie in one partition, and would be parsed by one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def calls(symbols_: DataFrame) -> DataFrame:
    """(symbol_id, name): the names that each symbol's own source calls; classes include their methods' calls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, source, language in zip(f["symbol_id"], f["source"], f["language"]):
                if language == "python":
                    tree = parse(_flush(source))
                    names = called_names(tree) if tree is not None else []
                else:
                    names = [n for n in re.findall(r"([A-Za-z_]\w*)\s*\(", source)[1:] if n not in _KEYWORDS]
                rows += [(i, n) for n in names]
            yield pd.DataFrame(rows, columns=["symbol_id", "name"])

    return symbols_.select("symbol_id", "source", "language").mapInPandas(run, "symbol_id long, name string")


_KEYWORDS = frozenset("if for while switch catch return sizeof function func fn fun def new match when".split())


def _flush(source: str) -> str:
    rows = source.splitlines()
    depth = len(rows[0]) - len(rows[0].lstrip()) if rows else 0
    return "\n".join(r[depth:] if not r[:depth].strip() else r for r in rows)


def call_lines(files: DataFrame) -> DataFrame:
    """(name, file, line): every call in Python files(path, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source in zip(f["path"], f["source"]):
                for n in ast.walk(parse(source) or ast.Module([], [])):
                    if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                        rows.append((n.func.id if isinstance(n.func, ast.Name) else n.func.attr, path, n.lineno))
            yield pd.DataFrame(rows, columns=["name", "file", "line"])

    return _dealt(files.where("language = 'python'").select("path", "source")).mapInPandas(run, "name string, file string, line int")


def metadata(files: DataFrame) -> DataFrame:
    """The widest symbol rows of files(path, source, language); for files without symbols, their blocks come from text_blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, source, language in zip(f["path"], f["source"], f["language"]):
                tree = parse(source) if language == "python" else None
                nodes = [n for n, _ in _walk(tree)] if tree is not None else None
                found = python_symbols(path, source) if language == "python" else other_symbols(path, source, language)
                for i, s in enumerate(found):
                    rows.append(_metadata_row(s, nodes[i] if nodes else None))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in re.split(r", (?=\w+ )", schemas.METADATA)])

    return files.where("language is not null and source is not null").select("path", "source", "language").mapInPandas(run, schemas.METADATA)


def _metadata_row(s: dict, node: ast.AST | None) -> dict:
    params: list[str] = []
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        a = node.args
        params = [x.arg for x in a.posonlyargs + a.args] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return {
        **{k: s[k] for k in ("file", "name", "symbol_type", "start_line", "end_line", "parent_class", "docstring_first_line", "language")}, "line_count": s["end_line"] - s["start_line"] + 1, "parameters": params,
        "decorators": [ast.unparse(d) for d in node.decorator_list] if node is not None else [], "return_type_hint": ast.unparse(node.returns) if getattr(node, "returns", None) is not None else None,
        "is_async": isinstance(node, ast.AsyncFunctionDef), "keywords": sorted(_words(s["name"]) | _words(s["docstring_first_line"] or "")), "calls": sorted(set(called_names(node))) if node is not None else [],
        "content_hash": hashlib.sha256(s["source"].encode()).hexdigest()[:16], "block": s["source"],
    }


def imports(files: DataFrame) -> DataFrame:
    """(path, start_line, end_line, names, modules): import statements at module scope, also in try and if, of Python files(path, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n.lineno, n.end_lineno, *_bound(n)) for p, s in zip(f["path"], f["source"]) for n in _module_imports(parse(s) or ast.Module([], []))]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "names", "modules"])

    return files.where("language = 'python'").select("path", "source").mapInPandas(run, "path string, start_line int, end_line int, names array<string>, modules array<string>")


def file_imports(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, modules): the modules that Python files import, else the import lines of other languages, in order, each once.

    files(path, source, language); lines(file_id, n, line) with paths as file_id, for the other languages.
    """
    python = imports(files).select("path", "start_line", F.posexplode("modules").alias("i", "module"))
    other = other_imports(lines.join(files.where("language <> 'python'").select(F.col("path").alias("file_id")), "file_id", "left_semi")).select(F.col("file_id").alias("path"), F.col("n").alias("start_line"), F.lit(0).alias("i"), F.trim("line").alias("module"))
    first = python.unionByName(other).groupBy("path", "module").agg(F.min(F.struct("start_line", "i")).alias("at"))
    return first.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "module"))), lambda x: x["module"]).alias("modules"))


def block_metadata(blocks_: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata rows for the blocks(file_id, name, start_line, end_line) of files without symbols: files(file_id, path, language)."""
    body = blocks_.join(lines, "file_id").where(F.col("n").between(F.col("start_line"), F.col("end_line")))
    joined = body.groupBy("file_id", "name", "start_line", "end_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("block"))
    none = F.array().cast("array<string>")
    keywords = F.sort_array(words(F.translate("name", "_.#", "   ")))
    return joined.join(files, "file_id").select(
        F.col("path").alias("file"), "name", F.lit("block").alias("symbol_type"), "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("line_count"), F.lit(None).cast("string").alias("parent_class"),
        F.lit(None).cast("string").alias("docstring_first_line"), none.alias("parameters"), none.alias("decorators"), F.lit(None).cast("string").alias("return_type_hint"), F.lit(False).alias("is_async"), keywords.alias("keywords"),
        none.alias("calls"), content_hash(F.col("block")).alias("content_hash"), F.coalesce("language", F.lit("text")).alias("language"), "block",
    )


def _module_imports(node: ast.AST) -> Iterator[ast.AST]:
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.Import, ast.ImportFrom)):
            yield child
        elif not isinstance(child, _DEFINITIONS):
            yield from _module_imports(child)


def _bound(node: ast.AST) -> tuple[list[str], list[str]]:
    if isinstance(node, ast.Import):
        return [a.asname or a.name.split(".")[0] for a in node.names], [a.name for a in node.names]
    return [a.asname or a.name for a in node.names], [node.module or ""]


def import_span(imports_: DataFrame) -> DataFrame:
    """(path, start_line, end_line) from the first to the last import."""
    return imports_.groupBy("path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def other_imports(lines: DataFrame) -> DataFrame:
    """(file_id, n, line): import lines of other languages, from a line table."""
    return lines.where(F.col("line").rlike(r"^(?:import\b|use\b|#include\b|using\b|require\b|from\s+\S+\s+import\b|package\b|export\s+.*\bfrom\b|const\s+\w+\s*=\s*require\b)"))


@F.pandas_udf(BooleanType())
def _looks_like_python(source: pd.Series) -> pd.Series:
    def look(s: str | None) -> bool:
        tree = parse(s)
        return tree is not None and any(isinstance(n, (*_DEFINITIONS, ast.Import, ast.ImportFrom)) for n in tree.body)

    return source.map(look)


def looks_like_python(source: Column) -> Column:
    """Whether a text parses as Python and defines or imports something at its top level."""
    return _looks_like_python(source)


def syntax_errors(files: DataFrame) -> DataFrame:
    """(path, errors): Python's syntax errors, up to five unbalanced brackets for others, none for texts without a language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "errors": [_errors(s or "", l) for s, l in zip(f["source"], f["language"])]})

    return files.select("path", "source", "language").mapInPandas(run, "path string, errors array<string>")


def _errors(source: str, language: str | None) -> list[str]:
    if language is None:
        return []
    if language == "python":
        try:
            ast.parse(source)
            return []
        except (SyntaxError, ValueError) as e:
            return [f"line {getattr(e, 'lineno', 0) or 0}: {getattr(e, 'msg', None) or e}"]
    from lodeline.sources.files import LANGUAGES

    if not LANGUAGES.get(language, ((), False))[1]:
        return []
    pairs, stack, out, number = {")": "(", "]": "[", "}": "{"}, [], [], 1
    plain = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", lambda m: "\n" * m[0].count("\n"), source, flags=re.S)
    for c in plain:
        number += c == "\n"
        if c in "([{":
            stack.append((c, number))
        elif c in pairs and (not stack or stack.pop()[0] != pairs[c]):
            out.append(f"line {number}: unexpected {c}")
    return (out + [f"line {n}: {c} is not closed" for c, n in stack])[:5]


def defined_name(content: str, language: str = "python") -> str | None:
    """The name of the only definition at the top of a snippet, or None."""
    if language == "python":
        tree = parse(textwrap.dedent(content))
        names = [n.name for n in tree.body if isinstance(n, _DEFINITIONS)] if tree is not None else []
    else:
        found = other_symbols("", content, language)
        top = min((s["indent"] for s in found), default=0)
        names = [s["name"] for s in found if s["indent"] == top]
    return names[0] if len(names) == 1 else None


#: How a definition opens, in the languages that have symbols; the first group is what it is indented by.
DEFINITION = re.compile(
    r"^([ \t]*)(?:(?:export|default|public|private|protected|internal|static|async|final|abstract|sealed|data|open|override|inline|unsafe|pub)\s+)*"
    r"(?:def|class|function|func|fn|fun|sub|struct|interface|trait|enum)\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_]\w*)", re.M
)


def snippet_name(content: str | None, path: str | None = None) -> str | None:
    """The name of the only definition at the top of a snippet for a file, or None for none or several.

    Of a file of no known language, what parses as Python is that, else the definitions of the least indent are at the top.
    """
    from lodeline.sources.files import LANGUAGES

    if not content:
        return None
    extension = (path or "").rpartition(".")[2].lower() if "." in (path or "") else ""
    language = next((name for name, (known, _) in LANGUAGES.items() if extension in known), None)
    if language == "python":
        return defined_name(content)
    if language is not None and (name := defined_name(content, language)):
        return name
    if language is None and (tree := parse(textwrap.dedent(content))) is not None and tree.body:
        return defined_name(content)
    found = [(len(m[1]), m[2]) for m in DEFINITION.finditer(content)]
    top = [name for depth, name in found if depth == min(found)[0]]
    return top[0] if len(top) == 1 else None

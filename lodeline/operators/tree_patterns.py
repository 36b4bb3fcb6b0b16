"""Patterns with metavariables and ellipses over a table of syntax-tree nodes.

A source is a set of rows, one a node of its tree: where it stands in a walk of the tree (pre), the last node below it (last), its
parent, and its kind, text and slot (the parent's field, its place in it from the front and from the back). A pattern is compiled
to rows of the same shape. Patterns of all requests are matched together, level by level from their leaves: nodes meet the pattern
nodes they agree with, and a node matches a pattern node when matched nodes stand in the slots of all its children. `<... p ...>`
matches a node that has a match of p at or below it, by the interval (pre, last).

In patterns `$X` is any expression or name, the same one wherever it stands again; `...` is any number of items of a list, or
any expression or body. A field that a pattern leaves empty is free, but for the arguments of a call and the items of a
display; a decorator or keyword may stand among others; `def` also matches `async def`.
"""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.plans.lineage import cut

NODE_TYPES = "source_id long, pre int, last int, parent int, level int, kind string, text string, field string, idx int, rev int, lists array<string>, shape string, line int"
_SKIPPED = ("ctx", "type_comment", "type_ignores", "kind")
#: Lists that are matched item by item even where a pattern leaves them empty.
_EXACT = {"Call": ("args", "keywords"), "Tuple": ("elts",), "List": ("elts",), "Set": ("elts",)}
#: Lists of which a pattern names some items.
_SOME = ("decorator_list", "keywords")
#: Nodes of a batch, and more by a source at most.
_ROWS = 8192
_VARIABLE, _DEEP, _REST = "__mv_", "__deep__", "__rest__"


def _parts(node: ast.AST) -> tuple[str, list[tuple[str, list[ast.AST], bool]]]:
    """(text of the node's plain fields, (field, child nodes, whether it is a list))."""
    plain, below = [], []
    for name in node._fields:
        value = getattr(node, name, None)
        if name in _SKIPPED or value is None and not (isinstance(node, ast.Constant) and name == "value"):
            continue
        if isinstance(value, ast.AST):
            below.append((name, [value], False))
        elif isinstance(value, list) and all(isinstance(x, ast.AST) or x is None for x in value):
            below.append((name, [x for x in value if x is not None], True))
        else:
            plain.append(value if isinstance(value, str) and not isinstance(node, ast.Constant) else repr(value))
    return " ".join(plain), below


def tree_rows(source: str | None) -> list[dict]:
    """The nodes of a Python source, or of an indented piece of one; none if it does not parse."""
    try:
        tree = ast.parse(textwrap.dedent(source or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    rows, stack = [], [(tree, -1, "", 0, 0, 0)]
    while stack:
        node, parent, name, idx, rev, level = stack.pop()
        text, below = _parts(node)
        pre = len(rows)
        rows.append({"pre": pre, "last": pre, "parent": parent, "level": level, "kind": type(node).__name__, "text": text, "field": name, "idx": idx, "rev": rev, "lists": [f for f, items, many in below if many and items], "line": getattr(node, "lineno", None)})
        for f, items, _ in reversed(below):
            stack += [(x, pre, f, i, len(items) - 1 - i, level + 1) for i, x in reversed(list(enumerate(items)))]
    shapes = [hashlib.md5(f"{r['kind']} {r['text']}".encode("utf-8", "surrogatepass")) for r in rows]
    for r in reversed(rows):
        r["shape"] = shapes[r["pre"]].hexdigest()
        if r["parent"] >= 0:
            rows[r["parent"]]["last"] = max(rows[r["parent"]]["last"], r["last"])
            shapes[r["parent"]].update(f"{r['field']} {r['idx']} {r['shape']}".encode())
    return rows


def nodes(sources: DataFrame) -> DataFrame:
    """The node table (NODE_TYPES) of Python sources(source_id, source)."""
    columns = [c.split()[0] for c in NODE_TYPES.split(", ")]

    def table(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"line": "Int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for f in frames:
            for key, source in zip(f["source_id"], f["source"]):
                held += [r | {"source_id": key} for r in tree_rows(source)]
                if len(held) >= _ROWS:
                    yield table(held)
                    held = []
        if held:
            yield table(held)

    # short rows of much work each: a small table is one partition, and would be parsed by one task
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sources.select(F.col("source_id").cast("long"), "source").repartition(parts).mapInPandas(run, NODE_TYPES)


@dataclass
class _Step:
    """A pattern node: kinds and text (None: any), the slot under its parent, and its children."""

    kinds: tuple[str, ...] | None = None
    text: str | None = None
    variable: str | None = None
    deep: bool = False
    absent: tuple[str, ...] = ()
    slot: tuple[str | None, int | None, int | None, int, int] = (None, None, None, 0, 0)  # field, idx, rev, least idx, least rev
    below: list["_Step"] = field(default_factory=list)

    def height(self) -> int:
        return 1 + max((s.height() for s in self.below), default=-1)


def _is_rest(node: ast.AST) -> bool:
    node = node.value if isinstance(node, ast.Expr) else node
    return isinstance(node, ast.Constant) and node.value is ...


def _step(node: ast.AST) -> _Step:
    if isinstance(node, ast.Expr) and (getattr(node.value, "id", "").startswith(_VARIABLE) or isinstance(node.value, ast.Call) and getattr(node.value.func, "id", "") == _DEEP):
        node = node.value  # a variable or <... p ...> as a statement is any statement
    if isinstance(node, ast.Name) and node.id.startswith(_VARIABLE):
        return _Step(variable=node.id.removeprefix(_VARIABLE))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == _DEEP:
        return _Step(deep=True, below=[_step(node.args[0])])
    kind = type(node).__name__
    text, below = _parts(node)
    out = _Step(("FunctionDef", "AsyncFunctionDef") if kind == "FunctionDef" else (kind,), text)
    if text.startswith(_VARIABLE):
        out.text, out.variable = None, text.removeprefix(_VARIABLE)
    named = {f: items for f, items, _ in below}
    open_call = any(_is_rest(x) for x in named.get("args", []))
    out.absent = tuple(f for f in _EXACT.get(kind, ()) if not named.get(f) and not (f == "keywords" and open_call))
    for f, items, many in below:
        if isinstance(items[0] if items else None, ast.arguments) and items[0].vararg is not None and items[0].vararg.arg == _REST:
            continue
        rests = [i for i, x in enumerate(items) if _is_rest(x)]
        front, back = (rests[0], len(items) - 1 - rests[-1]) if rests else (0, 0)
        if rests and sum(front <= i < len(items) - back and i not in rests for i in range(len(items))) > 1:
            raise ValueError("one item at most may stand between two ellipses")
        for i, x in enumerate(items):
            if i in rests:
                continue
            step = _step(x)
            if f in _SOME:
                step.slot = (f, None, None, 0, 0)
            elif not rests:
                step.slot = (f, i, len(items) - 1 - i if many else None, 0, 0)
            elif i < front:
                step.slot = (f, i, None, 0, back)
            elif i >= len(items) - back:
                step.slot = (f, None, len(items) - 1 - i, front, 0)
            else:
                step.slot = (f, None, None, front, back)
            out.below.append(step)
    return out


def compiled(pattern: str) -> _Step:
    source = re.sub(r"\$([A-Z_][A-Z0-9_]*)", rf"{_VARIABLE}\1", pattern)
    source = re.sub(r"<\.\.\.\s*(.*?)\s*\.\.\.>", rf"{_DEEP}(\1)", source)
    source = re.sub(r"(def\s+\w+\s*)\(\s*\.\.\.\s*\)", rf"\1(*{_REST})", source)
    body = ast.parse(source).body
    if len(body) != 1:
        raise ValueError("a pattern is one statement or expression")
    return _step(body[0].value if isinstance(body[0], ast.Expr) else body[0])


_STEP_TYPES = "pattern string, step int, up int, height int, up_height int, n_below int, of_kind string, of_text string, deep boolean, absent array<string>, at string, at_idx int, at_rev int, least_idx int, least_rev int, variable string"


def pattern_rows(patterns: Mapping[str, str]) -> list[tuple]:
    """The steps of named patterns as rows of _STEP_TYPES; a step with two kinds gives two rows of one number."""
    out = []
    for name, pattern in patterns.items():
        steps: list[tuple[_Step, int]] = [(compiled(pattern), -1)]
        for k, (s, _) in enumerate(steps):
            steps += [(b, k) for b in s.below]
        names = [s.variable for s, _ in steps if s.variable]
        for k, (s, up) in enumerate(steps):
            if s.variable and names.count(s.variable) > 1 and s.slot[1:3] == (None, None) and up >= 0:
                raise ValueError("a variable that stands twice needs a place of its own")
            own = s.variable if s.variable and names.count(s.variable) > 1 else None
            for kind in s.kinds or (None,):
                out.append((name, k, up, s.height(), steps[up][0].height() if up >= 0 else -1, len(s.below), kind, s.text, s.deep, list(s.absent), *s.slot, own))
    return out


def matches(tree: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(pattern, source_id, pre, line): the nodes of the node table that match each pattern. The table is read some times a level."""
    spark: SparkSession = tree.sparkSession
    rows = pattern_rows(patterns)
    steps = F.broadcast(spark.createDataFrame(rows, _STEP_TYPES))  # a few rows a pattern
    # a name and what is defined under it are the same value of a variable; other expressions are by their shape
    value = F.when(F.col("of_kind").isNotNull() | (F.col("kind") == "Name"), F.col("text")).otherwise(F.col("shape"))
    nothing = F.create_map().cast("map<string,string>")
    bound = F.when(F.col("variable").isNull(), nothing).otherwise(F.create_map(F.coalesce("variable", F.lit("")), value))
    fits = (
        (F.col("of_kind").isNull() | (F.col("of_kind") == F.col("kind"))) & (F.col("of_text").isNull() | (F.col("of_text") == F.col("text"))) & ~F.arrays_overlap("absent", "lists")
        & (F.col("at").isNull() | (F.col("at") == F.col("field"))) & (F.col("at_idx").isNull() | (F.col("at_idx") == F.col("idx"))) & (F.col("at_rev").isNull() | (F.col("at_rev") == F.col("rev")))
        & (F.col("idx") >= F.col("least_idx")) & (F.col("rev") >= F.col("least_rev"))
    )
    keep = ["pattern", "step", "up", "up_height", "source_id", "pre", "last", "parent", "line"]
    done: DataFrame | None = None
    for height in range(max(r[3] for r in rows) + 1):
        met = tree.join(steps.where(F.col("height") == height), fits)
        if done is None:
            level = met.select(*keep, bound.alias("bound"))
        else:
            below = done.where(F.col("up_height") == height)
            flat = below.select("pattern", F.col("up").alias("of"), "source_id", F.col("parent").alias("at_pre"), "step", F.explode_outer("bound").alias("v", "x"))
            agreed = flat.groupBy("pattern", "of", "source_id", "at_pre", "v").agg(F.count_distinct("x").alias("n"), F.min("x").alias("x"), F.collect_set("step").alias("steps"))
            full = agreed.groupBy("pattern", "of", "source_id", "at_pre").agg(
                F.size(F.array_distinct(F.flatten(F.collect_list("steps")))).alias("n_found"), F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "x")))).alias("bound_below")
            )
            full = full.where(F.coalesce("most", F.lit(0)) <= 1).withColumnsRenamed({"pattern": "p2", "source_id": "s2"})
            joined = met.where("not deep").join(full, (F.col("pattern") == F.col("p2")) & (F.col("step") == F.col("of")) & (F.col("source_id") == F.col("s2")) & (F.col("pre") == F.col("at_pre")) & (F.col("n_below") == F.col("n_found")))
            own, more = F.element_at(bound, F.col("variable")), F.element_at("bound_below", F.col("variable"))
            agree = F.col("variable").isNull() | more.isNull() | (own == more)
            plain = joined.where(agree).select(*keep, F.map_concat(F.map_filter("bound_below", lambda k, v: F.col("variable").isNull() | (k != F.col("variable"))), bound).alias("bound"))
            inner = below.select(F.col("pattern").alias("p2"), F.col("up").alias("of"), F.col("source_id").alias("s2"), F.col("pre").alias("inner_pre"))
            around = met.where("deep").join(inner, (F.col("pattern") == F.col("p2")) & (F.col("step") == F.col("of")) & (F.col("source_id") == F.col("s2")) & F.col("inner_pre").between(F.col("pre"), F.col("last")), "left_semi")
            level = plain.union(around.select(*keep, nothing.alias("bound")))
        done = cut(level if done is None else done.union(level))
    return done.where("up = -1").select("pattern", "source_id", "pre", "line").distinct()

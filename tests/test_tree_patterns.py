"""Tree patterns against a recursive matcher over syntax trees, on generated sources."""

import ast
import random
import re
import textwrap

import pytest

from lodeline import on_workers
from lodeline.operators import tree_patterns as tp
from lodeline.operators.retrieval import CONSTRUCTS
from lodeline.plans.lineage import cut

PATTERNS = CONSTRUCTS | {
    "twice": "f($A, $A)", "last": "f(..., 3)", "none": "g()", "one": "g($X)", "middle": "f(..., $X.y, ...)", "keyword": "f(..., k=$V)", "return": "return $X", "deep": "def $F(...): <... re.$M(...) ...>",
    "same": "$X = $X", "own": "def $F(...): return $F(...)", "tuple": "($A, 1)", "class": "class $C(...): ...",
}


def same(a, b):
    return ast.dump(a) == ast.dump(b)


def agree(var, value, held):
    """value: a name's text, or a node."""
    value = value.id if isinstance(value, ast.Name) else value
    old = held.get(var)
    if old is None:
        return [{**held, var: value}]
    return [held] if (old == value if isinstance(old, str) or isinstance(value, str) else same(old, value)) else []


def rest(x):
    x = x.value if isinstance(x, ast.Expr) else x
    return isinstance(x, ast.Constant) and x.value is ...


def match(p, n, held):
    """All bindings under which the pattern tree matches the node."""
    if isinstance(p, ast.Expr) and isinstance(p.value, ast.Call) and getattr(p.value.func, "id", "") == "__deep__":
        p = p.value
    if isinstance(p, ast.Call) and getattr(p.func, "id", "") == "__deep__":
        return [held] if any(match(p.args[0], x, {}) for x in ast.walk(n)) else []
    if isinstance(p, ast.Name) and p.id.startswith("__mv_"):
        return agree(p.id, n, held)
    if type(p) is not type(n) and not (isinstance(p, ast.FunctionDef) and isinstance(n, ast.AsyncFunctionDef)):
        return []
    found = [held]
    for name in p._fields:
        if name in ("ctx", "type_comment", "kind"):
            continue
        x, y = getattr(p, name, None), getattr(n, name, None)
        found = [more for h in found for more in (items(p, name, x, y, h) if isinstance(x, list) else single(x, y, h))]
    return found


def single(x, y, held):
    if isinstance(x, ast.arguments) and x.vararg is not None and x.vararg.arg == "__rest__" or isinstance(x, ast.AST) and rest(x):
        return [held]
    if isinstance(x, ast.AST):
        return match(x, y, held) if isinstance(y, ast.AST) else []
    if isinstance(x, str) and x.startswith("__mv_"):
        return agree(x, y, held)
    return [held] if x is None or x == y else []


def items(p, name, xs, ys, held):
    if name in ("decorator_list", "keywords"):
        if not xs:
            return [held] if name == "decorator_list" or not isinstance(p, ast.Call) or any(map(rest, p.args)) or not ys else []
        found = [held]
        for x in xs:
            found = [m for h in found for y in ys for m in match(x, y, h)]
        return found
    if not xs and not (isinstance(p, (ast.Call, ast.Tuple, ast.List, ast.Set)) and name in ("args", "elts")):
        return [held]
    if not xs:
        return [] if ys else [held]
    if rest(xs[0]):
        return [m for k in range(len(ys) + 1) for m in (items(p, name, xs[1:], ys[k:], held) if xs[1:] else [held] if k == len(ys) else [])]
    return [m for h in (match(xs[0], ys[0], held) if ys else []) for m in (items(p, name, xs[1:], ys[1:], h) if xs[1:] else [] if ys[1:] else [h])]


def brute(source):
    try:
        tree = ast.parse(textwrap.dedent(source))
    except SyntaxError:
        return set()
    out = set()
    for name, pattern in PATTERNS.items():
        text = re.sub(r"\$([A-Z]+)", r"__mv_\1", pattern)
        text = re.sub(r"<\.\.\. (.*) \.\.\.>", r"__deep__(\1)", text)
        text = re.sub(r"(def \w+)\(\.\.\.\)", r"\1(*__rest__)", text)
        p = ast.parse(text).body[0]
        p = p.value if isinstance(p, ast.Expr) else p
        out |= {(name, n.lineno) for n in ast.walk(tree) if hasattr(n, "lineno") and match(p, n, {})}
    return out


def expression(rng, depth=0):
    if depth > 2 or rng.random() < 0.4:
        return rng.choice(["a", "b", "x.y", "1", "3", "'isinstance(a, b)'", "(a, 1)", "[]"])
    inner = [expression(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    call = rng.choice(["f", "g", "isinstance", "math.sin", "re.match", "logging.info", "h.f"])
    return f"{call}({', '.join(inner + rng.choice([[], [], ['k=a'], ['k=3', 'q=b']]))})"


def block(rng, pad="", depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind, inner = rng.randrange(9), pad + "    "
        if depth > 2 or kind < 4:
            out.append(pad + rng.choice(["{e}", "a = {e}", "b = b", "raise {e}", "return {e}", "pass  # raise E(1)", "raise E({e})"]).format(e=expression(rng)) + "\n")
        elif kind == 4:
            out.append(f"{pad}for a in {expression(rng)}:\n{block(rng, inner, depth + 1)}")
        elif kind == 5:
            out.append(f"{pad}class C{rng.choice(['', '(B)'])}:\n{block(rng, inner, depth + 1)}")
        else:
            above = "".join(f"{pad}{d}\n" for d in rng.choice([[], ["@d"], ["@d.e(1)"], ["@d", "@e"]]))
            out.append(f"{above}{pad}{rng.choice(['', 'async '])}def {rng.choice('fg')}(a, *b, c=1):\n{block(rng, inner, depth + 1)}")
    return "".join(out)


def test_patterns_against_recursive_matcher(spark):
    on_workers(spark)
    rng = random.Random(17)
    sources = [block(rng, rng.choice(["", "    "])) for _ in range(500)] + ["def f(:\n", "", None]
    tree = cut(tp.nodes(spark.createDataFrame(list(enumerate(sources)), "source_id long, source string").repartition(4)))
    got = {}
    for r in tp.matches(tree, PATTERNS).collect():
        got.setdefault(r["source_id"], set()).add((r["pattern"], r["line"]))
    want = {i: brute(s) for i, s in enumerate(sources) if s and brute(s)}
    assert {n for found in want.values() for n, _ in found} == set(PATTERNS)
    assert got == want


def test_node_table():
    rows = tp.tree_rows("  x = f(a, 'f(b)')  # f(c)\n")
    assert [r["text"] for r in rows if r["kind"] == "Name"] == ["x", "f", "a"]
    assert all(rows[r["parent"]]["pre"] < r["pre"] <= r["last"] <= rows[r["parent"]]["last"] for r in rows[1:])
    assert len(tp.tree_rows("+".join(["a"] * 3000))) > 3000 or tp.tree_rows("+".join(["a"] * 3000)) == []
    assert tp.tree_rows("def (") == [] and tp.tree_rows(None)[0]["kind"] == "Module"


def test_what_patterns_may_not_say():
    with pytest.raises(ValueError):
        tp.pattern_rows({"p": "f(..., a, b, ...)"})
    with pytest.raises(ValueError):
        tp.pattern_rows({"p": "f(..., $X, ..., k=$X)"})

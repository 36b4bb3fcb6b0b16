"""Imports of a project's own modules against a sequential fixpoint, and the cases that a user meets."""

import random

from lodeline.sources.imports import absolute, module_of, unresolved_imports

SCHEMA = "path string, source string, language string"


def found(spark, files):
    rows = [(p, s, "python") for p, s in files.items()]
    return {tuple(r) for r in unresolved_imports(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_names_of_modules():
    assert [module_of(p) for p in ("a/b.py", "a/__init__.py", "__init__.py", "a.pyi")] == ["a.b", "a", "", "a"]
    assert [absolute("a/b/c.py", n, m) for n, m in ((1, "x"), (2, None), (3, "x"), (4, "x"))] == ["a.b.x", "a", "x", "....x"]
    assert absolute("a/__init__.py", 1, "x") == "a.x"


def test_chains_circles_and_stars(spark):
    files = {
        "pkg/__init__.py": "from .core import run, missing\nfrom . import util\nfrom .sub import *\n",
        "pkg/core.py": "import os\nif os.name:\n    def run(): pass\nelse:\n    run = None\n",
        "pkg/util.py": "from os.path import *\n",
        "pkg/sub/__init__.py": "from ..core import run as go\nfrom .deep import *\n_private = 1\n",
        "pkg/sub/deep.py": "__all__ = ['_shown']\n_shown = 1\nhidden = 2\n",
        "pkg/lazy.py": "def __getattr__(name): return name\n",
        "ring/a.py": "from ring.b import x, y\n",
        "ring/b.py": "from ring.a import x\nfrom ring.a import *\ny = 1\n",
        "broken.py": "def (\n",
        "main.py": "import pkg.core, pkg.none, numpy.x\nfrom pkg import run, go, _shown, hidden, _private, core, __name__\nfrom pkg.util import join\nfrom pkg.lazy import anything\nfrom pkg.sub import _shown\nfrom ring.b import y, z\n"
        "from broken import f\nfrom .pkg import run\nfrom ..above import g\nfrom pkg.core import os\n"
        + "class C:\n    inner = 1\n    def f(self):\n        from pkg import never\n",
        "user.py": "from main import C, inner, g, pkg\nfrom pkg import missing\nfrom pkg.nothing import *\n",
        "none.py": None,
    }
    assert found(spark, files) == {
        ("pkg/__init__.py", "pkg.core", "missing"), ("ring/a.py", "ring.b", "x"), ("ring/b.py", "ring.a", "x"), ("main.py", "pkg.none", None), ("main.py", "pkg", "hidden"), ("main.py", "pkg", "_private"), ("main.py", "pkg", "_shown"),
        ("main.py", "ring.b", "z"), ("main.py", "broken", "f"), ("main.py", "..above", None), ("user.py", "main", "inner"), ("user.py", "main", "g"), ("user.py", "pkg", "missing"), ("user.py", "pkg.nothing", None),
    }
    assert found(spark, {"a.py": ""}) == set()
    assert unresolved_imports(spark.createDataFrame([], SCHEMA)).count() == 0


def brute(modules):
    """modules: {path: statements}, a statement ('own', n), ('name', of, n, as) or ('star', of); sweeps until nothing changes."""
    has = {module_of(p): set() for p in modules}
    changed = True
    while changed:
        changed = False
        for path, statements in modules.items():
            own, before = has[module_of(path)], len(has[module_of(path)])
            for s in statements:
                if s[0] == "own":
                    own.add(s[1])
                elif s[0] == "name" and s[2] in has.get(s[1], ()):
                    own.add(s[3])
                elif s[0] == "star":
                    own |= {n for n in has.get(s[1], ()) if not n.startswith("_")}
            changed |= len(own) > before
    out = set()
    for path, statements in modules.items():
        for s in statements:
            if s[0] != "own" and s[1] not in has:
                out.add((path, s[1], None))
            elif s[0] == "name" and s[2] not in has[s[1]]:
                out.add((path, s[1], s[2]))
    return out


def test_random_projects(spark):
    rng = random.Random(9)
    text = {"own": "{1} = 1", "name": "from {1} import {2} as {3}", "star": "from {1} import *"}
    for _ in range(4):
        modules = {}
        for i in range(14):
            of = lambda: f"m{rng.randrange(15)}"  # noqa: E731  # m14 isn't there unless as another's name
            name = lambda: rng.choice(["a", "b", "c", "_d", "e"])
            modules[f"m{i}.py"] = [rng.choice([("own", name()), ("name", of(), name(), name()), ("name", of(), name(), name()), ("star", of())]) for _ in range(rng.randint(0, 3))]
        files = {p: "\n".join(text[s[0]].format(*s) for s in statements) for p, statements in modules.items()}
        # m14 is no file, so the project takes it for another's: give it a folder without such a module
        files["m14/x.py"], modules["m14/x.py"] = "", []
        want = brute(modules)
        assert found(spark, files) == {r for r in want if r[1] != "m14"} | {(p, "m14", s[2]) for p, ss in modules.items() for s in ss if s[0] == "name" and s[1] == "m14"}
        assert len(want) > 3

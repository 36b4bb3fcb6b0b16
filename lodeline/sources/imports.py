"""Resolution of a project's own Python imports, across files, to a fixpoint.

A static stand-in for importing the files. What each file binds and imports becomes rows; a name that a module takes from
another one is there once the other one has it. Rounds of joins carry the names that are new along import edges and star
imports until nothing is new, so names are followed through any number of `__init__` files, and names that modules only
take from each other in a circle are not there.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.plans.lineage import cut
from lodeline.sources.code import _DEFINITIONS, parse

#: Stands for every name of a module that has a `__getattr__` or a star import from outside the project.
ANY = "*"
# Names that every module has.
IMPLICIT = ("__name__", "__doc__", "__file__", "__package__", "__spec__", "__loader__", "__path__", "__dict__")
_ROWS = "path string, module string, kind string, name string, of_module string, of_name string, relative boolean"


def module_of(path: str) -> str:
    """The dotted name of a file's module; a package's is its folder's, and the root's is empty."""
    parts = path.rsplit(".", 1)[0].split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def absolute(path: str, level: int, module: str | None) -> str:
    """What `from <level dots><module> import` in a file refers to; as written if it leads above the project's root."""
    folders = path.split("/")[:-1]
    if level - 1 > len(folders):
        return "." * level + (module or "")
    return ".".join(folders[: len(folders) - level + 1] + ([module] if module else []))


def _top_level(tree: ast.Module) -> Iterator[ast.AST]:
    """Nodes that run when a module is imported: not what is inside of definitions, lambdas and comprehensions."""
    waiting: list[ast.AST] = [tree]
    while waiting:
        for child in ast.iter_child_nodes(waiting.pop()):
            yield child
            if not isinstance(child, (*_DEFINITIONS, ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                waiting.append(child)


def _listed(node: ast.AST) -> list[str] | None:
    """The names of `__all__ = [...]`; nothing if it isn't one list of strings."""
    if isinstance(node, (ast.Assign, ast.AnnAssign)):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            if all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in node.value.elts):
                return [e.value for e in node.value.elts]
    return None


def _file_rows(path: str, source: str | None) -> list[tuple]:
    at, rows = module_of(path), []
    add = lambda kind, name=None, of_module=None, of_name=None, relative=False: rows.append((path, at, kind, name, of_module, of_name, relative))
    for node in _top_level(parse(source) or ast.Module([], [])):
        if isinstance(node, _DEFINITIONS):
            add("own", node.name)
            if node.name == "__getattr__" and not isinstance(node, ast.ClassDef):
                add("own", ANY)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            add("own", node.id)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            add("own", node.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("module", a.asname or a.name.split(".")[0], a.name)
        elif isinstance(node, ast.ImportFrom):
            of = absolute(path, node.level, node.module) if node.level else node.module
            for a in node.names:
                add("star" if a.name == "*" else "name", None if a.name == "*" else a.asname or a.name, of, None if a.name == "*" else a.name, node.level > 0)
        listed = _listed(node)
        if listed is not None:
            add("listing")
            for name in listed:
                add("listed", name)
    return rows


def import_rows(files: DataFrame) -> DataFrame:
    """(path, module, kind, name, of_module, of_name, relative) of Python files(path, source, language).

    Kinds: own (a definition or assigned name), module (`import of_module`), name (`from of_module import of_name as name`),
    star, listing (the module has a list `__all__`) and listed (a name in it).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, s in zip(f["path"], f["source"]) for r in _file_rows(p, s)], columns=[c.split()[0] for c in _ROWS.split(", ")])

    return files.where("language = 'python' and path is not null").select("path", "source").mapInPandas(run, _ROWS).distinct()


def _tail(c):
    return F.regexp_extract(c, r"([^.]*)$", 1)


def _parent(c):
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


class Resolution:
    """What a project's modules have: `modules`(module), `names`(module, name), and `unresolved`, as written tables."""

    def __init__(self, files: DataFrame):
        python = files.where("language = 'python' and path is not null")
        bare = F.regexp_replace(F.regexp_replace("path", r"\.[^./]*$", ""), "(^|/)__init__$", "")
        parts = F.split(bare, "/")
        prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
        self.modules = cut(python.select(F.explode(prefixes).alias("module")).distinct())
        heads = self.modules.where("module <> ''").select(F.split_part("module", F.lit("."), F.lit(1)).alias("head")).distinct()
        rows = cut(import_rows(files))
        headed = rows.withColumn("head", F.split_part("of_module", F.lit("."), F.lit(1))).join(heads.withColumn("known_head", F.lit(True)), "head", "left")
        #: Imports, with whether they concern the project.
        self.imports = cut(headed.where("of_module is not null").withColumn("inner", F.col("relative") | F.col("known_head").isNotNull()).drop("head", "known_head"))
        self.rows = rows
        self.names = self._names()

    def _names(self) -> DataFrame:
        named = lambda df, name="name": df.select("module", F.col(name).alias("name"))
        inner, outer = self.imports.where("inner"), self.imports.where("not inner")
        reached = inner.join(self.modules.withColumnRenamed("module", "of_module"), "of_module", "left_semi")
        submodules = self.modules.where("module <> ''").select(_parent("module").alias("module"), _tail("module").alias("name"))
        stars = reached.where("kind = 'star'").select("of_module", "module").distinct()
        edges = reached.where("kind = 'name'").select("of_module", "of_name", "module", "name").distinct()
        listing, listed = self.rows.where("kind = 'listing'").select("module").distinct(), named(self.rows.where("kind = 'listed'")).distinct()
        first = named(self.rows.where("kind = 'own'")).unionByName(submodules).unionByName(named(reached.where("kind = 'module'"))).unionByName(named(outer.where("kind <> 'star'")))
        known = new = cut(first.unionByName(outer.where("kind = 'star'").select("module", F.lit(ANY).alias("name"))).distinct())
        while not new.isEmpty():
            source = new.withColumnsRenamed({"module": "of_module", "name": "of_name"})
            direct = edges.join(source, ["of_module", "of_name"])
            through_any = edges.join(source.where(F.col("of_name") == ANY).select("of_module"), "of_module")
            public = new.join(listing, "module", "left_anti").where(~F.col("name").startswith("_")).unionByName(new.join(listed, ["module", "name"], "left_semi")).unionByName(new.where(F.col("name") == ANY))
            starred = stars.join(public.withColumnRenamed("module", "of_module"), "of_module")
            found = named(direct).unionByName(named(through_any)).unionByName(named(starred)).distinct()
            new = cut(found.join(known, ["module", "name"], "left_anti"))
            known = known.unionByName(new)
        return known

    def unresolved(self) -> DataFrame:
        """(path, module, name): imports of a module of the project that isn't there (name is null), or of a name that it hasn't."""
        inner = self.imports.where("inner").select("path", F.col("of_module").alias("module"), F.col("of_name").alias("name"))
        no_module = inner.join(self.modules, "module", "left_anti").select("path", "module", F.lit(None).cast("string").alias("name"))
        open_ = self.names.where(F.col("name") == ANY).select("module").distinct()
        asked = inner.where(F.col("name").isNotNull() & ~F.col("name").isin(*IMPLICIT)).join(self.modules, "module", "left_semi").join(open_, "module", "left_anti")
        return no_module.unionByName(asked.join(self.names, ["module", "name"], "left_anti").select("path", "module", "name")).distinct()


def unresolved_imports(files: DataFrame) -> DataFrame:
    """(path, module, name) of files(path, source, language): imports of the project's own modules that fail.

    Relative imports are taken from the file's folder; one that leads above the root is named as written. Modules whose first
    part is no folder or file of the project are others' and count as there, as does every name behind a star import of
    such a module or a module-level `__getattr__`. A star import brings the names of a list `__all__`, without one those
    that don't start with an underscore. A file that doesn't parse has no names. The order of statements, `del` and
    conditions are not looked at. Each round of names is a written table; there are as many as the longest chain of imports.
    """
    return Resolution(files).unresolved()

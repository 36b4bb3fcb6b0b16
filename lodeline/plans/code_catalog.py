"""Queries over a generated project, a source file for each supplier, and their SQL counterparts.

The files are built by one rule, so SQL can say what has to be found in them without parsing. A file whose supplier's key
ends in 7 does not parse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F


from lodeline.functions import predicates as p
from lodeline.functions import text as t
from lodeline.operators import blocks, context, delta, graph, retrieval, targets, tree_patterns, versions
from lodeline.operators.posting_index import PostingIndex
from lodeline.plans import catalog
from lodeline.plans.catalog import _BM25, _words, query, table
from lodeline.plans.engine import Engine
from lodeline.plans.lineage import cut, shared_folder
from lodeline.sources import code, files, imports, pages
from lodeline.streaming import events as streams

_SOURCE = '''import os
from pkg.mod{next} import {what} as h{k}


class Supplier{k}:
    """{name} supplies."""

    def total(self, a, *rest, key=None, **more):
        return helper_{k}(a)


@cache
async def helper_{k}(x: int) -> int:
    return shared(x) + os.getpid()


def shared(x):
    return x
'''
_K = "k AS (SELECT s_suppkey AS k, s_name AS name, 'pkg/mod' || s_suppkey || '.py' AS file FROM supplier), g AS (SELECT * FROM k WHERE k % 10 <> 7)"


def _filled(pattern: str):
    """The pattern as a column: {k}, {next}, {what} and {name} stand for the row's values."""
    k = F.col("s_suppkey")
    values = {"k": k.cast("string"), "next": (k + 1).cast("string"), "what": F.when(k % 2 == 0, "shared").otherwise("helper"), "name": F.col("s_name")}
    out = F.lit(pattern)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _project(spark, d):
    source = F.concat(_filled(_SOURCE), F.when(F.col("s_suppkey") % 10 == 7, "def (\n").otherwise(""))
    return table(spark, d, "supplier").select(_filled("pkg/mod{k}.py").alias("path"), source.alias("source"), F.lit("python").alias("language"), F.col("s_suppkey").alias("k"))


def _symbols(spark, d):
    return code.symbols(_project(spark, d))


_SYMBOLS = f"""{_K}, s AS (
SELECT k, file, 'Supplier' || k AS name, 'class' AS symbol_type, 5 AS start_line, 9 AS end_line, 0 AS indent, NULL AS parent_class, name || ' supplies.' AS doc, 0 AS ordinal, 0 AS depth_ordinal FROM g UNION ALL
SELECT k, file, 'total', 'function', 8, 9, 4, 'Supplier' || k, NULL, 3, 1 FROM g UNION ALL
SELECT k, file, 'helper_' || k, 'function', 12, 14, 0, NULL, NULL, 1, 2 FROM g UNION ALL
SELECT k, file, 'shared', 'function', 17, 18, 0, NULL, NULL, 2, 3 FROM g)"""


@query(f"WITH {_SYMBOLS} SELECT file, name, symbol_type, start_line, end_line, indent, parent_class, doc AS docstring_first_line, ordinal, depth_ordinal FROM s")
def python_symbols(spark, d):
    return _symbols(spark, d).select("file", "name", "symbol_type", "start_line", "end_line", "indent", "parent_class", "docstring_first_line", "ordinal", "depth_ordinal")


@query(f"""WITH {_SYMBOLS} SELECT file, name, end_line - start_line + 1 AS line_count, CASE WHEN name = 'total' THEN 'self,a,*rest,key,**more' WHEN symbol_type = 'class' THEN '' ELSE 'x' END AS parameters,
CASE WHEN start_line = 12 THEN 'cache' ELSE '' END AS decorators, CASE WHEN start_line = 12 THEN 'int' END AS return_type_hint, start_line = 12 AS is_async,
array_to_string(list_sort(list_distinct(list_concat({_words('name')}, {_words("coalesce(doc, '')")}))), ',') AS keywords, CASE start_line WHEN 12 THEN 'getpid,shared' WHEN 17 THEN '' ELSE 'helper_' || k END AS calls FROM s""")
def python_metadata(spark, d):
    m = code.metadata(_project(spark, d))
    listed = [F.array_join(c, ",").alias(c) for c in ("parameters", "decorators", "keywords", "calls")]
    return m.select("file", "name", "line_count", *listed, "return_type_hint", "is_async")


@query(f"""WITH {_SYMBOLS}, c AS (SELECT file, name, start_line, unnest(CASE start_line WHEN 12 THEN ['shared', 'getpid'] WHEN 17 THEN [] ELSE ['helper_' || k] END) AS callee FROM s) SELECT file, name, callee FROM c""")
def python_calls(spark, d):
    s = _symbols(spark, d)
    return code.calls(s).withColumnRenamed("name", "callee").join(s.select("symbol_id", "file", "name"), "symbol_id").select("file", "name", "callee")


_EDGES = f"""{_SYMBOLS}, e AS (SELECT k, file, name, CASE start_line WHEN 12 THEN 'shared' ELSE 'helper_' || k END AS callee FROM s WHERE start_line <> 17)"""


def _edges(spark, d):
    s = _symbols(spark, d)
    return graph.call_edges(code.calls(s), s)


@query(f"WITH {_EDGES} SELECT file, name, callee FROM e")
def project_call_graph(spark, d):
    return _edges(spark, d).join(_symbols(spark, d).select(F.col("symbol_id").alias("caller_id"), "file", "name"), "caller_id").select("file", "name", F.col("callee_name").alias("callee"))


@query(f"WITH {_K} SELECT file, 'helper_' || k AS name, 1 AS called_by_count FROM g UNION ALL SELECT file, 'shared', 1 FROM g")
def local_callers(spark, d):
    s = _symbols(spark, d)
    return graph.local_called_by(code.calls(s), s).join(s, "symbol_id").select("file", "name", "called_by_count")


@query(f"WITH {_K} SELECT name, file, line FROM (SELECT 'helper_' || k AS name, file, 9 AS line FROM g UNION ALL SELECT 'shared', file, 14 FROM g UNION ALL SELECT 'getpid', file, 14 FROM g)")
def call_lines(spark, d):
    return code.call_lines(_project(spark, d))


@query(f"WITH {_K}, s AS (SELECT file, row_number() OVER (ORDER BY file) AS n FROM g) SELECT 1 AS request_id, string_agg(file || ':14', ',' ORDER BY n) AS sites FROM s WHERE n <= 10")
def call_sites(spark, d):
    asked = spark.createDataFrame([(1, 1, "shared")], "request_id long, symbol_id long, name string")
    got = retrieval.call_sites(asked, code.call_lines(_project(spark, d)))
    return got.select("request_id", F.array_join(F.transform("call_sites", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ",").alias("sites"))


@query(f"WITH {_K} SELECT file AS path, 1 AS start_line, 2 AS end_line, 'os,pkg.mod' || (k + 1) AS modules, 'os,h' || k AS names FROM g")
def python_imports(spark, d):
    f = _project(spark, d)
    rows = code.imports(f)
    names = rows.groupBy("path").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "names"))), lambda x: x["names"])), ",").alias("names"))
    modules = code.file_imports(f, blocks.line_table(f.select(F.col("path").alias("file_id"), "source"))).select("path", F.array_join("modules", ",").alias("modules"))
    return code.import_span(rows).join(modules, "path").join(names, "path")


@query(f"""WITH {_K}, t AS (SELECT file AS path, k + 1 AS n, CASE WHEN k % 2 = 0 THEN 'shared' ELSE 'helper' END AS name FROM g)
SELECT path, 'pkg.mod' || n AS module, CASE WHEN n <= (SELECT max(k) FROM k) THEN name END AS name FROM t WHERE n > (SELECT max(k) FROM k) OR name = 'helper' OR n % 10 = 7""")
def unresolved_imports(spark, d):
    return imports.unresolved_imports(_project(spark, d))


_CHAIN = {0: "value = {k}\n_hidden = value\n", 3: "from .c{before} import *\n", 5: "from .c{k} import value\n"}


def _chained_project(spark, d):
    """For each supplier a module and its user; five modules of six take a name from the one before, or from themselves."""
    k = F.col("s_suppkey")
    source = F.lit("try:\n    from ..chain.c{before} import value as value\nexcept ImportError:\n    pass\n")
    for rest, text in _CHAIN.items():
        source = F.when(k % 6 == rest, F.lit(text)).otherwise(source)
    filled = lambda c: F.replace(F.replace(c, F.lit("{k}"), k.cast("string")), F.lit("{before}"), (k - 1).cast("string"))
    both = F.array(F.struct(F.lit("chain/c{k}.py").alias("path"), source.alias("source")), F.struct(F.lit("use/u{k}.py").alias("path"), F.lit("from chain.c{k} import value, _hidden\n").alias("source")))
    return table(spark, d, "supplier").select(k, F.explode(both).alias("f")).select(filled(F.col("f.path")).alias("path"), filled(F.col("f.source")).alias("source"), F.lit("python").alias("language"))


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS k FROM supplier), h AS (SELECT k FROM k WHERE k % 6 = 0 UNION ALL SELECT k.k FROM h JOIN k ON k.k = h.k + 1 WHERE k.k % 6 NOT IN (0, 5)),
t AS (SELECT 'chain/c' || k || '.py' AS path, CASE WHEN k % 6 = 5 THEN k ELSE k - 1 END AS src, CASE WHEN k % 6 <> 3 THEN 'value' END AS name FROM k WHERE k % 6 <> 0
UNION ALL SELECT 'use/u' || k || '.py', k, unnest(['value', '_hidden']) FROM k)
SELECT path, 'chain.c' || src AS module, CASE WHEN src IN (SELECT k FROM k) THEN name END AS name FROM t
WHERE src NOT IN (SELECT k FROM k) OR name = 'value' AND src NOT IN (SELECT k FROM h) OR name = '_hidden' AND src % 6 <> 0""")
def import_chains(spark, d):
    return imports.unresolved_imports(_chained_project(spark, d))


@query(f"WITH {_K} SELECT file AS path, CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END AS n_errors, k % 10 <> 7 AS is_python, CASE WHEN k % 10 <> 7 THEN 'python' END AS sniffed FROM k")
def syntax_and_sniff(spark, d):
    f = _project(spark, d)
    bare = files.detect_language(f.select(F.regexp_replace("path", r"\.py$", "").alias("bare"), "source", "path"), "bare", sniff="source").select("path", F.col("language").alias("sniffed"))
    looks = f.select("path", code.looks_like_python(F.col("source")).alias("is_python"))
    return code.syntax_errors(f).select("path", F.size("errors").alias("n_errors")).join(looks, "path").join(bare, "path")


@query("""SELECT 'src/S' || s_suppkey || '.java' AS file, unnest(['S' || s_suppkey, 'f' || s_suppkey, 'g']) AS name, unnest(['class', 'function', 'function']) AS symbol_type, unnest([1, 2, 6]) AS start_line, unnest([5, 4, 8]) AS end_line, unnest([NULL, 'S' || s_suppkey, NULL]) AS parent_class FROM supplier""")
def java_symbols(spark, d):
    source = _filled("public class S{k} {\n  private int f{k}(int a) {\n    return g(a);\n  }\n}\nstatic int g(int b) {\n  return b;\n}\n")
    f = table(spark, d, "supplier").select(_filled("src/S{k}.java").alias("path"), source.alias("source"), F.lit("java").alias("language"))
    return code.symbols(f).select("file", "name", "symbol_type", "start_line", "end_line", "parent_class")


_NOTES = "# Head {k}\ntext of {name}\n# Tail_part\nmore words\n"


def _notes(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), _filled("notes/{k}.md").alias("path"), _filled(_NOTES).alias("source"), F.lit("markdown").alias("language"))


@query("""SELECT 'notes/' || s_suppkey || '.md' AS file, unnest(['Head ' || s_suppkey, 'Tail_part']) AS name, 'block' AS symbol_type, unnest([1, 3]) AS start_line, unnest([2, 4]) AS end_line, 'markdown' AS language,
unnest([s_suppkey || ',head', 'part,tail']) AS keywords, unnest([substr(sha256('# Head ' || s_suppkey || chr(10) || 'text of ' || s_name), 1, 16), substr(sha256('# Tail_part' || chr(10) || 'more words'), 1, 16)]) AS content_hash FROM supplier""")
def block_metadata(spark, d):
    n = _notes(spark, d)
    m = code.block_metadata(blocks.text_blocks(n), blocks.line_table(n), n.select("file_id", "path", "language"))
    return m.select("file", "name", "symbol_type", "start_line", "end_line", "language", F.array_join("keywords", ",").alias("keywords"), "content_hash")


def _note_blocks(spark, d):
    n = _notes(spark, d)
    return blocks.as_symbols(blocks.text_blocks(n), blocks.line_table(n))


def _note_requests(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), _filled("change head {k}").alias("text"))


_NOTE_WORDS = "b AS (SELECT s_suppkey AS k FROM supplier), r AS (SELECT a.k AS request_id, c.k AS file_id, a.k = c.k AS own FROM b a, b c)"


@query(f"WITH {_NOTE_WORDS} SELECT request_id, file_id, CASE WHEN own THEN 7.0 ELSE 1.0 END::DOUBLE AS score FROM r WHERE request_id % 50 = 0")
def name_ranked_blocks(spark, d):
    b = _note_blocks(spark, d)
    return blocks.name_ranking(_note_requests(spark, d).where("request_id % 50 = 0"), b, also=["file_id"]).select("request_id", "file_id", "score")


@query(f"WITH {_NOTE_WORDS} SELECT request_id, file_id, CASE WHEN own THEN 7.0 ELSE 1.0 END::DOUBLE AS score FROM r WHERE request_id % 50 = 0")
def located_blocks(spark, d):
    b = _note_blocks(spark, d)
    return blocks.locate_blocks(_note_requests(spark, d).where("request_id % 50 = 0"), b, also=["file_id"]).select("request_id", "file_id", "score")


@query("SELECT s_suppkey AS request_id, s_suppkey AS file_id, 7.0::DOUBLE AS score FROM supplier WHERE (SELECT count(*) FROM supplier) > 1")
def located_block(spark, d):
    b = _note_blocks(spark, d)
    got = blocks.locate_block(_note_requests(spark, d), b)
    return got.join(b.select("symbol_id", "file_id"), "symbol_id").select("request_id", "file_id", "score")


@query("SELECT s_suppkey AS request_id, s_suppkey AS file_id FROM supplier")
def located_module_block(spark, d):
    f = _project(spark, d).withColumn("file_id", F.col("k"))
    lines = blocks.line_table(f.select("file_id", "source")).where("n <= 2 or n >= 17")
    gaps = blocks.as_symbols(blocks.paragraphs(lines), lines)
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), _filled("move import mod{next} elsewhere").alias("text"))
    return blocks.locate_module_block(asked, gaps).join(gaps.select("symbol_id", "file_id"), "symbol_id").select("request_id", "file_id")


_CASES = "CASE k % 5 WHEN 0 THEN 'REPLACE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'REPLACE' ELSE 'INSERT' END"


def _checked(spark, d):
    f = _project(spark, d)
    pick = lambda *values: F.get(F.array(*values), (F.col("k") % 5).cast("int"))
    k, helper = F.col("k").cast("string"), F.concat(F.lit("helper_"), F.col("k").cast("string"))
    none = F.lit(None).cast("string")
    ops = f.select(
        k.alias("run_id"), F.lit(0).alias("op_ord"), pick(*map(F.lit, ("REPLACE", "DELETE", "REPLACE", "INSERT", "INSERT"))).alias("operation"), F.col("path").alias("file"), F.lit("function").alias("symbol_type"),
        pick(F.lit("total"), F.lit("nothing"), helper, F.lit("shared"), F.lit("wrong")).alias("symbol_name"), pick(none, none, none, F.lit("shared"), F.lit("shared")).alias("anchor"),
        pick(F.lit("def total(self):\n    pass"), none, F.concat(F.lit("async def "), helper, F.lit("(x):\n    pass")), F.lit("def shared():\n    pass"), F.concat(F.lit("def fresh_"), k, F.lit("():\n    pass"))).alias("content"),
    )
    lines = blocks.line_table(f.select(F.col("path").alias("file_id"), "source")).withColumnRenamed("file_id", "file")
    return delta.validate_targets(ops, code.symbols(f), None, lines), f


_STATUS = "CASE WHEN k % 10 = 7 THEN 'MISSING' ELSE ['OK', 'MISSING', 'DECORATORS_LOST', 'ALREADY_DEFINED', 'OK'][(k % 5 + 1)::INT] END"


@query(f"WITH {_K} SELECT file, {_CASES} AS operation, {_STATUS} AS status FROM k")
def validated_targets(spark, d):
    return _checked(spark, d)[0].select("file", "operation", "status")


@query(f"""WITH {_K} SELECT file, CASE WHEN k % 5 = 0 THEN 'total' ELSE 'fresh_' || k END AS symbol_name, CASE WHEN k % 5 = 0 THEN 8 END AS "start", CASE WHEN k % 5 = 0 THEN 9 END AS "end", CASE WHEN k % 5 = 4 THEN 18 END AS after_line FROM k WHERE {_STATUS} = 'OK'""")
def line_ranges(spark, d):
    checked, f = _checked(spark, d)
    sizes = f.select(F.col("path").alias("file"), F.size(t.split_lines(F.col("source"))).alias("n_lines"))
    return delta.annotated(checked.where("status = 'OK'"), sizes).select("file", "symbol_name", "line_range.*")


def _renames(spark, d):
    f = _project(spark, d).select(F.col("k").alias("file_id"), "source", "path")
    k = F.col("file_id").cast("string")
    op = lambda name, start, end, new: f.select("file_id", F.lit("REPLACE").alias("operation"), name.alias("symbol_name"), F.lit(start).alias("start_line"), F.lit(end).alias("end_line"), F.concat(F.lit("def "), new, F.lit("():\n    pass")).alias("content"))
    helper = F.concat(F.lit("helper_"), k)
    ops = op(helper, 12, 14, F.concat(F.lit("aide_"), k)).unionByName(op(F.lit("total"), 8, 9, F.lit("sum_up"))).unionByName(op(F.lit("shared"), 17, 18, F.lit("shared")))
    return f, delta.rename_sweep(f.select("file_id", "source"), ops)


@query("SELECT s_suppkey AS file_id, 'helper_' || s_suppkey AS old_name, 'aide_' || s_suppkey AS new_name FROM supplier")
def rename_sweep(spark, d):
    return _renames(spark, d)[1]


def _sql_source() -> str:
    out = "'" + _SOURCE.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in {"k": "s_suppkey", "next": "(s_suppkey + 1)", "what": "CASE WHEN s_suppkey % 2 = 0 THEN 'shared' ELSE 'helper' END", "name": "s_name"}.items():
        out = f"replace({out}, '{{{name}}}', ({value})::VARCHAR)"
    return f"{out} || CASE WHEN s_suppkey % 10 = 7 THEN 'def (' || chr(10) ELSE '' END"


@query(f"SELECT s_suppkey AS file_id, sha256(replace({_sql_source()}, 'helper_' || s_suppkey || '(', 'aide_' || s_suppkey || '(')) AS hash FROM supplier")
def swept_files(spark, d):
    f, sweeps = _renames(spark, d)
    return delta.swept(f.select("file_id", "source"), sweeps).select("file_id", F.sha2("source", 256).alias("hash"))


@query(f"""SELECT s_suppkey AS file_id, sha256(regexp_replace({_sql_source()}, '(?s)class Supplier.*?helper_[0-9]+\\(a\\)', 'NEW_{{x}}' || chr(10) || 'two')) AS hash FROM supplier""")
def spliced_blocks(spark, d):
    f = _project(spark, d).select(F.col("k").alias("file_id"), "source")
    put = f.select("file_id", F.lit(5).alias("start_line"), F.lit(9).alias("end_line"), F.lit("NEW_{x}\ntwo").alias("content"))
    return delta.splice_blocks(blocks.line_table(f), put).select("file_id", F.sha2("source", 256).alias("hash"))


@query("SELECT s_suppkey::VARCHAR AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ok' ELSE 'GENERATION_INCOMPLETE' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'b' END AS missing, 'x' || s_suppkey || chr(10) || 'y' AS first FROM supplier")
def block_outcomes(spark, d):
    s = table(spark, d, "supplier")
    run = F.col("s_suppkey").cast("string").alias("run_id")
    second = F.when(F.col("s_suppkey") % 2 == 0, "===BLOCK: b===\nz\n===END BLOCK===").otherwise("===BLOCK: c===\nz\n===END BLOCK===")
    answers = s.select(run, F.concat(_filled("noise\n===BLOCK: a===\nx{k}\ny\n===END BLOCK===\n"), second).alias("response"))
    expected = s.select(run, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    return delta.block_outcomes(answers, expected).select("run_id", "status", "missing", F.col("blocks")["a"].alias("first"))


@query(f"WITH {_K} SELECT file AS path, CASE WHEN k % 2 = 0 THEN 'os' ELSE '' END AS orphaned FROM k")
def orphaned_imports(spark, d):
    f = _project(spark, d)
    after = F.when(F.col("k") % 2 == 0, F.array(F.lit("h"))).otherwise(F.array(F.lit("os")))
    return f.select("path", F.array_join(delta.orphaned_imports(F.array(F.lit("os"), F.lit("unused")), after, F.col("source")), ",").alias("orphaned"))


@query(f"WITH {_K} SELECT a.k AS file_id, 'shared' AS old_name, b.file AS caller_file FROM k a JOIN g b ON a.k <> b.k WHERE a.k % 50 = 0")
def cross_file_impact(spark, d):
    renames = _project(spark, d).where("k % 50 = 0").select(F.col("k").alias("file_id"), F.col("path").alias("file"), F.lit("shared").alias("old_name"))
    return delta.cross_file_impact(renames, _edges(spark, d), _symbols(spark, d)).select("file_id", "old_name", "caller_file")


@query("SELECT s_suppkey::VARCHAR AS run_id, n - 1 AS op_ord, 'DELETE' AS operation, 'f' || n AS symbol_name, n * 10 AS prefer_line FROM supplier, (SELECT unnest([1, 2]) AS n)")
def confirmed_deletes(spark, d):
    picks = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.lit("x.py").alias("file"), F.lit("function").alias("symbol_type"), F.explode(F.array(F.lit(2), F.lit(1))).alias("n"))
    return context.confirmed_deletes(picks.select("run_id", "file", "symbol_type", F.concat(F.lit("f"), F.col("n").cast("string")).alias("symbol_name"), (F.col("n") * 10).alias("start_line"))).select("run_id", "op_ord", "operation", "symbol_name", "prefer_line")


@query(f"WITH {_K} SELECT k AS request_id, file, 'total(self, a, *rest, key, **more), helper_' || k || '(x) @cache, shared(x)' AS names FROM g")
def remaining_names(spark, d):
    shown = _project(spark, d).select(F.col("k").alias("request_id"), F.col("path").alias("file"), _like_class())
    return context.remaining_names(code.metadata(_project(spark, d)), shown)


def _like_class():
    return F.concat(F.lit("Supplier"), F.col("k").cast("string")).alias("name")


@query(f"WITH {_K} SELECT file AS path, 'class Supplier' || k || '()' || chr(10) || 'function total(self, a, *rest, key, **more)' || chr(10) || 'function helper_' || k || '(x)' || chr(10) || 'function shared(x)' AS summary FROM g")
def file_summaries(spark, d):
    return context.file_summary(code.metadata(_project(spark, d)), _project(spark, d).where("k % 10 <> 7"))


@query(f"""WITH {_K} SELECT k AS request_id, file, 18 AS total_lines, 3 AS context_lines, 'helper_' || k AS shown, sha256('@cache' || chr(10) || 'async def helper_' || k || '(x: int) -> int:' || chr(10) || '    return shared(x) + os.getpid()') AS hash FROM g""")
def built_contexts(spark, d):
    f, s = _project(spark, d).where("k % 10 <> 7"), _symbols(spark, d)
    own = s.where("start_line = 12").select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("request_id"), "symbol_id", F.lit(1).alias("rank"))
    got = context.build(own, own.limit(0), s, f.select(F.col("k").alias("request_id"), "path", "source"))
    return got.select("request_id", "file", "total_lines", "context_lines", F.array_join("shown", ",").alias("shown"), F.sha2("context", 256).alias("hash"))


_EDITS = "e AS (SELECT s_suppkey AS k, 'pkg/mod' || s_suppkey || '.py' AS file, CASE WHEN s_suppkey % 7 = 0 THEN 'own' ELSE '.' END AS test_target FROM supplier)"


@query(f"WITH {_EDITS} SELECT k AS run_id, file, test_target, CASE WHEN test_target = 'own' THEN 'own' ELSE ['pkg/tests/test_mod' || k || '.py', 'tests/test_mod' || k || '.py', 'pkg'][(k % 3 + 1)::INT] END AS target FROM e")
def narrowed_test_target(spark, d):
    s = table(spark, d, "supplier")
    edits = s.select(F.col("s_suppkey").alias("run_id"), _filled("pkg/mod{k}.py").alias("file"), F.when(F.col("s_suppkey") % 7 == 0, "own").otherwise(".").alias("test_target"))
    there = F.when(F.col("s_suppkey") % 3 == 0, F.array(_filled("pkg/tests/test_mod{k}.py"), _filled("tests/test_mod{k}.py"))).when(F.col("s_suppkey") % 3 == 1, F.array(_filled("tests/test_mod{k}.py"))).otherwise(F.array(_filled("tests/test_other{k}.py")))
    return p.narrowed_test_target(edits, s.select(F.explode(there).alias("path")))


@query("""SELECT p_partkey, p_size % 3 = 0 AS goes, CASE WHEN p_size >= 20 THEN ['question', 'whole_file', NULL][(p_size % 3 + 1)::INT] END AS kind, p_size <= 10 AS overlaps, p_size BETWEEN 2 AND 9 AS contains, p_size % 2 = 0 AS within,
CASE WHEN p_size % 2 = 0 THEN 'tests/t' || p_size || '.py' END AS uncollected FROM part""")
def edit_predicates(spark, d):
    n = F.col("p_size")
    request = F.when(n % 3 == 0, "delete the notes file").otherwise("delete the other things")
    kind = F.get(F.array(F.lit("question"), F.lit("whole_file"), F.lit("rename")), (n % 3).cast("int"))
    file = F.concat(F.lit("tests/t"), n.cast("string"), F.lit(".py"))
    return table(spark, d, "part").select(
        "p_partkey", p.whole_file_delete(request, F.lit("docs/notes.md")).alias("goes"), p.accepted_kind(kind, F.when(n >= 20, 0.9).otherwise(0.5)).alias("kind"), p.spans_overlap(F.lit(1), F.lit(10), n, n + 5).alias("overlaps"),
        p.strictly_contains(F.lit(1), F.lit(10), F.when(n >= 2, n).otherwise(F.lit(1)), F.when(n >= 2, n + 1).otherwise(F.lit(10))).alias("contains"), p.path_within(F.when(n % 2 == 0, "/root/a/b.py").otherwise("/root/a/../../b.py"), F.lit("/root/a")).alias("within"),
        p.unrelated_collection_error(F.concat(F.lit("x ERROR collecting "), file, F.lit(" y")), F.when(n % 2 == 0, F.lit("src/a.py")).otherwise(file)).alias("uncollected"),
    )


@query("""SELECT p_partkey, rpad('REPLACE', 8, ' ') || rpad('f' || p_size, 40, ' ') || 'lines ' || p_size || '-' || (p_size + 2) AS line, CASE WHEN p_size % 2 = 0 THEN 'f(a, b) @c' ELSE 'f @c' END AS entry,
CASE p_size % 3 WHEN 0 THEN 'NEWNAME' WHEN 1 THEN 'NewName' ELSE 'newName' END AS cased, p_size % 2 = 0 AS preserved FROM part""")
def formatted_entries(spark, d):
    n = F.col("p_size")
    like = F.get(F.array(F.lit("OLD"), F.lit("Old"), F.lit("old")), (n % 3).cast("int"))
    names = lambda *x: F.array(*map(F.lit, x))
    return table(spark, d, "part").select(
        "p_partkey", p.operation_line(F.lit("REPLACE"), F.concat(F.lit("f"), n.cast("string")), F.lit(None).cast("string"), n, n + 2).alias("line"), p.symbol_entry(F.lit("f"), names("a", "b"), names("c"), n % 2 == 0).alias("entry"),
        t.match_case(F.lit("newName"), like).alias("cased"), t.words_preserved(F.lit("do not always stop"), F.when(n % 2 == 0, "not always stop").otherwise("always stop")).alias("preserved"),
    )


@query("""SELECT s_suppkey AS k, ['a', 'a', NULL][(s_suppkey % 3 + 1)::INT] AS defined, (s_suppkey % 4 IN (0, 1))::INT AS score FROM supplier""")
def definitions_and_structure(spark, d):
    n = F.col("s_suppkey")
    snippet = F.get(F.array(F.lit("@x\ndef a():\n    def b(): pass"), F.lit("export async function a() {\n}"), F.lit("x = 1")), (n % 3).cast("int"))
    source = F.get(F.array(F.lit("if isinstance(x, int):\n    pass"), F.lit("raise ValueError(x)"), F.lit("for x in y:\n    pass"), F.lit("z = 1")), (n % 4).cast("int"))
    request = F.get(F.array(F.lit("validate it"), F.lit("raise an error"), F.lit("sort it"), F.lit("validate it")), (n % 4).cast("int"))
    rows = table(spark, d, "supplier").select(n.alias("k"), delta.definition(snippet).alias("defined"), source.alias("source"), request.alias("text"))
    scores = retrieval.structural_scores(rows.select(F.col("k").alias("request_id"), "text"), rows.select(F.col("k").alias("request_id"), F.col("k").alias("symbol_id"), "source", F.lit("python").alias("language")))
    return rows.select("k", "defined").join(scores.select(F.col("symbol_id").alias("k"), "score"), "k", "left").select("k", "defined", F.coalesce(F.col("score").cast("int"), F.lit(0)).alias("score"))


#: A source with each construct in its code, or in a string and a comment only.
_TREE = """import math


@cache{k}
def first_{k}(a, *, b=None):
    text = 'isinstance({name}, int) math.sqrt(2)'  # raise ValueError({k}); for x in y: ...
    return pick(a, {twice}, {k})


class Holder{k}:
    async def second(self, rows):
        for row in rows:
            {call}
"""


@query("""WITH k AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m FROM supplier), p AS (SELECT * FROM (VALUES ('isinstance($X, ...)', 1), ('raise $E(...)', 2), ('math.$F(...)', 3)) p(pattern, m))
SELECT k, pattern, 13 AS line FROM k JOIN p USING (m) UNION ALL SELECT k, 'for $X in $Y: ...', 12 FROM k UNION ALL SELECT k, 'async def $F(...): ...', 11 FROM k UNION ALL SELECT k, '@$D' || chr(10) || 'def $F(...): ...', 5 FROM k
UNION ALL SELECT k, 'pick($A, $A, ...)', 7 FROM k WHERE k % 3 = 0 UNION ALL SELECT k, 'pick(..., 7)', 7 FROM k WHERE k = 7 UNION ALL SELECT k, 'class $C: <... isinstance(...) ...>', 10 FROM k WHERE m = 1""")
def tree_matches(spark, d):
    """Patterns over the node table of a source a supplier."""
    n = F.col("s_suppkey")
    call = F.get(F.array(F.lit("pass"), F.lit("isinstance(row, int)"), F.lit("raise errors.Bad(row)"), F.lit("math.sin(row)")), (n % 4).cast("int"))
    source = F.replace(F.replace(_filled(_TREE), F.lit("{twice}"), F.when(n % 3 == 0, "a").otherwise("b")), F.lit("{call}"), call)
    tree = cut(tree_patterns.nodes(table(spark, d, "supplier").select(n.alias("source_id"), source.alias("source"))))
    asked = ["isinstance($X, ...)", "raise $E(...)", "math.$F(...)", "for $X in $Y: ...", "async def $F(...): ...", "@$D\ndef $F(...): ...", "pick($A, $A, ...)", "pick(..., 7)", "class $C: <... isinstance(...) ...>"]
    return tree_patterns.matches(tree, {p: p for p in asked}).select(F.col("source_id").alias("k"), "pattern", "line")


@query(f"WITH {_SYMBOLS} SELECT 'p' || k % 3 AS project_id, count(DISTINCT file) AS n_files, count(*) AS n_symbols FROM s GROUP BY 1")
def project_symbol_counts(spark, d):
    m = code.metadata(_project(spark, d))
    return versions.symbol_counts(m.withColumn("project_id", F.concat(F.lit("p"), (F.regexp_extract("file", r"(\d+)", 1).cast("long") % 3).cast("string"))))


@query("""SELECT 'p' AS project_id, 'benchmarks/r' || s_suppkey AS key, '{"project_id":"p","run_id":"r' || s_suppkey || '","status":"ok"}' AS body FROM supplier UNION ALL
SELECT 'p', 'deltas/r' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '-attempt2' ELSE '' END, '{}' FROM supplier WHERE s_suppkey % 3 <> 0""")
def run_records(spark, d):
    s = table(spark, d, "supplier").withColumn("run_id", _filled("r{k}"))
    runs = s.select(F.lit("p").alias("project_id"), "run_id", F.lit("ok").alias("status"))
    deltas = s.select(F.lit("p").alias("project_id"), "run_id", F.when(F.col("s_suppkey") % 2 == 0, 2).alias("attempt"), F.when(F.col("s_suppkey") % 3 != 0, "{}").alias("body"))
    return versions.run_records(runs, deltas)


@query("""SELECT conv_id AS run_id, n::INT AS line_no, rpad(['status', 'strategy', 'version_id', 'change_ratio', 'context_lines', 'total_lines', 'n_ops', 'input_tokens', 'output_tokens', 'cost_usd', 'latency_ms', 'retry_count'][n + 1], 16, ' ') ||
coalesce(['ok', 'EDIT', NULL, '0.5', '3', '9', '1', turns::VARCHAR, '7', '0.25', '10', '0'][n + 1], '-') AS line FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), (SELECT unnest(range(12)) AS n)""")
def run_summaries(spark, d):
    runs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("input_tokens"))
    fixed = {"status": "ok", "strategy": "EDIT", "version_id": None, "change_ratio": 0.5, "context_lines": 3, "total_lines": 9, "n_ops": 1, "output_tokens": 7, "cost_usd": 0.25, "latency_ms": 10, "retry_count": 0}
    return context.run_summary(runs.select("run_id", "input_tokens", *[F.lit(v).alias(c) for c, v in fixed.items()]))


@query("""SELECT 'gpt-5.4' AS model, 0.0025::DOUBLE AS input, 0.015::DOUBLE AS output, 0.00025::DOUBLE AS cached UNION ALL SELECT 'openai/gpt-5.4', 0.001, 0.002, 0.001
UNION ALL SELECT role, count(*) / 1000, count(*) / 500, CASE WHEN count(*) % 2 = 0 THEN count(*) / 1000 ELSE 0.5 END FROM conversations GROUP BY 1""")
def price_override(spark, d):
    """Prices of the roles of conversations, read from a JSON text made of their turns, over the built-in ones."""
    n = F.count("*")
    prices = F.when(n % 2 == 0, F.array(n / 1000, n / 500)).otherwise(F.array(n / 1000, n / 500, F.lit(0.5)))
    by_role = table(spark, d, "conversations").groupBy("role").agg(prices.alias("prices")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("role", "prices")))).alias("j"))
    given = '{"openai/gpt-5.4": [0.001, 0.002], "short": [1], ' + by_role.first()["j"].lstrip("{")  # a price a role
    return versions.price_table(spark, given)


@query("""SELECT conv_id, turn, '{"turn":' || turn || '}' AS body FROM conversations""")
def parsed_frames(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    frames = c.withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct("turn")), F.lit("\n\n")))
    buffers = frames.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), "").alias("buffer"))
    # every buffer goes on with a frame that has not come to its end
    got = streams.parse_frames(buffers.withColumn("buffer", F.concat("buffer", F.lit('data: {"turn":1'))))
    return got.select("conv_id", F.from_json("body", "turn long")["turn"].alias("turn"), "body")


@query("""SELECT conv_id, pos::INT AS pos, '{"type":"' || CASE WHEN last THEN 'done' ELSE 'step' END || '","tag":"é' || turn || '"}' AS body, CASE WHEN last THEN pos ELSE pos + 1 END AS n_steps,
  'é' || CASE WHEN last THEN lag(turn) OVER (PARTITION BY conv_id ORDER BY pos) ELSE turn END AS last_tag, last AS done
FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations)""")
def frames_from_stream(spark, d):
    """Each conversation's events as bytes in chunks of 17, which come in three batches and in no order."""
    at, c = _scratch(spark), table(spark, d, "conversations").select("conv_id", "turn")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    events = c.withColumn("type", F.when(n == 1, "done").otherwise("step")).withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct("type", F.concat(F.lit("é"), F.col("turn").cast("string")).alias("tag"))), F.lit("\n\n")))
    bodies = events.groupBy("conv_id").agg(F.encode(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), ""), "utf-8").alias("bytes"))
    seq = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("bytes") / 17).cast("int"))).alias("seq")
    chunks = bodies.select("conv_id", "bytes", seq).select("conv_id", "seq", F.substring("bytes", F.col("seq") * 17 + 1, F.lit(17)).alias("chunk"))
    chunks.repartition(3, "seq").write.parquet(f"{at}/chunks")
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, streams.ROCKS)
    try:
        frames = streams.frames_stream(streams.read_events(spark, f"{at}/chunks"), "conv_id")
        run = frames.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/frames")
    finally:
        spark.conf.set(key, before)
    run.awaitTermination()
    return spark.read.schema(frames.schema).parquet(f"{at}/frames")


@query("""SELECT item_id AS request_id, CASE WHEN item_id % 2 = 0 THEN 'answer ' || item_id END AS answer FROM benchmark""")
def answered_prompts(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    prompts = b.select("request_id", context.edit_prompt(F.concat(F.col("text"), F.col("request_id").cast("string")), F.lit("a.py"), F.lit("code")).alias("prompt"))
    answers = prompts.where("request_id % 2 = 0").select(F.sha2("prompt", 256).alias("hash"), F.concat(F.lit("answer "), F.col("request_id").cast("string")).alias("answer"))
    return context.responses(prompts, answers).select("request_id", "answer")


@query("""SELECT item_id AS request_id, sha256('File:' || chr(10) || 'a.py' || chr(10) || chr(10) || 'Request:' || chr(10) || text || chr(10) || chr(10) || 'Code:' || chr(10) || 'x = 1') AS edit, sha256('Request:' || chr(10) || text || chr(10) || chr(10) || 'Code:' || chr(10) || 'x' || chr(10) || chr(10) || 'Previous answer:' || chr(10) || 'y' || chr(10) || chr(10) || 'Failure:' || chr(10) || substr(repeat(text, 20), 1, 2000)) AS repair,
sha256('Request:' || chr(10) || text || chr(10) || chr(10) || 'Before:' || chr(10) || 'b' || chr(10) || chr(10) || 'Block:' || chr(10) || '===BLOCK: n===' || chr(10) || 'x' || chr(10) || '===END BLOCK===') AS block, sha256('Question:' || chr(10) || text || chr(10) || chr(10) || 'Code:' || chr(10) || 'x') AS question FROM benchmark""")
def prompts(spark, d):
    text, one = F.col("text"), lambda x: F.lit(x)
    made = {"edit": context.edit_prompt(text, one("a.py"), one("x = 1")), "repair": context.repair_prompt(text, one("x"), F.repeat(text, 20), one("y")), "block": context.block_prompt(text, one("n"), one("x"), one("b"), one("")), "question": context.question_prompt(text, one("x"))}
    return table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), *[F.sha2(c, 256).alias(n) for n, c in made.items()])


@query(f"WITH {_K} SELECT file AS path, 200 AS status, {_sql_source().replace('s_suppkey', 'k').replace('s_name', 'name')} AS source FROM k WHERE k = 1")
def read_file(spark, d):
    return files.read_file(_project(spark, d).select("path", "source"), F.lit("pkg/mod1.py"))


@query(f"WITH {_K} SELECT regexp_replace(file, '[^A-Za-z0-9_.-]+', '-', 'g') || '-' || substr(sha256(file), 1, 8) AS key, substr(sha256(file), 1, 16) || '_python_' || substr(sha256(name), 1, 12) AS graph_key FROM k")
def cache_keys(spark, d):
    s = table(spark, d, "supplier").withColumn("path", _filled("pkg/mod{k}.py"))
    return s.select(files.cache_key(F.col("path"), F.col("path")).alias("key"), files.graph_cache_key(F.col("path"), F.lit("python"), F.sha2("s_name", 256)).alias("graph_key"))




# --- sources and sinks, through a folder of the session's own ---------------------------------------------------------

def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/lodeline-scratch/{uuid.uuid4().hex}"



@query(f"WITH {_BM25} SELECT request_id, symbol_id, round(score, 4) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_indexed_topk(spark, d):
    """The ranking of bm25_topk from a stored index, after the documents of ids divisible by 5 came in with another text and were put right."""
    rows, index = catalog.symbols(spark, d), PostingIndex(spark, _scratch(spark), buckets=8, span=256)
    changed = F.col("symbol_id") % 5 == 0
    stale = rows.where(changed).withColumn("source", F.concat(F.lit("stale words "), F.reverse("source")))
    index.add(rows.where(~changed).unionByName(stale))
    index.add(rows.where(changed), gone=stale)
    return index.ranking(catalog.requests(spark, d), k=10).withColumn("score", F.round("score", 4))


@query("SELECT s_suppkey AS k, 'text' AS language, 'source of ' || s_name || chr(10) AS source FROM supplier")
def scanned_files(spark, d):
    at = _scratch(spark)
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), _filled("source of {name}").alias("value"))
    if not files.write(spark, at, rows.select(F.concat(F.lit("k="), F.col("k").cast("string"), F.lit("/one.txt")).alias("path"), F.concat("value", F.lit("\n")).alias("source"))):
        # by a given number the files are dealt to all tasks, which put them in their places themselves
        dealt = rows.repartition(spark.sparkContext.defaultParallelism, "k")
        dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("k").text(at)
    got = files.scan(spark, at).where("path like 'k=%.txt'")
    return got.select(F.regexp_extract("path", r"^k=(\d+)/", 1).cast("long").alias("k"), "language", "source")


@query("SELECT 'a/' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'second' ELSE s_name END AS body FROM supplier")
def stored_objects(spark, d):
    store, rows = files.Store(spark, _scratch(spark)), table(spark, d, "supplier").select("s_suppkey", _filled("a/{k}").alias("key"), F.col("s_name").alias("body"))
    store.put(rows.select("key", "body"), "objects")
    store.put(rows.where("s_suppkey % 2 = 0").select("key", F.lit("second").alias("body")), "objects")
    return store.list("objects", "a/").join(store.all("objects"), "key").select("key", "body")


@query("SELECT p_brand AS project_id, p_brand || ':' || count(*) AS body FROM part GROUP BY 1")
def kept_runs(spark, d):
    at, rows = _scratch(spark), table(spark, d, "part").groupBy(F.col("p_brand").alias("project_id")).agg(F.concat_ws(":", F.first("p_brand"), F.count("*").cast("string")).alias("body"))
    versions.persist_runs(rows.select("project_id", F.lit("benchmarks/r").alias("key"), F.lit("old").alias("body")), at)
    versions.persist_runs(rows.select("project_id", F.lit("benchmarks/r").alias("key"), "body"), at)
    return versions.persisted_runs(spark, at).select("project_id", "body")


@query("SELECT DISTINCT sha256(text) AS hash, length(text)::DOUBLE AS size, doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AS fresh FROM documents")
def cached_embeddings(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.array(F.length("text").cast("double")).alias("embedding")).distinct()
    every, fresh = retrieval.embeddings(docs, cache, lambda t_: t_.select("hash", F.array(F.length("text").cast("double")).alias("embedding")))
    return every.join(fresh.select("hash", F.lit(True).alias("fresh")), "hash", "left").select("hash", F.col("embedding")[0].alias("size"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


# --- the engine's front door -----------------------------------------------------------------------------------------

def _engine(spark, d):
    f = _project(spark, d).select("path", "source").unionByName(_notes(spark, d).select("path", "source"))
    return Engine(spark, f)


@query("""SELECT s_suppkey AS request_id, 'pkg/mod' || s_suppkey || '.py' AS file, CASE WHEN s_suppkey % 10 = 7 THEN ['structured_edit', 'structured_edit', 'question', 'structured_edit'][(s_suppkey % 4 + 1)::INT]
ELSE ['rename', 'delete', 'question', 'structured_edit'][(s_suppkey % 4 + 1)::INT] END AS route FROM supplier""")
def engine_routes(spark, d):
    k = F.col("s_suppkey")
    words = F.get(F.array(_filled("Rename helper_{k} to aide_{k}"), _filled("delete Supplier{k}"), F.lit("what is this"), F.lit("speed it up")), (k % 4).cast("int"))
    asked = table(spark, d, "supplier").select(k.alias("request_id"), words.alias("text"), _filled("pkg/mod{k}.py").alias("file"), F.when(k % 4 == 2, "question").alias("kind"), F.lit(0.9).alias("kind_confidence"))
    e = _engine(spark, d)
    return e.routes(asked).select("request_id", "file", "route")


@query("""SELECT s_suppkey AS request_id, ['DELETE_FILE', 'CONVERT', 'ANSWERED', 'EDIT'][(s_suppkey % 4 + 1)::INT] AS outcome, CASE WHEN s_suppkey % 4 = 1 THEN 'pkg/mod' || s_suppkey || '.go' END AS target, CASE WHEN s_suppkey % 4 = 2 THEN 'it is ' || s_suppkey END AS answer FROM supplier""")
def engine_outcomes(spark, d):
    k = F.col("s_suppkey")
    words = F.get(F.array(_filled("delete file {k}"), F.lit("port it"), F.lit("what is it"), F.lit("speed it up")), (k % 4).cast("int"))
    file = F.when(k % 4 == 0, _filled("notes/{k}.md")).otherwise(_filled("pkg/mod{k}.py"))
    kind = F.when(k % 4 == 1, "whole_file").when(k % 4 == 2, "question")
    asked = table(spark, d, "supplier").select(k.alias("request_id"), words.alias("text"), file.alias("file"), kind.alias("kind"), F.lit(0.9).alias("kind_confidence"), F.when(k % 4 == 1, "go").alias("extension"))
    answers = table(spark, d, "supplier").where("s_suppkey % 4 = 2").select(k.alias("request_id"), _filled("it is {k}").alias("answer"))
    return _engine(spark, d).outcomes(asked, answers).select("request_id", "outcome", "target", "answer")


@query(f"""WITH {_K} SELECT k::VARCHAR AS run_id, CASE WHEN k % 4 = 1 THEN 'NO_OP' WHEN k % 10 = 7 THEN 'REFERENCE_ERROR' ELSE ['ok', '', 'REFERENCE_ERROR', 'SYNTAX_ERROR'][(k % 4 + 1)::INT] END AS status,
CASE WHEN k % 4 = 0 AND k % 10 <> 7 THEN sha256(replace(replace(replace({_sql_source().replace('s_suppkey', 'k').replace('s_name', 'name')}, '@cache' || chr(10) || 'async def helper_' || k || '(x: int) -> int:' || chr(10) || '    return shared(x) + os.getpid()',
'@cache' || chr(10) || 'def aide_' || k || '(x):' || chr(10) || '    return 1'), 'helper_' || k, 'aide_' || k), 'zzz', 'zzz')) END AS hash FROM k""")
def engine_edits(spark, d):
    k = F.col("s_suppkey")
    op = lambda body: F.concat(F.lit('{"operations":['), body, F.lit("]}"))
    one = lambda name, content: F.concat(F.lit('{"operation":"REPLACE","target":{"symbol_type":"function","symbol_name":"'), name, F.lit('"},"content":'), content, F.lit("}"))
    good = one(_filled("helper_{k}"), F.concat(F.lit('"@cache\\ndef aide_'), k.cast("string"), F.lit('(x):\\n    return 1"')))
    body = F.get(F.array(op(good), F.lit('{"operations":[]}'), op(one(F.lit("nothing"), F.lit('"x"'))), op(one(F.lit("shared"), F.lit('"def shared(:"')))), (k % 4).cast("int"))
    deltas = table(spark, d, "supplier").select(k.cast("string").alias("run_id"), _filled("pkg/mod{k}.py").alias("file"), body.alias("body"))
    got = _engine(spark, d).edit(deltas)
    return got.select("run_id", "status", F.when(F.col("status") == "ok", F.sha2("source", 256)).alias("hash"))


@query("""SELECT s_suppkey AS request_id, ['EXISTS', 'ok', 'SYNTAX_ERROR', 'BINARY'][(s_suppkey % 4 + 1)::INT] AS status FROM supplier""")
def engine_creates(spark, d):
    k = F.col("s_suppkey")
    path = F.get(F.array(_filled("pkg/mod{k}.py"), _filled("new/m{k}.py"), _filled("new/m{k}.py"), _filled("new/m{k}.xlsx")), (k % 4).cast("int"))
    asked = table(spark, d, "supplier").select(k.alias("request_id"), path.alias("path"), F.when(k % 4 == 2, "def (").otherwise("```python\nx = 1\n```").alias("content"))
    return _engine(spark, d).plan_create(asked).select("request_id", "status")


@query(f"WITH {_K} SELECT k AS request_id, file, 'helper_' || k AS name FROM g")
def engine_finds(spark, d):
    asked = table(spark, d, "supplier").where("s_suppkey % 10 <> 7").select(F.col("s_suppkey").alias("request_id"), _filled("change helper_{k} now").alias("text"))
    e = _engine(spark, d)
    return targets.locate_candidates(asked, e.symbols.withColumn("ordinal", F.col("ordinal").cast("long")), k=1).join(e.symbols.select("symbol_id", "file", "name"), "symbol_id").select("request_id", "file", "name")


@query(f"WITH {_K} SELECT k AS request_id, file, 'helper_' || k AS name, 'shared' AS calls, 2 AS called_by_count, file || ':9' AS sites, 5 AS n_rankings FROM g")
def engine_finds_by_all_signals(spark, d):
    """Engine.find with words, BM25, vectors, call edges, structure and call sites: the best symbol and what is known of it."""
    asked = table(spark, d, "supplier").where("s_suppkey % 10 <> 7").select(F.col("s_suppkey").alias("request_id"), _filled("iterate: change helper_{k} now").alias("text"))
    e, vectors = _engine(spark, d), table(spark, d, "embeddings").select("vec_id", "embedding")
    # a request and the symbols of its supplier's file share a vector
    stored = e.symbols.select("symbol_id", "ordinal", (F.regexp_extract("file", r"(\d+)", 1).cast("long") - 1).alias("vec_id")).join(vectors, "vec_id")
    near = retrieval.vector_ranking(asked.withColumn("vec_id", F.col("request_id") - 1).join(vectors, "vec_id"), stored, 15)
    got = e.find(asked, 1, near)
    sites = F.array_join(F.transform("call_sites", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ",")
    return got.select("request_id", "file", "name", F.array_join("calls", ",").alias("calls"), "called_by_count", sites.alias("sites"), F.regexp_extract("evidence", r"of (\d+) rankings", 1).cast("int").alias("n_rankings"))


# --- diffs, HTML and close names -------------------------------------------------------------------------------------

def _two_versions(spark, d):
    before = _filled("one\ntwo {k}\nthree\nfour\nfive\nsix\nseven\neight\nnine\n")
    after = _filled("one\n2 {k}\nmore\nthree\nfour\nfive\nsix\nseven\neight\nnine\n")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), _filled("x{k}").alias("path"), before.alias("before"), after.alias("after"))


@query("""SELECT s_suppkey AS file_id, round(3.0 / 9, 6)::DOUBLE AS change_ratio, replace(replace('--- a/x{k}~+++ b/x{k}~@@ -1,5 +1,6 @@~ one~-two {k}~+2 {k}~+more~ three~ four~ five~', '{k}', s_suppkey::VARCHAR), '~', chr(10)) AS diff FROM supplier""")
def diff_of_versions(spark, d):
    return delta.diffs(_two_versions(spark, d)).select("file_id", F.round("change_ratio", 6).alias("change_ratio"), "diff")


@query("""SELECT s_suppkey AS file_id, 1 AS hunk, unnest(['ctx', 'del', 'add', 'add', 'ctx', 'ctx', 'ctx']) AS kind, unnest(['one', 'two ' || s_suppkey, '2 ' || s_suppkey, 'more', 'three', 'four', 'five']) AS text, unnest([1, 2, 2, 3, 4, 5, 6]) AS new_line FROM supplier""")
def diff_view(spark, d):
    return delta.parse_diff(delta.diffs(_two_versions(spark, d))).select("file_id", "hunk", "kind", "text", "new_line")


@query("SELECT s_suppkey AS file_id, 2 AS new_line, 'two ' || s_suppkey AS text FROM supplier")
def ghost_blocks(spark, d):
    return delta.ghost_blocks(delta.parse_diff(delta.diffs(_two_versions(spark, d))))


@query("""SELECT s_suppkey AS file_id, unnest([1, 2, 3]) AS ordinal, unnest(['header#h' || s_suppkey, 'main.big', 'br']) AS name, unnest([2, 3, 6]) AS start_line, unnest([2, 5, 7]) AS end_line FROM supplier""")
def page_blocks(spark, d):
    html = _filled('<html><body>\n<header id="h{k}">a</header>\n<main class="big wide">\n<p>x</p>\n</main>\n<br>\n</body></html>')
    return pages.html_blocks(table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), html.alias("source")))


@query("SELECT s_suppkey AS request_id, s_suppkey AS symbol_id, 'fuzzy' AS method FROM supplier")
def close_delete_targets(spark, d):
    name = F.concat(F.lit("n"), F.substring(F.sha2(F.col("s_suppkey").cast("string"), 256), 1, 20))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), name.alias("name"))
    typed = F.concat(F.lit("delete "), F.substring("name", 1, 10), F.lit("qq"), F.substr("name", F.lit(13)))
    return targets.delete_candidates(s.select("request_id", typed.alias("text")), s.select(F.col("request_id").alias("symbol_id"), "name", F.lit("function").alias("symbol_type")))


@query("""SELECT s_suppkey AS file_id, 'load' || s_suppkey || 'BifrostClient() + BIFROST_KEY' || s_suppkey || ' and bifrost_key' AS renamed FROM supplier""")
def parts_renamed(spark, d):
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_id"), _filled("load{k}OpenAIClient() + OPEN_AI_KEY{k} and open_ai_key").alias("source"), F.lit("openai").alias("old_name"), F.lit("bifrost").alias("new_name"))
    return delta.rename(f)


@query("SELECT s_suppkey AS k, to_base64(encode(s_name)) AS packed, s_name AS unpacked FROM supplier")
def binary_codec(spark, d):
    packed = files.encode_binary(F.encode("s_name", "utf-8"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), packed.alias("packed"), F.decode(files.decode_binary(packed), "utf-8").alias("unpacked"))


@query("SELECT s_suppkey AS key, s_suppkey % 2 = 0 AS delegates, CASE WHEN s_suppkey % 3 = 0 THEN 'AMBIGUOUS' WHEN s_suppkey % 2 = 0 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS status, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0 THEN s_suppkey * 2 END AS symbol_id FROM supplier")
def delegates(spark, d):
    """A function of two lines that calls the class's method of its name is a delegate; the method is meant."""
    k = F.col("s_suppkey")
    body = F.when(k % 2 == 0, "    return Tool.go(x)").otherwise("    return x")
    lines = F.array(F.lit("class Tool:"), F.lit("    def go(self, x):"), F.lit("        return x"), F.lit("def go(x):"), body)
    s = table(spark, d, "supplier").withColumn("lines", lines).withColumn("file", _filled("m{k}.py"))
    of = lambda i, start, end, indent, parent: s.select((k * 2 + i).alias("symbol_id"), "file", F.lit("function").alias("symbol_type"), F.lit("go").alias("name"), F.lit(start).alias("start_line"), F.lit(end).alias("end_line"), F.lit(indent).alias("indent"), F.lit(parent).cast("string").alias("parent_class"), "lines")
    pool = of(0, 2, 3, 4, "Tool").unionByName(of(1, 4, 5, 0, None))
    wanted = s.select(k.alias("key"), "file", F.lit("function").alias("symbol_type"), F.lit("go").alias("symbol_name"), F.lit(None).cast("int").alias("prefer_line"), (k % 3 != 0).alias("allow_delegate"))
    found = targets.find_symbol(wanted, pool)
    short = s.select(k.alias("key"), p.trivial_delegate(F.col("lines"), F.lit(4), F.lit(5), F.lit(0), F.lit("Tool"), F.lit("go")).alias("delegates"))
    return found.join(short, "key").select("key", "delegates", "status", "symbol_id")


@query("SELECT s_suppkey AS request_id, s_suppkey AS symbol_id, 1 AS rank FROM supplier UNION ALL SELECT s_suppkey, 1000000, 2 FROM supplier")
def hybrid_reranked(spark, d):
    """The candidate that BM25 finds as well comes first."""
    s = table(spark, d, "supplier")
    own = s.select(F.col("s_suppkey").alias("symbol_id"), F.col("s_suppkey").alias("ordinal"), _filled("unique{k}word").alias("name"), F.lit("").alias("docstring_first_line"), F.lit("").alias("source"))
    pool = own.unionByName(spark.createDataFrame([(1_000_000, 1_000_000, "other", "", "")], own.schema))
    asked = s.select(F.col("s_suppkey").alias("request_id"), _filled("find unique{k}word").alias("text"))
    first = s.select(F.col("s_suppkey").alias("request_id"), F.lit(1_000_000).cast("long").alias("symbol_id"), F.lit(2.0).alias("score"), F.lit(1).alias("rank"))
    second = s.select(F.col("s_suppkey").alias("request_id"), F.col("s_suppkey").alias("symbol_id"), F.lit(1.0).alias("score"), F.lit(2).alias("rank"))
    return retrieval.hybrid_rerank(asked, pool, first.unionByName(second)).select("request_id", "symbol_id", "rank")

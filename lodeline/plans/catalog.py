"""Queries over the driver's tables and their SQL counterparts.

`documents` play symbols or files, `benchmark` requests, `embeddings` vectors, `pages` HTML files, `conversations` chats and
model calls, `events` run events; suppliers and parts make a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import predicates as p
from lodeline.functions import text as t
from lodeline.operators import blocks, delta, graph, retrieval, targets, versions
from lodeline.sources import code, files, pages
from lodeline.streaming import events as streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _words(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}),'[a-z0-9]+')), lambda x: NOT list_contains({_list(t.STOP_WORDS)}, x))"


def _content_words(c: str) -> str:
    return f"list_filter({_words(c)}, lambda x: length(x) >= 3 AND NOT list_contains({_list(t.LEADING_VERBS + t.TYPE_WORDS)}, x))"


def _bm25(c: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({c},'([a-z0-9])([A-Z])','\1 \2','g')),'[a-z0-9]+')"


LINES = "list_filter(string_split(text, chr(10)), lambda x, i: NOT (x = '' AND i = len(string_split(text, chr(10)))))"
SYM = "sym AS (SELECT doc_id AS symbol_id, doc_id AS ordinal, source AS file, regexp_extract(text,'[A-Za-z_][A-Za-z0-9_]*') AS name, split_part(text, chr(10), 1) AS doc, text AS source FROM documents)"
REQ = "req AS (SELECT item_id AS request_id, text FROM benchmark)"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("symbol_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("file"), F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0).alias("name"), F.lit("function").alias("symbol_type"),
        F.lit(1).alias("start_line"), F.size(t.split_lines(F.col("text"))).alias("end_line"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("docstring_first_line"), F.col("text").alias("source"), F.lit("text").alias("language"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text")


# --- retrieval -------------------------------------------------------------------------------------------------------

_DOC = "concat_ws(' ', nullif(replace(name,'_',' '),''), nullif(doc,''), nullif(source,''))"
_BM25 = f"""{SYM}, {REQ},
dt AS (SELECT symbol_id, ordinal, {_bm25(_DOC)} AS toks FROM sym),
corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
tf AS (SELECT symbol_id, ordinal, dl, w, count(*) AS tf FROM (SELECT symbol_id, ordinal, len(toks) AS dl, unnest(toks) AS w FROM dt) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
raw AS (SELECT w, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, corpus),
idf AS (SELECT w, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT request_id, w, count(*) AS qf FROM (SELECT request_id, unnest({_bm25('text')}) AS w FROM req) GROUP BY ALL),
bm AS (SELECT request_id, symbol_id, ordinal, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN q USING (w) JOIN idf USING (w), corpus GROUP BY ALL HAVING score > 0),
bmr AS (SELECT request_id, symbol_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ordinal, symbol_id) AS rank FROM bm)"""


@query(f"WITH {_BM25} SELECT request_id, symbol_id, round(score, 4) AS score, rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieval.bm25_ranking(requests(spark, d), symbols(spark, d), 10).withColumn("score", F.round("score", 4))


@query(f"WITH {_BM25} SELECT w AS word, df, round(idf, 6) AS idf, n, round(avgdl, 6) AS avgdl FROM idf, corpus")
def bm25_stats(spark, d):
    corpus, idf = retrieval.bm25_stats(symbols(spark, d))
    return idf.crossJoin(F.broadcast(corpus)).select("word", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


_SYMBOL = f"""sw AS (SELECT symbol_id, ordinal, lower(name) AS low, {_words('name')} AS nw, {_words('doc')} AS dw FROM sym),
rw AS (SELECT request_id, unnest({_words('text')}) AS w FROM req),
rt AS (SELECT DISTINCT request_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM req),
hits AS (SELECT request_id, symbol_id, ordinal, 5.0 AS s FROM sw JOIN rt ON low = w
 UNION ALL SELECT request_id, symbol_id, ordinal, 1.0 FROM (SELECT symbol_id, ordinal, unnest(nw) AS w FROM sw) JOIN rw USING (w)
 UNION ALL SELECT request_id, symbol_id, ordinal, 1.0 FROM (SELECT symbol_id, ordinal, unnest(dw) AS w FROM sw) JOIN rw USING (w)),
sr AS (SELECT request_id, symbol_id, CAST(sum(s) AS DOUBLE) AS score, row_number() OVER (PARTITION BY request_id ORDER BY sum(s) DESC, ordinal, symbol_id) AS rank FROM hits GROUP BY request_id, symbol_id, ordinal)"""


@query(f"WITH {SYM}, {REQ}, {_SYMBOL} SELECT request_id, symbol_id, score, rank FROM sr WHERE rank <= 10")
def word_overlap_rank(spark, d):
    return retrieval.symbol_ranking(requests(spark, d), symbols(spark, d), 10)


@query(f"""WITH {SYM}, {REQ}, b AS (SELECT symbol_id, ordinal, unnest({_words('source')}) AS w FROM sym), q AS (SELECT request_id, unnest({_content_words('text')}) AS w FROM req),
s AS (SELECT request_id, symbol_id, ordinal, CAST(count(*) AS DOUBLE) AS score FROM b JOIN q USING (w) GROUP BY ALL)
SELECT request_id, symbol_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ordinal, symbol_id) AS rank FROM s) WHERE rank <= 3""")
def content_word_body_hits(spark, d):
    return retrieval.body_ranking(requests(spark, d), symbols(spark, d), 3, drop_containers=False)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT q.vec_id AS request_id, u.vec_id AS symbol_id, round(list_dot_product(q.e, u.e), 9) AS score FROM u q JOIN u ON q.vec_id <> u.vec_id)
SELECT request_id, symbol_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, symbol_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("symbol_id"), F.col("vec_id").alias("ordinal"), "embedding")
    asked = v.select(F.col("symbol_id").alias("request_id"), "embedding")
    return retrieval.vector_ranking(asked, v, 10, exclude_self=True).withColumn("score", F.round("score", 4))


_FUSED = f"""f AS (SELECT request_id, symbol_id, rank, 0 AS r FROM sr WHERE rank <= 15 UNION ALL SELECT request_id, symbol_id, rank, 1 FROM bmr WHERE rank <= 15),
fs AS (SELECT request_id, symbol_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(r * 1000000 + rank) AS seen FROM f GROUP BY ALL),
fused AS (SELECT request_id, symbol_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, seen, symbol_id) AS rank FROM fs)"""


def _fused(spark, d, k):
    s, r = symbols(spark, d), requests(spark, d)
    return retrieval.fuse([retrieval.symbol_ranking(r, s, 15), retrieval.bm25_ranking(r, s, 15)], k)


@query(f"WITH {_BM25}, {_SYMBOL}, {_FUSED} SELECT request_id, symbol_id, round(score, 6) AS score, rank FROM fused WHERE rank <= 5")
def rrf_fusion(spark, d):
    return _fused(spark, d, 5).select("request_id", "symbol_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_BM25}, {_SYMBOL}, {_FUSED}, m AS (SELECT request_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second FROM fused WHERE rank <= 5 GROUP BY 1)
SELECT request_id, CASE WHEN top <= 0 THEN 0.0 WHEN second IS NULL THEN 0.9 ELSE round(least(0.5 + 0.5 * (top - second) / top, 0.99), 2) END::DOUBLE AS confidence FROM m""")
def retrieval_confidence(spark, d):
    return retrieval.confidence(_fused(spark, d, 5))


@query(f"""WITH {_BM25}, {_SYMBOL}, {_FUSED.replace('<= 15', '<= 5')} SELECT request_id, symbol_id, file, round(score, 6) AS score FROM fused JOIN sym USING (symbol_id) WHERE rank = 1""")
def locate_best_doc(spark, d):
    return retrieval.locate_best_file(requests(spark, d), symbols(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {_BM25}, {_SYMBOL}, {_FUSED}, top AS (SELECT * FROM fused WHERE rank <= 5), m AS (SELECT request_id, max(score) FILTER (rank = 1) AS first, max(score) FILTER (rank = 2) AS second FROM top GROUP BY 1),
c AS (SELECT request_id, CASE WHEN first <= 0 THEN 0.0 WHEN second IS NULL THEN 0.9 ELSE round(least(0.5 + 0.5 * (first - second) / first, 0.99), 2) END::DOUBLE AS confidence FROM m)
SELECT request_id, rank, symbol_id, file, name, round(score, 4) AS score, confidence, confidence < 0.6 AS use_call_graph, CASE WHEN regexp_matches(concat_ws(' ', name, source), '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(p.HIGH_RISK_WORDS)})([^\\p{{L}}\\p{{N}}_]|$)') THEN 'HIGH' WHEN starts_with(name, '_') THEN 'LOW' ELSE 'MEDIUM' END AS risk
FROM top JOIN c USING (request_id) JOIN sym USING (symbol_id)""")
def locate_full(spark, d):
    got = retrieval.locate(requests(spark, d), symbols(spark, d), None, None, 5)
    return got.select("request_id", "rank", "symbol_id", "file", "name", "score", "confidence", "use_call_graph", "risk")


# --- graphs ----------------------------------------------------------------------------------------------------------

_STEPS = 10


def _pagerank_sql() -> str:
    ctes = ["""e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY ALL)""", "nodes AS (SELECT 's' || s_suppkey AS node FROM supplier UNION SELECT 'p' || p_partkey FROM part)", "nn AS (SELECT count(*)::DOUBLE AS n FROM nodes)"]
    ctes += ["k AS (SELECT * FROM e WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes))", "l AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM k)", "r0 AS (SELECT node, 1.0 / n AS rank FROM nodes, nn)"]
    for i in range(_STEPS):
        ctes.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, 0.85 * (coalesce(arrived, 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE node NOT IN (SELECT src FROM l)), 0) / n) + 0.15 / n AS rank"
            f" FROM nodes LEFT JOIN (SELECT dst AS node, sum(rank * share) AS arrived FROM r{i} JOIN l ON r{i}.node = l.src GROUP BY dst) USING (node), nn)"
        )
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 9) AS rank FROM r{_STEPS}"


@query(_pagerank_sql())
def pagerank_partsupp(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    edges = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).union(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey")))
    return graph.pagerank(nodes, edges, iterations=_STEPS, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


_PAGE_EDGES = """s AS (SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS name FROM pages), c AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS callee_name FROM pages),
edges AS (SELECT c.page_id AS caller_id, callee_name FROM c JOIN s USING (page_id) WHERE callee_name IN (SELECT name FROM s) AND callee_name <> s.name)"""


def _page_edges(spark, d):
    pg = table(spark, d, "pages")
    own = pg.select(F.col("page_id").alias("symbol_id"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("name"))
    return graph.call_edges(pages.links(pg).select(F.col("page_id").alias("symbol_id"), F.col("href").alias("name")), own)


@query(f"WITH {_PAGE_EDGES} SELECT caller_id, callee_name FROM edges")
def call_edges_links(spark, d):
    return _page_edges(spark, d)


@query(f"WITH {_PAGE_EDGES} SELECT callee_name AS name, count(DISTINCT caller_id) AS called_by_count FROM edges GROUP BY 1")
def called_by_count(spark, d):
    return graph.called_by(_page_edges(spark, d))


# --- predicates and projections --------------------------------------------------------------------------------------

@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(p.HIGH_RISK_WORDS)})([^\p{{L}}\p{{N}}_]|$)') THEN 'HIGH' WHEN starts_with(text, '_') THEN 'LOW' ELSE 'MEDIUM' END AS risk FROM documents""")
def risk_class(spark, d):
    return table(spark, d, "documents").select("doc_id", p.risk(F.regexp_extract("text", "^_?", 0), F.lit("function"), F.col("text")).alias("risk"))


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    return table(spark, d, "documents").groupBy(t.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT doc_id, array_to_string(list_sort({_words('text')}), ' ') AS words, len({_bm25('text')}) AS n_tokens FROM documents")
def locator_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(t.words(F.col("text"))), " ").alias("words"), F.size(t.bm25_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def _compress_sql() -> str:
    c = "text"
    for pattern, put in t.compress_patterns():
        c = f"regexp_replace({c}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, {c} AS compressed FROM documents"


@query(_compress_sql())
def compress_text(spark, d):
    return table(spark, d, "documents").select("doc_id", t.compress(F.col("text")).alias("compressed"))


@query(rf"""SELECT item_id AS request_id, CASE WHEN regexp_extract(lower(text), '^\s*(\S+)', 1) IN ('remove', 'delete') THEN true ELSE false END AS is_delete FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Delete ' ELSE '' END || text AS text FROM benchmark)""")
def delete_intent(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.when(F.col("item_id") % 3 == 0, "Delete ").otherwise(""), "text").alias("text"))
    return b.select(F.col("item_id").alias("request_id"), p.delete_intent(F.col("text")).alias("is_delete"))


_PATHS = "(SELECT p_partkey, replace(p_name, ' ', '/') || CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.XLSX' WHEN 2 THEN '' ELSE '.tar.gz' END AS path FROM part)"


def _paths(spark, d):
    ext = F.when(F.col("p_size") % 4 == 0, ".py").when(F.col("p_size") % 4 == 1, ".XLSX").when(F.col("p_size") % 4 == 2, "").otherwise(".tar.gz")
    return table(spark, d, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "/"), ext).alias("path"))


@query(rf"SELECT p_partkey, path, coalesce(lower(regexp_extract(path, '\.[^./]+$')) IN ('.xlsx','.xls','.docx','.pptx','.pdf','.db','.sqlite','.sqlite3'), false) AS is_binary, regexp_replace(path, '([^/])\.[^./]*$', '\1') || '.go' AS converted FROM {_PATHS}")
def path_predicates(spark, d):
    return _paths(spark, d).select("p_partkey", "path", p.binary_target(F.col("path")).alias("is_binary"), p.conversion_target(F.col("path"), F.lit(".go")).alias("converted"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'SCHEMA_ERROR' ELSE 'REFERENCE_ERROR' END WHEN 'click' THEN 'SYNTAX_ERROR' WHEN 'view' THEN 'PATCH_CONFLICT' WHEN 'signup' THEN 'TEST_FAILURE' ELSE 'UNKNOWN' END AS failure_class FROM events""")
def failure_class(spark, d):
    kind = F.create_map(*[F.lit(x) for pair in {"error": "DeltaValidationError", "click": "SyntaxCheckError", "view": "ApplyError", "signup": "TestFailure", "purchase": "ValueError"}.items() for x in pair])
    message = F.when(F.col("event_id") % 2 == 0, "schema validation failed: x").otherwise("target not found")
    return table(spark, d, "events").select("event_id", p.failure_class(kind[F.col("event_type")], message).alias("failure_class"))


@query("""SELECT event_id, (event_id % 7)::INT AS failed, user_id::INT AS passed, 0 AS errors, event_id % 7 IN (0, 5) AS tests_passed, event_id % 7 = 5 AS no_tests_collected FROM events""")
def test_summary_parse(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("== "), (F.col("event_id") % 7).cast("string"), F.lit(" failed, "), F.col("user_id").cast("string"), F.lit(" passed in 0.1s ==")).alias("out"), (F.col("event_id") % 7).cast("int").alias("rc"))
    return e.select("event_id", p.test_summary(F.col("out"), F.col("rc")).alias("s")).select("event_id", "s.*")


# --- lines and blocks ------------------------------------------------------------------------------------------------

_LT = f"lt AS (SELECT doc_id AS file_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, {LINES} AS l FROM documents))"


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("source"), "lang")


@query(f"WITH {_LT} SELECT file_id, n, line FROM lt")
def line_table(spark, d):
    return blocks.line_table(_files(spark, d))


def _para_sql(source: str) -> str:
    return f"""w AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY file_id ORDER BY n) = n - 1 THEN 0 ELSE 1 END AS opens FROM {source} WHERE trim(line, chr(32) || chr(9)) <> ''),
r AS (SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY n) AS run FROM w)
SELECT file_id, run::INT AS ordinal, substr(trim(arg_min(line, n)), 1, 60) AS name, min(n) AS start_line, max(n) AS end_line FROM r GROUP BY file_id, run"""


@query(f"WITH {_LT.replace('FROM documents', 'FROM (SELECT doc_id, replace(text, chr(46) || chr(32), chr(46) || chr(10) || chr(10)) AS text FROM documents)')}, {_para_sql('lt')}")
def blocks_blank_line(spark, d):
    spaced = _files(spark, d).withColumn("source", F.replace("source", F.lit(". "), F.lit(".\n\n")))
    return blocks.paragraphs(blocks.line_table(spaced))


_MARKED = r"FROM (SELECT doc_id, regexp_replace(text, '\. ([A-Z])', '.' || chr(10) || '# ' || '\1', 'g') AS text FROM documents)"


@query(rf"""WITH {_LT.replace('FROM documents', _MARKED)},
m AS (SELECT file_id, n, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*$', 2)) AS name FROM lt WHERE regexp_matches(line, '^(#{{1,6}})\s+(.+?)\s*$')),
z AS (SELECT file_id, max(n) AS last FROM lt GROUP BY 1)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n)::INT AS ordinal, name, n AS start_line, coalesce(lead(n) OVER (PARTITION BY file_id ORDER BY n) - 1, last) AS end_line FROM m JOIN z USING (file_id)""")
def blocks_marker(spark, d):
    marked = _files(spark, d).withColumn("source", F.regexp_replace("source", r"\. ([A-Z])", ".\n# $1"))
    return blocks.marker_blocks(blocks.line_table(marked), marked.select("file_id", F.lit("markdown").alias("language")))


@query()
def html_blocks(spark, d):
    return pages.html_blocks(table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("source")))


@query(r"""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=["'']([^"'']*)["'']', 1)) AS href FROM pages) GROUP BY 1""")
def html_links(spark, d):
    return pages.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_targets"))


@query(f"""WITH {_LT}, b AS (SELECT file_id, 1 AS ordinal, 3 AS start_line, 4 AS end_line FROM lt WHERE n = 4)
SELECT b.file_id, ordinal, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n < start_line), '') AS before, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n > start_line), '') AS after
FROM b LEFT JOIN lt ON b.file_id = lt.file_id AND (n BETWEEN 1 AND 2 OR n BETWEEN 5 AND 6) GROUP BY ALL""")
def block_context_window(spark, d):
    lines = blocks.line_table(_files(spark, d))
    some = lines.where("n = 4").select("file_id", F.lit(1).alias("ordinal"), F.lit(3).alias("start_line"), F.lit(4).alias("end_line"))
    return blocks.context_window(lines, some)


@query(f"WITH {_LT}, g AS (SELECT * FROM lt WHERE n % 5 <> 2), {_para_sql('g')}")
def module_gaps(spark, d):
    lines = blocks.line_table(_files(spark, d))
    spans = lines.where("n % 5 = 2").select("file_id", F.col("n").alias("start_line"), F.col("n").alias("end_line"))
    return blocks.module_gaps(lines, spans)


# --- edits -----------------------------------------------------------------------------------------------------------

def _ops(spark, d, operation):
    f = _files(spark, d).select("file_id", F.size(t.split_lines(F.col("source"))).alias("n_lines"))
    at = {"REPLACE": (2, 3, "n_lines >= 3"), "DELETE": (1, 1, "n_lines >= 2"), "INSERT": (None, 1, "n_lines >= 1")}[operation]
    return f.where(at[2]).select("file_id", F.lit(0).alias("op_ord"), F.lit(operation).alias("operation"), F.lit(at[0]).cast("int").alias("start_line"), F.lit(at[1]).alias("end_line"), F.lit(2).alias("indent"), F.concat(F.lit("new line "), F.col("file_id").cast("string"), F.lit("\n  second\n")).alias("content"))


_TURNS = r"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) || chr(10) ELSE chr(10) || chr(10) END) AS s FROM documents),
f AS (SELECT doc_id, p, len(p) AS n FROM (SELECT doc_id, list_filter(regexp_extract_all(s, '[^\n]*\n|[^\n]+$'), lambda x: x <> '') AS p FROM src) WHERE len(p) > 0),
o AS (SELECT doc_id, k, ['REPLACE', 'DELETE', 'INSERT'][(doc_id + k) % 3 + 1] AS kind, 1 + (doc_id * 7 + k * k * 5) % n AS s, least(n, 1 + (doc_id * 7 + k * k * 5) % n + (doc_id + k) % 4) AS e,
  CASE WHEN k = 4 THEN chr(10) ELSE '  put ' || k || chr(10) || '    in' || chr(10) END AS body, n FROM f, range(6) AS t(k)),
w AS (SELECT *, CASE WHEN kind <> 'INSERT' THEN s WHEN k = 5 THEN n ELSE e END AS pos FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC, k) AS turn FROM w),
q AS (SELECT doc_id, 0::BIGINT AS turn, p FROM f UNION ALL
  SELECT q.doc_id, r.turn, CASE kind WHEN 'INSERT' THEN list_concat(list_concat(p[1:pos], [chr(10), body]), p[pos + 1:]) WHEN 'REPLACE' THEN list_concat(list_append(p[1:s - 1], body), p[e + 1:])
    ELSE list_concat(p[1:s - 1], p[e + coalesce(list_position(list_transform(p[e + 1:], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13)) <> ''), true), len(p) + 1):]) END
  FROM q JOIN r ON r.doc_id = q.doc_id AND r.turn = q.turn + 1)
SELECT doc_id AS file_id, sha256(array_to_string(p, '')) AS hash, length(array_to_string(p, ''))::BIGINT AS n_chars FROM q WHERE turn = 6"""


@query(_TURNS)
def edits_in_turn(spark, d):
    """Six operations a document, whose spans overlap, on lines with either end, a blank one behind each."""
    ends = F.when(F.col("doc_id") % 2 == 0, "\r\n\n").otherwise("\n\n")
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.replace("text", F.lit("\n"), ends).alias("source"))
    n = F.regexp_count("source", F.lit(r"[^\n]*\n|[^\n]+$"))
    rows = f.withColumn("n", n).where("n > 0").select("file_id", "n", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    s = (1 + (F.col("file_id") * 7 + F.col("k") * F.col("k") * 5) % F.col("n")).cast("int")
    kind = F.element_at(F.array(F.lit("REPLACE"), F.lit("DELETE"), F.lit("INSERT")), ((F.col("file_id") + F.col("k")) % 3 + 1).cast("int"))
    e = F.least(F.col("n"), s + (F.col("file_id") + F.col("k")) % 4).cast("int")
    end = F.when(~((kind == "INSERT") & (F.col("k") == 5)), e)
    content = F.when(F.col("k") == 4, "").otherwise(F.concat(F.lit("put "), F.col("k").cast("string"), F.lit("\n  in\n")))
    ops = rows.select("file_id", F.col("k").alias("op_ord"), kind.alias("operation"), F.when(kind != "INSERT", s).alias("start_line"), end.alias("end_line"), F.lit(2).alias("indent"), content.alias("content"))
    return delta.apply_sequential(f, ops).select("file_id", F.sha2("source", 256).alias("hash"), F.length("source").cast("long").alias("n_chars"))


def _applied(spark, d, operation):
    ops = _ops(spark, d, operation)
    lines = blocks.line_table(_files(spark, d)).join(ops.select("file_id"), "file_id", "left_semi")
    return delta.apply_lines(lines, ops).select("file_id", F.sha2("source", 256).alias("hash"), F.length("source").cast("long").alias("n_chars"))


_NEW = "'  new line ' || file_id || chr(10) || '    second'"


def _apply_sql(kept: str, fresh: str, least: int) -> str:
    return f"""WITH {_LT}, ok AS (SELECT file_id FROM lt GROUP BY 1 HAVING count(*) >= {least}), l AS (SELECT * FROM lt WHERE file_id IN (SELECT file_id FROM ok)),
a AS (SELECT file_id, n * 10 AS k, line FROM l WHERE {kept} {fresh}), s AS (SELECT file_id, string_agg(line, chr(10) ORDER BY k) || chr(10) AS source FROM a GROUP BY 1) SELECT file_id, sha256(source) AS hash, length(source) AS n_chars FROM s"""


@query(_apply_sql("n NOT IN (2, 3)", f"UNION ALL SELECT file_id, 20, {_NEW} FROM ok", 3))
def apply_delta_replace(spark, d):
    return _applied(spark, d, "REPLACE")


@query(_apply_sql("n <> 1 AND NOT (trim(line) = '' AND n = 2)", "", 2))
def apply_delta_delete(spark, d):
    return _applied(spark, d, "DELETE")


@query(_apply_sql("true", f"UNION ALL SELECT file_id, 11, '' FROM ok UNION ALL SELECT file_id, 12, {_NEW} FROM ok", 1))
def apply_delta_insert(spark, d):
    return _applied(spark, d, "INSERT")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1THE_NEW\2', 'g'), '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)', '\1THE_NEW\2', 'g') AS renamed FROM documents""")
def mechanical_rename(spark, d):
    return table(spark, d, "documents").select("doc_id", delta.rename_words(F.col("text"), "the", "THE_NEW").alias("renamed"))


@query()
def subword_rename(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.regexp_replace("text", r"\b(\w+) (\w+)\b", "$1_$2").alias("source"), F.lit("The").alias("old_name"), F.lit("New").alias("new_name"))
    return delta.rename(f)


def _pairs(spark, d):
    f = table(spark, d, "documents")
    return f.select(F.col("doc_id").alias("file_id"), F.col("source").alias("path"), F.col("text").alias("before"), delta.rename_words(F.col("text"), "the", "THE_NEW").alias("after"))


@query()
def unified_diff(spark, d):
    return delta.diffs(_pairs(spark, d))


@query()
def diff_lines(spark, d):
    return delta.parse_diff(delta.diffs(_pairs(spark, d)))


@query("""SELECT conv_id, turn, turn % 7 IN (0, 6) AS valid, 'schema validation failed: ' || [NULL, 'operation', 'operations', 'operations', 'target', 'escalate', NULL][(turn % 7 + 1)::INT] AS error, CASE WHEN turn % 7 = 0 THEN 'f' || conv_id END AS symbol_name FROM conversations""")
def delta_schema_validate(spark, d):
    op = lambda kind, target: F.concat(F.lit('{"operations":[{"operation":"'), F.lit(kind), F.lit('","target":{"symbol_type":"'), F.lit(target), F.lit('","symbol_name":"f'), F.col("conv_id").cast("string"), F.lit('(x)"},"content":null}]}'))
    bodies = [op("REPLACE", "function"), op("UPDATE", "function"), F.lit("{}"), F.lit('{"operations": [{'), op("DELETE", "method"), F.lit('{"operations":[],"escalate":{"kind":"explode"}}'), F.lit('{"operations":[],"escalate":{"kind":"question"}}')]
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("run_id"), "conv_id", "turn", F.get(F.array(*bodies), (F.col("turn") % 7).cast("int")).alias("body"))
    return delta.parse(rows).select("conv_id", "turn", "valid", "error", F.get("delta.operations", 0)["target"]["symbol_name"].alias("symbol_name"))


# --- targets ---------------------------------------------------------------------------------------------------------

_NAMED = "s AS (SELECT p_partkey AS symbol_id, replace(p_name, ' ', '_') AS name FROM part)"


def _named(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.translate("p_name", " ", "_").alias("name"), F.lit("function").alias("symbol_type"))


def _asked(spark, d, text):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"), text.alias("text"))


def _delete_requests(spark, d):
    word = F.get(F.array(*[F.lit(x) for x in ("red", "blue", "widget", "bolt", "zzz")]), F.col("s_suppkey") % 5)
    return _asked(spark, d, F.concat(F.lit("delete the "), word, F.lit(" function")))


@query(f"""WITH {_NAMED}, q AS (SELECT s_suppkey AS request_id, ['red','blue','widget','bolt','zzz'][(s_suppkey % 5 + 1)::INT] AS w FROM supplier)
SELECT DISTINCT request_id, symbol_id, 'substring' AS method FROM q JOIN s ON contains(lower(name), w)""")
def delete_candidates(spark, d):
    return targets.delete_candidates(_delete_requests(spark, d), _named(spark, d), fuzzy=False)


@query()
def delete_candidates_fuzzy(spark, d):
    word = F.get(F.array(*[F.lit(x) for x in ("rde_widget", "blue_botl", "smal_ring")]), F.col("s_suppkey") % 3)
    return targets.delete_candidates(_asked(spark, d, F.concat(F.lit("delete "), F.regexp_replace(word, "_", ""))), _named(spark, d).withColumn("name", F.regexp_replace("name", "_", "")))


def _suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol_id"), F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")).alias("name"))


def _pair_requests(spark, d):
    u = _suppliers(spark, d)
    pairs = u.alias("a").join(u.alias("b"), F.col("b.symbol_id") == F.col("a.symbol_id") + 1)
    return pairs.select(F.col("a.symbol_id").alias("request_id"), F.concat(F.lit("Delete "), "a.name", F.lit(" and "), "b.name").alias("text"))


@query("""WITH u AS (SELECT s_suppkey AS symbol_id, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM supplier), q AS (SELECT a.symbol_id AS request_id, a.symbol_id AS first, b.symbol_id AS second FROM u a JOIN u b ON b.symbol_id = a.symbol_id + 1)
SELECT request_id, 0 AS phrase_ord, first AS symbol_id FROM q UNION ALL SELECT request_id, 1, second FROM q""")
def multi_delete(spark, d):
    return targets.multi_delete(_pair_requests(spark, d), _suppliers(spark, d))


@query("""WITH u AS (SELECT s_suppkey AS symbol_id, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS name FROM supplier) SELECT symbol_id AS request_id, name AS old_name, 'fresh_' || symbol_id AS new_name FROM u WHERE symbol_id % 2 = 0""")
def rename_target(spark, d):
    u = _suppliers(spark, d)
    verb = F.when(F.col("symbol_id") % 2 == 0, "Rename the function ").otherwise("Move the function ")
    return targets.rename_target(u.select(F.col("symbol_id").alias("request_id"), F.concat(verb, "name", F.lit(" to fresh_"), F.col("symbol_id").cast("string"), F.lit(".")).alias("text")), u)


# --- versions, cost, runs --------------------------------------------------------------------------------------------

_CALLS = r"""c AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, role, CASE conv_id % 3 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'openai/gpt-5.4' ELSE 'other' END AS model FROM conversations),
k AS (SELECT conv_id, model, CASE role WHEN 'assistant' THEN 0 ELSE w END AS i, CASE role WHEN 'assistant' THEN w ELSE 0 END AS o, CASE role WHEN 'assistant' THEN 0 ELSE w // 2 END AS ca FROM c),
x AS (SELECT *, CASE WHEN model = 'other' THEN 0.0 ELSE round((i - ca) / 1000 * 0.0025::DOUBLE + ca / 1000 * 0.00025::DOUBLE + o / 1000 * 0.015::DOUBLE, 6) END AS cost FROM k)"""


def _calls(spark, d):
    w = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    model = F.when(F.col("conv_id") % 3 == 0, "gpt-5.4").when(F.col("conv_id") % 3 == 1, "openai/gpt-5.4").otherwise("other")
    out = F.col("role") == "assistant"
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", model.alias("model"), w.alias("w"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("attempt"), "model", F.when(out, 0).otherwise(F.col("w")).alias("input_tokens"), F.when(out, 0).otherwise(F.floor(F.col("w") / 2)).alias("cached_tokens"), F.when(out, F.col("w")).otherwise(0).alias("output_tokens"), F.lit(0).alias("latency_ms"))


@query(f"WITH {_CALLS} SELECT conv_id AS run_id, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(ca)::BIGINT AS cached_tokens, round(sum(cost), 6)::DOUBLE AS cost_usd, count(*) - 1 AS retry_count FROM x GROUP BY 1")
def cost_per_conversation(spark, d):
    return versions.fold_runs(versions.call_costs(_calls(spark, d), versions.price_table(spark))).drop("latency_ms")


@query("""SELECT event_type, dow, n, total FROM (SELECT event_type, dayofmonth(ts)::INT AS dow, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, dow))""")
def run_telemetry_rollup(spark, d):
    e = table(spark, d, "events").withColumn("dow", F.dayofmonth("ts"))
    return e.rollup("event_type", "dow").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _commits(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("commit_id"), "event_type")


@query("""SELECT user_id AS project_id, event_id AS commit_id, row_number() OVER w::INT AS version_n, CASE WHEN row_number() OVER w > 1 THEN (row_number() OVER w - 1)::INT END AS parent_n, 'v' || row_number() OVER w AS version_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def version_chain(spark, d):
    return versions.chain(_commits(spark, d)).select("project_id", "commit_id", "version_n", "parent_n", "version_id")


@query("SELECT user_id AS project_id, count(*)::INT AS head FROM events GROUP BY 1")
def version_head(spark, d):
    return versions.head(versions.chain(_commits(spark, d)))


@query("""WITH v AS (SELECT user_id AS project_id, event_type AS filename, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 5 = 0 AS deleted FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY project_id, filename ORDER BY n DESC) AS k FROM v WHERE n <= 20) SELECT project_id, filename, event_id::VARCHAR AS content, n::INT AS version_n FROM l WHERE k = 1 AND NOT deleted""")
def version_as_of(spark, d):
    v = versions.chain(_commits(spark, d)).select("project_id", "version_n", F.col("event_type").alias("filename"), F.col("commit_id").cast("string").alias("content"), (F.col("commit_id") % 5 == 0).alias("deleted"))
    return versions.as_of(v, 20)


@query("""SELECT source AS project_id, sha256(string_agg(e, chr(10) ORDER BY e)) AS fingerprint, count(*) AS n_files FROM (SELECT source, doc_id || ':' || doc_id * 1000 || ':' || n_chars AS e FROM documents) GROUP BY 1""")
def fingerprint(spark, d):
    f = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.col("n_chars").alias("size"))
    return versions.fingerprint(f)


@query("SELECT count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE doc_id % 3 <> 0")
def incremental_stale(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("path"), t.content_hash(F.col("text")).alias("hash"))
    return versions.stale(f, f.where("path % 3 = 0")).agg(F.count("*").alias("n"), F.min("path").alias("first_doc"), F.max("path").alias("last_doc"))


@query("""SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS hash FROM conversations GROUP BY 1""")
def chat_history_latest(spark, d):
    h = files.chat_history(table(spark, d, "conversations"))
    return h.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n"), 256).alias("hash"))


# --- streams, as batches ---------------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT user_id::VARCHAR AS run_id, min(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1), r AS (SELECT user_id::VARCHAR AS run_id, ts, event_type = 'purchase' AS accept FROM events WHERE event_type IN ('purchase', 'error')),
m AS (SELECT s.run_id, r.ts AS done_at, accept, row_number() OVER (PARTITION BY s.run_id ORDER BY r.ts NULLS LAST) AS k FROM s LEFT JOIN r ON s.run_id = r.run_id AND r.ts >= s.ts AND r.ts < s.ts + INTERVAL 86400 SECONDS)
SELECT run_id, CASE WHEN done_at IS NULL THEN 'expired' WHEN accept THEN 'accepted' ELSE 'rejected' END AS outcome, done_at AS resolved_at FROM m WHERE k = 1""")
def pending_confirmation_ttl(spark, d):
    e = table(spark, d, "events").withColumn("run_id", F.col("user_id").cast("string"))
    return streams.confirmations_batch(e.where("event_type = 'signup'"), e.where("event_type in ('purchase', 'error')").withColumn("accept", F.col("event_type") == "purchase"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return streams.tumbling(table(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens FROM events), r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM r GROUP BY user_id, s""")
def session_window(spark, d):
    return streams.sessions(table(spark, d, "events"))


@query("""SELECT user_id::VARCHAR AS run_id, count(*) FILTER (event_type IN ('view', 'click')) AS n_steps, arg_max(event_type, event_id) FILTER (event_type IN ('view', 'click')) AS last_tag, bool_or(event_type = 'error') AS done FROM events GROUP BY 1""")
def run_steps(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "step").when(F.col("event_type") == "error", "error").otherwise("preview")
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("tag"))
    return streams.steps(e)


# --- more projections, sources and plans -----------------------------------------------------------------------------

@query(f"WITH {SYM} SELECT symbol_id, sha256({_DOC}) AS bm25_hash, sha256(concat_ws(chr(10), nullif(name,''), nullif(doc,''), nullif(substr(source, 1, 2000),''))) AS vector_hash FROM sym")
def document_projections(spark, d):
    n, doc, src = F.col("name"), F.col("docstring_first_line"), F.col("source")
    return symbols(spark, d).select("symbol_id", F.sha2(t.bm25_document(n, doc, src), 256).alias("bm25_hash"), F.sha2(t.vector_document(n, doc, src), 256).alias("vector_hash"))


@query(r"""SELECT doc_id, trim(split_part(text, '(', 1), ' ') AS bare, regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) AS unfenced, split_part(text, chr(10), 1) <> '' AS has_head FROM documents""")
def small_projections(spark, d):
    fenced = F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", t.bare_name(F.col("text")).alias("bare"), t.strip_fences(fenced).alias("unfenced"), (F.split_part("text", F.lit("\n"), F.lit(1)) != "").alias("has_head"))


@query("""WITH h AS (SELECT DISTINCT sha256(text) AS hash, text FROM documents), c AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0) SELECT hash, length(text) AS n_chars FROM h WHERE hash NOT IN (SELECT hash FROM c)""")
def embedding_misses(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash")).distinct()
    return retrieval.embedding_misses(docs, cache).select("hash", F.length("text").cast("long").alias("n_chars"))


@query("""SELECT p_partkey AS key, CASE WHEN n = 1 THEN 'FOUND' WHEN n > 1 AND hit THEN 'FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status
FROM (SELECT a.p_partkey, count(b.p_partkey) AS n, coalesce(bool_or(b.p_partkey = a.p_partkey AND a.p_partkey % 2 = 0), false) AS hit FROM part a LEFT JOIN part b ON b.p_brand = a.p_brand AND b.p_name = CASE WHEN a.p_partkey % 5 = 0 THEN 'nope' ELSE a.p_name END GROUP BY 1)""")
def find_symbol(spark, d):
    part = table(spark, d, "part")
    pool = part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file"), F.lit("function").alias("symbol_type"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("start_line"), F.lit(None).cast("string").alias("parent_class"))
    name = F.when(F.col("p_partkey") % 5 == 0, "nope").otherwise(F.col("p_name"))
    wanted = part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("file"), F.lit("function").alias("symbol_type"), name.alias("symbol_name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("int")).alias("prefer_line"), F.lit(False).alias("allow_delegate"))
    return targets.find_symbol(wanted, pool).select("key", "status")


_TREE = "(SELECT p_brand || '/' || replace(p_name, ' ', '/') || '.py' AS path FROM part)"


def _tree(spark, d):
    return table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.translate("p_name", " ", "/"), F.lit(".py")).alias("path")).distinct()


@query(rf"""WITH p AS (SELECT DISTINCT string_split(path, '/') AS p FROM {_TREE}), e AS (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)
SELECT DISTINCT coalesce(array_to_string(p[1:i-1], '/'), '') AS parent, p[i] AS name, i = len(p) AS is_file, (i - 1)::INT AS depth FROM e""")
def tree_listing(spark, d):
    return files.listing(_tree(spark, d))


@query(rf"SELECT path, 'python' AS language, true AS has_symbols FROM (SELECT DISTINCT path FROM {_TREE}) WHERE NOT list_has_any(string_split(path, '/'), ['Brand#1', 'red'])")
def detect_and_ignore(spark, d):
    ignored = spark.createDataFrame([("Brand#1",), ("red",)], "name string")
    return files.detect_language(files.keep_unignored(_tree(spark, d), ignored)).select("path", "language", "has_symbols")


@query("""WITH a AS (SELECT user_id::VARCHAR AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS status FROM events), k AS (SELECT * FROM a WHERE attempt <= 3)
SELECT run_id, coalesce(min(attempt) FILTER (status = 'ok'), max(attempt))::INT AS attempt, CASE WHEN bool_or(status = 'ok') THEN 'ok' ELSE 'failed' END AS status FROM k GROUP BY 1""")
def best_attempt(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tries = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), n.alias("attempt"), F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"))
    return versions.best_attempt(tries)


@query("""WITH o AS (SELECT l_orderkey AS file_id, row_number() OVER () AS op_ord, l_partkey % 50 AS s, l_partkey % 50 + l_suppkey % 6 AS e FROM lineitem)
SELECT DISTINCT a.file_id FROM o a JOIN o b ON a.file_id = b.file_id AND a.op_ord < b.op_ord AND a.s <= b.e AND b.s <= a.e""")
def overlapping_operations(spark, d):
    ops = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("op_ord"), F.lit("REPLACE").alias("operation"), (F.col("l_partkey") % 50).cast("int").alias("start_line"), (F.col("l_partkey") % 50 + F.col("l_suppkey") % 6).cast("int").alias("end_line"))
    return delta.overlapping(ops)


@query(r"""SELECT file_id, n, line FROM (SELECT page_id AS file_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT page_id, string_split('import ' || replace(url, '/', chr(10) || 'use '), chr(10)) AS l FROM pages)) WHERE regexp_matches(line, '^(import|use|package)\b')""")
def import_lines(spark, d):
    f = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.lit("import "), F.replace("url", F.lit("/"), F.lit("\nuse "))).alias("source"))
    return code.other_imports(blocks.line_table(f))


@query("""SELECT conv_id, sha256(string_agg('data: {"turn":' || turn || '}' || chr(10) || chr(10), '' ORDER BY turn)) AS hash FROM conversations GROUP BY 1""")
def event_frames(spark, d):
    f = streams.step_frames(table(spark, d, "conversations").select("turn")).select("frame").distinct()
    turns = table(spark, d, "conversations").select("conv_id", "turn").withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct("turn")), F.lit("\n\n"))).join(f, "frame", "left_semi")
    return turns.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "frame"))), lambda x: x["frame"]), ""), 256).alias("hash"))


@query(f"""WITH {SYM}, {REQ}, q AS (SELECT request_id, list_sort({_content_words('text')}) AS w FROM req) SELECT request_id, array_to_string(w, ' ') AS words, len(w)::INT AS n FROM q""")
def request_content_words(spark, d):
    w = F.sort_array(t.content_words(F.col("text")))
    return requests(spark, d).select("request_id", F.array_join(w, " ").alias("words"), F.size(w).alias("n"))


@query()
def locate_symbols_in_file(spark, d):
    return targets.locate_candidates(requests(spark, d), symbols(spark, d).withColumn("parent_class", F.lit(None).cast("string")))


def _centrality_sql(steps: int = _STEPS) -> str:
    ctes = [f"{_PAGE_EDGES}, nodes AS (SELECT page_id AS node FROM pages), nn AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "q AS (SELECT page_id AS request_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages WHERE page_id % 50 = 0)"]
    ctes += ["lk AS (SELECT caller_id AS src, s.page_id AS dst, count(*)::DOUBLE AS w FROM edges JOIN s ON s.name = edges.callee_name WHERE caller_id <> s.page_id GROUP BY ALL)", "l AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM lk)"]
    ctes += [f"hit AS (SELECT DISTINCT request_id, page_id AS node FROM (SELECT page_id, unnest({_words('name')}) AS w FROM s) JOIN (SELECT request_id, unnest({_content_words('text')}) AS w FROM q) USING (w))"]
    ctes += ["b AS (SELECT q.request_id, node, CASE WHEN named IS NULL THEN 1.0 / n ELSE (CASE WHEN hit.node IS NULL THEN 0.0 ELSE 1.0 END) / named END::DOUBLE AS restart FROM q CROSS JOIN nodes CROSS JOIN nn LEFT JOIN hit USING (request_id, node) LEFT JOIN (SELECT request_id, count(*) AS named FROM hit GROUP BY 1) USING (request_id))"]
    ctes.append("r0 AS (SELECT request_id, node, 1.0 / n AS rank FROM b, nn)")
    for i in range(steps):
        ctes.append(
            f"r{i + 1} AS MATERIALIZED (SELECT request_id, node, 0.85 * (coalesce(arrived, 0) + coalesce(loose, 0) / n) + (1 - 0.85) * restart AS rank FROM b CROSS JOIN nn"
            f" LEFT JOIN (SELECT request_id, dst AS node, sum(rank * share) AS arrived FROM r{i} JOIN l ON r{i}.node = l.src GROUP BY 1, 2) USING (request_id, node) LEFT JOIN (SELECT request_id, sum(rank) AS loose FROM r{i} WHERE node NOT IN (SELECT src FROM l) GROUP BY 1) USING (request_id))"
        )
    return f"WITH {', '.join(ctes)} SELECT request_id, node AS symbol_id, round(rank, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(rank, 9) DESC, node) AS k FROM r{steps}) WHERE k <= 10"


@query(_centrality_sql())
def graph_centrality(spark, d):
    pg = table(spark, d, "pages")
    own = pg.select(F.col("page_id").alias("symbol_id"), F.col("page_id").alias("ordinal"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("name"))
    asked = pg.where("page_id % 50 = 0").select(F.col("page_id").alias("request_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return retrieval.graph_ranking(asked, own, _page_edges(spark, d), 10, iterations=_STEPS).withColumn("score", F.round("score", 6))


@query(_centrality_sql(90))
def settled_centrality(spark, d):
    """graph_centrality with settled ranks, by push; the SQL takes 90 steps, by which the ranks of these graphs have settled."""
    pg = table(spark, d, "pages")
    own = pg.select(F.col("page_id").alias("symbol_id"), F.col("page_id").alias("ordinal"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("name"))
    asked = pg.where("page_id % 50 = 0").select(F.col("page_id").alias("request_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return retrieval.graph_ranking(asked, own, _page_edges(spark, d), 10).withColumn("score", F.round("score", 6))

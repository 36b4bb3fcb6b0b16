from lodeline import on_workers
from lodeline.functions.register import register


def test_sql_functions(spark):
    on_workers(spark)
    assert len(register(spark)) == 7
    row = spark.sql("select bm25_tokens('getName x') a, content_words('add the parser to file') b, cosine(array(1D, 0D), array(2D, 2D)) c, content_hash('x') d, locator_words(null) e").first()
    assert row["a"] == ["get", "name", "x"] and row["b"] == ["parser"] and round(row["c"], 4) == 0.7071 and len(row["d"]) == 16 and row["e"] == []
    assert [r["name"] for r in spark.sql("select * from py_symbols('def f():\n    pass\nclass A:\n    pass')").collect()] == ["f", "A"]
    assert [(r["name"], r["end_line"]) for r in spark.sql("select * from text_blocks('# A\nx\n# B', 'markdown')").collect()] == [("A", 2), ("B", 3)]
    assert [r["start_line"] for r in spark.sql("select * from text_blocks('a\n\n\nb', 'text')").collect()] == [1, 4]

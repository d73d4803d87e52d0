"""Table functions in SQL."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import tables, text


def test_parse_source_and_grams(spark):
    tables.register(spark)
    files = spark.createDataFrame([("a.ts", "typescript", "// TODO x\nexport function f() { g(); }"), ("b.py", "python", "def ("), ("c", None, "x"), ("d.ts", "typescript", None)], "path string, language string, content string")
    files.createOrReplaceTempView("t_files")
    ask = lambda columns, what: sorted(tuple(r) for r in spark.sql(f"SELECT f.path, {columns} FROM t_files f, LATERAL parse_source(f.path, f.language, f.content, '{what}') s").collect())
    assert ask("s.name, s.exported, s.line_start", "nodes") == [("a.ts", "f", True, 2)]
    assert ask("s.src, s.dst, s.kind", "edges") == [("a.ts", "file:a.ts", "fn:a.ts:f", "EXPORTS"), ("a.ts", "fn:a.ts:f", "g", "CALLS")]
    assert ask("s.tag_type, s.line", "tags") == [("a.ts", "TODO", 1)]
    assert [r[0] for r in ask("s.message", "errors")] == ["b.py"]
    with pytest.raises(Exception, match="last argument"):
        ask("s.*", "other")
    bodies = spark.createDataFrame([("abcdabcd",), ("abc",), (None,), ("aé1;  'q' /* c */ x",)], "b string")
    bodies.createOrReplaceTempView("t_bodies")
    found = sorted(r[0] for r in spark.sql("SELECT g.gram FROM t_bodies, LATERAL near_clone_grams(b) g").collect())
    assert found == sorted(x for r in bodies.select(F.explode(text.byte_grams(F.col("b")))).collect() for x in r)
    both = bodies.select(F.expr("normalized_text(b)").alias("a"), text.normalized_body(F.col("b")).alias("n")).collect()
    assert all(r["a"] == r["n"] for r in both) and both[3]["n"] == "aéN; S  x"

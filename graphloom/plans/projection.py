"""The driver's star-schema tables seen as a property graph.

Each element is one SELECT that Spark SQL and DuckDB both run: parts are files, orders functions, customers
classes, nations modules, regions types, suppliers authors; an order is also a commit that changes its lines' parts.
As a repository is indexed once and asked many times, nodes, edges and commits are written to the shared folder
when they are first asked for, and read from there by all queries of the session over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators import enrich
from graphloom.operators.storage import exists, remove, scratch, tidy
from graphloom.schemas import as_edges, as_nodes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_PATH = "lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 7 = 0 THEN '/tests/' ELSE '/' END || replace(p_name, ' ', '_') || '-' || CAST(p_partkey AS STRING) || '.ts'"

FILES = f"SELECT p_partkey, {_PATH} AS path, lower(p_type) AS language FROM part"

NODES = """
SELECT 'file:' || CAST(p_partkey AS STRING) AS id, 'File' AS kind, path AS name, path, 1 AS line_start, 1 AS line_end, language,
       CAST(0 AS BIGINT) AS community, false AS exported, CAST(0 AS DOUBLE) AS complexity, CAST(NULL AS STRING) AS doc_comment, p_partkey % 7 = 0 AS is_test_file FROM files
UNION ALL
SELECT 'fn:' || CAST(o_orderkey AS STRING), 'Function', 'fn_' || CAST(o_orderkey % 4999 AS STRING), coalesce(f.path, ''), CAST(o_orderkey % 500 + 1 AS INT), CAST(o_orderkey % 500 + 11 AS INT), coalesce(f.language, ''),
       CAST(c_nationkey + 1 AS BIGINT), o_orderstatus = 'O', o_totalprice / 1000000, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END, o_orderstatus = 'P'
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey LEFT JOIN files f ON f.p_partkey = first_part
UNION ALL
SELECT 'cls:' || CAST(c_custkey AS STRING), 'Class', c_name, 'customers/' || lower(c_mktsegment) || '.java', CAST(c_custkey % 900 + 1 AS INT), CAST(c_custkey % 900 + 40 AS INT), 'java',
       CAST(c_nationkey + 1 AS BIGINT), c_acctbal > 5000, CAST(0 AS DOUBLE), CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, false FROM customer
UNION ALL
SELECT 'mod:' || CAST(n_nationkey AS STRING), 'Module', n_name, 'modules/' || lower(n_name) || '.go', 1, 1, 'go', CAST(n_nationkey + 1 AS BIGINT), true, CAST(0 AS DOUBLE), NULL, false FROM nation
UNION ALL
SELECT 'type:' || CAST(r_regionkey AS STRING), 'Type', r_name || ' "& co"', 'types/' || lower(r_name) || '.d.ts', 1, 1, 'typescript', CAST(r_regionkey + 1 AS BIGINT), true, CAST(0 AS DOUBLE), NULL, false FROM region
UNION ALL
SELECT 'author:' || CAST(s_suppkey AS STRING), 'Author', s_name || ' <s' || CAST(s_suppkey AS STRING) || '@example.org>', '', 0, 0, '', CAST(0 AS BIGINT), false, CAST(0 AS DOUBLE), NULL, false FROM supplier
"""

COMMITS = """
SELECT DISTINCT CAST(o_orderkey AS STRING) AS sha, o_orderdate AS ts, 'Customer ' || CAST(o_custkey AS STRING) AS author_name, CAST(o_custkey AS STRING) || '@example.org' AS author_email, path
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN files ON p_partkey = l_partkey
"""

BLAME = """
SELECT path, s_name AS author_name, 'author:' || CAST(s_suppkey AS STRING) AS author_email, CAST(sum(l_quantity) AS BIGINT) AS lines
FROM lineitem JOIN files ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY path, s_name, s_suppkey
"""

EDGES = """
SELECT 'fn:' || CAST(src AS STRING) AS src, 'fn:' || CAST(dst AS STRING) AS dst, CASE WHEN st = 'P' AND dt <> 'P' THEN 'TESTS' ELSE 'CALLS' END AS kind, CAST(1 AS DOUBLE) AS weight, CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT o_orderkey AS src, o_orderstatus AS st, lead(o_orderkey) OVER w AS dst, lead(o_orderstatus) OVER w AS dt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) c WHERE dst IS NOT NULL
UNION ALL
SELECT DISTINCT 'file:' || CAST(src AS STRING), 'file:' || CAST(dst AS STRING), 'IMPORTS', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE)
FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) d) s WHERE dst IS NOT NULL AND src <> dst
UNION ALL
SELECT 'file:' || CAST(min(l_partkey) AS STRING), 'fn:' || CAST(l_orderkey AS STRING), 'EXPORTS', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM lineitem GROUP BY l_orderkey
UNION ALL
SELECT 'cls:' || CAST(c_custkey AS STRING), 'mod:' || CAST(c_nationkey AS STRING), 'INHERITS', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM customer
UNION ALL
SELECT 'mod:' || CAST(n_nationkey AS STRING), 'type:' || CAST(n_regionkey AS STRING), 'DEPENDS_ON', CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM nation
UNION ALL
SELECT 'author:' || CAST(l_suppkey AS STRING), 'file:' || CAST(l_partkey AS STRING), 'OWNS', CAST(0.25 AS DOUBLE) * (1 + (l_suppkey + l_partkey) % 4), CAST(1 AS DOUBLE) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 9 <> 0) o
"""


#: State of the tables, path and schema of what is written, by application, folder and name.
_INDEX: dict[tuple[str, str, str], tuple[tuple, str, StructType]] = {}


@dataclass
class Graph:
    """The projected tables; nodes come enriched."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        """Runs a SELECT with the tables it names bound as frames, so no view is left behind."""
        used = {t: self.table(t) for t in TABLES if _names(text, t)}
        if _names(text, "files"):
            used["files"] = self.files
        for name in used:
            text = _bound(text, name)
        return self.spark.sql(text, **used)

    @cached_property
    def _state(self) -> tuple:
        """Path, bytes and time of change of the tables' files; another state needs another index."""
        spark = self.spark
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = fs_path(self.sf_dir)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f for tail in ("*.parquet", "*.parquet/*") for f in fs.globStatus(fs_path(root, tail)) or []]
        return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))

    def _indexed(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make() gave when it was first written in this session for these tables as they are now."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        known = _INDEX.get(key)
        if known is None or known[0] != self._state or not exists(self.spark, known[1]):
            if known is not None:
                remove(self.spark, known[1])
            df, path = make(), scratch(self.spark, f"index-{name}")
            with tidy(self.spark):
                df.write.option("compression", "zstd").parquet(path)
            _INDEX[key] = self._state, path, df.schema
        _, path, schema = _INDEX[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def files(self) -> DataFrame:
        return self._sql(FILES)

    @cached_property
    def raw_nodes(self) -> DataFrame:
        return self._indexed("raw_nodes", lambda: as_nodes(self._sql(NODES)))

    @cached_property
    def edges(self) -> DataFrame:
        return self._indexed("edges", lambda: as_edges(self._sql(EDGES)))

    @cached_property
    def commits(self) -> DataFrame:
        return self._indexed("commits", self._committed)

    def _committed(self) -> DataFrame:
        """COMMITS, made distinct by keys, where the join has them already, before names and paths are written: a path ends in its part's key."""
        orders = self.table("orders").select("o_orderkey", "o_orderdate", "o_custkey")
        keys = orders.join(self.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")), "o_orderkey").distinct()
        who = F.col("o_custkey").cast("string")
        rows = keys.join(self.files.select("p_partkey", "path").distinct(), "p_partkey")
        return rows.select(F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("Customer "), who).alias("author_name"), F.concat(who, F.lit("@example.org")).alias("author_email"), "path")

    @cached_property
    def blame(self) -> DataFrame:
        return self._sql(BLAME)

    @cached_property
    def churn(self) -> DataFrame:
        return enrich.churn(self.commits)

    @cached_property
    def nodes(self) -> DataFrame:
        """With degrees, coupling, churn and test coverage."""
        return self._indexed("nodes", self._enriched)

    def _enriched(self) -> DataFrame:
        # churn is of files alone, so only they are dealt by path; all else is joined by id, dealt once
        files, others = self.raw_nodes.where("kind = 'File'"), self.raw_nodes.where("kind <> 'File'")
        nodes = enrich.with_churn(files, self.churn).unionByName(others)
        nodes = enrich.with_coupling(enrich.with_degrees(nodes, self.edges))
        return enrich.with_test_coverage(nodes, self.edges)


def _names(text: str, table: str) -> bool:
    import re

    return re.search(rf"\b(?:FROM|JOIN) {table}\b", text) is not None


def _bound(text: str, table: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", text)


#: DuckDB: the same graph as common table expressions, enriched by plain SQL.
PRELUDE = f"""
WITH files AS ({FILES}), raw_nodes AS ({NODES}), edges AS ({EDGES}), commits AS ({COMMITS}), blame AS ({BLAME}),
din AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst), dout AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src),
tst AS (SELECT dst AS id, count(*) AS n FROM edges WHERE kind = 'TESTS' GROUP BY dst),
counted AS (SELECT path, count(DISTINCT sha) AS n FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 90 DAY GROUP BY path),
churn AS (SELECT path, CAST(n AS DOUBLE) / (SELECT max(n) FROM counted) AS churn FROM counted),
degreed AS (SELECT r.*, CAST(coalesce(din.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(dout.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(tst.n, 0) AS BIGINT) AS test_count
  FROM raw_nodes r LEFT JOIN din ON din.id = r.id LEFT JOIN dout ON dout.id = r.id LEFT JOIN tst ON tst.id = r.id),
nodes AS (SELECT d.*, CASE WHEN kind = 'File' THEN coalesce(CAST(in_degree AS DOUBLE) / nullif((SELECT max(in_degree) FROM degreed WHERE kind = 'File'), 0), 0) ELSE 0 END AS coupling,
  CASE WHEN kind = 'File' THEN coalesce(churn, 0) ELSE 0 END AS churn, test_count > 0 AND NOT is_test_file AS is_tested FROM degreed d LEFT JOIN churn ON churn.path = d.path)
"""

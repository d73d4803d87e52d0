"""Registered queries on the parsers: a source file of each language for every part, and what is in it.

A template holds the text, {k} the part's key, {m} that modulo 4; beside it stand the symbols, edges and tags that
its parser must find, which the SQL writes out for every part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import tables
from graphloom.operators import rules
from graphloom.operators.storage import spread, stored
from graphloom.plans.projection import Graph
from graphloom.plans.queries import query
from graphloom.sources import parse


@dataclass
class Template:
    """nodes: (kind, name, first line, last line, exported, complexity, doc); edges: (from, to, kind, confidence), {p} the path; tags: (type, text, line)."""

    language: str
    path: str
    text: str
    nodes: list[tuple]
    edges: list[tuple]
    tags: list[tuple]


TEMPLATES = {
    "P1_typescript": Template(
        "typescript",
        "src/m{k}.ts",
        "import { a } from './lib_{m}';\n// FIXME: see {k}\n/** Doc {k}. */\n\n\n\n\nexport class C_{k} {\n  run(x) {\n    if (x) { for (;;) { helper_{k}(x); } }\n    return new D_{m}();\n  }\n}\n/** Top {k}. */\nexport const top_{k} = (y) => {\n  return obj.call_{k}(y) && y;\n};\n",
        [("Class", "C_{k}", 8, 13, True, 0.025, None), ("Function", "run", 9, 12, False, 0.025, None), ("Function", "top_{k}", 15, 17, True, 0.005, "Top {k}.")],
        [
            ("file:{p}", "file:src/lib_{m}", "IMPORTS", 1.0), ("fn:{p}:run", "helper_{k}", "CALLS", 0.7), ("fn:{p}:run", "D_{m}", "CALLS", 0.7),
            ("fn:{p}:top_{k}", "call_{k}", "CALLS", 0.7), ("fn:{p}:top_{k}", "obj", "CALLS", 0.6),
        ],
        [("FIXME", "FIXME: see {k}", 2)],
    ),
    "P2_python": Template(
        "python",
        "src/m{k}.py",
        'import os.path\nfrom . import sibling\nfrom .lib_{m} import x\n\n\nclass C_{k}:\n    """Class {k}."""\n\n    def run(self):\n        return _helper_{k}()\n\n\ndef _helper_{k}():\n    """Help {k}."""\n',
        [("Class", "C_{k}", 6, 10, True, 0.0, "Class {k}."), ("Function", "run", 9, 10, True, 0.0, None), ("Function", "_helper_{k}", 13, 14, False, 0.0, "Help {k}.")],
        [("file:{p}", "file:os/path.py", "IMPORTS", 1.0), ("file:{p}", "file:src/__init__.py", "IMPORTS", 1.0), ("file:{p}", "file:src/lib_{m}.py", "IMPORTS", 1.0)],
        [],
    ),
    "P3_rust": Template(
        "rust",
        "src/m{k}.rs",
        "use crate::a::b_{m}::Thing;\nuse other_{k};\n/// Doc {k}.\npub struct S_{k} {\n    x: i32,\n    y: i32,\n}\n\nimpl S_{k} {\n    fn get(&self) -> i32 { self.x }\n}\n\npub fn top_{k}() {\n    other();\n}\n",
        [("Class", "S_{k}", 4, 7, True, 0.0, "Doc {k}."), ("Function", "get", 10, 10, False, 0.0, None), ("Function", "top_{k}", 13, 15, True, 0.0, None)],
        [("file:{p}", "file:src/a/b_{m}.rs", "IMPORTS", 1.0), ("file:{p}", "file:other_{k}.rs", "IMPORTS", 1.0)],
        [],
    ),
    "P4_go": Template(
        "go",
        "src/m{k}.go",
        'package m\n\nimport "./lib_{m}"\n\n// Type {k}.\ntype T_{k} struct {\n\tx int\n}\n\nfunc (t *T_{k}) get() int {\n\treturn calc_{k}(t.x)\n}\n\n// Top {k}.\nfunc Top_{k}() {\n\thelper()\n}\n',
        [("Class", "T_{k}", 6, 8, True, 0.0, "Type {k}."), ("Function", "get", 10, 12, False, 0.0, None), ("Function", "Top_{k}", 15, 17, True, 0.0, "Top {k}.")],
        [("file:{p}", "file:src/lib_{m}", "IMPORTS", 1.0), ("fn:{p}:get", "calc_{k}", "CALLS", 0.7), ("fn:{p}:Top_{k}", "helper", "CALLS", 0.7)],
        [],
    ),
    "P5_java": Template(
        "java",
        "src/M{k}.java",
        "import a.b.C_{m};\n\n/** Class {k}. */\npublic class K_{k} {\n    int a;\n    int b;\n    int c;\n    int d;\n\n    public int run(int x) {\n        return twice_{k}(x);\n    }\n}\n",
        [("Class", "K_{k}", 4, 13, False, 0.0, "Class {k}."), ("Function", "run", 10, 12, False, 0.0, None)],
        [("file:{p}", "file:a/b/C_{m}.java", "IMPORTS", 1.0), ("fn:{p}:run", "twice_{k}", "CALLS", 0.7)],
        [],
    ),
    "P6_php": Template(
        "php",
        "src/m{k}.php",
        "<?php\nrequire_once './lib_{m}.php';\n/** Class {k}. */\nclass K_{k} {\n    public $a;\n    public $b;\n    public $c;\n    public $d;\n\n    public function run($x) {\n        return twice_{k}($x);\n    }\n}\n",
        [("Class", "K_{k}", 4, 13, False, 0.0, "Class {k}."), ("Function", "run", 10, 12, False, 0.0, None)],
        [("file:{p}", "file:src/lib_{m}.php", "IMPORTS", 1.0), ("fn:{p}:run", "twice_{k}", "CALLS", 0.7)],
        [],
    ),
}


def _filled(text: str, k: Column) -> Column:
    return F.replace(F.replace(F.lit(text), F.lit("{k}"), k.cast("string")), F.lit("{m}"), (k % 4).cast("string"))


def _quoted(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _sql(t: Template) -> str:
    key = lambda kind, name: f"{'cls' if kind == 'Class' else 'fn'}:{{p}}:{name}"
    rows = [("node", key(kind, name), kind, name, first, last, exported, complexity, doc) for kind, name, first, last, exported, complexity, doc in t.nodes]
    links = [*t.edges, *(("file:{p}", key(kind, name), "EXPORTS", 1.0) for kind, name, *_ in t.nodes)]
    rows += [("edge", a, kind, b, 0, 0, False, confidence, None) for a, b, kind, confidence in links]
    rows += [("tag", "{p}", kind, text, line, line, False, 0.0, None) for kind, text, line in t.tags]
    values = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    fill = lambda c: f"replace(replace(replace({c}, '{{p}}', '{t.path}'), '{{k}}', CAST(p_partkey AS VARCHAR)), '{{m}}', CAST(p_partkey % 4 AS VARCHAR))"
    return f"SELECT element, {fill('a')} AS a, kind, {fill('b')} AS b, first, last, exported, value, {fill('doc')} AS doc FROM part, (VALUES {values}) v(element, a, kind, b, first, last, exported, value, doc)"


def _parts(g: Graph) -> DataFrame:
    """Keys of all parts, dealt over tasks before texts are made of them."""
    return spread(g.table("part").select("p_partkey"), "p_partkey")


def _found(g: Graph, t: Template) -> DataFrame:
    k = F.col("p_partkey")
    # stored, as each of the three plans below else parses all texts
    parsed = stored(parse.extract(_parts(g).select(_filled(t.path, k).alias("path"), F.lit(t.language).alias("language"), _filled(t.text, k).alias("content")), dealt=True), "parsed")
    none = F.lit(None).cast("string")
    nodes = parse.nodes_of(parsed).select(F.lit("node").alias("element"), F.col("id").alias("a"), "kind", F.col("name").alias("b"), F.col("line_start").alias("first"), F.col("line_end").alias("last"), "exported", F.col("complexity").alias("value"), F.col("doc_comment").alias("doc"))
    edges = parse.edges_of(parsed).select(F.lit("edge").alias("element"), F.col("src").alias("a"), "kind", F.col("dst").alias("b"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(False).alias("exported"), F.col("confidence").alias("value"), none.alias("doc"))
    tags = parse.tags_of(parsed).select(F.lit("tag").alias("element"), F.col("file_path").alias("a"), F.col("tag_type").alias("kind"), F.col("text").alias("b"), F.col("line").alias("first"), F.col("line").alias("last"), F.lit(False).alias("exported"), F.lit(0.0).alias("value"), none.alias("doc"))
    return nodes.unionByName(edges).unionByName(tags)


def _register(name: str, template: Template) -> None:
    query(name, _sql(template), graph=False)(lambda g: _found(g, template))


for _name, _template in TEMPLATES.items():
    _register(_name, _template)


# TypeScript put together from shapes: for every part eight functions, each of a shape that the part's key and the function's number say, one in another

#: {f} the function, {g} and {h} what it calls; three lines each. Beside it what is called from where: (owner, callee, confidence), m a method.
SHAPES = (
    ("function {f}(a) {\n  return `x ${a + {g}(1)} decoy(1) ${`in ${{h}(2)} {`}`;\n}\n", [("{f}", "{g}", 0.7), ("{f}", "{h}", 0.7)], []),
    ("const {f} = async (a) => {\n  return { m{f}(b: number) { return {g}(b); }, k: {h}(a) };\n};\n", [("m{f}", "{g}", 0.7), ("{f}", "{h}", 0.7)], ["m{f}"]),
    ("export function {f}(a) {\n  return /decoy\\(3\\)[/\"`{]/.test(a) ? \"decoy(4) {\" : {g}(a / 2 / {h}(a));\n}\n", [("{f}", "test", 0.7), ("{f}", "{g}", 0.7), ("{f}", "{h}", 0.7)], []),
    ("export const {f} = (a) => {\n  return <C{f} a={{g}(a)} b='decoy(5) {'>it's decoy(6) ` {{h}(`${a}`)}</C{f}>;\n};\n", [("{f}", "{g}", 0.7), ("{f}", "{h}", 0.7), ("{f}", "C{f}", 0.6)], []),
    ("function {f}(a) { /* decoy(7) ` { */\n  // decoy(8) ${ '\n  return new {g}(o{f}.{h}(a)); }\n", [("{f}", "{g}", 0.7), ("{f}", "{h}", 0.7), ("{f}", "o{f}", 0.6)], []),
)
PIECES = 8


def _shape_number(k, i):
    """Of function i of part k; the same arithmetic in SQL below."""
    return (k * (i + 3) + (k / 7).cast("long") * i + i * i) % len(SHAPES)


def _composed(g: Graph) -> DataFrame:
    k = F.col("p_partkey")
    pieces = []
    for i in range(PIECES):
        names = {"f": f"f{i}_", "g": f"g{i}_", "h": f"h{i}_"}
        text = F.lit(SHAPES[-1][0])
        for s, (shape, *_) in enumerate(SHAPES[:-1]):
            text = F.when(_shape_number(k, F.lit(i)) == s, F.lit(shape)) if s == 0 else text.when(_shape_number(k, F.lit(i)) == s, F.lit(shape))
        text = text.otherwise(F.lit(SHAPES[-1][0]))
        for name, value in names.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), F.concat(F.lit(value), k.cast("string")))
        pieces.append(text)
    return _parts(g).select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".tsx")).alias("path"), F.lit("typescript").alias("language"), F.concat(*pieces).alias("content"))


_SHAPE_ROWS = ", ".join(f"({s}, {_quoted(a)}, {_quoted(b)}, {c})" for s, (_, calls, _) in enumerate(SHAPES) for a, b, c in calls)
_OWN_ROWS = ", ".join(f"({s}, {_quoted(m)}, {str(m == '{f}' and shape.startswith('export')).lower()}, {int(m != '{f}')})" for s, (shape, _, methods) in enumerate(SHAPES) for m in ["{f}", *methods])
_PIECE_SQL = f"""WITH piece AS (SELECT p_partkey AS k, i, 'src/p' || CAST(p_partkey AS VARCHAR) || '.tsx' AS path, (p_partkey * (i + 3) + p_partkey // 7 * i + i * i) % {len(SHAPES)} AS shape FROM part, (SELECT unnest(range({PIECES})) AS i)),
named AS (SELECT *, lambda_f AS f FROM (SELECT *, 'f' || i || '_' || k AS lambda_f, 'g' || i || '_' || k AS gg, 'h' || i || '_' || k AS hh FROM piece))"""
_FILL = "replace(replace(replace({c}, '{{f}}', f), '{{g}}', gg), '{{h}}', hh)"


@query(
    "P1d_composed_calls",
    _PIECE_SQL + f" SELECT DISTINCT 'fn:' || path || ':' || {_FILL.format(c='a')} AS src, {_FILL.format(c='b')} AS dst, CAST(c AS DOUBLE) AS confidence FROM named JOIN (VALUES {_SHAPE_ROWS}) v(shape, a, b, c) USING (shape)",
    graph=False,
)
def composed_calls(g: Graph) -> DataFrame:
    """Calls inside nested templates, object methods, markup, beside regular expressions and decoys in strings and comments."""
    return parse.edges_of(parse.extract(_composed(g), dealt=True)).where("kind = 'CALLS'").select("src", "dst", "confidence")


@query(
    "P1_composed_symbols",
    _PIECE_SQL + f" SELECT 'fn:' || path || ':' || {_FILL.format(c='m')} AS id, {_FILL.format(c='m')} AS name, exported, CAST(3 * i + 1 + inner_line AS INT) AS line_start FROM named JOIN (VALUES {_OWN_ROWS}) v(shape, m, exported, inner_line) USING (shape)",
    graph=False,
)
def composed_symbols(g: Graph) -> DataFrame:
    return parse.nodes_of(parse.extract(_composed(g), dealt=True)).select("id", "name", "exported", "line_start")


# Rules in SQL that call the parsers and the text functions


@query(
    "U1_rule_parse_source",
    _PIECE_SQL + f" SELECT path AS file, path || ', ' || {_FILL.format(c='m')} || ', ' || CAST(3 * i + 1 + inner_line AS VARCHAR) AS message FROM named JOIN (VALUES {_OWN_ROWS}) v(shape, m, exported, inner_line) USING (shape) WHERE exported OR inner_line = 1",
    graph=False,
)
def rule_parse_source(g: Graph) -> DataFrame:
    """A rule over a table of files: functions that are exported or begin inside another."""
    tables.register(g.spark)
    sql = "SELECT f.path, s.name, s.line_start FROM files f, LATERAL parse_source(f.path, f.language, f.content, 'nodes') s WHERE s.kind = 'Function' AND (s.exported OR startswith(s.name, 'm'))"
    none = g.spark.createDataFrame([], "id string")
    return rules.sql_rule(g.spark, sql, none, none, files=_composed(g))


_GRAM_LIST = "list_distinct(list_transform(range(1, strlen(b) - 2), lambda i: substr(b, i, 4)))"


@query(
    "U6_rule_grams",
    f"SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(p_partkey AS VARCHAR) || ', ' || CAST(len(g) AS VARCHAR) AS message FROM (SELECT p_partkey, {_GRAM_LIST} AS g FROM (SELECT p_partkey, p_name || ' ' || p_brand AS b FROM part)) WHERE len(g) > 0",
    graph=False,
)
def rule_grams(g: Graph) -> DataFrame:
    """A rule that counts the distinct grams of each body."""
    tables.register(g.spark)
    none = g.spark.createDataFrame([], "id string")
    sql = "SELECT b.p_partkey, count(*) AS n FROM bodies b, LATERAL near_clone_grams(concat(b.p_name, ' ', b.p_brand)) g GROUP BY b.p_partkey"
    return rules.sql_rule(g.spark, sql, none, none, bodies=g.table("part"))

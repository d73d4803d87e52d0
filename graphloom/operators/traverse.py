"""Reachability: neighbourhoods, dependents, call chains, impact closures, cycles.

A step is an equi-join of the frontier with the edges in each direction it follows, never a join on
either end at once, which would plan as a nested loop. Loops that run until nothing new turns up
write each round to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.resolve import of_that_name
from graphloom.operators.storage import mark, positions, release, setting, spread, stored

DEPTH = 3


def _ends(edges: DataFrame, direction: str) -> DataFrame:
    """(at, to) of each edge as the direction walks it: out, in or both."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


#: Ids of a frontier, and ends of its edges, that go to all tasks at most.
NEAR_ROWS = 1_000_000


def _first_by_id(ends: DataFrame, cap: int | None) -> DataFrame:
    """Of each `at` the first so many `to`."""
    if cap is None:
        return ends
    from pyspark.sql import Window as W

    return ends.withColumn("_r", F.row_number().over(W.partitionBy("at").orderBy("to"))).where(F.col("_r") <= cap).drop("_r")


def _ends_near(nodes: DataFrame, edges: DataFrame, ids: DataFrame, direction: str, cap: int | None) -> DataFrame:
    """Ends (at, to) of the edges at these ids (`at`, no more than go to all tasks) that lead to nodes; no other edge is shuffled."""
    ends = stored(_first_by_id(_ends(edges, direction).join(F.broadcast(ids), "at", "left_semi").distinct(), cap), "near-ends")
    known = nodes.select(F.col("id").alias("to"))
    if ends.count() <= NEAR_ROWS:
        known = known.join(F.broadcast(ends.select("to").distinct()), "to", "left_semi")
    return ends.join(known, "to", "left_semi").select("at", "to")


def within(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, direction: str = "both", cap: int | None = None) -> DataFrame:
    """(seed, id, hops) of nodes within depth steps of each seed (a column `seed` of ids), the seeds left out.

    Only ids with a node row count, and only through such is it walked on. All seeds are walked at once, and each frontier is
    stored, so a hop's plan holds that hop alone. While a frontier is small, only the edges at it are looked at; for a larger one the ends of all
    edges are stored. A cap keeps the first neighbours by id of each node walked from.
    """
    ends = None
    frontier = stored(seeds.select("seed").distinct().select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops")), "frontier")
    seen = frontier
    for hop in range(1, depth + 1):
        at = frontier.select(F.col("id").alias("at")).where("at IS NOT NULL").distinct()
        if ends is None and at.count() > NEAR_ROWS:
            ends = stored(_first_by_id(_ends(edges, direction).distinct(), cap).join(nodes.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to"), "ends")
        near = ends if ends is not None else _ends_near(nodes, edges, at, direction, cap)
        reached = frontier.select("seed", F.col("id").alias("at")).join(near, "at").select("seed", F.col("to").alias("id")).distinct()
        frontier = stored(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def neighbours(nodes: DataFrame, edges: DataFrame, seed: str, depth: int = 1) -> DataFrame:
    """Nodes within depth (at most 3) undirected steps."""
    found = within(nodes, edges, nodes.sparkSession.createDataFrame([(seed,)], "seed string"), min(depth, DEPTH), "both")
    return nodes.join(found.select("id", "hops"), "id")


def dependents(nodes: DataFrame, edges: DataFrame, seed: str, depth: int = DEPTH) -> DataFrame:
    """Nodes that reach the seed within depth steps."""
    found = within(nodes, edges, nodes.sparkSession.createDataFrame([(seed,)], "seed string"), min(depth, DEPTH), "in")
    return nodes.join(found.select("id", "hops"), "id")


def risk(count):
    """Bucket of a number of affected nodes."""
    return F.when(count > 50, "CRITICAL").when(count > 20, "HIGH").when(count > 5, "MEDIUM").otherwise("LOW")


#: Seeds that one number holds, a bit each; numbers in a row; edges that go to all tasks at most.
LANES, WORDS, BROADCAST_EDGES = 64, 8, 2_000_000
#: Blocks that walk together at most, where the edges don't go to all tasks; lets a join's sides be dealt by a part of its keys.
TOGETHER, DEALT_SETTING = 32, "spark.sql.requireAllClusterKeysForCoPartition"
#: The place of a kind in a node's number.
KIND_BITS = 40


def _numbered(nodes: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, kinds): names (id, kind, n, known, place) of the nodes and the seeds that are none; n has the number of the kind, as in kinds (kind, code), above KIND_BITS bits."""
    names = nodes.select("id", "kind", "path").where("id IS NOT NULL").dropDuplicates(["id", "kind"]).withColumn("known", F.lit(True))
    others = seeds.select(F.col("seed").alias("id")).where("id IS NOT NULL").distinct().join(nodes.select("id"), "id", "left_anti")
    names = names.unionByName(others.select("id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("known")))
    place = F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("kind", "path")), "id", F.col("known").cast("string"))
    names = positions(names.select("id", "kind", "known", place.alias("place")), "place")
    kinds = stored(positions(nodes.select("kind").distinct(), "kind").select("kind", F.col("position").alias("code")), "kinds")
    codes = F.broadcast(kinds.toDF("_kind", "code"))  # a row a kind
    n = F.shiftleft(F.coalesce("code", F.lit(0).cast("long")), KIND_BITS) + F.col("position")
    names = names.join(codes, F.col("kind").eqNullSafe(F.col("_kind")), "left").select("id", "kind", n.alias("n"), "known", "place")
    return stored(names, "names"), kinds


def reached_masks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, direction: str = "in") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(numbered, masks, own, kinds) of a walk from all seeds at once, LANES of them in a number and WORDS numbers in a row.

    numbered has (seed, block, word, bit) a seed; masks has (block, n, m0, m1, ...), where a bit says that the block's seed of that
    word and bit reaches the node of that number within depth steps or is it; own has the same columns and only the seeds themselves; kinds is of _numbered().
    A hop joins all that was reached with the edges, to which each node's way to itself is added, and combines what arrives at a node by bit_or;
    so there is a row for a block and a node it reaches, not for a seed and a node. Seeds are in order of kind, of the least hash among the nodes that they reach,
    which is the more often the same the more of these they share, and of path. Rows are dealt by block, and what arrives is not shuffled: the edges go
    to all tasks if they are few enough; else those at the nodes that some blocks have reached go where these blocks are.
    """
    spark = nodes.sparkSession
    names, kinds = _numbered(nodes, seeds)
    keys = names.select("id", "n")
    ends = _ends(edges, direction).distinct().join(keys.toDF("at", "n_at"), "at").join(names.where("known").select(F.col("id").alias("to"), F.col("n").alias("n_to")), "to")
    ends = stored(ends.select(F.col("n_at").alias("n"), F.col("n_to").alias("to")).unionByName(names.select("n", F.col("n").alias("to"))).distinct(), "ends")
    few = ends.count() <= BROADCAST_EDGES
    least = names.select("n", F.xxhash64("n").alias("h"))
    for _ in range(depth):
        least = stored(ends.join(least.toDF("to", "h"), "to").groupBy("n").agg(F.min("h").alias("h")), "least-reached")
    # an id of several kinds has a number for each, but is one seed
    chosen = seeds.select(F.col("seed").alias("id")).distinct().join(names, "id").join(least, "n")
    place = F.concat_ws("\n", F.coalesce("kind", F.lit("")), F.lpad(F.hex("h"), 16, "0"), "place", "id")
    one = positions(chosen.groupBy(F.col("id").alias("seed")).agg(F.min(place).alias("place")), "place")
    lane = F.col("position") % (LANES * WORDS)
    numbered = one.select("seed", F.floor(F.col("position") / (LANES * WORDS)).alias("block"), F.floor(lane / LANES).cast("int").alias("word"), (lane % LANES).cast("int").alias("bit"))
    numbered = stored(numbered, "numbered-seeds")
    words = [f"m{w}" for w in range(WORDS)]
    bits = [F.when(F.col("word") == w, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")).alias(m) for w, m in enumerate(words)]
    own = stored(numbered.join(keys.toDF("seed", "n"), "seed").select("block", "n", *bits), "own-masks")
    blocks = 1 + (numbered.agg(F.max("block")).first()[0] or 0)
    group = F.floor(F.col("block") / max(1, min(TOGETHER, blocks // (4 * spark.sparkContext.defaultParallelism)))).alias("p")
    state = own
    for _ in range(depth):
        if few:
            came = spread(state, "block").join(F.broadcast(ends), "n").groupBy("block", F.col("to").alias("n"))
        else:
            there = state.select(group, "n").distinct().join(ends, "n").select("p", "n", "to")
            came = spread(state.select(group, "*"), "p").join(spread(there, "p").hint("shuffle_hash"), ["p", "n"]).groupBy("p", "block", F.col("to").alias("n"))
        with setting(spark, DEALT_SETTING, "false"):
            state = stored(came.agg(*(F.bit_or(m).alias(m) for m in words)).select("block", "n", *words), "masks")
    return numbered, state, own, kinds


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = DEPTH, direction: str = "in") -> DataFrame:
    """(seed, total, by_kind, risk) of what depends on each seed; any number of seeds, up to every node."""
    numbered, masks, own, kinds = reached_masks(nodes, edges, seeds, depth, direction)
    both = masks.withColumn("sign", F.lit(1)).unionByName(own.withColumn("sign", F.lit(-1)))  # a seed is not among what it reaches
    split = F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.col(f"m{w}").alias("mask")) for w in range(WORDS))))
    rows = both.select("block", F.shiftright("n", KIND_BITS).alias("code"), "sign", split.alias("part")).select("block", "code", "sign", "part.word", "part.mask").where("mask <> 0")
    counted = rows.groupBy("block", "word", "code").agg(*(F.sum(F.getbit("mask", F.lit(b)) * F.col("sign")).alias(f"n{b}") for b in range(LANES)))
    lanes = F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.col(f"n{b}").alias("n")) for b in range(LANES))))
    by_kind = counted.select("block", "word", "code", lanes.alias("lane")).select("block", "word", "code", "lane.bit", "lane.n").where("n > 0").join(F.broadcast(kinds), "code").join(numbered, ["block", "word", "bit"])
    by = by_kind.groupBy("seed").agg(F.sum("n").alias("total"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("by_kind"))
    out = numbered.select("seed").join(by, "seed", "left").select("seed", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("by_kind", F.lit("")).alias("by_kind"))
    return out.withColumn("risk", risk(F.col("total")))


def reachable(edges: DataFrame, seeds: DataFrame, direction: str = "out", rounds: int = 10_000) -> DataFrame:
    """(id, hops) of all ids that can be reached from any seed (a column `id`); seeds at 0.

    Each round stores its frontier; every eighth folds them into what was reached before, and deletes them.
    """
    spark = edges.sparkSession
    ends = stored(_ends(edges, direction).where("at IS NOT NULL AND to IS NOT NULL").distinct(), "ends")
    since = mark()
    seen = stored(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("hops", F.lit(0)), "reached")
    frontier = seen
    for hop in range(1, rounds + 1):
        new = frontier.select(F.col("id").alias("at")).join(ends, "at").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hops", F.lit(hop))
        frontier = stored(new, "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if hop % 8 == 0:
            seen = stored(seen, "reached")
            frontier = seen.where(F.col("hops") == hop)
            release(spark, since, keep=1)
    raise RuntimeError(f"reachable: no end after {rounds} rounds")


def shortest_chain(edges: DataFrame, source: str, target: str, rounds: int = 10_000) -> DataFrame:
    """(hops, path) of a shortest directed chain, by level the one through the smallest ids; no row if there is none.

    Each round keeps one parent for every newly met id, so a round holds as many rows as ids it meets. The way back reads those of
    eight levels at a time.
    """
    spark = edges.sparkSession
    ends = stored(_ends(edges, "out").where("at IS NOT NULL AND to IS NOT NULL").distinct(), "ends")
    schema = "hops int, path array<string>"
    if source == target:
        return spark.createDataFrame([(0, [source])], schema)
    since = mark()
    frontier = spark.createDataFrame([(source, None, 0)], "id string, parent string, level int")
    seen = frontier
    for level in range(1, rounds + 1):
        new = frontier.select(F.col("id").alias("at")).join(ends, "at").groupBy(F.col("to").alias("id")).agg(F.min("at").alias("parent"))
        frontier = stored(new.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("id") == target).isEmpty():
            return spark.createDataFrame([(level, _way_back(seen, target, level))], schema)
        if level % 8 == 0:
            seen = stored(seen, "levels")
            frontier = seen.where(F.col("level") == level)
            release(spark, since, keep=1)
    raise RuntimeError(f"shortest_chain: no end after {rounds} rounds")


def _way_back(seen: DataFrame, target: str, level: int) -> list[str]:
    """Ids from the source to the target; seen has the parent and level of each id."""
    path = [target]
    while level > 0:
        step = min(8, level)
        at = seen.where((F.col("level") == level) & (F.col("id") == path[-1])).select("id", F.col("parent").alias("p1"))
        for k in range(1, step):
            up = seen.where(F.col("level") == level - k).select(F.col("id").alias(f"p{k}"), F.col("parent").alias(f"p{k + 1}"))
            at = at.join(up, f"p{k}")
        row = at.first()
        path += [row[f"p{k}"] for k in range(1, step + 1)]
        level -= step
    return path[::-1]


def with_name_fallback(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose dst is no id lead to all nodes of that name; those that name none go. Pairs are distinct, as ids of nodes are.

    A pair that an edge has both ways is left to the names before rows are made of these, which are too many to be compared.
    """
    known = nodes.select(F.col("id").alias("dst"), "name").distinct()
    direct = edges.join(known, "dst").select("src", "dst", "name").distinct()
    rest = edges.join(known, "dst", "left_anti").select("src", F.col("dst").alias("name")).distinct()
    twice = direct.join(rest, ["src", "name"], "left_semi").select("src", "dst")
    return direct.select("src", "dst").distinct().join(twice, ["src", "dst"], "left_anti").unionByName(of_that_name(rest, known))


def impact(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """(id, role, hops): nodes in changed files (`path`), and all that depends on them, however far."""
    changed = nodes.join(changed_paths.select("path").distinct(), "path", "left_semi").select("id")
    found = reachable(edges, changed, "in")
    return found.join(nodes.select("id"), "id", "left_semi").select("id", F.when(F.col("hops") == 0, "changed").otherwise("impacted").alias("role"), "hops")


def cyclic_edges(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(src, dst) of distinct edges that lie on a cycle; self-loops are left out.

    First ids without edges in or out are peeled off until none is left. Among the rest, an edge is on a
    cycle when its ends carry the same label after forward and backward colouring: the largest id
    that reaches a node is spread along the edges, and from each colour's root the nodes of that colour that
    reach it are one strongly connected component; it is taken out, and the rest is coloured anew.
    """
    spark, since = edges.sparkSession, mark()
    live = stored(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges")
    found = live.limit(0)
    for _ in range(rounds):
        live = _peeled(live, rounds)
        if live.isEmpty():
            return found
        color = _coloured(live, rounds)
        same = stored(live.join(color.toDF("src", "cs"), "src").join(color.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("root")), "same-colour")
        members = _back_from_roots(same, rounds)
        inner = same.join(members.toDF("src"), "src", "left_semi").join(members.toDF("dst"), "dst", "left_semi").select("src", "dst")
        found = stored(found.unionByName(inner), "cyclic")
        live = stored(live.join(members.toDF("src"), "src", "left_anti").join(members.toDF("dst"), "dst", "left_anti"), "cycle-edges")
        release(spark, since, keep=2)
    raise RuntimeError(f"cycles: no end after {rounds} rounds")


def _peeled(live: DataFrame, rounds: int) -> DataFrame:
    """Edges left when ids that lack edges in or out go, again and again."""
    before, spark, since = live.count(), live.sparkSession, mark()
    for _ in range(rounds):
        kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        live = stored(kept.select("src", "dst"), "peeled")
        release(spark, since, keep=1)
        after = live.count()
        if after == before:
            return live
        before = after
    raise RuntimeError(f"peeling: no end after {rounds} rounds")


def _coloured(live: DataFrame, rounds: int) -> DataFrame:
    """(id, color): the largest id that reaches each id, itself included."""
    spark, since = live.sparkSession, mark()
    color = stored(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("color", F.col("id")), "colour")
    for _ in range(rounds):
        moved = live.join(color.toDF("src", "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("new"))
        after = stored(color.join(moved, "id", "left").select("id", F.greatest("color", "new").alias("color"), (F.col("new") > F.col("color")).alias("moved")), "colour")
        release(spark, since, keep=1)
        done = after.where("moved").isEmpty()
        color = after.select("id", "color")
        if done:
            return color
    raise RuntimeError(f"colouring: no end after {rounds} rounds")


def _back_from_roots(same: DataFrame, rounds: int) -> DataFrame:
    """(id): what reaches its colour's root inside the colour; the roots too."""
    spark, since = same.sparkSession, mark()
    seen = stored(same.select(F.col("root").alias("id"), F.lit(0).alias("round")).distinct(), "roots")
    frontier = seen
    for k in range(1, rounds + 1):
        new = same.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = stored(seen.unionByName(new.select("id", F.lit(k).alias("round"))), "roots")
        release(spark, since, keep=1)
        frontier = seen.where(F.col("round") == k)
        if frontier.isEmpty():
            return seen.select("id")
    raise RuntimeError(f"backward step: no end after {rounds} rounds")


def chain_between(nodes: DataFrame, edges: DataFrame, source: str, target: str, by_name: bool = False) -> DataFrame:
    """shortest_chain, on request with edges that only name their target."""
    return shortest_chain(with_name_fallback(nodes, edges) if by_name else edges, source, target)


def induced_by(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges between the nodes, of these kinds."""
    from graphloom.operators.lookup import induced

    return induced(nodes, edges.where(F.col("kind").isin(*kinds)) if kinds else edges)

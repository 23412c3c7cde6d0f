"""Interaction networks: edges, degree, distances, cliques and hubs."""

from __future__ import annotations

from math import factorial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.storage import cut
from strandworks.operators.graph import connected_components
from strandworks.operators.scan import numbered

#: Vertices of no more than so many times the mean degree go in one round of the peeling.
PEEL = 1.5


def undirected_edges(pairs: DataFrame, least: float = 0.4) -> DataFrame:
    """(src, dst, weight) with src < dst: the highest score of a pair, at least ``least``; self-loops go."""
    kept = pairs.where((F.col("score") >= least) & (F.col("a") != F.col("b")))
    return kept.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("score").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(edges.select(F.col("dst").alias("v"), F.col("src").alias("w")))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("v").agg(F.count("*").alias("degree"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most vertices; ties go to the smaller component id."""
    parts = connected_components(edges)
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    kept = parts.join(best, "component", "left_semi").select(F.col("vertex").alias("src"))
    return edges.join(kept, "src", "left_semi")


def core_order(edges: DataFrame) -> DataFrame:
    """(v, place): an order in which no vertex has many later neighbours, however many it has in all.

    Each round takes away the vertices of no more than PEEL times the mean degree of what is left, which is at least a
    third of it; so a vertex has at most 2 * PEEL times as many later neighbours as the densest part of the graph has
    edges for a vertex. ``place`` is the round, then the name.
    """
    left, order, n = cut(both_ways(edges)), None, 0
    while left.take(1):
        degrees = left.groupBy("v").agg(F.count("*").alias("degree"))
        mean = degrees.agg((F.avg("degree") * PEEL).alias("most"))
        gone = cut(degrees.crossJoin(F.broadcast(mean)).where(F.col("degree") <= F.col("most")).select("v", F.struct(F.lit(n).alias("round"), "v").alias("place")))  # one row
        order = gone if order is None else order.unionByName(gone)
        taken = gone.select("v")
        left = cut(left.join(taken, "v", "left_anti").join(taken.withColumnRenamed("v", "w"), "w", "left_anti"))
        n += 1
    # a vertex whose neighbours all went before it has no edge left
    every = both_ways(edges).select("v").distinct().select("v", F.struct(F.lit(n).alias("round"), "v").alias("place"))
    return every if order is None else order.unionByName(every.join(order, "v", "left_anti"))


def cliques_by_vertex(edges: DataFrame) -> DataFrame:
    """MCC of each vertex: the sum over its maximal cliques C of (|C| - 1)!, as double.

    Every clique belongs to its first vertex v in the order of ``core_order``; the others are among v's later neighbours,
    which are few. It is maximal if it is so among those, and if no earlier neighbour of v is adjacent to all of it: for
    this a task gets, of each earlier neighbour, the later ones that it is adjacent to, and each such set once.
    """
    kind = dict(edges.dtypes)["src"]
    rank = cut(core_order(edges))
    ends = both_ways(edges).join(rank, "v").join(rank.select(F.col("v").alias("w"), F.col("place").alias("pw")), "w")
    later = cut(ends.where(F.col("pw") > F.col("place")).select("v", "w"))
    first, second = later.select(F.col("v").alias("a"), F.col("w").alias("b")), later.select(F.col("v").alias("a"), F.col("w").alias("c"))
    closing = later.select(F.col("v").alias("b"), F.col("w").alias("c"))
    triangles = cut(first.join(second, "a").join(closing, ["b", "c"]))  # a before b before c
    seen = triangles.groupBy(F.col("b").alias("v"), "a").agg(F.array_sort(F.collect_list("c")).alias("set")).select("v", "set").distinct()
    none = F.lit(None).cast(kind)
    rows = later.select("v", "w", none.alias("x"), F.array().cast(f"array<{kind}>").alias("set"))
    rows = rows.unionByName(triangles.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("c").alias("x"), F.array().cast(f"array<{kind}>").alias("set")))
    rows = rows.unionByName(seen.select("v", none.alias("w"), none.alias("x"), "set"))

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        single, linked = group["x"].isna() & group["w"].notna(), group["x"].notna()
        links: dict = {u: set() for u in group.loc[single, "w"]}
        for w, x in zip(group.loc[linked, "w"], group.loc[linked, "x"], strict=True):
            links[w].add(x)
            links[x].add(w)
        covered = [set(s) for s in group.loc[group["w"].isna(), "set"]]
        score: dict = {}
        stack = [((), set(links), set())]
        while stack:
            clique, more, done = stack.pop()
            if not more:
                if not done and clique and not any(c.issuperset(clique) for c in covered):
                    for u in (key[0], *clique):
                        score[u] = score.get(u, 0.0) + float(factorial(len(clique)))
                continue
            pivot = max(more | done, key=lambda u: (len(links[u] & more), str(u)))
            more, done = set(more), set(done)
            for u in sorted(more - links[pivot], key=str):
                stack.append(((*clique, u), more & links[u], done & links[u]))
                more.discard(u)
                done.add(u)
        return pd.DataFrame({"v": list(score), "mcc": list(score.values())})

    found = rows.groupBy("v").applyInPandas(search, f"v {kind}, mcc double")
    return found.groupBy("v").agg(F.sum("mcc").alias("mcc"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(v, betweenness) of every vertex of a connected graph, normalised, by joins keyed by source and vertex.

    Level by level the shortest paths from each source are counted; backward, each vertex hands what depends on it to
    the vertices before it, in parts by their paths. The state has a row for each source and vertex. ``sources``: a
    sample of vertices by which the sums are scaled up; by default all.
    """
    steps = both_ways(edges).persist()
    vertices = cut(steps.select("v").distinct())
    asked = vertices if sources is None else sources.select("v").distinct()
    n, m = vertices.count(), asked.count()
    levels = [cut(asked.select(F.col("v").alias("s"), "v", F.lit(1.0).alias("paths")))]
    found = levels[0].select("s", "v")
    while True:
        new = levels[-1].join(steps, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        new = cut(new.join(found, ["s", "v"], "left_anti"))
        if not new.take(1):
            break
        levels.append(new)
        found = found.unionByName(new.select("s", "v"))
    total = None
    owed = levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[:-1]):
        handed = owed.select("s", "v", ((1 + F.col("share")) / F.col("paths")).alias("part")).join(steps, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("part").alias("part"))
        done = owed.select("v", "share")
        total = done if total is None else total.unionByName(done)
        owed = cut(level.join(handed, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
    steps.unpersist()
    scale = (n / m) / ((n - 1) * (n - 2)) if n > 2 and m else 0.0
    sums = total.groupBy("v").agg(F.sum("share").alias("b")) if total is not None else vertices.withColumn("b", F.lit(0.0))
    return vertices.join(sums, "v", "left").select("v", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def closeness(edges: DataFrame) -> DataFrame:
    """(reached vertices) / (sum of hops) of every vertex.

    Breadth-first searches of 64 sources at once: what a vertex has been reached by is one long of a bit for each source.
    As hops are the same both ways, a vertex's sum of hops is that of how many sources reach it anew in each round, so
    the state is one row for each vertex and 64 sources.
    """
    steps = both_ways(edges).persist()
    places = numbered(steps.select("v").distinct(), "i", [], ["v"]).withColumn("i", F.col("i") - 1)
    bit = F.expr("shiftleft(1L, cast(i % 64 AS int))")
    batches = places.select(F.floor(F.col("i") / 64).alias("batch"), "v", bit.alias("seen"), bit.alias("front"), F.lit(0).cast("long").alias("hops"), F.lit(0).cast("long").alias("reached"))
    state, hop = cut(batches), 0
    while state.where("front <> 0").take(1):
        hop += 1
        none = F.lit(0).cast("long")
        sent = state.where("front <> 0").join(steps, "v").select("batch", F.col("w").alias("v"), none.alias("seen"), F.col("front").alias("got"), none.alias("hops"), none.alias("reached"))
        held = state.select("batch", "v", "seen", none.alias("got"), "hops", "reached")
        met = held.unionByName(sent).groupBy("batch", "v").agg(F.bit_or("seen").alias("seen"), F.bit_or("got").alias("got"), F.sum("hops").alias("hops"), F.sum("reached").alias("reached"))
        new = F.col("got").bitwiseAND(F.bitwise_not("seen"))
        state = cut(met.withColumn("front", new).select("batch", "v", F.col("seen").bitwiseOR(F.col("front")).alias("seen"), "front", (F.col("hops") + hop * F.bit_count("front")).alias("hops"), (F.col("reached") + F.bit_count("front")).alias("reached")))
    steps.unpersist()
    return state.groupBy("v").agg(F.try_divide(F.sum("reached").cast("double"), F.sum("hops")).alias("closeness"))


def distances(edges: DataFrame, source: DataFrame) -> DataFrame:
    """Hops from each source to every vertex it reaches, by frontier joins: (s, v, hops). Hops go on until none is
    reached anew."""
    steps = both_ways(edges).persist()
    found = cut(source.select(F.col("v").alias("s"), "v", F.lit(0).alias("hops")))
    front, hop = found, 0
    while True:
        hop += 1
        new = cut(front.join(steps, "v").select("s", F.col("w").alias("v")).distinct().join(found, ["s", "v"], "left_anti").withColumn("hops", F.lit(hop)))
        if not new.take(1):
            break
        found, front = cut(found.unionByName(new)), new
    steps.unpersist()
    return found


def centralities(edges: DataFrame) -> DataFrame:
    """v, degree, mcc, betweenness and closeness of the vertices of a connected graph, as doubles."""
    out = degree(edges).select("v", F.col("degree").cast("double").alias("degree"))
    for part in (cliques_by_vertex(edges), betweenness(edges), closeness(edges)):
        out = out.join(part, "v", "left")
    return out.na.fill(0.0)


def hubs(metrics: DataFrame, names: list[str], top: int = 20, least: int = 3) -> DataFrame:
    """How many metrics have a vertex among their first ``top``; ties by vertex. hub: at least ``least`` do."""
    long = metrics.unpivot(["v"], names, "metric", "value").where(F.col("value").isNotNull())
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "v")))
    n = ranked.where(F.col("r") <= top).groupBy("v").agg(F.count("*").alias("n_top"))
    return metrics.join(n, "v", "left").withColumn("n_top", F.coalesce("n_top", F.lit(0))).withColumn("hub", F.col("n_top") >= least)


def hub_subnetwork(edges: DataFrame, centre: DataFrame) -> DataFrame:
    """Edges among hubs and their neighbours."""
    near = both_ways(edges).join(centre.select("v"), "v", "left_semi").select(F.col("w").alias("v")).unionByName(centre.select("v")).distinct()
    return edges.join(near.select(F.col("v").alias("src")), "src", "left_semi").join(near.select(F.col("v").alias("dst")), "dst", "left_semi")


def candidate_list(first: DataFrame, second: DataFrame, limit: int = 30) -> DataFrame:
    """Genes of the first list, then the first ``limit`` of the second, each once, with their place.

    Both have gene and order (ascending).
    """
    held = second.orderBy("order", "gene").limit(limit)
    both = first.select("gene", F.lit(0).alias("part"), "order").unionByName(held.select("gene", F.lit(1).alias("part"), "order"))
    once = both.groupBy("gene").agg(F.min(F.struct("part", "order")).alias("o"))
    return once.select("gene", F.row_number().over(Window.orderBy("o", "gene")).alias("place"))  # a short list

"""Traversal, ranking and partition measures of directed link graphs.

Iterations are saved in the shared folder so that plans stay short and survive
lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder


RUN = 1024  # ends of one node's links held as one row
PART_BYTES, LINK_BYTES = 4 << 20, 1 << 19  # of source files, and of saved links, that one task takes


def _saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, as columns: a fraction of a checkpoint's size."""
    path = shared_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, each: int | None = None) -> int:
    """In how many parts to deal ``df``, read from files, so that a task's share does not grow with them; two at least, since Spark deals one part anew."""
    size = int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return max(2, min(-(-size // (each or PART_BYTES)), 20_000))


def oriented(edges: DataFrame, mode: str) -> DataFrame:
    """Links as walked: ``out`` as they are, ``in`` reversed, ``all`` both ways."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst") if mode == "out" else back if mode == "in" else edges.select("src", "dst").union(back).distinct()


def bfs(edges: DataFrame, seeds: list, depth: int, mode: str = "out") -> DataFrame:
    """(node, hop, parent) of all nodes within ``depth`` links of the seeds; the parent is the smallest of those one hop nearer."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    edges = _saved(edges.select("src", "dst"))
    walked = oriented_all(edges) if mode == "all" else oriented(edges, mode)
    seen = spark.createDataFrame([(s, 0, None) for s in sorted(set(seeds))], f"node {kind}, hop int, parent {kind}")
    front = seen
    for hop in range(1, depth + 1):
        step = walked.join(front.select(F.col("node").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("parent"))
        front = _saved(step.select(F.col("dst").alias("node"), F.lit(hop).alias("hop"), "parent").join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def oriented_all(edges: DataFrame) -> DataFrame:
    """Each link twice, from either end; links both ways count as two."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def ball(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` links of the seeds (node), either way; ``edges`` are read once a hop."""
    ways, near = oriented_all(edges), seeds.select("node").distinct()
    for _ in range(hops):
        near = _saved(near.union(ways.join(near, ways["src"] == near["node"], "left_semi").select("dst")).distinct())
    return near


def induced(edges: DataFrame, held: DataFrame) -> DataFrame:
    """Links with both ends among ``held`` (node)."""
    for end in ("src", "dst"):
        edges = edges.join(held.select(F.col("node").alias(end)).hint("shuffle_hash"), end, "left_semi")
    return edges.select("src", "dst")


def shortest_path(edges: DataFrame, source, target, depth: int = 5, mode: str = "out") -> list:
    """Nodes from source to target, or none; of equal paths that of smallest parents."""
    found = bfs(edges, [source], depth, mode)
    path = [target]
    while path[-1] != source:
        r = found.where(F.col("node") == path[-1]).select("parent").first()
        if r is None or r[0] is None:
            return []
        path.append(r[0])
    return path[::-1]


def pattern(edges: DataFrame, seeds: DataFrame, directions: str) -> DataFrame:
    """Nodes at the end of walks that follow ``directions``, a string of ``o`` (out) and ``i`` (in)."""
    front, edges = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), _saved(edges)
    for d in directions:
        step = oriented(edges, "out" if d == "o" else "in")
        front = front.join(step, front["node"] == step["src"]).select(F.col("dst").alias("node")).distinct()
    return front


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _dealt(links: DataFrame, by: str, held: str | Column) -> DataFrame:
    """(``by``, held): what stands at the other ends of links, as lists of up to ``RUN``, saved: what a round joins to a value of ``by``."""
    links = _saved(links)
    w = Window.partitionBy(by).orderBy(by)
    ranked = links.repartition(parts(links, LINK_BYTES), by).withColumn("__run", F.floor((F.row_number().over(w) - 1) / RUN))
    return _saved(ranked.groupBy(by, "__run").agg(F.collect_list(held).alias("held")).drop("__run"))


def _met(dealt: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """Lists joined to the ``values`` of ``by``; a task holds its share of the values, and links stream past."""
    return dealt.join(values.hint("shuffle_hash"), by)


def _flow(dealt: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """(node, x): at the other ends of links, the sums of ``values`` (``by``, x)."""
    return _met(dealt, by, values).select(F.explode("held").alias("node"), "x").groupBy("node").agg(F.sum("x").alias("x"))


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, seeds: list | None = None) -> DataFrame:
    """(node, rank): ranks sum to 1; the mass of nodes without links out is spread as the restart is (evenly, or over the seeds)."""
    edges = _saved(edges.select("src", "dst"))
    every = _saved(nodes(edges).join(degrees(edges), "node", "left").fillna(0, ["out_degree"]))
    n = every.count()
    if n == 0:
        return every.select("node", F.lit(0.0).alias("rank"))
    start = F.lit(1.0 / n) if seeds is None else F.when(F.col("node").isin(seeds), F.lit(1.0 / len(set(seeds)))).otherwise(0.0)
    every = every.withColumn("start", start)
    state = every.withColumn("rank", F.col("start"))
    for _ in range(iterations):
        loose = state.where("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        share = state.where("out_degree > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share"))
        flow = edges.join(share, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("flow"))
        rank = (1 - damping) * F.col("start") + damping * (F.coalesce("flow", F.lit(0.0)) + F.lit(loose) * F.col("start"))
        state = _saved(every.join(flow, "node", "left").select("node", "out_degree", "start", rank.alias("rank")))
    return state.select("node", "rank")


def hits(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """(node, hub, authority), each scaled to a greatest value of 1."""
    edges = _saved(edges.select("src", "dst"))
    out, back, every = _dealt(edges, "src", "dst"), _dealt(edges, "dst", "src"), _saved(nodes(edges))
    hub, top = every.withColumn("hub", F.lit(1.0)), 1.0
    for _ in range(iterations):
        # Sums are saved as they are, and scaled where they are read: each is made once.
        a = _saved(_flow(out, "src", hub.select(F.col("node").alias("src"), (F.col("hub") / top).alias("x"))).select("node", F.col("x").alias("authority")))
        top = a.agg(F.max("authority")).first()[0] or 1.0
        authority = a.withColumn("authority", F.col("authority") / top)
        hub = _saved(_flow(back, "dst", authority.select(F.col("node").alias("dst"), F.col("authority").alias("x"))).select("node", F.col("x").alias("hub")))
        top = hub.agg(F.max("hub")).first()[0] or 1.0
    hub = hub.withColumn("hub", F.col("hub") / top)
    return every.join(hub, "node", "left").join(authority, "node", "left").fillna(0.0, ["hub", "authority"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of weakly connected nodes, the smallest node for a name: least labels, each round doubled by the label's own label."""
    both = _saved(oriented(edges, "all"))
    state = _saved(nodes(edges).withColumn("component", F.col("node")))
    while True:
        near = both.join(state, both["dst"] == state["node"]).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        low = state.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = state.select(F.col("node").alias("c"), F.col("component").alias("next"))
        new = _saved(low.join(jump, "c").select("node", "was", F.least("c", "next").alias("component")))
        changed = new.where("was <> component").isEmpty()
        state = new.select("node", "component")
        if changed:
            return state

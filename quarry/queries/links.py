"""Queries over links: neighbours, overlaps, traversal, ranking, communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, relational
from .base import CITES, GRAPH, Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query(f"WITH {CITES}, own AS (SELECT src FROM cites WHERE dst = 1) SELECT dst, count(DISTINCT src) AS n_shared FROM cites WHERE src IN (SELECT src FROM own) AND dst <> 1 GROUP BY dst HAVING count(DISTINCT src) >= 1 ORDER BY n_shared DESC, dst LIMIT 20")
def co_citation(t):
    return relational.overlap(t.cites(), 1, "src", "dst", 1, 20)


@query(f"WITH {CITES}, own AS (SELECT dst FROM cites WHERE src = 1) SELECT src, count(DISTINCT dst) AS n_shared FROM cites WHERE dst IN (SELECT dst FROM own) AND src <> 1 GROUP BY src HAVING count(DISTINCT dst) >= 1 ORDER BY n_shared DESC, src LIMIT 20")
def bib_coupling(t):
    return relational.overlap(t.cites(), 1, "dst", "src", 1, 20)


@query(f"WITH {CITES}, refs AS (SELECT DISTINCT dst AS p_partkey FROM cites WHERE src = 1) SELECT p_partkey, p_brand, p_retailprice FROM refs JOIN part USING (p_partkey) ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 50")
def refs_of(t):
    return relational.neighbours(t.cites(), t.part.select("p_partkey", "p_brand", "p_retailprice"), 1, "src", "dst", "p_partkey", "p_retailprice", 50)


@query(f"WITH {CITES}, refs AS (SELECT DISTINCT src AS o_orderkey FROM cites WHERE dst = 1) SELECT o_orderkey, o_totalprice FROM refs JOIN orders USING (o_orderkey) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def citations_of(t):
    return relational.neighbours(t.cites(), t.orders.select("o_orderkey", "o_totalprice"), 1, "dst", "src", "o_orderkey", "o_totalprice", 50)


@query(f"WITH {CITES} SELECT DISTINCT dst AS node FROM cites WHERE src IN (1, 2, 3)")
def multi_seed_walk(t):
    return t.cites().where(F.col("src").isin(1, 2, 3)).select(F.col("dst").alias("node")).distinct()


@query(f"WITH {CITES} SELECT o_orderkey, CAST(count(src) AS BIGINT) AS ref_count FROM orders LEFT JOIN cites ON o_orderkey = src GROUP BY o_orderkey")
def paper_counts(t):
    counts = t.cites().groupBy("src").agg(F.count("*").alias("n"))
    return t.orders.join(counts, F.col("o_orderkey") == F.col("src"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("ref_count"))


@query("SELECT l_partkey, l_orderkey, l_returnflag, total FROM (SELECT l_partkey, l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS rn, count(*) OVER (PARTITION BY l_partkey, l_orderkey) AS total FROM lineitem) WHERE rn = 1 AND l_returnflag = 'R'")
def cited_by_intent(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey", "l_orderkey")
    r = t.lineitem.withColumn("rn", F.row_number().over(w.orderBy("l_linenumber", "l_suppkey", "l_returnflag"))).withColumn("total", F.count("*").over(w))
    return r.where("rn = 1 and l_returnflag = 'R'").select("l_partkey", "l_orderkey", "l_returnflag", "total")


@query("SELECT yr, o_orderkey, o_totalprice, rn FROM (SELECT CAST(year(o_orderdate) AS INT) AS yr, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INT) AS rn FROM orders) WHERE rn <= 5")
def per_year_anchors(t):
    papers = t.orders.select(F.year("o_orderdate").alias("yr"), "o_orderkey", "o_totalprice")
    return relational.top_per_group(papers, ["yr"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 5)


@query(f"WITH {CITES} SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM cites JOIN orders ON src = o_orderkey WHERE dst IN (1, 2, 3) GROUP BY 1")
def temporal_citations(t):
    cited = t.cites().where(F.col("dst").isin(1, 2, 3))
    return cited.join(t.orders, F.col("src") == F.col("o_orderkey")).groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH}, seeds AS (SELECT p_partkey, p_brand FROM part WHERE p_partkey <= 20) SELECT DISTINCT src AS node, p_brand FROM graph JOIN part ON src = p_partkey WHERE dst IN (SELECT p_partkey FROM seeds) AND src NOT IN (SELECT p_partkey FROM seeds) AND p_brand IS NOT NULL AND p_brand NOT IN (SELECT p_brand FROM seeds WHERE p_brand IS NOT NULL)")
def find_gaps(t):
    seeds = t.part.where("p_partkey <= 20").select("p_partkey", "p_brand")
    near = t.graph().join(seeds.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    near = near.join(seeds.select(F.col("p_partkey").alias("node")), "node", "left_anti")
    placed = near.join(t.part, F.col("node") == F.col("p_partkey")).where("p_brand is not null").select("node", "p_brand")
    return placed.join(seeds.select("p_brand").where("p_brand is not null").distinct(), "p_brand", "left_anti").select("node", "p_brand")


@query("WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber % 2 = 1), u AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS k, a.l_orderkey IS NOT NULL AS in_a, b.l_orderkey IS NOT NULL AS in_b FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey) SELECT count(*) AS total, count(*) FILTER (in_a AND in_b) AS both_sides, count(*) FILTER (in_a AND NOT in_b) AS only_a, count(*) FILTER (in_b AND NOT in_a) AS only_b FROM u")
def edge_diff_overall(t):
    k = ["l_orderkey", "l_partkey"]
    d = relational.edge_diff(t.lineitem.where("l_linenumber % 2 = 0"), t.lineitem.where("l_linenumber % 2 = 1"), k)
    return d.agg(F.count("*").alias("total"), F.count_if(F.expr("in_a and in_b")).alias("both_sides"), F.count_if(F.expr("in_a and not in_b")).alias("only_a"), F.count_if(F.expr("in_b and not in_a")).alias("only_b"))


@query("SELECT l_partkey, l_suppkey, round(1 + 1e-9 - exp(sum(ln(1 - least(greatest(coalesce(1 - l_discount, 0.0) * (CASE l_linenumber % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.7 ELSE 0.5 END), 0.0), 0.999999)))), 6) AS fused, count(*) AS link_count FROM lineitem GROUP BY ALL")
def noisy_or_fusion(t):
    w = F.element_at(F.array(*map(F.lit, (0.98, 0.95, 0.85, 0.7, 0.5))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return relational.noisy_or(t.lineitem.withColumn("conf", 1 - F.col("l_discount")), ["l_partkey", "l_suppkey"], "conf", w)


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_returnflag DESC, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def claim_edges_distinct_on(t):
    return relational.top_per_group(t.lineitem, ["l_orderkey", "l_partkey"], [F.desc("l_returnflag"), F.asc("l_linenumber"), F.asc("l_suppkey")], 1).select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")


@query("SELECT l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS suppliers FROM lineitem GROUP BY l_partkey")
def doc_context(t):
    return t.lineitem.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("suppliers"))


@query(f"WITH {GRAPH}, ends AS (SELECT src AS p FROM graph UNION SELECT dst FROM graph) SELECT round(count(DISTINCT p) * 1.0 / (SELECT count(*) FROM part), 6) AS coverage FROM ends")
def coverage_probe(t):
    e = graph.nodes(t.graph()).agg(F.count_distinct("node").alias("c"))
    return e.crossJoin(t.part.agg(F.count("*").alias("n"))).select(F.round(F.col("c") / F.col("n"), 6).alias("coverage"))


@query(f"WITH RECURSIVE {GRAPH}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM walk JOIN graph ON node = src WHERE hop < 3) SELECT node, min(hop) AS hop FROM walk GROUP BY node")
def bfs_depth(t):
    return graph.bfs(t.graph(), [1], 3).select("node", "hop")


@query(f"WITH RECURSIVE {GRAPH}, ways AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph), walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM walk JOIN ways ON node = src WHERE hop < 2) SELECT hop, count(*) AS n FROM (SELECT node, min(hop) AS hop FROM walk GROUP BY node) GROUP BY hop")
def khop(t):
    return graph.bfs(t.graph(), [1], 2, "all").groupBy("hop").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH}, o AS (SELECT DISTINCT dst AS node FROM graph WHERE src = 1) SELECT DISTINCT src AS node FROM graph WHERE dst IN (SELECT node FROM o)")
def pattern_oi(t):
    return graph.pattern(t.graph(), t.part.where("p_partkey = 1").select("p_partkey"), "oi")


@query(f"WITH {GRAPH}, ego AS (SELECT dst AS node FROM graph WHERE src = 1), second AS (SELECT dst AS node, count(*) AS paths FROM graph WHERE src IN (SELECT node FROM ego) GROUP BY dst) SELECT node, paths FROM second WHERE node <> 1 ORDER BY paths DESC, node LIMIT 25")
def ego_network(t):
    g = t.graph()
    first = g.where("src = 1").select(F.col("dst").alias("src"))
    return g.join(first, "src", "left_semi").where("dst <> 1").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("paths")).orderBy(F.desc("paths"), "node").limit(25)


def _ranks(start: str, iterations: int) -> str:
    steps = [f"WITH {GRAPH}, v AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph), deg AS (SELECT src, count(*) AS d FROM graph GROUP BY src), s AS (SELECT node, {start} AS st FROM v), r0 AS (SELECT node, st AS rank FROM s)"]
    for i in range(iterations):
        steps.append(f"r{i + 1} AS (SELECT s.node, 0.15 * st + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM deg)) * st) AS rank FROM s LEFT JOIN (SELECT dst, sum(rank / d) AS flow FROM graph JOIN deg USING (src) JOIN r{i} ON r{i}.node = src GROUP BY dst) f ON f.dst = s.node)")
    return ", ".join(steps) + f" SELECT node, round(rank, 6) AS rank FROM r{iterations}"


def _materialized(sql: str) -> str:
    """Long chains of steps, each read twice, are run once a step."""
    return sql.replace(" AS (", " AS MATERIALIZED (")


@query(_materialized(_ranks("1.0 / (SELECT count(*) FROM v)", 10)))
def pagerank_10(t):
    return graph.pagerank(t.graph(), 10).select("node", F.round("rank", 6).alias("rank"))


@query(_materialized(_ranks("CASE WHEN node IN (1, 2) THEN 0.5 ELSE 0.0 END", 10)))
def ppr_10(t):
    return graph.pagerank(t.graph(), 10, seeds=[1, 2]).select("node", F.round("rank", 6).alias("rank"))


def _hubs(iterations: int) -> str:
    steps = [f"WITH {GRAPH}, h0 AS (SELECT src AS node, 1.0 AS hub FROM graph UNION SELECT dst, 1.0 FROM graph)"]
    for i in range(1, iterations + 1):
        steps.append(f"a{i} AS (SELECT dst AS node, sum(hub) AS x FROM graph JOIN h{i - 1} ON src = node GROUP BY dst), b{i} AS (SELECT node, x / (SELECT max(x) FROM a{i}) AS a FROM a{i})")
        steps.append(f"g{i} AS (SELECT src AS node, sum(a) AS x FROM graph JOIN b{i} ON dst = node GROUP BY src), h{i} AS (SELECT node, x / (SELECT max(x) FROM g{i}) AS hub FROM g{i})")
    return _materialized(", ".join(steps)) + f" SELECT h0.node, round(coalesce(h{iterations}.hub, 0), 6) AS hub, round(coalesce(b{iterations}.a, 0), 6) AS authority FROM h0 LEFT JOIN h{iterations} USING (node) LEFT JOIN b{iterations} USING (node)"


@query(_hubs(10))
def hits_10(t):
    r = graph.hits(t.graph(), 10)
    return r.select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query(f"WITH RECURSIVE {GRAPH}, ways AS (SELECT src AS a, dst AS b FROM graph UNION SELECT dst, src FROM graph), cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM ways UNION (SELECT b, min(c.component) FROM cc c JOIN ways ON c.node = a JOIN recurring.cc r ON r.node = b WHERE c.component < r.component GROUP BY b)) SELECT node, component FROM cc")
def graph_components(t):
    """Weakly connected components of the whole graph."""
    return graph.components(t.graph())


@query(f"WITH {GRAPH} SELECT a.p_brand AS src_brand, b.p_brand AS dst_brand, count(*) AS n FROM graph JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey GROUP BY ALL")
def community_heatmap(t):
    p = t.part.select("p_partkey", "p_brand")
    left = p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("src_brand"))
    right = p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("dst_brand"))
    return t.graph().join(left, "src").join(right, "dst").groupBy("src_brand", "dst_brand").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH}, x AS (SELECT a.p_brand AS s, b.p_brand AS d FROM graph JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey), m AS (SELECT count(*) AS e, count(*) FILTER (s = d) AS inside FROM x), vol AS (SELECT brand, sum(n) AS vol FROM (SELECT s AS brand, count(*) AS n FROM x GROUP BY s UNION ALL SELECT d, count(*) FROM x GROUP BY d) GROUP BY brand), cut AS (SELECT brand, sum(n) AS cut FROM (SELECT s AS brand, count(*) FILTER (s <> d) AS n FROM x GROUP BY s UNION ALL SELECT d, count(*) FILTER (s <> d) FROM x GROUP BY d) GROUP BY brand) SELECT brand, round(cut / least(vol, 2 * e - vol), 6) AS conductance, round(inside * 1.0 / e, 6) AS coverage FROM vol JOIN cut USING (brand) CROSS JOIN m")
def conductance(t):
    x = community_heatmap(t)
    e = x.agg(F.sum("n").alias("e"), F.sum(F.when(F.col("src_brand") == F.col("dst_brand"), F.col("n")).otherwise(0)).alias("inside"))
    out = F.when(F.col("src_brand") != F.col("dst_brand"), F.col("n")).otherwise(0)
    sides = x.select(F.col("src_brand").alias("brand"), "n", out.alias("out")).union(x.select("dst_brand", "n", out))
    v = sides.groupBy("brand").agg(F.sum("n").alias("vol"), F.sum("out").alias("cut"))
    return v.crossJoin(F.broadcast(e)).select("brand", F.round(F.col("cut") / F.least(F.col("vol"), 2 * F.col("e") - F.col("vol")), 6).alias("conductance"), F.round(F.col("inside") / F.col("e"), 6).alias("coverage"))

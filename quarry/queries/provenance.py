"""Queries of provenance, resolution, curation, samples and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import graph, provenance, relational, retrieval
from .base import CITES, GRAPH, Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_INTENT = "CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0.3 END"


@query(f"WITH seeds AS (SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INT) AS yr, 1.0 AS w, (o_custkey % 10) / 10.0 AS m FROM orders WHERE o_custkey < 20), hops AS (SELECT l_partkey + 1000000 AS paper, 1994 + CAST(l_partkey % 6 AS INT) AS yr, {_INTENT} AS w FROM lineitem WHERE l_orderkey IN (SELECT paper FROM seeds)), u AS (SELECT paper, min(yr) AS yr, max(w) AS w, max(m) AS m FROM (SELECT paper, yr, w, m FROM seeds UNION ALL SELECT paper, yr, w, 0.0 FROM hops) GROUP BY paper), k AS (SELECT * FROM u WHERE yr BETWEEN 1995 AND 2000 AND paper % 4 <> 1), o AS (SELECT * FROM k ORDER BY yr, w DESC, m DESC, paper LIMIT 1) SELECT o.paper AS origin, o.yr AS year, round(0.5 * w + 0.3 * CASE WHEN EXISTS (SELECT 1 FROM k, o o2 WHERE k.paper <> o2.paper AND k.yr <= o2.yr) THEN 0.5 ELSE 1.0 END + 0.2 * (m + 1) / 2, 6) AS confidence FROM o")
def claim_blame(t):
    """The origin of a claim stated by some orders: parts that they cite, in a window of years, the retracted left out."""
    seeds = t.orders.where("o_custkey < 20").select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), ((F.col("o_custkey") % 10) / 10).alias("meaning"))
    intent = F.when(F.col("l_returnflag") == "R", "result_comparison").when(F.col("l_returnflag") == "A", "method")
    cited = t.lineitem.select(F.col("l_orderkey").alias("source"), (F.col("l_partkey") + 1000000).alias("target"), (F.lit(1994) + F.col("l_partkey") % 6).cast("int").alias("year"), intent.alias("intent"))
    every = seeds.select("paper").union(cited.select("target")).distinct()
    found = provenance.claim_origin(seeds, cited, every.where("paper % 4 = 1"), 1995, 2000)
    return found.withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {CITES}, m AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13') SELECT src, count(*) AS total, count(p_partkey) AS matching, round(count(p_partkey) * 1.0 / count(*), 6) AS consistency FROM cites LEFT JOIN m ON dst = p_partkey GROUP BY src")
def citation_consistency(t):
    mentions = t.part.select(F.col("p_partkey").alias("paper"), F.col("p_brand").alias("entity"))
    return provenance.citation_consistency(t.cites(), mentions, "Brand#13").withColumn("consistency", F.round("consistency", 6))


@query("SELECT l_linenumber, l_suppkey, l_quantity, l_returnflag FROM lineitem WHERE l_orderkey = 3 AND l_partkey IN (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = 3) ORDER BY l_linenumber, l_suppkey")
def citation_context(t):
    """All contexts in which one paper cites another."""
    target = t.lineitem.where("l_orderkey = 3").agg(F.min("l_partkey")).first()[0]
    return t.lineitem.where((F.col("l_orderkey") == 3) & (F.col("l_partkey") == target)).orderBy("l_linenumber", "l_suppkey").select("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")


@query(f"WITH {GRAPH}, e AS (SELECT src AS entity, dst AS other, 'out' AS way FROM graph UNION ALL SELECT dst, src, 'in' FROM graph) SELECT p_partkey, p_brand, count(*) FILTER (way = 'out') AS n_out, count(*) FILTER (way = 'in') AS n_in, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) FILTER (way = 'out'), '') AS outgoing FROM part LEFT JOIN e ON p_partkey = entity GROUP BY ALL")
def entity_context(t):
    """Each entity with its relations both ways; one without any stays."""
    g = t.graph()
    e = g.select(F.col("src").alias("p_partkey"), F.col("dst").alias("other"), F.lit("out").alias("way")).union(g.select("dst", "src", F.lit("in")))
    out = F.col("way") == "out"
    n = e.groupBy("p_partkey").agg(F.count_if(out).alias("n_out"), F.count_if(~out).alias("n_in"), F.array_join(F.sort_array(F.collect_list(F.when(out, F.col("other").cast("string")))), ",").alias("outgoing"))
    return t.part.select("p_partkey", "p_brand").join(n, "p_partkey", "left").fillna(0, ["n_out", "n_in"]).fillna("", ["outgoing"])


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON split_part(c_name, '#', 2) = split_part(s_name, '#', 2) AND c_nationkey <> s_nationkey")
def crosswalk(t):
    """Two id schemes joined by what both carry, where they disagree on the nation."""
    a = t.customer.select("c_custkey", "c_nationkey", F.split("c_name", "#")[1].alias("k"))
    b = t.supplier.select("s_suppkey", "s_nationkey", F.split("s_name", "#")[1].alias("k"))
    return a.join(b, "k").where("c_nationkey <> s_nationkey").select("c_custkey", "s_suppkey")


@query(f"WITH {GRAPH}, s AS (SELECT p_partkey AS n FROM part WHERE p_brand = 'Brand#13'), k AS (SELECT n FROM s UNION SELECT dst FROM graph WHERE src IN (SELECT n FROM s) UNION SELECT src FROM graph WHERE dst IN (SELECT n FROM s)) SELECT src, dst FROM graph WHERE src IN (SELECT n FROM k) AND dst IN (SELECT n FROM k)")
def corpus_slice(t):
    """The links among some papers and their neighbours."""
    links = graph._saved(t.graph())
    return graph.induced(links, graph.ball(links, t.part.where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("node")), 1))


@query(f"WITH {GRAPH}, ways AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph), one AS (SELECT CAST(1 AS BIGINT) AS n UNION SELECT dst FROM ways WHERE src = 1), two AS (SELECT n FROM one UNION SELECT dst FROM ways WHERE src IN (SELECT n FROM one)), k AS (SELECT n FROM two JOIN part ON n = p_partkey ORDER BY n <> 1, p_retailprice DESC, n LIMIT 30) SELECT src, dst FROM graph WHERE src IN (SELECT n FROM k) AND dst IN (SELECT n FROM k)")
def subgraph_around(t):
    """Two hops about a seed, held to the 30 dearest nodes, the seed among them, and the links among these."""
    seed = t.part.where("p_partkey = 1").select(F.col("p_partkey").alias("node"))
    links = graph._saved(t.graph())
    near = graph.ball(links, seed, 2).join(t.part, F.col("node") == F.col("p_partkey"))
    held = near.orderBy(F.col("node") != 1, F.desc("p_retailprice"), "node").limit(30).select("node")
    return graph.induced(links, held)


_BFS = f"{GRAPH}, walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hop UNION SELECT dst, hop + 1 FROM walk JOIN graph ON node = src WHERE hop < 5), d AS (SELECT node, min(hop) AS hop FROM walk GROUP BY node)"


@query(f"WITH RECURSIVE {_BFS}, par AS (SELECT b.node, min(a.node) AS parent FROM graph JOIN d a ON a.node = src JOIN d b ON b.node = dst AND b.hop = a.hop + 1 GROUP BY b.node), path AS (SELECT node, hop FROM d WHERE node = 100 UNION ALL SELECT parent, hop - 1 FROM path JOIN par USING (node)) SELECT node, hop FROM path")
def shortest_path(t):
    """The nodes of a shortest path of five links at most, smallest parents first; no row if there is none."""
    path = graph.shortest_path(t.graph(), 1, 100, 5)
    return t.spark.createDataFrame([(n, i) for i, n in enumerate(path)], "node long, hop int")


@query(f"WITH {GRAPH}, deg AS (SELECT n, count(*) AS degree FROM (SELECT src AS n FROM graph UNION ALL SELECT dst FROM graph) GROUP BY n) SELECT CAST(count(*) AS BIGINT) AS papers, CAST(count(n) AS BIGINT) AS linked, max(degree) AS top FROM part LEFT JOIN deg ON n = p_partkey")
def degree_filter(t):
    """How many papers have links, and the greatest degree."""
    deg = graph.oriented_all(t.graph()).groupBy(F.col("src").alias("p_partkey")).agg(F.count("*").alias("degree"))
    return t.part.join(deg, "p_partkey", "left").agg(F.count("*").alias("papers"), F.count("degree").alias("linked"), F.max("degree").alias("top"))


@query("SELECT CAST(CASE WHEN l <> 9 THEN l END AS INT) AS label, CAST(count(*) AS BIGINT) AS n FROM (WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE label < 8), c AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) GROUP BY label), b AS (SELECT vec_id, c.label, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, c.label) AS rn FROM e CROSS JOIN c WHERE e.label >= 8) SELECT label AS l FROM b WHERE rn = 1) GROUP BY ALL")
def small_components(t):
    """Members of small communities by the nearest centroid of the large ones, which are few."""
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = e.where("label < 8").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c"))
    return retrieval.nearest_centroid(e.where("label >= 8"), "vec_id", "v", c, "label").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN p_brand WHEN p_type LIKE 'Brand#1%' THEN p_type ELSE p_name END AS class FROM part")
def taxonomic_community(t):
    """The first class of a family, else the first."""
    classes = F.array("p_name", "p_brand", "p_type")
    own = F.filter(classes, lambda c: c.startswith("Brand#1"))
    return t.part.select("p_partkey", F.coalesce(F.get(own, 0), F.get(classes, 0)).alias("class"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1) AND p_partkey <> 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def explore_community(t):
    own = t.part.where("p_partkey = 1").select("p_brand")
    return t.part.where("p_partkey <> 1").join(F.broadcast(own), "p_brand", "left_semi").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_retailprice")


@query("SELECT doc_id, source, CAST(rn AS INT) AS rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) WHERE rn <= 3")
def community_sample(t):
    """Three members of each community, drawn by the digest of their ids."""
    return relational.drawn(t.documents, ["source"], "doc_id", 3).select("doc_id", "source", "rn")


@query("WITH t AS (SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_totalprice, o_orderkey) AS INT) AS tier FROM orders) SELECT o_orderkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM t) WHERE rn <= 20")
def stratified_sample(t):
    """Twenty papers of each fifth of the citation counts."""
    from .corpus import ntile_tiers

    return relational.drawn(ntile_tiers(t), ["tier"], "o_orderkey", 20).select("o_orderkey", "tier")


@query("SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n, count(DISTINCT o_custkey) AS authors FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def temporal_publications(t):
    """Publications by year of what a query finds."""
    return t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("authors"))


@query("SELECT l_suppkey, count(*) AS links, count(DISTINCT l_partkey) AS entities, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tiers FROM lineitem GROUP BY l_suppkey")
def link_stats(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("links"), F.count_distinct("l_partkey").alias("entities"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("tiers"))


@query("WITH m AS (SELECT max(ts) AS last FROM events), r AS (SELECT * FROM events, m WHERE ts >= last - INTERVAL 14 DAY) SELECT user_id, count(*) FILTER (event_type = 'error') AS zero_results, count(*) FILTER (event_type <> 'error') AS hits, round(sum(value), 4) AS weight FROM r GROUP BY user_id")
def core_curation(t):
    """Two passes over the last fortnight of a log: queries without and with results, by entity."""
    recent = t.events.crossJoin(F.broadcast(t.events.agg(F.max("ts").alias("last")))).where("ts >= last - interval 14 days")  # one row
    miss = F.col("event_type") == "error"
    return recent.groupBy("user_id").agg(F.count_if(miss).alias("zero_results"), F.count_if(~miss).alias("hits"), F.round(F.sum("value"), 4).alias("weight"))


@query("WITH h AS (SELECT user_id, count(*) AS hits, min(ts) AS since FROM events GROUP BY user_id) SELECT user_id, hits FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, since DESC, user_id) AS rn FROM h) WHERE rn > 10")
def core_eviction(t):
    """What a core of ten gives up: fewest hits first, then the oldest."""
    h = t.events.groupBy("user_id").agg(F.count("*").alias("hits"), F.min("ts").alias("since"))
    held = h.orderBy(F.desc("hits"), F.desc("since"), "user_id").limit(10)
    return h.join(held, "user_id", "left_anti").select("user_id", "hits")


@query("SELECT lang, count(*) AS n, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, round(100.0 * count(*) FILTER (quality IS NULL) / count(*), 4) AS gap_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def metadata_gaps(t):
    d = t.documents.select("doc_id", "lang", "text").join(t.labels, "doc_id", "left")
    none = F.col("quality").isNull()
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(none).alias("unlabelled"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), F.round(100 * F.count_if(none) / F.count("*"), 4).alias("gap_pct"))


@query("WITH c AS (SELECT quality * 2 AS a, CASE WHEN toxic = 1 THEN 0 ELSE quality + 1 END AS b FROM labels), t AS (SELECT count(*) * 1.0 AS n FROM c), o AS (SELECT sum((a - b) * (a - b)) AS o FROM c), e AS (SELECT sum(x.n * y.n * (x.a - y.b) * (x.a - y.b)) AS e FROM (SELECT a, count(*) AS n FROM c GROUP BY a) x, (SELECT b, count(*) AS n FROM c GROUP BY b) y) SELECT round(1 - o * n / e, 6) AS weighted_kappa FROM t, o, e")
def weighted_kappa(t):
    b = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1)
    return stats.weighted_kappa(t.labels.select((F.col("quality") * 2).alias("a"), b.alias("b")), "a", "b")


@query("WITH x AS (SELECT l_orderkey AS q, l_partkey AS id, max(CASE WHEN l_linenumber % 2 = 0 OR l_quantity > 25 THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_linenumber % 2 = 1 OR l_quantity < 20 THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY ALL), j AS (SELECT q, sum(a * b) * 1.0 / sum(greatest(a, b)) AS j FROM x GROUP BY q) SELECT count(*) AS queries, round(avg(1 - j), 6) AS mean_divergence, round(quantile_cont(1 - j, 0.9), 6) AS p90, quantile_cont(1 - j, 0.9) <= 0.5 AS passed FROM j")
def lane_divergence(t):
    """How far two lanes' answers differ: 1 - Jaccard by query, its mean and 90th percentile against a gate."""
    c = F.col
    one, two = (c("l_linenumber") % 2 == 0) | (c("l_quantity") > 25), (c("l_linenumber") % 2 == 1) | (c("l_quantity") < 20)
    return stats.divergence(t.lineitem.select(c("l_orderkey").alias("q"), c("l_partkey").alias("id"), one.alias("a"), two.alias("b")), 0.5)


@query("SELECT conv_id, count(*) AS steps, max(turn) + 1 AS depth, count(DISTINCT role) AS roles, string_agg(substr(role, 1, 1), '' ORDER BY turn, role, text) AS path FROM conversations GROUP BY conv_id")
def trace_summaries(t):
    """Length, depth and the sequence of roles of each trace."""
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.substring(x["role"], 1, 1)), "")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("steps"), (F.max("turn") + 1).alias("depth"), F.count_distinct("role").alias("roles"), path.alias("path"))


@query("WITH r AS (SELECT o_custkey % 10 AS task, o_orderpriority AS variant, o_orderstatus AS choice, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT task, variant, sum(n) AS n, max(n) AS modal, coalesce(sum(n) FILTER (choice = 'F'), 0) AS good FROM r GROUP BY ALL) SELECT variant, round(sum(good) * 1.0 / sum(n), 6) AS accuracy, round(avg(modal * 1.0 / n), 6) AS consistency FROM m GROUP BY variant")
def tool_scoring(t):
    """Accuracy of choices against an answer, and how far runs of one task agree, by variant."""
    r = t.orders.groupBy((F.col("o_custkey") % 10).alias("task"), F.col("o_orderpriority").alias("variant"), "o_orderstatus").agg(F.count("*").alias("n"))
    m = r.groupBy("task", "variant").agg(F.sum("n").alias("n"), F.max("n").alias("modal"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("n")).otherwise(0)).alias("good"))
    return m.groupBy("variant").agg(F.round(F.sum("good") / F.sum("n"), 6).alias("accuracy"), F.round(F.avg(F.col("modal") / F.col("n")), 6).alias("consistency"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH n AS (SELECT DISTINCT p_brand AS entity, p_brand AS name, 'canonical' AS kind, p_type AS field FROM part WHERE p_partkey < 60 UNION SELECT DISTINCT p_brand, p_name, 'alias', p_type FROM part WHERE p_partkey < 60 UNION SELECT DISTINCT p_brand, 'id:' || p_partkey, 'identifier', p_type FROM part WHERE p_partkey < 60),
    m AS (SELECT unnest(['brand#13', 'cold widget', 'ID:2', 'coldest widgets', 'brandy 13', 'nothing']) AS mention), h AS (SELECT mention, entity, kind, field FROM m JOIN n ON lower(mention) = lower(name)),
    x AS (SELECT mention, entity, field, CASE kind WHEN 'canonical' THEN 1.0 WHEN 'alias' THEN 0.9 ELSE 0.85 END AS score FROM h WHERE kind <> 'alias' OR mention NOT IN (SELECT mention FROM h WHERE kind = 'canonical')),
    f AS (SELECT mention, entity, field, len(list_intersect(a, b)) * 1.0 / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM (SELECT mention, entity, field, {_GRAMS.format('mention')} AS a, {_GRAMS.format('name')} AS b FROM m CROSS JOIN n WHERE kind <> 'identifier' AND mention NOT IN (SELECT mention FROM h)) WHERE len(list_intersect(a, b)) * 1.0 / (len(a) + len(b) - len(list_intersect(a, b))) > 0.3)
    SELECT mention, entity, round(max(least(1.0, score + CASE WHEN field = 'PROMO' THEN 0.05 ELSE 0 END)), 6) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM f) GROUP BY ALL""")
def resolve_fuzzy(t):
    """The whole ladder: canonical, alias, identifier, trigrams, and the bonus of the same field."""
    p = t.part.where("p_partkey < 60").select(F.col("p_brand").alias("entity"), "p_name", "p_partkey", F.col("p_type").alias("field"))
    names = p.select("entity", F.col("entity").alias("name"), F.lit("canonical").alias("kind"), "field").union(p.select("entity", "p_name", F.lit("alias"), "field")).union(p.select("entity", F.concat(F.lit("id:"), F.col("p_partkey").cast("string")), F.lit("identifier"), "field")).distinct()
    asked = t.spark.createDataFrame([(x,) for x in ("brand#13", "cold widget", "ID:2", "coldest widgets", "brandy 13", "nothing")], "mention string")
    return provenance.resolve(asked, names, 0.3, "PROMO").withColumn("score", F.round("score", 6))


@query("WITH l AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS entity FROM lineitem), w AS (SELECT p_partkey AS part, p_partkey // 10 AS whole FROM part WHERE p_partkey % 10 < 3) SELECT DISTINCT paper, whole AS entity FROM l JOIN w ON entity = part WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.paper = l.paper AND x.entity = w.whole)")
def part_of_inheritance(t):
    links = t.cites().select(F.col("src").alias("paper"), F.col("dst").alias("entity"))
    return provenance.inherited(links, t.part.where("p_partkey % 10 < 3").select(F.col("p_partkey").alias("part"), F.floor(F.col("p_partkey") / 10).alias("whole")))


@query("WITH n AS (SELECT DISTINCT p_partkey AS entity, p_name AS name, 'canonical' AS kind, p_brand AS source FROM part UNION ALL SELECT p_partkey, p_type, 'alias', p_brand FROM part WHERE p_partkey % 9 = 0), s AS (SELECT lower(name) AS k, count(DISTINCT entity) AS owners, count(DISTINCT source) AS sources FROM n GROUP BY 1), e AS (SELECT entity, max(CASE WHEN length(trim(name)) < 3 OR lower(name) IN ('promo', 'large bolt') THEN 1 ELSE 0 END) AS bad, max(owners) AS owners, max(sources) AS sources, max(length(trim(name))) FILTER (kind = 'canonical') AS len FROM n JOIN s ON lower(name) = k GROUP BY entity) SELECT entity, CASE WHEN bad = 1 THEN 'banned' WHEN owners > 1 THEN 'homograph' WHEN len >= 6 AND sources = 1 THEN 'domain_safe' ELSE 'unique' END AS class FROM e")
def ambiguity(t):
    n = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.lit("canonical").alias("kind"), F.col("p_brand").alias("source"))
    n = n.union(t.part.where("p_partkey % 9 = 0").select("p_partkey", "p_type", F.lit("alias"), "p_brand"))
    return provenance.ambiguity(n, ["promo", "large bolt"])


@query("SELECT DISTINCT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT 'EARTH', r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def relationship_edges(t):
    """Steps of hierarchy paths as edges."""
    path = F.concat_ws(" > ", F.lit("EARTH"), "r_name", "n_name")
    p = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.explode(provenance.hierarchy_edges(path)).alias("e"))
    return p.select("e.parent", "e.child").distinct()


@query("SELECT DISTINCT p_partkey, 'N:' || n AS concept FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part) JOIN (SELECT DISTINCT p_size AS n, lower(split_part(p_name, ' ', 1)) AS name FROM part WHERE p_partkey < 20) ON lower(k) = name")
def keyword_concepts(t):
    """Keywords that equal a concept's label."""
    labels = t.part.where("p_partkey < 20").select(F.concat(F.lit("N:"), F.col("p_size").cast("string")).alias("concept"), F.lower(F.split("p_name", " ")[0]).alias("k")).distinct()
    words = t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("k")).distinct()
    return words.join(labels, "k").select("p_partkey", "concept").distinct()


@query("SELECT conv_id, turn, role, round(CASE WHEN c = '' OR q IS NULL THEN 0 WHEN contains(q, c) OR contains(c, q) THEN 0.95 ELSE least(0.95, len(list_intersect(list_distinct(string_split(c, ' ')), list_distinct(string_split(q, ' ')))) * 1.0 / len(list_distinct(string_split(c, ' ')))) END, 6) AS score FROM (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS c, (SELECT any_value(trim(regexp_replace(lower(x.text), '[^a-z0-9]+', ' ', 'g'))) FROM conversations x WHERE x.conv_id = t.conv_id AND x.turn = 0 AND x.role <> 'system') AS q FROM conversations t)")
def grounding(t):
    """How far each turn is grounded in its conversation's first."""
    c = t.conversations
    first = c.where("turn = 0 and role <> 'system'").select("conv_id", F.col("text").alias("quote"))
    s = provenance.grounded(c.select(F.struct("conv_id", "turn", "role").alias("id"), "conv_id", F.col("text").alias("claim")), first, "conv_id")
    return s.select("id.conv_id", "id.turn", "id.role", F.round("score", 6).alias("score"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 400 AS INT) AS batch FROM events WHERE event_id > 100")
def keyset_batches(t):
    """Micro-batches by key: each page begins after the last key of the one before."""
    return provenance.keyset_batches(t.events.select("event_id"), "event_id", 100, 400)


@query("SELECT CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS INT) AS shard, count(*) AS n FROM orders GROUP BY ALL")
def hash_shards(t):
    return t.orders.groupBy(provenance.shard(F.col("o_orderkey"), 8).alias("shard")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT strftime(ts + INTERVAL 14 DAY, '%Y-%m-%d') AS expires_on, count(*) AS n FROM events, m WHERE ts + INTERVAL 14 DAY > now GROUP BY ALL")
def ttl_partitions(t):
    """Live rows of a cache by the day on which they expire."""
    now = t.events.agg(F.max("ts")).first()[0]
    return provenance.live_rows(t.events, "ts", F.lit(now).cast("timestamp_ntz")).groupBy(F.col("expires_on").cast("string").alias("expires_on")).agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT event_id, CAST(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS failures, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 3 AS open FROM x")
def circuit_breaker(t):
    e = provenance.breaker(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
    return e.select("event_id", "failures", "open")


@query("SELECT event_type, event_id, CAST(rn AS INT) AS age FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def event_ring(t):
    """The last 50 events of each type."""
    return relational.top_per_group(t.events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 50, "age").select("event_type", "event_id", "age")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*(?:±|\\+/-)\\s*[0-9]+')) AS claims, CASE WHEN regexp_matches(lower(text), '\\b(null result|no evidence (of|for)|failed to (detect|find|replicate))\\b') THEN 'high' WHEN regexp_matches(lower(text), '\\b(not significant|no significant|did not (find|detect|observe))\\b') THEN 'medium' WHEN regexp_matches(lower(text), '\\b(inconclusive|unlikely|could not)\\b') THEN 'low' END AS negative FROM documents")
def negative_results(t):
    return t.documents.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+(?:\\.[0-9]+)?\\s*(?:±|\\+/-)\\s*[0-9]+"), 0)).cast("long").alias("claims"), text.negative_tier(F.col("text")).alias("negative"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'conclusion|summary|discussion') THEN 'conclusion' WHEN regexp_matches(lower(p_name), 'method|data|observation|experiment') THEN 'method' WHEN p_size % 3 = 0 THEN 'result' WHEN p_size % 3 = 1 THEN 'background' ELSE 'other' END AS role FROM part")
def section_roles(t):
    """Roles of headings: here a part's name with a word that names a role, or none."""
    extra = F.get(F.array(F.lit(" Findings"), F.lit(" Related work"), F.lit("")), F.col("p_size") % 3)
    return t.part.select("p_partkey", text.section_role(F.concat("p_name", extra)).alias("role"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CAST(unnest(CASE WHEN l_linenumber % 3 = 0 THEN [l_linenumber] WHEN l_linenumber % 3 = 1 THEN [l_linenumber, l_linenumber + 2, l_linenumber + 3] ELSE [] END) AS INT) AS marker FROM lineitem")
def citation_markers(t):
    """Numbers that a text cites, ranges expanded."""
    n = F.col("l_linenumber")
    body = F.when(n % 3 == 0, F.format_string("as in [%d] and (3)", n)).when(n % 3 == 1, F.format_string("see [%d, %d-%d]", n, n + 2, n + 3)).otherwise("none [a]")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.explode(text.citation_markers(body)).alias("marker"))

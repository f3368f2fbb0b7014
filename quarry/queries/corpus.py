"""Queries over papers, entities, texts, vectors, logs and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import entities, relational, retrieval
from .base import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY n DESC, value LIMIT 10")
def facet_scalar(t):
    return relational.facet(t.documents, "lang", 10)


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value ORDER BY n DESC, value LIMIT 20")
def facet_array(t):
    return relational.facet(t.part, F.explode(F.split("p_name", " ")), 20)


@query("SELECT source AS value, count(*) AS n FROM documents WHERE lang = 'en' AND n_chars >= 1000 AND source ILIKE '%src1%' GROUP BY source ORDER BY n DESC, value LIMIT 10")
def facet_filtered(t):
    return relational.facet(relational.paper_filter(t.documents, "n_chars", 1000, equals={"lang": "en"}, ilike={"source": "src1"}), "source", 10)


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def entity_semi_join(t):
    return t.part.join(t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey <= 10)")
def scope_anti_join(t):
    o = t.orders.where(F.year("o_orderdate").between(1996, 1998))
    return o.join(t.lineitem.where("l_suppkey <= 10").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_totalprice, o_orderkey) AS INT) AS tier FROM orders")
def ntile_tiers(t):
    """Ranks come from counts below each price band, so no task sorts all rows."""
    return stats.ntile(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5, "tier").select("o_orderkey", "tier")


@query("SELECT event_type AS tool, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, tool, k LIMIT 20")
def log_top(t):
    return t.events.groupBy(F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool", "k").limit(20)


@query("SELECT user_id, count(*) AS calls, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_pct FROM events GROUP BY user_id")
def log_failure_rate(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(100 * F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("failure_pct"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_latency(t):
    return t.events.groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


@query("WITH w AS (SELECT p_brand AS community, unnest(string_split(p_name, ' ')) AS term FROM part), tf AS (SELECT community, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(DISTINCT community) AS df FROM w GROUP BY term), n AS (SELECT count(DISTINCT community) AS n FROM w), s AS (SELECT community, term, round(tf * ln(n * 1.0 / greatest(df, 1)), 6) AS score FROM tf JOIN df USING (term) CROSS JOIN n) SELECT community, term, score, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY score DESC, term) AS INT) AS rn FROM s) WHERE rn <= 5")
def tfidf_labels(t):
    w = t.part.select(F.col("p_brand").alias("community"), F.explode(F.split("p_name", " ")).alias("term"))
    tf = w.groupBy("community", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.count_distinct("community").alias("n"))
    s = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log(F.col("n") / F.greatest("df", F.lit(1))), 6))
    return relational.top_per_group(s, ["community"], [F.desc("score"), F.asc("term")], 5).select("community", "term", "score", "rn")


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln(any_value(n) * 1.0 / count(*)), 6) AS idf FROM w, n GROUP BY term HAVING count(*) * 10 <= any_value(n)")
def specificity_idf(t):
    """Terms of at most a tenth of the texts."""
    df = t.documents.select("doc_id", F.explode(F.array_distinct(retrieval.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(t.documents.agg(F.count("*").alias("n")))).where("df * 10 <= n").select("term", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))  # one row


@query("WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT count(*) AS communities, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(stddev_pop(n), 6) AS std, count(*) FILTER (n = 1) AS singletons FROM s")
def community_sizes(t):
    s = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("communities"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.median("n"), 6).alias("median"), F.round(F.stddev_pop("n"), 6).alias("std"), F.count_if(F.col("n") == 1).alias("singletons"))


@query("WITH c AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), ca AS (SELECT a, sum(n) AS na FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM c JOIN ca USING (a) JOIN cb USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS ha FROM ca, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM cb, t) SELECT round(CASE WHEN ha + hb = 0 THEN 1 ELSE 2 * mi / (ha + hb) END, 6) AS nmi FROM mi, ha, hb")
def nmi(t):
    return stats.entropy_terms(t.part, "p_brand", "p_type")


@query("SELECT community, yr, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT o_orderpriority AS community FROM orders) CROSS JOIN (SELECT CAST(unnest(generate_series(1994, 2002)) AS INT) AS yr) LEFT JOIN (SELECT o_orderpriority AS community, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM orders GROUP BY ALL) USING (community, yr)")
def stream_dense(t):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("community"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return relational.dense_counts(c, "community", "yr", 1994, 2002)


@query("WITH c AS (SELECT CAST(floor(year(o_orderdate) / 2) * 2 AS INT) AS d, o_orderpriority AS c, count(*) AS n FROM orders GROUP BY ALL) SELECT a.d AS d_from, b.d AS d_to, a.c AS community, b.n AS value FROM c a JOIN c b ON b.d = a.d + 2 AND a.c = b.c ORDER BY value DESC, d_from, community LIMIT 20")
def sankey(t):
    c = t.orders.groupBy((F.floor(F.year("o_orderdate") / 2) * 2).cast("int").alias("d"), F.col("o_orderpriority").alias("community")).agg(F.count("*").alias("n"))
    later = c.select((F.col("d") - 2).alias("d"), "community", F.col("n").alias("value"))
    return c.join(later, ["d", "community"]).select(F.col("d").alias("d_from"), (F.col("d") + 2).alias("d_to"), "community", "value").orderBy(F.desc("value"), "d_from", "community").limit(20)


@query("WITH p AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang), q AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), x AS (SELECT q.lang, coalesce(p.n, 0) * 1.0 / (SELECT sum(n) FROM p) AS pp, q.n * 1.0 / (SELECT sum(n) FROM q) AS qq FROM q LEFT JOIN p USING (lang)) SELECT lang, round(pp / greatest(qq, 1e-12), 6) AS ratio, round(CASE WHEN pp > 0 THEN pp * ln(pp / greatest(qq, 1e-12)) ELSE 0 END, 6) AS kl_part FROM x")
def kl_coverage(t):
    docs = t.documents.select("doc_id", "lang")
    q = docs.groupBy("lang").agg(F.count("*").alias("qn"))
    p = docs.join(t.labels, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("pn"))
    x = q.join(p, "lang", "left").fillna(0, ["pn"])
    total = x.agg(F.sum("pn").alias("pt"), F.sum("qn").alias("qt"))
    pp, qq = F.col("pn") / F.col("pt"), F.greatest(F.col("qn") / F.col("qt"), F.lit(1e-12))
    return x.crossJoin(F.broadcast(total)).select("lang", F.round(pp / qq, 6).alias("ratio"), F.round(F.when(pp > 0, pp * F.log(pp / qq)).otherwise(0.0), 6).alias("kl_part"))


@query("WITH x AS (SELECT source, count(*) * 1.0 AS n, count(*) FILTER (quality = 1) * 1.0 AS k FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, round((k / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((k / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM x")
def wilson(t):
    x = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("quality") == 1).cast("double").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return x.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("WITH c AS (SELECT quality AS a, 1 - toxic AS b FROM labels), t AS (SELECT count(*) * 1.0 AS n, count(*) FILTER (a = b) * 1.0 AS s FROM c), e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a AS k, count(*) AS n FROM c GROUP BY a) x JOIN (SELECT b AS k, count(*) AS n FROM c GROUP BY b) y USING (k)) SELECT round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM t, e")
def kappa(t):
    return stats.kappa(t.labels.select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b")


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(t):
    return stats.spearman(t.lineitem, "l_quantity", "l_discount")


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1)"
_COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT q FROM {_Q})), 6)"


def _query_vector(t) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 1").select("embedding").first()[0]]


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vec_topk(t):
    return retrieval.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 20)


@query(f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def vec_filter_first(t):
    return retrieval.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 20, F.col("label") == 3)


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE vec_id IN (1, 2, 3)), q AS (SELECT list(y ORDER BY i) AS q FROM (SELECT i, 2 * avg(x) FILTER (vec_id < 3) - avg(x) FILTER (vec_id = 3) AS y FROM u GROUP BY i)) SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def vec_recommend(t):
    """Twice the mean of the liked less the mean of the disliked; the examples themselves are left out."""
    rows = {r.vec_id: r.embedding for r in t.embeddings.where("vec_id in (1, 2, 3)").collect()}
    q = [(a + b) - c for a, b, c in zip(rows[1], rows[2], rows[3])]
    return retrieval.vector_search(t.embeddings, "vec_id", "embedding", q, 10, ~F.col("vec_id").isin(1, 2, 3))


_HITS = "round(len(regexp_extract_all(lower(text), '\\b(?:the|and)\\b')) * 1.0 / (length(text) + 50), 6)"


@query(f"SELECT doc_id, {_HITS} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def section_score(t):
    return t.documents.select("doc_id", F.round(retrieval.section_score("text", ["the", "and"]), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"SELECT doc_id, {_HITS} AS score FROM documents WHERE list_contains({TOKENS.format('text')}, 'the') AND list_contains({TOKENS.format('text')}, 'and') ORDER BY score DESC, doc_id LIMIT 20")
def lexical_and(t):
    return retrieval.match_all(t.documents, "doc_id", "text", ["the", "and"], 20)


@query(f"WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT doc_id, {_HITS} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 50)), b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50)) SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 20")
def rrf_hybrid(t):
    lexical = t.documents.select("doc_id", F.round(retrieval.section_score("text", ["the", "and"]), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)
    vector = retrieval.vector_search(t.embeddings, "vec_id", "embedding", _query_vector(t), 50).withColumnRenamed("vec_id", "doc_id")
    return retrieval.rrf([lexical, vector], "doc_id", "score")


@query("SELECT doc_id, CASE WHEN strpos(lower(text), 'license') > 0 THEN substr(text, greatest(strpos(lower(text), 'license') - 20, 1), 47) ELSE substr(text, 1, 40) END AS snippet FROM documents")
def snippet(t):
    return t.documents.select("doc_id", retrieval.snippet("text", "license", 20).alias("snippet"))


@query(f"WITH s AS (SELECT doc_id, len({TOKENS.format('text')}) AS total FROM documents), c AS (SELECT doc_id, total, unnest(generate_series(0, greatest(total - 1, 0), 448)) AS st FROM s WHERE total > 0) SELECT doc_id, CAST(st / 448 AS INT) AS chunk, CAST(least(512, total - st) AS INT) AS n FROM c WHERE least(512, total - st) >= 64 OR st = 0")
def chunk_windows(t):
    return retrieval.chunks(t.documents, "doc_id", "text")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[!-/:-@\\[-`{-~]', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS norm FROM part")
def normalize(t):
    return t.part.select("p_partkey", text.normalise(F.col("p_name")).alias("norm"))


@query("WITH n AS (SELECT DISTINCT p_brand AS name FROM part), g AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS k FROM part), nm AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS e, 'canonical' AS kind, lower(split_part(p_type, ' ', 1)) AS k FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'alias', lower(split_part(p_name, ' ', 1)) FROM part) SELECT p_partkey, e AS entity, min(kind) AS match_source FROM g JOIN nm USING (k) GROUP BY ALL")
def tier1_link(t):
    names = t.part.select(F.split("p_type", " ")[0].alias("entity"), F.lit("canonical").alias("kind")).union(t.part.select(F.split("p_name", " ")[0], F.lit("alias"))).distinct().withColumn("name", F.col("entity"))
    return entities.keyword_links(t.part.select("p_partkey", F.split("p_name", " ").alias("kw")), "p_partkey", "kw", names)


@query("WITH m AS (SELECT DISTINCT p_brand AS mention FROM part UNION SELECT DISTINCT p_type FROM part), n AS (SELECT DISTINCT p_brand AS entity, p_brand AS name, 'canonical' AS kind FROM part UNION SELECT DISTINCT p_brand, p_type, 'alias' FROM part), ex AS (SELECT mention, entity FROM m JOIN n ON lower(mention) = lower(name) WHERE kind = 'canonical') SELECT mention, entity, 1.0 AS score FROM ex UNION SELECT mention, entity, 0.9 FROM m JOIN n ON lower(mention) = lower(name) WHERE kind = 'alias' AND mention NOT IN (SELECT mention FROM ex)")
def resolve_ladder(t):
    m = t.part.select(F.col("p_brand").alias("mention")).union(t.part.select("p_type")).distinct()
    n = t.part.select(F.col("p_brand").alias("entity"), F.col("p_brand").alias("name"), F.lit("canonical").alias("kind")).union(t.part.select("p_brand", "p_type", F.lit("alias"))).distinct()
    return entities.resolve(m, n)


@query(f"WITH t AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark), g AS (SELECT item_id, unnest(w) AS gram FROM t UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def ngram_counts(t):
    return entities.ngrams(t.benchmark, "item_id", "text", 2).groupBy("gram").agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, CAST(count(c_custkey) AS BIGINT) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def hierarchy_descendants(t):
    tree = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return tree.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("WITH new AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 10), old AS (SELECT s_suppkey AS k FROM supplier), x AS (SELECT (SELECT count(*) FROM new) AS n_new, (SELECT count(*) FROM old) AS n_old, (SELECT count(*) FROM new WHERE k NOT IN (SELECT k FROM old)) AS orphans) SELECT n_new, n_old, orphans, n_new >= 0.98 * n_old AND orphans <= 1000 AS accepted FROM x")
def promote_gate(t):
    new, old = t.lineitem.where("l_quantity > 10").select(F.col("l_suppkey").alias("k")).distinct(), t.supplier.select(F.col("s_suppkey").alias("k"))
    a, b, c = new.agg(F.count("*").alias("n_new")), old.agg(F.count("*").alias("n_old")), new.join(old, "k", "left_anti").agg(F.count("*").alias("orphans"))
    return a.crossJoin(b).crossJoin(c).withColumn("accepted", (F.col("n_new") >= 0.98 * F.col("n_old")) & (F.col("orphans") <= 1000))


@query("SELECT entity, hits FROM (SELECT user_id AS entity, count(*) AS hits FROM events WHERE event_type <> 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY user_id) ORDER BY hits DESC, entity LIMIT 10000")
def core_promotion(t):
    last = t.events.agg(F.max("ts").alias("last"))
    recent = t.events.crossJoin(F.broadcast(last)).where("event_type <> 'error' and ts >= last - interval 14 days")
    return recent.groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "entity").limit(10_000)  # the core's cap


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS INT) AS headings, CAST(len(regexp_extract_all(html, '<p[^>]*>')) AS INT) AS paragraphs FROM pages")
def html_sections(t):
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<h[1-6][^>]*>")).alias("headings"), F.regexp_count("html", F.lit("<p[^>]*>")).alias("paragraphs"))


@query("SELECT conv_id, turn, role, CAST(count(*) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seen FROM conversations")
def session_replay(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", "role", F.count("*").over(w).alias("seen"))


@query("WITH r AS (SELECT a.vec_id AS q, CAST(a.label = b.label AS INT) AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rk FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id), n AS (SELECT q, sum(rel) AS total FROM r GROUP BY q), i AS (SELECT m, sum(1 / log2(x + 1)) AS ideal FROM (SELECT unnest(generate_series(1, 10)) AS m) , (SELECT unnest(generate_series(1, 10)) AS x) WHERE x <= m GROUP BY m) SELECT q, round(sum(rel) / 10.0, 6) AS precision_10, round(coalesce(sum(rel) * 1.0 / nullif(any_value(total), 0), 0), 6) AS recall_10, round(coalesce(max(rel * 1.0 / rk), 0), 6) AS rr, round(coalesce(sum(rel / log2(rk + 1)) / any_value(ideal), 0), 6) AS ndcg FROM r JOIN n USING (q) LEFT JOIN i ON m = least(total, 10) WHERE rk <= 10 GROUP BY q")
def ir_metrics(t):
    """Precision, recall, reciprocal rank and nDCG at 10 of every 20th vector as a query, vectors of its label being relevant."""
    e = t.embeddings.where("embedding is not null")
    asked = e.where("vec_id % 20 = 0")
    hits = retrieval.nearest_in_blocks(e, asked, "vec_id", "embedding", 10)
    labels, sizes = e.select("vec_id", "label"), e.groupBy("label").agg((F.count("*") - 1).alias("total"))
    judged = hits.join(labels.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(labels, "vec_id")
    judged = judged.withColumn("rel", F.coalesce((F.col("label") == F.col("ql")).cast("int"), F.lit(0)))
    return stats.ranking(judged.join(sizes.withColumnRenamed("label", "ql"), "ql", "left"), "q", "rk", "rel", "total", 10)

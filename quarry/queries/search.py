"""Queries of retrieval: keywords, concepts, authors, sections, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, relational, retrieval, search
from .base import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

_T = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
_DOCS = f"d AS (SELECT doc_id, {_T.format('split_part(text, chr(10), 1)')} AS tt, {_T.format('text')} AS bb FROM documents), s AS (SELECT *, ' ' || array_to_string(tt, ' ') || '  ' || array_to_string(bb, ' ') || ' ' AS x, ' ' || array_to_string(bb, ' ') || ' ' AS y FROM d)"


def _rank(words: str, body: bool = True) -> str:
    def hits(c: str) -> str:
        return f"len(list_filter({c}, lambda w: w IN ({words})))"

    r = hits("tt") + (f" + 0.4 * {hits('bb')}" if body else "")
    return f"round(({r}) / (({r}) + 1.0), 6)"


def _title():
    return F.substring_index("text", "\n", 1)


@query(f"WITH {_DOCS} SELECT doc_id, {_rank(repr('the') + ', ' + repr('and') + ', ' + repr('of'))} AS score FROM s WHERE (contains(x, ' the ') AND contains(x, ' and ') AND NOT contains(x, ' would ')) OR contains(x, ' of the ') ORDER BY score DESC, doc_id LIMIT 20")
def keyword_search(t):
    return search.keyword_search(t.documents, "doc_id", _title(), F.col("text"), 'the and -would or "of the"', 20)


@query(f"WITH {_DOCS} SELECT doc_id, {_rank(repr('the') + ', ' + repr('for'), False)} AS score FROM s WHERE contains(y, ' the ') AND contains(y, ' for ') ORDER BY score DESC, doc_id LIMIT 20")
def body_search(t):
    return search.keyword_search(t.documents, "doc_id", _title(), F.col("text"), "the for", 20, "body")


@query("SELECT conv_id, turn, role <> 'system' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND (len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) >= 3 OR length(trim(text)) >= 30) AS blocked FROM conversations")
def broad_guard(t):
    """Turns as queries, those of the system scoped."""
    return t.conversations.select("conv_id", "turn", search.broad(F.col("text"), F.col("role") == "system").alias("blocked"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE user_id IN (1, 2, 3) AND event_type IN ('error', 'click', 'view') GROUP BY event_type")
def merged_filter(t):
    f = search.merge_filters({"entity_types": ["error", "click"], "entity_ids": [1]}, ["view", "click"], [2, 3])
    e = t.events.where(F.col("event_type").isin(f["entity_types"]) & F.col("user_id").isin(f["entity_ids"]))
    return e.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE json_extract_string(props, '$.k') = '12' AND event_type IN ('view', 'click')")
def property_ids(t):
    """Entities of two types whose properties hold a pair."""
    return search.with_properties(t.events.where("event_type in ('view', 'click')"), "props", {"k": 12}).select("user_id").distinct()


@query("WITH n AS (SELECT count(*) AS total, count(*) FILTER (p_size = 7) AS a, count(*) FILTER (p_size > 7) AS b FROM part), c AS (SELECT total, CAST(floor(total * 0.03) AS BIGINT) + 1 AS cap, a, b FROM n) SELECT unnest(['rare', 'common']) AS filter, round(unnest([least(a, cap), least(b, cap)]) * 1.0 / total, 6) AS share, unnest([a >= cap, b >= cap]) AS capped FROM c")
def filter_selectivity(t):
    rows = [(n, *search.selectivity(t.part, F.expr(w), 0.03)) for n, w in (("rare", "p_size = 7"), ("common", "p_size > 7"))]
    return t.spark.createDataFrame([(n, round(s, 6), c) for n, s, c in rows], "filter string, share double, capped boolean")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def research_scope(t):
    """A year window, communities, authors to leave out and instruments to hold."""
    o = relational.paper_filter(t.orders.withColumn("yr", F.year("o_orderdate")), "yr", 1996, 1999).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    out = t.customer.where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    held = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(out, "o_custkey", "left_anti").join(held, "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' AND starts_with(source, 'src1') AND n_chars BETWEEN 100 AND 9000 GROUP BY source")
def section_filters(t):
    d = relational.paper_filter(t.documents, "n_chars", 100, 9000, equals={"lang": "fr"}).where(F.col("source").startswith("src1"))
    return d.groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) NOT IN ('furniture', 'building')")
def publisher_suppression(t):
    listed = t.spark.createDataFrame([("Furniture",), ("BUILDING",)], "p string").select(F.lower("p").alias("p"))
    return t.customer.join(listed, F.lower("c_mktsegment") == F.col("p"), "left_anti").select("c_custkey")


_ALT = "[p_type, p_brand]"


@query("WITH c AS (SELECT DISTINCT p_name, p_type, CASE WHEN lower(p_name) = 'promo' THEN 1.0 WHEN lower(p_type) = 'promo' THEN 0.7 WHEN starts_with(lower(p_name), 'promo') THEN 0.5 WHEN contains(lower(p_name), 'promo') THEN 0.3 END AS score FROM part UNION SELECT DISTINCT p_name, p_type, CASE WHEN lower(p_name) = 'bolt' THEN 1.0 WHEN lower(p_type) = 'bolt' THEN 0.7 WHEN starts_with(lower(p_name), 'bolt') THEN 0.5 WHEN contains(lower(p_name), 'bolt') THEN 0.3 END FROM part) SELECT p_name, p_type, score FROM c WHERE score IS NOT NULL")
def concept_lookup(t):
    """Two queries, one an alternate label, one a part of labels."""
    c = t.part.select("p_name", "p_type").distinct()
    found = [search.concepts(c, "p_name", F.array("p_type"), q) for q in ("PROMO", "bolt ")]
    return found[0].union(found[1]).distinct()


@query("WITH RECURSIVE tree AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), walk AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT child, depth + 1 FROM walk JOIN tree ON parent = node WHERE depth < 6), n AS (SELECT DISTINCT node FROM walk) SELECT l_orderkey AS paper, max(l_quantity) AS weight FROM lineitem JOIN n ON l_partkey = node GROUP BY l_orderkey ORDER BY weight DESC, paper LIMIT 50")
def concept_descendants(t):
    """Papers of a concept and of all below it, six levels deep; the hierarchy is walked level by level."""
    tree = t.part.where("p_partkey > 0").select(F.floor(F.col("p_partkey") / 3).alias("src"), F.col("p_partkey").alias("dst"))
    below = graph.bfs(tree, [1], 6).select(F.col("node").alias("l_partkey")).distinct()
    papers = t.lineitem.join(below, "l_partkey", "left_semi").groupBy(F.col("l_orderkey").alias("paper")).agg(F.max("l_quantity").alias("weight"))
    return papers.orderBy(F.desc("weight"), "paper").limit(50)


@query(f"WITH {_DOCS} SELECT doc_id, {_rank(repr('with'))} AS score FROM s WHERE contains(x, ' with ') ORDER BY score DESC, doc_id LIMIT 10")
def concept_fallback(t):
    """A query that no vocabulary names is searched as keywords."""
    named = search.concepts(t.part.select("p_name", "p_type").distinct(), "p_name", F.array("p_type"), "with")
    if not named.isEmpty():
        raise ValueError("the query names a concept")
    return search.keyword_search(t.documents, "doc_id", _title(), F.col("text"), "with", 10)


@query("WITH v AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label) SELECT label, round(list_cosine_similarity(c, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 5) AS score FROM c ORDER BY score DESC, label LIMIT 3")
def query_expansion(t):
    """Entities (labels, by their mean vector) nearest to a query's vector."""
    q = [float(x) for x in t.embeddings.where("vec_id = 1").select("embedding").first()[0]]
    mean = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c"))
    return c.select("label", F.round(retrieval.cosine("c", q), 5).alias("score")).orderBy(F.desc("score"), "label").limit(3)


@query("WITH n AS (SELECT DISTINCT p_brand AS entity, p_name AS name FROM part UNION SELECT DISTINCT p_brand, p_brand FROM part), o AS (SELECT name, count(DISTINCT entity) AS owners FROM n GROUP BY name), q AS (SELECT 1 AS id, 'the Brand#13 cold widget' AS text UNION ALL SELECT 2, 'brand 5 or brand 19' UNION ALL SELECT 3, 'small widget'), h AS (SELECT DISTINCT id, entity FROM q JOIN n ON contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(n.name), '[^a-z0-9]+', ' ', 'g')) || ' ') JOIN o USING (name) WHERE owners = 1), a AS (SELECT entity, array_to_string(list_slice(list(name ORDER BY name), 1, 8), '|') AS aliases FROM n GROUP BY entity) SELECT id, entity, aliases FROM h JOIN a USING (entity)")
def alias_expansion(t):
    names = t.part.select(F.col("p_brand").alias("entity"), F.col("p_name").alias("name")).union(t.part.select("p_brand", "p_brand"))
    asked = t.spark.createDataFrame([(1, "the Brand#13 cold widget"), (2, "brand 5 or brand 19"), (3, "small widget")], "id int, text string")
    return search.alias_expansion(asked, "id", "text", names).select("id", "entity", F.array_join("aliases", "|").alias("aliases"))


@query("WITH a AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS yr, o_totalprice, CASE o_custkey % 5 WHEN 0 THEN 'Jarmak, Stephanie G.' WHEN 1 THEN 'Jarmak, S.' WHEN 2 THEN 'Jarmak, S. G.' WHEN 3 THEN 'Jarmak, T.' ELSE 'Other, A.' END AS author FROM orders) SELECT o_orderkey, yr FROM a WHERE author IN ('Jarmak, Stephanie G.', 'Jarmak, Stephanie', 'Jarmak, S. G.', 'Jarmak, S.') AND yr >= 1996 ORDER BY yr DESC NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 50")
def author_papers(t):
    names = ["Jarmak, Stephanie G.", "Jarmak, S.", "Jarmak, S. G.", "Jarmak, T.", "Other, A."]
    authors = F.array(F.lit("First, X."), F.get(F.array(*map(F.lit, names)), (F.col("o_custkey") % 5).cast("int")))
    own = F.arrays_overlap(authors, F.array(*map(F.lit, search.author_variants("Stephanie G. Jarmak"))))
    papers = t.orders.withColumn("yr", F.year("o_orderdate")).where(own & (F.col("yr") >= 1996))
    return papers.orderBy(F.desc_nulls_first("yr"), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "yr")


_LINES = "l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), p AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS section, unnest(l) AS body FROM l)"
_BODY = "round(len(regexp_extract_all(lower(body), '\\b(?:the|of)\\b')) * 1.0 / (length(body) + 50), 6)"


@query(f"WITH {_LINES}, r AS (SELECT doc_id, section, {_BODY} AS score FROM p), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) AS INT) AS rn FROM r WHERE score > 0) SELECT doc_id, section, score, rn FROM k WHERE rn <= 3")
def within_paper(t):
    """The three best sections of every paper."""
    parts = search.sections(t.documents, "doc_id", "text")
    found = search.best_sections(parts, ["doc_id"], "body", F.round(retrieval.section_score("body", ["the", "of"]), 6), 3)
    return found.select("doc_id", "section", "score", "rn")


_COS1 = "round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)), 6)"


@query(f"WITH {_LINES}, a AS (SELECT doc_id, section, row_number() OVER (ORDER BY {_BODY} DESC, doc_id, section) AS r FROM p WHERE {_BODY} > 0 QUALIFY r <= 50), b AS (SELECT vec_id AS doc_id, 0 AS section, row_number() OVER (ORDER BY {_COS1} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 50) SELECT doc_id, section, round(sum(1.0 / (60 + r)), 6) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL ORDER BY rrf DESC, doc_id, section LIMIT 20")
def section_hybrid(t):
    """Sections by words and by vectors, fused."""
    parts = search.sections(t.documents, "doc_id", "text").withColumn("s", F.round(retrieval.section_score("body", ["the", "of"]), 6)).where("s > 0")
    one = parts.orderBy(F.desc("s"), "doc_id", "section").limit(50).select(F.struct("doc_id", "section").alias("key"), F.col("s").alias("score"))
    q = [float(x) for x in t.embeddings.where("vec_id = 1").select("embedding").first()[0]]
    two = retrieval.vector_search(t.embeddings, "vec_id", "embedding", q, 50).select(F.struct(F.col("vec_id").alias("doc_id"), F.lit(0).alias("section")).alias("key"), "score")
    return retrieval.rrf([one, two], "key", "score").select("key.doc_id", "key.section", "rrf")


@query(f"SELECT vec_id, {_COS1} AS score, substr(text, 1, 40) AS snippet FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 15")
def chunk_search(t):
    """Filtered vector search, its few hits joined with their texts."""
    q = [float(x) for x in t.embeddings.where("vec_id = 1").select("embedding").first()[0]]
    hits = retrieval.vector_search(t.embeddings, "vec_id", "embedding", q, 15, F.col("label").isin(1, 2, 3))
    return hits.join(t.documents.select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 40).alias("snippet")), "vec_id", "left").select("vec_id", "score", "snippet")


@query(f"WITH {_DOCS}, c AS (SELECT doc_id, {_rank(repr('the') + ', ' + repr('and'))} AS score, tt FROM s WHERE contains(x, ' the ') AND contains(x, ' and ') ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, round(len(list_intersect(list_distinct(tt), ['the', 'and', 'of'])) / 3.0, 6) AS rerank FROM c ORDER BY rerank DESC, doc_id")
def rerank_pairs(t):
    """The best of a search, scored again by a pluggable scorer: here the share of the query's words in the title."""
    hits = search.keyword_search(t.documents, "doc_id", _title(), F.col("text"), "the and", 20)
    wanted = F.array(*map(F.lit, ("the", "and", "of")))
    scored = hits.join(t.documents, "doc_id").select("doc_id", F.round(F.size(F.array_intersect(retrieval.tokens(_title()), wanted)) / 3, 6).alias("rerank"))
    return scored.orderBy(F.desc("rerank"), "doc_id")


@query(f"WITH c AS (SELECT conv_id, turn, role, ' ' || array_to_string({_T.format('text')}, ' ') || ' ' AS x, {_T.format('text')} AS w FROM conversations) SELECT conv_id, turn, round(len(list_filter(w, lambda y: y IN ('the', 'and'))) * 0.4 / (len(list_filter(w, lambda y: y IN ('the', 'and'))) * 0.4 + 1), 6) AS score FROM c WHERE role = 'assistant' AND contains(x, ' the ') AND contains(x, ' and ') ORDER BY score DESC, conv_id DESC, turn LIMIT 500")
def claim_search(t):
    """Claims (turns) of one type with all words, best first, then newest."""
    c = t.conversations.where("role = 'assistant'").select(F.struct((-F.col("conv_id")).alias("newest"), "turn").alias("key"), "text")
    return search.keyword_search(c, "key", F.lit(""), F.col("text"), "the and", 500).select((-F.col("key.newest")).alias("conv_id"), "key.turn", "score")


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IN ('1', '2', '3') AND event_type IN ('view', 'error') ORDER BY ts DESC, event_id LIMIT 100")
def extraction_search(t):
    k = F.get_json_object("props", "$.k").isin("1", "2", "3") & F.col("event_type").isin("view", "error")
    return t.events.where(k).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id")


@query("SELECT doc_id, substr(text, 101, 200) AS page, greatest(length(text) - 300, 0) AS rest FROM documents")
def read_section(t):
    return t.documents.select("doc_id", search.page(F.col("text"), 100, 200).alias("page"), F.greatest(F.length("text") - 300, F.lit(0)).cast("long").alias("rest"))


@query("WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 10 THEN p_name END AS v FROM part), h AS (SELECT p_brand, min(p_partkey) AS k FROM r WHERE v IS NOT NULL GROUP BY p_brand) SELECT r.p_partkey, coalesce(r.v, a.v) AS v, CASE WHEN r.v IS NULL THEN a.p_partkey END AS served_by FROM r LEFT JOIN h USING (p_brand) LEFT JOIN r a ON a.p_partkey = k")
def sibling_fallback(t):
    """Papers without a text served by the first sibling (here: of the same brand) that has one."""
    r = t.part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 10, F.col("p_name")).alias("v"))
    first = r.where("v is not null").groupBy("p_brand").agg(F.min("p_partkey").alias("alias"))
    return search.with_fallback(r, "p_partkey", "v", r.join(first, "p_brand").select("p_partkey", "alias")).select("p_partkey", "v", "served_by")


@query("SELECT conv_id, turn, role, CAST(rn AS INT) AS age FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS rn FROM conversations) WHERE rn <= 3")
def session_sets(t):
    """The last three entries of each session's working set; older ones have left it."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return t.conversations.withColumn("age", F.row_number().over(w)).where("age <= 3").select("conv_id", "turn", "role", "age")

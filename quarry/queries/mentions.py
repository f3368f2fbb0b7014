"""Queries of mentions, of sections in flat bodies, and of the logs behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mentions, provenance
from ..sources import files, records
from .base import Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("""WITH q AS (SELECT l_suppkey AS id, 'Prices of ' || min(p_name) || ', or the ' || upper(max(p_name)) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
w AS (SELECT id, regexp_extract_all(lower(t), '\\w+') AS w FROM q), g AS (SELECT DISTINCT id, array_to_string(w[i:i + n - 1], ' ') AS k FROM w, range(1, 20) r(i), range(1, 5) s(n) WHERE i + n - 1 <= len(w)),
n AS (SELECT p_partkey AS e, lower(p_name) AS k, p_type AS ty FROM part WHERE p_size < 15 UNION SELECT p_partkey, split_part(p_name, ' ', 2), p_type FROM part WHERE p_size = 20),
c AS (SELECT l_partkey AS e, count(*) AS papers FROM lineitem GROUP BY l_partkey), h AS (SELECT id, k, e, ty, coalesce(papers, 0) AS papers FROM g JOIN n USING (k) LEFT JOIN c USING (e)),
m AS (SELECT *, max(papers) OVER (PARTITION BY id, k) AS most, min(CASE WHEN papers > 10 THEN ty END) OVER (PARTITION BY id, k) AS a, max(CASE WHEN papers > 10 THEN ty END) OVER (PARTITION BY id, k) AS b, row_number() OVER (PARTITION BY id, k ORDER BY papers DESC, e) AS rank FROM h)
SELECT id, k AS mention, e AS entity, papers, round(CASE WHEN most > 0 THEN papers * 1.0 / most ELSE 0 END, 6) AS score, CAST(rank AS INT) AS rank, coalesce(a < b, false) AS ambiguous FROM m""")
def query_disambiguation(t):
    """What the words of each supplier's query may name, among parts by name and by kind."""
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("id")).agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    asked = named.select("id", F.concat(F.lit("Prices of "), "a", F.lit(", or the "), F.upper("b")).alias("query"))
    names = t.part.where("p_size < 15").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    names = names.union(t.part.where("p_size = 20").select("p_partkey", F.split("p_name", " ")[1], "p_type"))
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("papers"))
    found = mentions.query_mentions(asked, "id", "query", names, counts)
    return found.select("id", F.lower("mention").alias("mention"), "entity", "papers", F.round("score", 6).alias("score"), "rank", "ambiguous")


@query("""WITH n AS (SELECT lower(p_name) AS k, min(p_partkey) AS e FROM part WHERE p_size < 25 GROUP BY 1), a AS (SELECT lower(p_name || ' ' || p_brand) AS k, min(p_partkey) AS e FROM part WHERE p_size < 25 GROUP BY 1),
m AS (SELECT l_orderkey AS paper, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' || p_brand END AS mention, l_linenumber % 2 = 0 AS plain FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 4)
SELECT paper, entity, max(score) AS score, count(*) AS mentions FROM (SELECT paper, coalesce(n.e, a.e) AS entity, CASE WHEN n.e IS NOT NULL THEN 1.0 ELSE 0.9 END AS score FROM m LEFT JOIN n ON lower(mention) = n.k LEFT JOIN a ON lower(mention) = a.k) WHERE entity IS NOT NULL GROUP BY ALL""")
def mention_entities(t):
    """Names in the JSON of extractions, linked to parts by name, else by name and brand."""
    part = t.part.where("p_size < 25").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), "p_brand")
    names = part.select("entity", "name", F.lit("canonical").alias("kind")).union(part.select("entity", F.concat_ws(" ", "name", "p_brand"), F.lit("alias")))
    l = t.lineitem.where("l_linenumber < 4").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_brand"))
    lists = l.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") == 1, name)).alias("a"), F.collect_list(F.when(F.col("l_linenumber") > 1, name)).alias("b"))
    split = F.struct(F.col("a").alias("datasets"), F.concat("b", F.array(F.lit("  "))).alias("software"), F.array(F.lit("unread")).alias("entities"))
    whole = F.struct(F.concat("a", "b").alias("entities"))
    payload = F.when(F.col("l_orderkey") % 2 == 0, F.to_json(split)).otherwise(F.to_json(whole))
    found = mentions.record_mentions(lists.select(F.col("l_orderkey").alias("paper"), payload.alias("payload")), "paper", "payload")
    return mentions.mention_links(found, "paper", names)


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part WHERE p_size % 3 <> 0 GROUP BY 1")
def mention_surfaces(t):
    """Spellings of names made one, common words of a type left out."""
    spelt = F.when(F.col("p_size") % 3 == 0, " Experimental  data ").when(F.col("p_size") % 3 == 1, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" (Smith et al.) "))).otherwise(F.replace("p_name", F.lit(" "), F.lit(" \t ")))
    m = t.part.select(mentions.surface(spelt).alias("name"), F.lit("dataset").alias("kind"))
    return m.where(~mentions.names_nothing(F.col("name"), F.col("kind"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(lang AS VARCHAR) AS heading, sha256(lang || chr(10) || coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 <> 0")
def sections_to_embed(t):
    """Sections that are new or whose text is not the one last embedded."""
    d = t.documents.select("doc_id", F.col("lang").alias("heading"), "text")
    stored = d.where("doc_id % 3 = 0 or doc_id % 3 = 1").select("doc_id", mentions.section_digest("heading", "text").alias("digest"))
    stored = stored.withColumn("digest", F.when(F.col("doc_id") % 3 == 1, F.reverse("digest")).otherwise(F.col("digest")))
    return mentions.changed_sections(d, stored, ["doc_id"]).select("doc_id", "heading", "digest")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'title_only' ELSE 'title_abstract' END AS input_type, sha256(CASE WHEN doc_id % 4 = 1 THEN source ELSE source || ' [SEP] ' || text END) AS source_hash FROM documents WHERE doc_id % 4 <> 0 AND source <> '' AND (doc_id % 4 = 1 OR text <> '') UNION ALL SELECT doc_id, 'title_only', sha256(source) FROM documents WHERE doc_id % 4 > 1 AND source <> '' AND coalesce(text, '') = ''")
def embedding_inputs(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("title"), F.when(F.col("doc_id") % 4 != 1, F.col("text")).alias("abstract"))
    return mentions.embedding_inputs(d, "doc_id", "title", "abstract").select("doc_id", "input_type", "source_hash")


def _merges(t):
    return t.part.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("old"), F.floor(F.col("p_partkey") / 2).alias("new"), F.col("p_size").alias("at"))


@query("""WITH m AS (SELECT p_partkey AS id, p_partkey AS old, p_partkey // 2 AS new, p_size AS "at" FROM part WHERE p_partkey % 3 = 1),
s AS (SELECT p_partkey AS id, p_partkey AS parent, p_partkey + 1 AS c1, p_partkey + 2 AS c2, p_size AS "at" FROM part WHERE p_partkey % 5 = 0),
e AS (SELECT id, 'merge' AS event, CAST(new AS VARCHAR) AS others, "at", unnest(list_distinct([old, new])) AS entity FROM m UNION ALL SELECT id, 'split', c1 || ',' || c2, "at", unnest([parent, c1, c2]) FROM s)
SELECT entity, event, others, "at", CAST(row_number() OVER (PARTITION BY entity, event ORDER BY "at" DESC, id DESC) AS INT) AS newest FROM e""")
def merge_audit(t):
    """Every merge and split of each part, the newest first."""
    k = F.col("p_partkey")
    splits = t.part.where("p_partkey % 5 = 0").select(k.alias("id"), k.alias("parent"), F.array(k + 1, k + 2).alias("children"), F.col("p_size").alias("at"))
    h = mentions.audit_history(_merges(t), splits)
    return h.select("entity", "event", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"), "at", "newest")


@query("WITH RECURSIVE m AS (SELECT p_partkey AS old, p_partkey // 2 AS new FROM part WHERE p_partkey % 3 = 1), w AS (SELECT old, new FROM m UNION SELECT w.old, m.new FROM w JOIN m ON w.new = m.old WHERE m.new <> m.old) SELECT old, min(new) AS current FROM w GROUP BY old")
def merge_ends(t):
    """Each merged part's id after all later merges."""
    return provenance.merged_ids(_merges(t), "old", "new")


@query("SELECT user_id, event_type, CAST(1 AS INT) AS run FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' UNION ALL SELECT user_id, event_type, 2 FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00')")
def watermark_links(t):
    """Links of events in three runs: up to a day, all, and all once more; the second takes what is later, the third nothing."""
    out = files.shared_folder(t.spark, "watermark")
    e = t.events.select("user_id", "event_type", "ts")
    for run, rows in enumerate([e.where("ts <= timestamp'2024-01-10 00:00:00'"), e, e], 1):
        mentions.link_new(t.spark, rows, "ts", lambda new: new.select("user_id", "event_type"), f"{out}/links", f"{out}/runs", run)
    return t.spark.read.parquet(f"{out}/links").select("user_id", "event_type", "run")


@query("SELECT event_type, max(ts) < TIMESTAMP '2024-01-31 00:30:00' - INTERVAL 1 HOUR AS stale FROM events GROUP BY event_type")
def watermark_stale(t):
    last = t.events.groupBy("event_type").agg(F.max("ts").alias("last"))
    return last.select("event_type", mentions.stale(F.col("last"), F.lit("2024-01-31 00:30:00").cast(last.schema["last"].dataType), 1).alias("stale"))


@query("SELECT event_type AS tool, count(*) AS calls, count(DISTINCT user_id) AS sessions, round(avg(CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE 0 END), 6) AS empty_share FROM events WHERE user_id % 10 <> 0 GROUP BY event_type")
def query_log(t):
    """Calls written to a log in two appends, and the share without results by tool."""
    out = files.shared_folder(t.spark, "calls")
    c = t.events.select(F.col("event_type").alias("tool"), F.col("props").alias("query"), (F.col("event_id") % 4).alias("results"), F.col("user_id").alias("session"), (F.col("user_id") % 10 == 0).alias("is_test"), F.col("ts").alias("at"))
    for half in (0, 1):
        mentions.log_calls(c.where(F.pmod("session", F.lit(2)) == half), out)
    return mentions.empty_answers(t.spark.read.parquet(out)).withColumn("empty_share", F.round("empty_share", 6))


@query("""WITH b AS (SELECT p_partkey AS id, p_name || ' 1. Introduction ' || p_type || ' model' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' 2.1 RESULTS: ' || p_name ELSE '; introduction' END || CASE WHEN p_size % 3 = 0 THEN ' Related  work x APPENDIX  b y' ELSE '' END AS body, p_size FROM part),
s AS (SELECT id, p_size, body, ' 1. Introduction ' AS h0 FROM b WHERE p_size % 2 = 0 OR p_size % 3 = 0)
SELECT id, 'INTRODUCTION' AS first, CAST(position('1. Intro' IN body) - 1 AS INT) AS start, CAST(2 + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS INT) AS n,
CAST(len(body) - (position('1. Intro' IN body) - 1) - 15 - CASE WHEN p_size % 2 = 0 THEN 11 ELSE 12 END - CASE WHEN p_size % 3 = 0 THEN 24 ELSE 0 END AS INT) AS covered FROM s""")
def body_anchors(t):
    """Sections of flat bodies: the first heading, where it stands, how many follow and the text under them."""
    body = F.concat("p_name", F.lit(" 1. Introduction "), "p_type", F.lit(" model"), "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" 2.1 RESULTS: "), "p_name")).otherwise("; introduction"), F.when(F.col("p_size") % 3 == 0, " Related  work x APPENDIX  b y").otherwise(""))
    s = mentions.body_sections(t.part.select(F.col("p_partkey").alias("id"), body.alias("body")), "id", "body")
    return s.groupBy("id").agg(F.min_by("heading", "at").alias("first"), F.min("start").alias("start"), F.count("*").cast("int").alias("n"), F.sum(F.length("text")).cast("int").alias("covered"))


@query("SELECT l_orderkey AS corpus_id, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN '## ' || l_shipmode || chr(10) || chr(10) ELSE '' END || l_comment, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM (SELECT *, 'm' || l_suppkey AS l_shipmode, 't' || l_partkey AS l_comment FROM lineitem) WHERE l_linenumber <> 3 GROUP BY l_orderkey")
def record_bodies(t):
    """Bodies of JSON records whose sections may lack a name or a text."""
    s = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).alias("section"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("t"), F.col("l_partkey").cast("string"))).otherwise("").alias("text"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(s)).alias("s"))
    content = F.struct(F.transform("s", lambda x: F.struct(x["section"].alias("section"), x["text"].alias("text"))).alias("text"))
    lines = rows.select(F.to_json(F.struct(F.col("l_orderkey").alias("corpusid"), content.alias("content"))).alias("value"))
    return records.bodies(lines.union(t.spark.createDataFrame([('{"content": {"text": [{"text": "x"}]}}',), ('{"corpusid": -1}',), ("{",)], "value string"))).select("corpus_id", "body")


@query("SELECT l_orderkey AS citing, l_partkey AS cited, l_returnflag = 'R' AS influential, CASE WHEN l_returnflag = 'A' THEN 'methodology' ELSE '' END AS intents FROM lineitem WHERE l_linenumber <> 2")
def citation_intents(t):
    """Citations of JSON lines with their intents; one without an end drops out."""
    some = F.when(F.col("l_returnflag") == "A", F.array(F.lit("methodology")))
    row = F.struct(F.when(F.col("l_linenumber") != 2, F.col("l_orderkey")).alias("citingcorpusid"), F.col("l_partkey").alias("citedcorpusid"), F.when(F.col("l_returnflag") == "R", True).alias("isinfluential"), some.alias("intents"))
    return records.cited_intents(t.lineitem.select(F.to_json(row).alias("value"))).withColumn("intents", F.array_join("intents", ","))


@query("""WITH a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ['instrument||', 'telescope||', 'instrument|mission|JWST'] WHEN 1 THEN [] WHEN 2 THEN ['asteroid||', 'asteroid|taxonomy|M'] ELSE ['comet||', 'comet|mission|Hubble', 'asteroid|taxonomy|B'] END AS c FROM supplier)
SELECT s_suppkey, unnest(c) AS clause FROM a""")
def ontology_clauses(t):
    """What queries ask of entities: types, missions beside a type, taxonomies; a mission alone is none."""
    asked = F.get(F.array(F.lit("JWST instruments, telescopes and jwst Instrument for "), F.lit("Cassini and x2M-type at "), F.lit("M-type asteroids, m-type, Q-type near "), F.lit("b-type Comets of hubble by ")), F.col("s_suppkey") % 4)
    c = t.supplier.select("s_suppkey", F.explode(mentions.query_clauses(F.concat(asked, "s_name"))).alias("c"))
    return c.select("s_suppkey", F.concat_ws("|", "c.type", F.coalesce("c.property", F.lit("")), F.coalesce("c.value", F.lit(""))).alias("clause"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS ty, i, avg(x) AS m FROM e WHERE label < 6 GROUP BY ALL),
n AS (SELECT ty, sqrt(sum(m * m)) AS l FROM c GROUP BY ty), s AS (SELECT vec_id, ty, round(sum(x * m) / (sqrt(sum(x * x)) * any_value(l)), 9) AS cos FROM e JOIN c USING (i) JOIN n USING (ty) GROUP BY ALL),
b AS (SELECT vec_id, ty FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, ty) = 1)
SELECT vec_id, ty AS classified, label = ty AS agrees, CASE WHEN label <> ty THEN 0.2 WHEN label < 3 THEN 0.9 WHEN label < 5 THEN 0.6 ELSE 0.5 END AS precision FROM embeddings JOIN b USING (vec_id)""")
def type_agreement(t):
    """Each vector's nearest type among the means of six labels, whether that is its label, and the precision to expect."""
    e = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = e.where("label < 6").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = mean.groupBy(F.col("label").alias("type")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c"))
    v = mentions.type_verdicts(e, "vec_id", "label", "v", c)
    p = mentions.precision(F.col("agrees"), F.when(F.col("predicted") < 3, 0.9), F.when(F.col("predicted") < 5, 0.6))
    return v.select("vec_id", "classified", "agrees", p.alias("precision"))

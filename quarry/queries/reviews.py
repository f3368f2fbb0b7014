"""Queries over citation contexts, working sets, loads and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational, reviews
from .base import CITES, Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: Citing texts, by line number, so that every relation occurs.
_CITING = ["This partially confirms it", "It contradicts the claim", "It extends the claim", "We confirm the claim", "It may confirm the claim", "We cite it", None]


def _contexts(t):
    intent = F.when(F.col("l_returnflag") == "R", "result_comparison").when(F.col("l_returnflag") == "A", "method")
    text = F.get(F.array(*map(F.lit, _CITING)), (F.col("l_linenumber") % 7).cast("int"))
    c = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", intent.alias("intent"), text.alias("context"))
    return c.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("yr")), "l_orderkey")


_REPLICATIONS = "SELECT l_orderkey, l_linenumber, l_suppkey, CAST(year(o_orderdate) AS INT) AS yr, CASE l_returnflag WHEN 'R' THEN 1.0 WHEN 'A' THEN 0.6 ELSE 0.3 END AS intent_weight, CASE l_linenumber % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'refutes' WHEN 2 THEN 'qualifies' WHEN 3 THEN 'replicates' WHEN 4 THEN 'qualifies' ELSE 'unknown' END AS relation, l_linenumber % 7 = 4 AS hedged FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = 1 ORDER BY intent_weight DESC, yr, l_orderkey, l_linenumber, l_suppkey LIMIT 50"


@query(_REPLICATIONS)
def find_replications(t):
    found = reviews.replications(_contexts(t), 1, "l_partkey", "context", "intent", "yr", ["l_orderkey", "l_linenumber", "l_suppkey"], 50)
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", "yr", "intent_weight", "relation", "hedged")


@query(f"WITH {CITES}, w AS (SELECT DISTINCT src AS o_orderkey FROM cites WHERE dst IN (1, 2, 3)), p AS (SELECT orders.* FROM orders JOIN w USING (o_orderkey)), y AS (SELECT 'year' AS part, CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM p GROUP BY ALL), v AS (SELECT 'venue' AS part, o_orderpriority AS value, count(*) AS n FROM p GROUP BY ALL ORDER BY n DESC, value LIMIT 8) SELECT * FROM y UNION ALL SELECT * FROM v")
def lit_review(t):
    """Years and the commonest venues of what cites a few seeds."""
    near = t.cites().where(F.col("dst").isin(1, 2, 3)).select(F.col("src").alias("o_orderkey")).distinct()
    papers = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority").join(near, "o_orderkey", "left_semi")
    years = papers.groupBy(F.year("o_orderdate").cast("string").alias("value")).agg(F.count("*").alias("n"))
    venues = relational.facet(papers, "o_orderpriority", 8)
    return years.select(F.lit("year").alias("part"), "value", "n").union(venues.select(F.lit("venue").alias("part"), "value", "n"))


@query("WITH e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst) SELECT dst AS node FROM e WHERE src IN (1, 2) UNION SELECT src FROM e WHERE dst IN (1, 2) UNION SELECT unnest([1, 2])")
def expand_working_set(t):
    return reviews.working_set(t.graph(), [1, 2])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) WHERE rn = 1")
def load_new_keys(t):
    held = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return reviews.fresh_rows(t.orders.select("o_custkey", "o_orderkey"), held, ["o_custkey"], [F.asc("o_orderkey")])


@query("SELECT CAST(year(o_orderdate) AS INT) AS yr, count(*) AS expected, count(*) FILTER (o_orderstatus = 'F') AS held, count(*) - count(*) FILTER (o_orderstatus = 'F') AS missing FROM orders GROUP BY 1 HAVING count(*) <> count(*) FILTER (o_orderstatus = 'F')")
def fill_gaps(t):
    o = t.orders.select(F.year("o_orderdate").alias("yr"), "o_orderstatus")
    return reviews.gaps(o, o.where("o_orderstatus = 'F'"), "yr")


@query("SELECT item_id, text AS abstract FROM benchmark")
def reconstruct_abstract(t):
    """Texts through an inverted index and back."""
    indexed = reviews.inverted_index(t.benchmark, "item_id", "text")
    return indexed.select("item_id", reviews.from_inverted_index(F.col("index")).alias("abstract"))


@query("SELECT event_id, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, year(ts) * 100 + month(ts) AS ym FROM events")
def record_transform(t):
    """Raw JSON records to typed columns; what is no number becomes null."""
    raw = F.get_json_object("props", "$.k")
    return t.events.select("event_id", F.col("event_type").alias("kind"), raw.try_cast("int").alias("k"), (F.year("ts") * 100 + F.month("ts")).alias("ym"))


@query("SELECT user_id, count(*) AS n_corrections, strftime(min(day) FILTER (event_type = 'error'), '%Y-%m-%d') AS retracted_at FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id")
def correction_merge(t):
    return reviews.corrections(t.events, "user_id", "event_type", "ts", "error").withColumn("retracted_at", F.col("retracted_at").cast("string"))


@query("WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, arg_max(event_type, ts) AS last_status, max(ts) FILTER (event_type = 'purchase') AS completed FROM events GROUP BY user_id) SELECT user_id, last_status, coalesce(completed + INTERVAL 24 HOUR < now, true) AS stale FROM l, n")
def source_freshness(t):
    now = t.events.agg(F.max("ts").alias("now")).first()["now"]
    return reviews.freshness(t.events, "user_id", "event_type", "ts", "purchase", F.lit(now).cast("timestamp_ntz")).select("user_id", "last_status", "stale")


@query("SELECT event_id, round(s, 4) AS spent, s <= 100.005 AS within FROM (SELECT event_id, sum(value) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM events)")
def cost_ledger(t):
    """What each user has spent in a day so far, and whether that is within the cap."""
    day = F.struct(F.to_date("ts"), "user_id")
    return reviews.ledger(t.events.select("event_id", "ts", "user_id", "value"), day, ["ts", "event_id"], "value", 100.005).select("event_id", F.round("spent", 4).alias("spent"), "within")


@query("WITH p AS (SELECT p_brand AS community, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY ALL), t AS (SELECT sum(n) AS total FROM p) SELECT community, n, CASE WHEN n * 1.0 / total >= 0.15 THEN 'core' WHEN n * 1.0 / total >= 0.05 THEN 'supporting' ELSE 'bridging' END AS section FROM p, t")
def community_sections(t):
    """Communities of a working set by their share of it."""
    p = t.part.where("p_size <= 10").groupBy(F.col("p_brand").alias("community")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("total")
    return p.crossJoin(F.broadcast(p.agg(F.sum("n").alias("total")))).select("community", "n", F.when(share >= 0.15, "core").when(share >= 0.05, "supporting").otherwise("bridging").alias("section"))  # one row

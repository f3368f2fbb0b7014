"""Queries that write the driver's rows in an outside format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files, records
from .base import CITES, Registry

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def _records(t):
    """Orders as JSON records of papers, one a line."""
    refs = t.cites().groupBy("src").agg(F.sort_array(F.collect_list(F.col("dst").cast("string"))).alias("reference"))
    o = t.orders.join(refs, F.col("o_orderkey") == F.col("src"), "left")
    number = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("bibcode"), F.array("o_orderpriority", F.lit("second")).alias("title"), F.year("o_orderdate").cast("string").alias("year"),
        F.array(F.concat(F.lit("A\0, "), F.col("o_custkey").cast("string"))).alias("author"), number.alias("citation_count"), F.col("o_orderstatus").alias("status"), "reference",
    )
    return o.select(F.to_json(record).alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS bibcode, o_orderpriority AS title, CAST(year(o_orderdate) AS INT) AS year, 'A, ' || o_custkey AS first, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS INT) END AS citation_count, o_orderstatus AS status FROM orders")
def paper_records(t):
    """Records to typed rows; what has no column is found in ``raw``."""
    p = records.papers(_records(t))
    return p.select("bibcode", "title", "year", F.get("authors", 0).alias("first"), "citation_count", F.get_json_object("raw", "$.status").alias("status"))


@query(f"WITH {CITES} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM cites JOIN orders ON src = o_orderkey")
def paper_edges(t):
    return records.reference_edges(_records(t))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def jsonl_scan(t):
    """A compressed JSON lines file, written and scanned."""
    out = files.shared_folder(t.spark, "jsonl")
    t.events.select("event_id", "event_type", "value").write.option("compression", "gzip").json(out)
    rows = files.scan_json(t.spark, files.file_names(t.spark, out, "*.json.gz"), "event_id long, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id FROM events UNION ALL SELECT -1, 2")
def load_twice(t):
    """Files that overlap, loaded, joined by another and loaded again; each key stands once, from the file that came first."""
    spark, base = t.spark, files.shared_folder(t.spark, "load")

    def put(name, df):
        df.selectExpr("to_json(struct(event_id, user_id)) AS value").coalesce(1).write.text(f"{base}/in/{name}")

    def load(name):
        return files.load_files(spark, f"{base}/in/{name}", f"{base}/table", f"{base}/log", lambda p: files.scan_json(spark, p, "event_id long, user_id long"), ["event_id"], "part-*")

    e = t.events.select("event_id", "user_id")
    put("a", e.where("event_id % 3 < 2").union(spark.createDataFrame([(-1, 5), (-1, 2)], "event_id long, user_id long")))
    put("b", e.where("event_id % 3 > 0").union(spark.createDataFrame([(-1, 1)], "event_id long, user_id long")))
    load("a")
    load("b")
    load("a")
    return spark.read.parquet(f"{base}/table").select("event_id", "user_id")


@query(f"WITH {CITES}, r AS (SELECT src, list('W' || dst ORDER BY 'W' || dst) AS refs FROM cites GROUP BY src) SELECT 'W' || o_orderkey AS id, '10.1/' || o_custkey AS doi, CAST(year(o_orderdate) AS INT) AS year, CAST(len(coalesce(refs, [])) AS INT) AS n_references, o_orderpriority || ' of ' || o_orderstatus || ' of' AS abstract FROM orders LEFT JOIN r ON o_orderkey = src")
def snapshot_works(t):
    """Works with addresses for ids and an inverted index for an abstract."""
    refs = t.cites().groupBy("src").agg(F.collect_list(F.concat(F.lit("https://openalex.org/W"), F.col("dst").cast("string"))).alias("referenced_works"))
    o = t.orders.join(refs, F.col("o_orderkey") == F.col("src"), "left")
    words = F.split("o_orderpriority", " ")
    index = F.map_concat(F.map_from_arrays(words, F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array(i))), F.map_from_arrays(F.array(F.lit("of"), F.col("o_orderstatus")), F.array(F.array(F.size(words), F.size(words) + 2), F.array(F.size(words) + 1))))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("https://doi.org/10.1/"), F.col("o_custkey").cast("string")).alias("doi"),
        F.year("o_orderdate").alias("publication_year"), "referenced_works", index.alias("abstract_inverted_index"),
    )
    w = records.works(o.select(F.to_json(work).alias("value")))
    return w.select("id", "doi", "year", F.coalesce(F.size("references"), F.lit(0)).alias("n_references"), "abstract")


@query("SELECT '10.1/' || c_custkey AS doi, strftime(DATE '2020-01-01' + CAST(c_custkey % 400 AS INT), '%Y-%m-%d') AS date, 'retraction' AS type FROM customer WHERE c_custkey % 5 <> 0")
def retraction_feed(t):
    """CSV lines with DOIs in several spellings and two date formats; lines without a date drop out."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 400).cast("int"))
    date = F.when(F.col("c_custkey") % 5 == 0, "").when(F.col("c_custkey") % 2 == 0, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    doi = F.concat(F.when(F.col("c_custkey") % 3 == 0, "https://doi.org/").otherwise("doi:"), F.lit("10.1/"), F.col("c_custkey").cast("string"))
    lines = t.customer.select(F.concat_ws(",", F.col("c_custkey").cast("string"), doi, date, F.lit('"Error, in data"')).alias("value"))
    return records.retractions(lines).withColumn("date", F.col("date").cast("string"))


@query("SELECT CASE n_nationkey % 3 WHEN 0 THEN 'Retraction of ' WHEN 1 THEN 'Erratum: ' ELSE 'Expression of Concern on ' END || n_name AS title, 'http://x/' || n_nationkey AS link, CASE n_nationkey % 3 WHEN 0 THEN 'retraction' WHEN 1 THEN 'erratum' ELSE 'expression_of_concern' END AS type FROM nation")
def errata_feed(t):
    """One RSS document for each region; items that are no correction drop out."""
    title = F.concat(F.get(F.array(F.lit("Retraction of "), F.lit("Erratum: "), F.lit("Expression of Concern on ")), F.col("n_nationkey") % 3), F.col("n_name"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://x/"), F.col("n_nationkey").cast("string"), F.lit("</link></item>"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("<item><title>News</title><link>n</link></item></channel></rss>"))
    return records.feed_items(t.nation.groupBy("n_regionkey").agg(feed.alias("value")))


@query("SELECT 'f' || s_suppkey AS name, s_suppkey AS size FROM supplier WHERE s_suppkey % 3 <> 0")
def manifest_new(t):
    """Files of XML manifests that are not held with the same digest."""
    s = t.supplier.select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"), F.md5("s_name").alias("md5"), "s_suppkey", "s_nationkey")
    entry = F.concat(F.lit("<file><filename>"), "name", F.lit("</filename><md5sum>"), "md5", F.lit("</md5sum><size>"), F.col("s_suppkey").cast("string"), F.lit("</size></file>"))
    listed = records.manifest(s.groupBy("s_nationkey").agg(F.concat(F.lit("<arXivSRC>"), F.array_join(F.collect_list(entry), ""), F.lit("</arXivSRC>")).alias("value")))
    held = s.select("name", F.when(F.col("s_suppkey") % 3 == 0, F.col("md5")).otherwise("old").alias("md5"))
    return records.manifest_delta(listed, held).select("name", "size")


@query("SELECT 'N:' || n_nationkey AS id, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey")
def vocabulary_terms(t):
    """An OBO file, written and read back, each term with its parent's name."""
    out = files.shared_folder(t.spark, "obo")
    terms = t.region.select(F.format_string("[Term]\nid: R:%d\nname: %s", "r_regionkey", "r_name").alias("value"))
    terms = terms.union(t.nation.select(F.format_string("[Term]\nid: N:%d\nname: %s\nis_a: R:%d ! parent", "n_nationkey", "n_name", "n_regionkey")))
    terms.union(t.spark.createDataFrame([("[Term]\nid: N:99\nname: GONE\nis_a: R:1\nis_obsolete: true",), ("[Typedef]\nid: x",)], "value string")).write.option("lineSep", "\n\n").text(out)
    found = records.obo_terms(t.spark.read.option("lineSep", "\n\n").text(out))
    up = found.select(F.col("id").alias("up"), F.col("name").alias("parent"))
    return found.select("id", "name", F.explode("parents").alias("up")).join(up, "up").select("id", "name", "parent")


@query("WITH f AS (SELECT user_id, count(*) AS attempts, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, attempts, strftime(last + to_days(CAST(CASE attempts WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 7 ELSE 30 END AS INT)), '%Y-%m-%d') AS retry_on FROM f")
def retry_ledger(t):
    f = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"))
    return f.select("user_id", "attempts", F.date_format(records.retry_after(F.col("attempts"), F.col("last")), "yyyy-MM-dd").alias("retry_on"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'serve_existing' WHEN p_brand = 'Brand#11' THEN 'serve_sibling' WHEN p_size > 40 THEN 'tier1_ads_body' WHEN p_size % 2 = 0 AND p_partkey % 5 <> 0 AND p_size > 20 THEN 'tier3_docling' ELSE 'abstract_only' END AS tier FROM part")
def fulltext_tiers(t):
    c = F.col
    sibling, kind = F.when(c("p_brand") == "Brand#11", "ar5iv").otherwise("pdf"), F.when(c("p_size") % 2 == 0, "article").otherwise("software")
    route = records.fulltext_route(c("p_size") > 45, sibling, c("p_size") > 40, kind, F.when(c("p_partkey") % 5 != 0, c("p_name")), c("p_size") > 20)
    return t.part.select("p_partkey", route.alias("tier"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_type DESC, value DESC) AS rn FROM events) WHERE rn = 1")
def entity_upsert(t):
    """Rows with even ids are held, odd ones come in; the latest of each user stays."""
    held, new = (t.events.where(F.col("event_id") % 2 == odd).select("user_id", "event_type", "value", "ts") for odd in (0, 1))
    return records.upsert(held, new, ["user_id"], "ts").select("user_id", "event_type", "value")


@query("SELECT lang, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY lang")
def sink_partitions(t):
    """A table written as partitioned Parquet and read back."""
    out = files.shared_folder(t.spark, "sink")
    t.documents.select("doc_id", "lang", "n_chars").write.partitionBy("lang").parquet(out)
    return t.spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))

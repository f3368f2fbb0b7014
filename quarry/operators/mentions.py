"""Mentions in queries, records and bodies, and the logs that keep them current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .entities import resolve
from .retrieval import nearest_centroid

# Lists of mentions in a record, words that name no entity of their type, headings of a body, shares of a parse's confidence.
MENTION_LISTS = ["datasets", "instruments", "materials", "methods", "observables", "software"]
NO_ENTITIES = {
    "dataset": ["data", "experimental data", "kinematic data", "library", "training samples"],
    "gene": ["dna", "genes", "protein", "proteins"],
    "method": ["method"],
    "organism": ["cells"],
    "software": ["code", "library", "program"],
}
BODY_HEADINGS = [
    "abstract", "acknowledgements", "acknowledgments", "analysis", "appendix", "background", "bibliography", "conclusion", "conclusions", "data", "discussion",
    "introduction", "methodology", "methods", "model", "observations", "references", "related work", "results", "summary", "theory",
]
TYPE_TERMS = {
    "asteroid": "asteroid", "asteroids": "asteroid", "comet": "comet", "comets": "comet", "exoplanet": "exoplanet", "exoplanets": "exoplanet", "instrument": "instrument", "instruments": "instrument",
    "mission": "mission", "missions": "mission", "spacecraft": "spacecraft", "telescope": "telescope", "telescopes": "telescope",
}
MISSIONS = ["Cassini", "Chandra", "Galileo", "HST", "Hubble", "JWST", "Juno", "Kepler", "MAVEN", "Perseverance", "Spitzer", "TESS", "Voyager"]
TAXONOMY = "BCKLMPSVX"
PACK = 256  # candidates of a name that go to a query at once
HEADINGS_SHARE, COVERAGE_SHARE, OFFSET_SHARE, ENOUGH_HEADINGS, LATE_HEADING = 0.45, 0.45, 0.10, 6, 5000


def query_grams(queries: DataFrame, id_col: str, query: str, longest: int = 4) -> DataFrame:
    """(id, key, mention, at): each run of one to ``longest`` words as it is written, once by its lower case, where it comes first."""
    q = queries.select(id_col, F.regexp_extract_all(query, F.lit(r"(?U)\w+"), 0).alias("w"), F.split(query, r"(?U)\w+", -1).alias("gap"))
    q = q.select(id_col, "w", F.slice(F.zip_with("gap", "w", lambda g, w: F.concat(g, w)), F.lit(1), F.size("w")).alias("led"))

    def run(i: Column, n: int) -> Column:
        text = F.concat(F.element_at("w", i), F.array_join(F.slice("led", i + 1, F.lit(n - 1)), ""))
        return F.struct((i * longest + n).alias("at"), text.alias("mention"))

    def runs(n: int) -> Column:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: run(i, n))

    g = q.select(id_col, F.explode(F.concat(*[runs(n) for n in range(1, longest + 1)])).alias("r"))
    return g.groupBy(id_col, F.lower("r.mention").alias("key")).agg(F.min("r").alias("r")).select(id_col, "key", F.col("r.mention").alias("mention"), F.col("r.at").alias("at"))


def query_mentions(queries: DataFrame, id_col: str, query: str, names: DataFrame, counts: DataFrame, least: int = 10, longest: int = 4) -> DataFrame:
    """(id, mention, entity, type, papers, score, rank, ambiguous): what the words of a query may name.

    ``names``: (entity, name, type), canonical names and aliases alike;
    ``counts``: (entity, papers), 0 where it has none. The score is the share
    of the most cited candidate; ranks go by papers, ties by id. A mention is
    ambiguous if candidates of two types have more than ``least`` papers.

    All this hangs on the name alone, so it is found once a name. Candidates
    then go to the queries in packs of ``PACK``, dealt by name and pack: no
    task sees all candidates of a name, and rows are not moved once made.
    """
    spark = queries.sparkSession
    known = names.select(F.lower("name").alias("key"), "entity", "type").distinct()
    known = known.join(counts, "entity", "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    often = F.when(F.col("papers") > least, F.col("type"))
    top = known.groupBy("key").agg(F.max("papers").alias("most"), F.coalesce(F.min(often) < F.max(often), F.lit(False)).alias("ambiguous"), F.count("*").alias("n"))
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("papers"), "entity")))
    packs = ranked.groupBy("key", F.floor((F.col("rank") - 1) / PACK).alias("pack")).agg(F.collect_list(F.struct("entity", "type", "papers", "rank")).alias("held"))
    asked = query_grams(queries, id_col, query, longest).join(top, "key").select(id_col, "key", "mention", "most", "ambiguous", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PACK))).alias("pack"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(parts, "key", "pack").join(packs, ["key", "pack"]).select(id_col, "mention", "most", "ambiguous", F.inline("held"))
    score = F.when(F.col("most") > 0, F.col("papers") / F.col("most")).otherwise(0.0)
    return met.select(id_col, "mention", "entity", "type", "papers", score.alias("score"), "rank", "ambiguous")


def query_clauses(query: Column, types: dict[str, str] = TYPE_TERMS, missions: list[str] = MISSIONS, taxonomy: str = TAXONOMY) -> Column:
    """array<struct<type, property, value>>: what a query asks of entities, each clause once; the query's text itself stays whole.

    First the types that its words name, in order; then, if there are any, the
    missions, as a property of the first type; then ``M-type`` and the like as
    an asteroid's taxonomy. A null query has none.
    """
    q = F.coalesce(query, F.lit(""))
    words = F.transform(F.regexp_extract_all(q, F.lit("[A-Za-z][A-Za-z0-9]*"), 0), lambda w: F.lower(w))

    def known(table: dict[str, str]) -> Column:
        m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.array_distinct(F.filter(F.transform(words, lambda w: F.element_at(m, w)), lambda x: x.isNotNull()))

    def clauses(values: Column, kind, prop) -> Column:
        return F.transform(values, lambda x: F.struct((x if kind is None else kind).alias("type"), F.lit(prop).cast("string").alias("property"), F.lit(None).cast("string").alias("value") if prop is None else x.alias("value")))

    named = known(types)
    flown = F.when(F.size(named) > 0, known({m.lower(): m for m in missions})).otherwise(F.array().cast("array<string>"))
    letters = F.transform(F.regexp_extract_all(q, F.lit(r"(?U)\b([A-Za-z])-type\b"), 1), lambda x: F.upper(x))
    classed = F.array_distinct(F.filter(letters, lambda x: F.lit(taxonomy).contains(x)))
    return F.concat(clauses(named, None, None), clauses(flown, F.get(named, F.lit(0)), "mission"), clauses(classed, F.lit("asteroid"), "taxonomy"))


def record_mentions(records: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, mention, list) of a JSON payload's lists of names, or of its list ``entities`` where those are empty; blanks drop out, broken payloads have none."""
    p = records.select(id_col, F.from_json(payload, ", ".join(f"{k} array<string>" for k in [*MENTION_LISTS, "entities"])).alias("p"))

    def named(k: str) -> Column:
        some = F.filter(F.transform(F.col("p")[k], lambda x: F.trim(x)), lambda x: x != "")
        return F.coalesce(F.transform(some, lambda x: F.struct(x.alias("mention"), F.lit(k).alias("list"))), F.array().cast("array<struct<mention:string,list:string>>"))

    own = F.concat(*[named(k) for k in MENTION_LISTS])
    return p.select(id_col, F.explode(F.when(F.size(own) > 0, own).otherwise(named("entities"))).alias("m")).select(id_col, "m.mention", "m.list")


def mention_links(mentions: DataFrame, id_col: str, names: DataFrame) -> DataFrame:
    """(id, entity, score, mentions): each mention's best entity (ties: the smallest id), one row a pair; ``names`` as ``entities.resolve`` takes them."""
    best = resolve(mentions.select("mention"), names).groupBy("mention").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity")).alias("b"))
    hit = mentions.join(best, "mention")
    return hit.groupBy(id_col, F.col("b.entity").alias("entity")).agg(F.max(-F.col("b.s")).alias("score"), F.count("*").alias("mentions"))


def surface(name: Column) -> Column:
    """A name in lower case, without a last parenthesis, white space runs as one space."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r" ?\([^)]*\)$", "")
    return F.lower(F.trim(bare))


def names_nothing(name: Column, kind: Column) -> Column:
    """Whether a name is a common word of its type; a null names nothing known and is kept."""
    key = F.lower(F.trim(name))
    return F.coalesce(F.when(F.lit(False), False), *[F.when(kind == k, key.isin(words)) for k, words in NO_ENTITIES.items()], F.lit(False))


def type_verdicts(found: DataFrame, id_col: str, predicted: str, vector: str, centroids: DataFrame) -> DataFrame:
    """(id, predicted, classified, agrees) of mentions by the type (type, c) whose centroid is nearest by cosine, ties by type.

    A null or zero vector has no class, and whether it agrees stays null.
    """
    near = nearest_centroid(found, id_col, vector, centroids, "type").withColumnRenamed("type", "classified")
    return found.select(id_col, F.col(predicted).alias("predicted")).join(near, id_col, "left").withColumn("agrees", F.col("classified") == F.col("predicted"))


def precision(agrees: Column, filtered: Column, unfiltered: Column, rejected: float = 0.2, unknown: float = 0.5) -> Column:
    """What share of such mentions is right: as measured with the classifier's consent, else without it; ``rejected`` where it disagrees."""
    plain = F.coalesce(unfiltered, F.lit(unknown))
    return F.when(~agrees, rejected).when(agrees, F.coalesce(filtered, plain)).otherwise(plain)


def section_digest(heading: str, text: str) -> Column:
    """The SHA-256 of a heading and its text; nulls as empty."""
    return F.sha2(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))), 256)


def changed_sections(sections: DataFrame, stored: DataFrame, key: list[str], heading: str = "heading", text: str = "text") -> DataFrame:
    """Sections whose digest is not the one stored under their key, with it: what has to be embedded again."""
    return sections.withColumn("digest", section_digest(heading, text)).join(stored.select(*key, "digest"), [*key, "digest"], "left_anti")


def embedding_inputs(papers: DataFrame, id_col: str, title: str, abstract: str) -> DataFrame:
    """(id, text, input_type, source_hash) of papers with a title; an abstract follows it after `` [SEP] ``."""
    both = F.coalesce(F.col(abstract), F.lit("")) != ""
    p = papers.where(F.col(title) != "").select(id_col, F.when(both, F.concat(title, F.lit(" [SEP] "), abstract)).otherwise(F.col(title)).alias("text"), F.when(both, "title_abstract").otherwise("title_only").alias("input_type"))
    return p.withColumn("source_hash", F.sha2("text", 256))


def audit_history(merges: DataFrame, splits: DataFrame) -> DataFrame:
    """(entity, event, others, at, newest): every merge and split under each entity that took part; newest 1 is its last event of the kind.

    ``merges``: (id, old, new, at); ``splits``: (id, parent, children, at).
    """
    m = merges.select("id", F.lit("merge").alias("event"), F.array(F.col("new")).alias("others"), "at", F.explode(F.array_distinct(F.array("old", "new"))).alias("entity"))
    s = splits.select("id", F.lit("split").alias("event"), F.col("children").alias("others"), "at", F.explode(F.array_distinct(F.concat(F.array("parent"), F.col("children")))).alias("entity"))
    w = Window.partitionBy("entity", "event").orderBy(F.desc("at"), F.desc("id"))
    return m.unionByName(s).withColumn("newest", F.row_number().over(w)).drop("id")


def last_watermark(spark: SparkSession, log: str):
    """The watermark of the latest run that has one; null before the first."""
    from pyspark.errors import AnalysisException

    try:
        runs = spark.read.schema("run int, rows long, watermark timestamp").parquet(log)
        return runs.where("watermark is not null").agg(F.max(F.struct("run", "watermark")).alias("r")).select("r.watermark").first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def link_new(spark: SparkSession, rows: DataFrame, at: str, link, table: str, log: str, run: int) -> None:
    """Link rows later than the last watermark, append the links, then the run: a run that dies before its log line is done again.

    ``link`` maps rows to links; rows without a time are never new. The run's
    links stand in a folder of their own, overwritten when it is done again.
    """
    since = last_watermark(spark, log)
    new = rows.where(F.col(at).isNotNull() if since is None else F.col(at) > F.lit(since))
    link(new).write.mode("overwrite").parquet(f"{table}/run={run}")
    new.agg(F.lit(run).alias("run"), F.count("*").alias("rows"), F.max(at).alias("watermark")).write.mode("overwrite").parquet(f"{log}/part={run}")


def stale(last: Column, now: Column, hours: int) -> Column:
    """Whether a watermark is older than it may be; none yet is not stale."""
    return F.coalesce(now - last > F.make_dt_interval(F.lit(0), F.lit(hours)), F.lit(False))


def log_calls(calls: DataFrame, path: str) -> None:
    """Append calls (tool, query, results, session, is_test) to a log partitioned by day; ``at`` is now where it is null."""
    row = calls.select("tool", "query", F.coalesce("results", F.lit(0)).alias("results"), "session", F.coalesce("is_test", F.lit(False)).alias("is_test"), F.coalesce("at", F.current_timestamp()).alias("at"))
    row.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def empty_answers(log: DataFrame) -> DataFrame:
    """(tool, calls, sessions, empty_share) without test traffic."""
    return log.where(~F.col("is_test")).groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("session").alias("sessions"), F.avg((F.col("results") == 0).cast("int")).alias("empty_share"))


def body_sections(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, at, heading, start, text, confidence) of a flat body cut at the words that head sections.

    Headings are found in any case and given in capitals; a number before one
    belongs to it. Bodies with fewer than two different headings, empty or
    null ones have no rows. Offsets count code points. The confidence weighs
    the number of headings, the share of the body under one and how early the
    first stands.
    """
    words = "|".join([r"appendix\s+[a-z]\b", *[w.replace(" ", r"\s+") + r"\b" for w in sorted(BODY_HEADINGS, key=lambda w: (-len(w), w))]])
    rx = rf"(?i)((?:\d+(?:\.\d+)*[.\s]+)?)\b({words})"
    whole = F.translate(body, "\x01\x02\x03", "   ")
    cut = df.select(id_col, F.length(body).alias("size"), F.split(F.regexp_replace(whole, rx, "\x01$1\x02$2\x03"), "\x01").alias("p"))

    def part(x: Column) -> Column:
        number, rest = F.substring_index(x, "\x02", 1), F.substring_index(x, "\x02", -1)
        head, text = F.substring_index(rest, "\x03", 1), F.substring_index(rest, "\x03", -1)
        return F.struct(F.upper(F.regexp_replace(head, r"\s+", " ")).alias("heading"), text.alias("text"), (F.length(number) + F.length(head) + F.length(text)).alias("size"))

    c = cut.where(F.size("p") > 2).select(id_col, "size", F.length(F.col("p")[0]).alias("first"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), part).alias("s"))
    c = c.where(F.size(F.array_distinct(F.transform("s", lambda x: x["heading"]))) > 1)
    covered = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x["text"]))
    score = HEADINGS_SHARE * F.least(F.size("s") / ENOUGH_HEADINGS, F.lit(1.0)) + COVERAGE_SHARE * covered / F.col("size") + OFFSET_SHARE * F.greatest(F.lit(0.0), 1 - F.col("first") / LATE_HEADING)
    c = c.select(id_col, "first", score.alias("confidence"), F.posexplode("s").alias("at", "x"))
    before = F.coalesce(F.sum("x.size").over(Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(id_col, "at", "x.heading", (F.col("first") + before).alias("start"), "x.text", "confidence")

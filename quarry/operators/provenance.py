"""Where claims come from, and how links, mentions and sessions hold together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reviews import INTENT_WEIGHTS, OTHER_WEIGHT, intent_weight

# Shares of intent, order and meaning in an origin's confidence; rungs of the resolution ladder.
INTENT_SHARE, ORDER_SHARE, MEANING_SHARE = 0.5, 0.3, 0.2
CANONICAL, ALIAS, IDENTIFIER, SAME_FIELD = 1.0, 0.9, 0.85, 0.05
SHORTEST_NAME, SAFE_NAME = 3, 6


def claim_origin(seeds: DataFrame, contexts: DataFrame, retracted: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row (origin, year, confidence): the earliest paper that stands behind a claim, or no row.

    ``seeds``: (paper, year, meaning), papers that state the claim, ``meaning``
    a cosine or null; ``contexts``: (source, target, year, intent), their
    citations. The candidates are the seeds and what they cite, without those
    outside the years and the retracted. The first by year (null last), then
    by the weight of its citations' intent, then by meaning, then by id.
    """
    own = seeds.select("paper", "year", F.lit(INTENT_WEIGHTS["result_comparison"]).alias("seeded"), F.lit(None).cast("double").alias("weight"), F.col("meaning").cast("double").alias("meaning"))
    cited = contexts.join(seeds.select(F.col("paper").alias("source")), "source", "left_semi")
    cited = cited.select(F.col("target").alias("paper"), "year", F.lit(None).cast("double").alias("seeded"), intent_weight(F.col("intent")).alias("weight"), F.lit(0.0).alias("meaning"))
    u = own.union(cited).groupBy("paper").agg(F.coalesce(F.min(F.when(F.col("seeded").isNotNull(), F.col("year"))), F.min("year")).alias("year"), F.coalesce(F.max("weight"), F.max("seeded"), F.lit(OTHER_WEIGHT)).alias("weight"), F.coalesce(F.max("meaning"), F.lit(0.0)).alias("meaning"))
    if first is not None:
        u = u.where(F.col("year").isNull() | (F.col("year") >= first))
    if last is not None:
        u = u.where(F.col("year").isNull() | (F.col("year") <= last))
    u = u.join(retracted.select("paper"), "paper", "left_anti")
    key = F.struct(F.coalesce("year", F.lit(9999)).alias("y"), (-F.col("weight")).alias("w"), (-F.col("meaning")).alias("s"), "paper", "year")
    best = u.agg(F.min(key).alias("o"))
    others = u.crossJoin(F.broadcast(best)).where("paper <> o.paper").agg(F.max((F.col("year") <= F.col("o.year")).cast("int")).alias("tied"))  # one row
    order = F.when(F.coalesce("tied", F.lit(0)) == 1, 0.5).otherwise(1.0)
    confidence = INTENT_SHARE * -F.col("o.w") + ORDER_SHARE * order + MEANING_SHARE * (1 - F.col("o.s")) / 2
    return best.crossJoin(F.broadcast(others)).where("o is not null").select(F.col("o.paper").alias("origin"), F.col("o.year").alias("year"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))


def citation_consistency(edges: DataFrame, mentions: DataFrame, entity) -> DataFrame:
    """(src, total, matching, consistency): the share of a paper's citations that mention an entity; a paper that cites nothing has no row."""
    own = mentions.where(F.col("entity") == entity).select(F.col("paper").alias("dst"), F.lit(1).alias("hit")).distinct()
    n = edges.join(own, "dst", "left").groupBy("src").agg(F.count("*").alias("total"), F.count("hit").alias("matching"))
    return n.withColumn("consistency", F.col("matching") / F.col("total"))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a name's words, each word padded with two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def resolve(mentions: DataFrame, names: DataFrame, threshold: float = 0.3, field: str | None = None) -> DataFrame:
    """(mention, entity, score) by a ladder: canonical names, aliases where none is canonical, identifiers beside either, trigrams where nothing else is found.

    ``names``: (entity, name, kind, field), kind canonical, alias or
    identifier. An entity of ``field`` scores a little more, 1 at most; of
    several scores the best. Trigrams meet in an equi-join and are counted.
    """
    m = mentions.select("mention").distinct().withColumn("key", F.lower("mention"))
    hit = m.join(names.select(F.lower("name").alias("key"), "entity", "kind", "field"), "key")
    rung = F.when(F.col("kind") == "canonical", CANONICAL).when(F.col("kind") == "alias", ALIAS).otherwise(IDENTIFIER)
    best = hit.groupBy("mention").agg(F.max((F.col("kind") == "canonical").cast("int")).alias("has"))
    exact = hit.join(best, "mention").where("kind <> 'alias' or has = 0").select("mention", "entity", "field", rung.alias("score"))
    rest = m.join(best, "mention", "left_anti")
    known = names.where("kind <> 'identifier'").select("entity", "field", "name").distinct()
    a = rest.select("mention", trigrams(F.col("mention")).alias("g"))
    b = known.select("entity", "field", "name", trigrams(F.col("name")).alias("h"))
    met = a.select("mention", F.size("g").alias("n"), F.explode("g").alias("x")).join(b.select("entity", "field", "name", F.size("h").alias("k"), F.explode("h").alias("x")), "x")
    both = met.groupBy("mention", "entity", "field", "name", "n", "k").agg(F.count("*").alias("o"))
    near = both.withColumn("score", F.col("o") / (F.col("n") + F.col("k") - F.col("o"))).where(F.col("score") > threshold).select("mention", "entity", "field", "score")
    score = F.col("score") if field is None else F.least(F.lit(1.0), F.col("score") + F.when(F.col("field") == field, SAME_FIELD).otherwise(0.0))
    return exact.union(near).withColumn("score", score).groupBy("mention", "entity").agg(F.max("score").alias("score"))


def ambiguity(names: DataFrame, banned: list[str]) -> DataFrame:
    """(entity, class): banned where a name is short or common, homograph where another entity has a name too, domain_safe where the canonical name is long and of one source, else unique.

    ``names``: (entity, name, kind, source).
    """
    key = F.lower("name")
    shared = names.groupBy(key.alias("key")).agg(F.count_distinct("entity").alias("owners"), F.count_distinct("source").alias("sources"))
    each = names.withColumn("key", key).join(shared, "key")
    bad = (F.length(F.trim("name")) < SHORTEST_NAME) | F.col("key").isin(banned)
    n = each.groupBy("entity").agg(F.max(bad.cast("int")).alias("bad"), F.max("owners").alias("owners"), F.max("sources").alias("sources"), F.max(F.when(F.col("kind") == "canonical", F.length(F.trim("name")))).alias("len"))
    kind = F.when(F.col("bad") == 1, "banned").when(F.col("owners") > 1, "homograph").when((F.col("len") >= SAFE_NAME) & (F.col("sources") == 1), "domain_safe").otherwise("unique")
    return n.select("entity", kind.alias("class"))


def inherited(links: DataFrame, part_of: DataFrame) -> DataFrame:
    """Links (paper, entity) that parts hand on to what they are part of (part, whole), without those there already."""
    return links.join(part_of, links["entity"] == part_of["part"]).select("paper", F.col("whole").alias("entity")).distinct().join(links.select("paper", "entity"), ["paper", "entity"], "left_anti")


def hierarchy_edges(paths: Column, cut: str = " > ") -> Column:
    """(parent, child) of each step of a path such as ``A > B > C``."""
    p = F.transform(F.split(paths, cut), lambda x: F.trim(x))
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.element_at(p, i).alias("parent"), F.element_at(p, i + 1).alias("child")))).otherwise(F.array().cast("array<struct<parent:string,child:string>>"))


def grounded(claims: DataFrame, quotes: DataFrame, key: str, exact: float = 0.95) -> DataFrame:
    """(id, score): ``exact`` where a claim's normal form holds or is held by a quote of the same ``key``, else the share of its words in the best quote; 0 without quotes."""
    def norm(c):
        return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    c, q = claims.select("id", key, norm("claim").alias("c")), quotes.select(key, norm("quote").alias("q")).where("q <> ''")
    words = F.array_distinct(F.split("c", " "))
    part = F.size(F.array_intersect(words, F.split("q", " "))) / F.size(words)
    s = F.when(F.coalesce("c", F.lit("")) == "", 0.0).when(F.col("q").isNull(), 0.0).when(F.col("q").contains(F.col("c")) | F.col("c").contains(F.col("q")), exact).otherwise(F.least(part, F.lit(exact)))
    return c.join(q, key, "left").groupBy("id").agg(F.max(s).alias("score"))


def merged_ids(merges: DataFrame, old: str, new: str) -> DataFrame:
    """(old, current) of an append-only log of merges, followed to its end; a cycle ends at its smallest id."""
    from .graph import _saved

    step = _saved(merges.groupBy(F.col(old).alias("old")).agg(F.max(new).alias("current")))
    while True:
        hop = step.select(F.col("old").alias("current"), F.col("current").alias("next"))
        nxt = _saved(step.join(hop, "current", "left").select("old", "current", F.when(F.col("next") == F.col("old"), F.least("old", "current")).otherwise(F.coalesce("next", "current")).alias("to")))
        if nxt.where("current <> to").isEmpty():
            return step
        step = nxt.select("old", F.col("to").alias("current"))


def breaker(calls: DataFrame, key: str, order: list[str], failed: Column, most: int) -> DataFrame:
    """Each call with how many failed in a row up to it, and whether the circuit is open after it."""
    w = Window.partitionBy(key).orderBy(*order)
    run = calls.withColumn("__f", failed.cast("int")).withColumn("__g", F.sum(1 - F.col("__f")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum("__f").over(Window.partitionBy(key, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("failures", n).withColumn("open", F.col("failures") >= most).drop("__f", "__g")


def live_rows(cache: DataFrame, written: str, now: Column, days: int = 14) -> DataFrame:
    """Rows of a cache that have not expired, with the day on which they do: the partition that is dropped whole."""
    return cache.withColumn("expires_on", F.to_date(F.col(written) + F.make_dt_interval(F.lit(days)))).where(F.col(written) + F.make_dt_interval(F.lit(days)) > now)


def shard(key: Column, shards: int) -> Column:
    """The shard of a key by its digest, the same in every session and engine."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after a key, in its order."""
    df = df if after is None else df.where(F.col(key) > after)
    return df.orderBy(key).limit(size)


def keyset_batches(df: DataFrame, key: str, after, size: int, name: str = "batch") -> DataFrame:
    """All rows after a key with the number, from 0, of the page of ``size`` rows by key that holds them: what repeated ``keyset_page`` calls read, numbered in one pass."""
    from ..functions.stats import running

    rows = df.where(F.col(key).isNotNull() if after is None else F.col(key) > after)
    return running(rows, [key], F.lit(1)).withColumn(name, F.floor(F.col("before") / size).cast("int")).drop("before", "whole")

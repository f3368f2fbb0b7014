"""Keyword queries, concepts, names and sections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import tokens

# Weights of title and body in a rank, limits of the broad-query guard, scores of a concept's names.
TITLE_WEIGHT, BODY_WEIGHT = 1.0, 0.4
BROAD_TOKENS, BROAD_CHARS = 3, 30
CONCEPT_SCORES = {"exact": 1.0, "alternate": 0.7, "prefix": 0.5, "contains": 0.3}


def parse(query: str) -> list[list[tuple[str, bool]]]:
    """A query as alternatives of (phrase, wanted) conditions: words and "phrases" all hold, ``-`` negates the next, ``or`` parts alternatives."""
    out: list[list[tuple[str, bool]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            out.append([])
            continue
        terms = " ".join(re.findall("[a-z0-9]+", (phrase or word).lower()))
        if terms:
            out[-1].append((terms, not minus))
    return [x for x in out if x]


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def matches(spaced: Column, parsed: list) -> Column:
    """Whether a text, given as words between single spaces, meets a parsed query; nothing meets an empty one."""

    def holds(phrase: str, wanted: bool) -> Column:
        hit = spaced.contains(f" {phrase} ")
        return hit if wanted else ~hit

    arms = [reduce(lambda a, b: a & b, (holds(*x) for x in arm)) for arm in parsed]
    return reduce(lambda a, b: a | b, arms) if arms else F.lit(False)


def keyword_search(df: DataFrame, id_col: str, title: Column, body: Column, query: str, k: int, match: str = "both") -> DataFrame:
    """(id, score): texts that meet the query, ``match`` in title and body together or in ``body`` alone; r / (r + 1) of weighted word hits, ties by id.

    Each text is split once. With ``match="body"`` the rank is still that of the title.
    """
    parsed = parse(query)
    words = sorted({w for arm in parsed for p, wanted in arm if wanted for w in p.split()})
    t = df.select(id_col, tokens(F.coalesce(title, F.lit(""))).alias("__t"), tokens(F.coalesce(body, F.lit(""))).alias("__b"))
    text = F.concat(_spaced(F.col("__t")), _spaced(F.col("__b"))) if match == "both" else _spaced(F.col("__b"))

    def hits(c: str) -> Column:
        return F.size(F.filter(c, lambda w: w.isin(words)))

    rank = TITLE_WEIGHT * hits("__t") + (BODY_WEIGHT * hits("__b") if match == "both" else 0)
    found = t.where(matches(text, parsed)).withColumn("r", rank)
    return found.select(id_col, F.round(F.col("r") / (F.col("r") + 1), 6).alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def broad(query: Column, scoped: Column) -> Column:
    """Whether a query without a scope is too broad: three words or thirty characters."""
    q = F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), "\\s+", " "))
    return ~scoped & (q != "") & ((F.size(F.split(q, " ")) >= BROAD_TOKENS) | (F.length(F.trim(query)) >= BROAD_CHARS))


def merge_filters(base: dict | None, types: list | None = None, ids: list | None = None) -> dict:
    """A filter with more entity types and ids, each list united in order; empty lists filter nothing."""
    out = dict(base or {})
    for key, more in (("entity_types", types), ("entity_ids", ids)):
        both = list(dict.fromkeys([*(out.get(key) or []), *(more or [])]))
        if both:
            out[key] = both
    return out


def selectivity(df: DataFrame, where: Column, share: float = 0.01) -> tuple[float, bool]:
    """(share of rows that pass, whether the count stopped at the cap): counting ends just beyond ``share`` of the table."""
    total = df.count()
    cap = int(total * share) + 1
    n = df.where(where).limit(cap).count()
    return (n / total if total else 0.0), n >= cap


def with_properties(df: DataFrame, json_col: str, wanted: dict) -> DataFrame:
    """Rows whose JSON object holds all the given pairs."""
    for name, value in wanted.items():
        df = df.where(F.get_json_object(json_col, f"$.{name}") == F.lit(str(value)))
    return df


def concepts(df: DataFrame, preferred: str, alternates: Column, query: str) -> DataFrame:
    """Rows that a query names, with ``score``: the preferred label 1, an alternate 0.7, a prefix of the label 0.5, a part of it 0.3."""
    q, label = query.strip().lower(), F.lower(preferred)
    s = CONCEPT_SCORES
    score = (
        F.when(label == q, s["exact"]).when(F.exists(alternates, lambda a: F.lower(a) == q), s["alternate"])
        .when(label.startswith(q), s["prefix"]).when(label.contains(q), s["contains"])
    )
    return df.withColumn("score", score).where("score is not null")


def author_variants(name: str) -> list[str]:
    """Spellings of a name as ``Surname, Given``: whole, first name, initials, first initial."""
    if "," in name:
        surname, given = (x.strip() for x in name.split(",", 1))
    elif len(name.split()) > 1:
        *first, surname = name.split()
        given = " ".join(first)
    else:
        return [name.strip()]
    parts = given.split()
    if not parts:
        return []
    found = [given, " ".join(f"{p[0]}." for p in parts)]
    if len(parts) > 1:
        found = [given, parts[0], found[1], f"{parts[0][0]}."]
    return list(dict.fromkeys(f"{surname}, {x}" for x in found))


def sections(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, section, body): the lines of a text with a word, numbered from 0."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return df.select(id_col, F.posexplode(lines).alias("section", "body"))


def best_sections(parts: DataFrame, keys: list[str], body: str, score: Column, k: int) -> DataFrame:
    """The ``k`` best sections of each document, ties by section."""
    ranked = parts.withColumn("score", score).where("score > 0")
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("section")))).where(F.col("rn") <= k)


def page(text: Column, offset: int, limit: int) -> Column:
    """``limit`` characters from ``offset`` (0 for the first) on."""
    return F.substring(text, F.lit(offset + 1), F.lit(limit))


def with_fallback(rows: DataFrame, key: str, value: str, aliases: DataFrame) -> DataFrame:
    """``value`` of each row, or, where it has none, that of the least alias (key, alias) that has one."""
    held = rows.select(F.col(key).alias("alias"), F.col(value).alias("__v")).where("__v is not null")
    other = aliases.join(held, "alias").groupBy(key).agg(F.min(F.struct("alias", "__v")).alias("__o"))
    joined = rows.join(other, key, "left")
    return joined.select(*[c for c in rows.columns if c != value], F.coalesce(F.col(value), F.col("__o.__v")).alias(value), F.when(F.col(value).isNull(), F.col("__o.alias")).alias("served_by"))


def alias_expansion(queries: DataFrame, id_col: str, text: str, names: DataFrame, most: int = 8, longest: int = 3) -> DataFrame:
    """(id, entity, aliases): entities that a run of one to ``longest`` of a query's words names, with up to ``most`` of their names in the alphabet's order.

    ``names``: (entity, name). A name of several entities counts only where a name of the entity alone is there as well.
    """
    words = queries.select(id_col, tokens(text).alias("w"))
    runs = F.flatten(F.array(*[F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]))
    grams = words.select(id_col, F.explode(F.array_distinct(runs)).alias("key"))
    keyed = names.select("entity", "name", F.array_join(tokens("name"), " ").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count_distinct("entity").alias("owners"))
    hit = grams.join(keyed.join(shared, "key"), "key")
    sure = hit.where("owners = 1").select(id_col, "entity").distinct()
    listed = names.select("entity", "name").distinct().groupBy("entity").agg(F.slice(F.sort_array(F.collect_list("name")), 1, most).alias("aliases"))
    return sure.join(listed, "entity").select(id_col, "entity", "aliases")

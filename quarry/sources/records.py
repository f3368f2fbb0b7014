"""Records of papers, vocabularies, corrections and manifests to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a paper's record and how they are renamed.
RENAMED = {"author": "authors", "aff": "affiliations", "keyword": "keywords", "grant": "grant_facet"}
TEXTS = ["bibcode", "abstract", "doctype", "pub", "first_author", "pubdate"]
ARRAYS = ["doi", "arxiv_class", "database"]
NUMBERS = {"citation_count": "int", "read_count": "int", "reference_count": "int"}
RETRY_DAYS = {1: 1, 2: 3, 3: 7}
RETRY_DAYS_AFTER = 30
LATEX_SOURCES = ["ar5iv", "arxiv_local"]
PDF_DOCTYPES = ["article", "eprint", "review"]


def _clean(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def _list(c: Column) -> Column:
    """The array that a JSON text is, its members as text; null if it is none."""
    return F.when(c.startswith("["), F.transform(F.from_json(c, "array<string>"), _clean))


def papers(lines: DataFrame, value: str = "value") -> DataFrame:
    """Typed rows of JSON records, one a line.

    Lists are renamed, a title is its list's first member, a year or number
    that is none becomes null, NUL characters go, and what has no column is
    folded into the JSON object ``raw`` (its values as text). A record without
    a bibcode is an error.
    """
    m = lines.select(F.from_json(value, "map<string,string>").alias("m"))

    def get(name: str) -> Column:
        return F.element_at("m", name)

    key = get("bibcode")
    cols = [F.when(F.coalesce(F.length(key), F.lit(0)) > 0, _clean(key)).otherwise(F.raise_error(F.lit("a record has no bibcode"))).alias("bibcode")]
    cols += [_clean(get(c)).alias(c) for c in TEXTS[1:]]
    title = get("title")
    cols.append(F.when(title.startswith("["), F.coalesce(F.get(_list(title), 0), F.when(F.from_json(title, "array<string>").isNull(), _clean(title)))).otherwise(_clean(title)).alias("title"))
    cols.append(get("year").try_cast("int").alias("year"))
    cols += [get(c).try_cast(t).alias(c) for c, t in NUMBERS.items()]
    cols += [_list(get(c)).alias(c) for c in ARRAYS]
    cols += [_list(get(c)).alias(n) for c, n in RENAMED.items()]
    mapped = [*TEXTS, "title", "year", *NUMBERS, *ARRAYS, *RENAMED]
    rest = F.map_filter("m", lambda k, v: ~k.isin(mapped))
    cols.append(F.when(F.size(rest) > 0, F.to_json(rest)).alias("raw"))
    return m.select(*cols)


def reference_edges(lines: DataFrame, value: str = "value") -> DataFrame:
    """(src, dst) of each record's references; empty ones are left out."""
    r = lines.select(F.from_json(value, "bibcode string, reference array<string>").alias("r"))
    return r.select(F.col("r.bibcode").alias("src"), F.explode("r.reference").alias("dst")).where("dst <> ''")


def works(lines: DataFrame, value: str = "value") -> DataFrame:
    """Works of a snapshot, pruned: (id, doi, title, year, type, cited_by, references, abstract), ids without their address, the abstract from its inverted index."""
    schema = "id string, doi string, title string, publication_year int, type string, cited_by_count int, referenced_works array<string>, abstract_inverted_index map<string,array<int>>"
    r = lines.select(F.from_json(value, schema).alias("r")).select("r.*")
    placed = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, "^https?://[^/]+/", "")

    return r.select(
        bare(F.col("id")).alias("id"), F.lower(bare(F.col("doi"))).alias("doi"), "title", F.col("publication_year").alias("year"), "type", F.col("cited_by_count").alias("cited_by"),
        F.transform("referenced_works", bare).alias("references"), F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ").alias("abstract"),
    )


def retractions(lines: DataFrame, value: str = "value") -> DataFrame:
    """(doi, date, type) of CSV lines ``RecordID,OriginalPaperDOI,RetractionDate,Reason``; lines without a DOI or date are left out."""
    r = lines.select(F.from_csv(value, "RecordID string, OriginalPaperDOI string, RetractionDate string, Reason string").alias("r")).select("r.*")
    doi = F.lower(F.regexp_replace(F.trim("OriginalPaperDOI"), "^(https?://(dx\\.)?doi\\.org/|doi:)", ""))
    date = F.coalesce(F.try_to_date("RetractionDate", "yyyy-MM-dd"), F.try_to_date("RetractionDate", "M/d/yyyy"))
    return r.select(doi.alias("doi"), date.alias("date"), F.lit("retraction").alias("type")).where("doi <> '' and date is not null")


def feed_items(feeds: DataFrame, value: str = "value") -> DataFrame:
    """(title, link, type) of the items of RSS documents; the type goes by the title."""
    r = feeds.select(F.explode(F.from_xml(value, "channel struct<item: array<struct<title: string, link: string>>>")["channel"]["item"]).alias("i")).select("i.title", "i.link")
    t = F.lower("title")
    kind = F.when(t.contains("retract"), "retraction").when(t.contains("erratum") | t.contains("corrigendum") | t.contains("correction"), "erratum").when(t.contains("concern"), "expression_of_concern")
    return r.select("title", "link", kind.alias("type")).where("type is not null")


def manifest(documents: DataFrame, value: str = "value") -> DataFrame:
    """(name, md5, size) of the files that XML manifests list."""
    r = documents.select(F.explode(F.from_xml(value, "file array<struct<filename: string, md5sum: string, size: bigint>>")["file"]).alias("f"))
    return r.select(F.col("f.filename").alias("name"), F.col("f.md5sum").alias("md5"), F.col("f.size").alias("size"))


def manifest_delta(listed: DataFrame, held: DataFrame) -> DataFrame:
    """What is listed and not held with the same digest."""
    return listed.join(held.select("name", "md5"), ["name", "md5"], "left_anti")


def obo_terms(stanzas: DataFrame, value: str = "value") -> DataFrame:
    """(id, name, parents) of the [Term] stanzas of an OBO file read with blank lines between records; obsolete terms are left out."""
    t = stanzas.where(F.col(value).rlike("^\\s*\\[Term\\]") & ~F.col(value).rlike("(?m)^is_obsolete: true"))
    parents = F.regexp_extract_all(value, F.lit("(?m)^is_a: (\\S+)"), 1)
    return t.select(F.regexp_extract(value, "(?m)^id: (\\S+)", 1).alias("id"), F.regexp_extract(value, "(?m)^name: (.*)$", 1).alias("name"), parents.alias("parents"))


def retry_after(attempts: Column, now: Column) -> Column:
    """When a failed parse may be tried again: after 1, 3, 7 and from then on 30 days."""
    days = F.coalesce(*[F.when(attempts == a, F.lit(d)) for a, d in RETRY_DAYS.items()], F.lit(RETRY_DAYS_AFTER))
    return now + F.make_dt_interval(days)


def fulltext_route(has_row: Column, sibling: Column, has_body: Column, doctype: Column, doi: Column, has_pdf: Column) -> Column:
    """Which tier serves a full text: the first rule that holds."""
    return (
        F.when(has_row, "serve_existing").when(sibling.isin(LATEX_SOURCES), "serve_sibling").when(has_body, "tier1_ads_body")
        .when(doctype.isin(PDF_DOCTYPES) & doi.isNotNull() & has_pdf, "tier3_docling").otherwise("abstract_only")
    )


def upsert(held: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """``held`` and ``incoming`` merged: of each key the row of the latest version, of equal ones the incoming row, then the greatest."""
    rest = [c for c in held.columns if c not in key]
    both = held.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return both.groupBy(*key).agg(F.max(F.struct(version, "__new", *[c for c in rest if c != version])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def bodies(lines: DataFrame, value: str = "value") -> DataFrame:
    """(corpus_id, body, sections) of JSON records whose content is a list of sections; empty ones drop out, a record without any too.

    A section's name stands before it as ``## name``; ``sections`` keeps name and text.
    """
    r = lines.select(F.from_json(value, "corpusid long, content struct<text: array<struct<section: string, text: string>>>").alias("r"))
    kept = F.filter("r.content.text", lambda s: F.coalesce(s["text"], F.lit("")) != "")
    r = r.select(F.col("r.corpusid").alias("corpus_id"), kept.alias("sections")).where("corpus_id is not null and size(sections) > 0")
    named = F.transform("sections", lambda s: F.when(F.coalesce(s["section"], F.lit("")) != "", F.concat(F.lit("## "), s["section"], F.lit("\n\n"), s["text"])).otherwise(s["text"]))
    return r.select("corpus_id", F.array_join(named, "\n\n").alias("body"), "sections")


def cited_intents(lines: DataFrame, value: str = "value") -> DataFrame:
    """(citing, cited, influential, intents) of JSON citations; without either end there is no row, without intents an empty list."""
    r = lines.select(F.from_json(value, "citingcorpusid long, citedcorpusid long, isinfluential boolean, intents array<string>").alias("r")).where("r.citingcorpusid is not null and r.citedcorpusid is not null")
    return r.select(F.col("r.citingcorpusid").alias("citing"), F.col("r.citedcorpusid").alias("cited"), F.coalesce("r.isinfluential", F.lit(False)).alias("influential"), F.coalesce("r.intents", F.array().cast("array<string>")).alias("intents"))

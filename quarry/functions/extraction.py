"""What texts say: author-year citations, quantities, sections, chunks, the structure of pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Quantities, their spellings and units, and headings by canonical name.
QUANTITIES = {"H0": "H_?0|Hubble constant", "Omega_m": "Omega_?m|Ω_?m", "sigma_8": "sigma_?8|σ_?8", "n_s": "n_s", "redshift": "redshift|z", "mass": "[Mm]ass"}
UNITS = "km\\s*/?\\s*s(?:\\^?-1)?\\s*/?\\s*Mpc(?:\\^?-1)?|Mpc|kpc|Gyr|Myr|GeV|MeV|keV|M_sun|K|%"
NUMBER = "[-+]?\\d+(?:\\.\\d+)?"
HEADINGS = {"introduction": "introduction|background", "methods": "methods?|methodology|data(?: and methods)?|observations?", "results": "results?|findings", "discussion": "discussion", "conclusions": "conclusions?|summary", "references": "references|bibliography"}


def author_years(body: Column) -> Column:
    """Surnames and years cited as ``Smith (2001)``, ``Smith et al. 2001`` or ``(Smith & Jones, 2001a)``: array<struct<author, year>>, in order."""
    rx = "([A-Z][A-Za-z'\\u00C0-\\u017F-]+)(?:\\s+(?:&|and)\\s+[A-Z][A-Za-z'\\u00C0-\\u017F-]+|\\s+et\\s+al\\.?)?,?\\s*\\(?((?:19|20)\\d\\d)[a-z]?\\b"
    a, y = F.regexp_extract_all(body, F.lit(rx), 1), F.regexp_extract_all(body, F.lit(rx), 2)
    return F.zip_with(a, y, lambda x, z: F.struct(x.alias("author"), z.cast("int").alias("year")))


def resolve_author_years(found: DataFrame, references: DataFrame, key: list[str], least: float = 0.0) -> DataFrame:
    """(key, author, year, target, confidence) of cited names whose reference begins with the year and ends with the surname's initial; confidence 1 / candidates, those under ``least`` left out.

    ``references``: (key, target), a target being a bibcode: year, journal, initial.
    """
    r = references.select(*key, "target", F.substring("target", 1, 4).try_cast("int").alias("year"), F.upper(F.substring("target", -1, 1)).alias("i"))
    hit = found.select(*key, "author", "year", F.upper(F.substring("author", 1, 1)).alias("i")).distinct().join(r, [*key, "year", "i"])
    n = hit.groupBy(*key, "author", "year").agg(F.count("*").alias("n"))
    return hit.join(n, [*key, "author", "year"]).withColumn("confidence", 1 / F.col("n")).where(F.col("confidence") >= least).select(*key, "author", "year", "target", "confidence")


def quantities(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, quantity, value, uncertainty, unit, confidence) of statements such as ``H0 = 70 ± 2 km/s/Mpc``; high with uncertainty and unit, medium with one, else low."""
    made = None
    for name, spelled in QUANTITIES.items():
        rx = f"(?:^|[^A-Za-z_])(?:{spelled})\\s*(?:=|of|is|~|≈)\\s*({NUMBER})(?:\\s*(?:±|\\+/-)\\s*(\\d+(?:\\.\\d+)?))?(?:\\s*({UNITS})(?![A-Za-z]))?"
        parts = [F.regexp_extract_all(text, F.lit(rx), g) for g in (1, 2, 3)]
        one = df.select(F.col(id_col), F.explode(F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])).alias("z"))
        v, u, unit = (F.col("z")[f"g{i}"] for i in range(3))
        one = one.select(id_col, F.lit(name).alias("quantity"), v.cast("double").alias("value"), F.when(u != "", u.cast("double")).alias("uncertainty"), F.when(unit != "", unit).alias("unit"))
        made = one if made is None else made.unionByName(one)
    both = F.col("uncertainty").isNotNull().cast("int") + F.col("unit").isNotNull().cast("int")
    return made.withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), both + 1))


def heading(raw: Column) -> Column:
    """The canonical name of a heading without its number, or its own words in lower case."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(raw)), "^(?:\\d+(?:\\.\\d+)*|[ivx]+)[.)]?\\s+|[.:]$", ""))
    return F.coalesce(*[F.when(bare.rlike(f"^(?:{rx})$"), n) for n, rx in HEADINGS.items()], bare)


def sections(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, section, name, text): a body cut at lines that are headings, what stands before the first as ``preamble``; without headings one ``full`` section."""
    line = "(?im)^[ \\t]*(?:\\d+(?:\\.\\d+)*[.)]?[ \\t]+)?(?:" + "|".join(HEADINGS.values()) + ")[ \\t]*:?[ \\t]*$"
    mark = "\x01"

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, "^\\s+|\\s+$", "")

    cut = F.split(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), line, mark + "$0" + mark), mark)
    heads = F.filter(F.sequence(F.lit(1), F.size(cut) - 1), lambda i: i % 2 == 1)
    named = F.transform(heads, lambda i: F.struct(heading(F.get(cut, i)).alias("name"), bare(F.get(cut, i + 1)).alias("text")))
    first = F.struct(F.lit("preamble").alias("name"), bare(F.get(cut, F.lit(0))).alias("text"))
    whole = F.struct(F.lit("full").alias("name"), F.coalesce(F.col(body), F.lit("")).alias("text"))
    every = F.when(F.size(cut) < 2, F.array(whole)).otherwise(F.concat(F.when(bare(F.get(cut, F.lit(0))) != "", F.array(first)).otherwise(F.array().cast("array<struct<name:string,text:string>>")), named))
    return df.select(id_col, F.posexplode(every).alias("section", "s")).select(id_col, "section", "s.name", "s.text")


def chunks(sections_: DataFrame, keys: list[str], text: str, window: int = 512, lap: int = 64) -> DataFrame:
    """(keys, chunk, start, n, body) of windows of words that overlap by ``lap`` and never leave their section; a tail shorter than ``lap`` is dropped unless it is all there is."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    step = window - lap
    w = sections_.select(*keys, words.alias("w")).where(F.size("w") > 0)
    at = w.select(*keys, "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("chunk", "start"))
    n = F.least(F.lit(window), F.size("w") - F.col("start"))
    return at.withColumn("n", n).where(f"n >= {lap} or chunk = 0").select(*keys, "chunk", "start", "n", F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("body"))


class _Page(HTMLParser):
    """Collects headings with what follows them, links, tables and figures; scripts, styles and navigation are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections, self.links, self.tables, self.figures, self.skip, self.head = [], [], 0, 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "nav"):
            self.skip.append(tag)
        elif self.skip:
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.head = (int(tag[1]), [])
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        self.tables += tag == "table" and not self.skip
        self.figures += tag in ("figure", "img") and not self.skip

    def handle_endtag(self, tag):
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        elif self.head and tag == f"h{self.head[0]}":
            self.sections.append({"level": self.head[0], "heading": " ".join("".join(self.head[1]).split()), "text": ""})
            self.head = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.head:
            self.head[1].append(data)
        elif data.strip():
            if not self.sections:
                self.sections.append({"level": 0, "heading": "", "text": ""})
            s = self.sections[-1]
            s["text"] = f"{s['text']} {' '.join(data.split())}".strip()


def pages(df: DataFrame, id_col: str, html: str) -> DataFrame:
    """(id, sections, links, tables, figures) of pages parsed whole; a null page has none of them."""
    kind = df.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    made = _parse_datatype_string("sections array<struct<level:int,heading:string,text:string>>, links array<string>, tables int, figures int")
    schema = StructType([StructField(id_col, kind), *made.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                p = _Page()
                p.feed(text or "")
                p.close()
                got.append((p.sections, p.links, p.tables, p.figures))
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(x, f.type) for x, f in zip(zip(*got), list(arrow)[1:]))], schema=arrow)

    return df.select(id_col, html).mapInArrow(run, schema)

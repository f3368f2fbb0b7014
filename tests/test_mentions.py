from pyspark.sql import functions as F

from quarry.operators import mentions


def test_ambiguous_needs_two_types_with_papers(spark):
    q = spark.createDataFrame([(1, "The Hubble constant, hubble"), (2, None), (3, " ")], "id int, q string")
    names = spark.createDataFrame([(10, "Hubble", "mission"), (11, "hubble", "person"), (12, "hubble constant", "quantity")], "entity int, name string, type string")

    def found(counts):
        c = spark.createDataFrame(counts, "entity int, papers int")
        return {(r.id, r.mention, r.entity): (r.score, r["rank"], r.ambiguous) for r in mentions.query_mentions(q, "id", "q", names, c).collect()}

    assert found([(10, 40), (11, 20)]) == {(1, "Hubble", 10): (1.0, 1, True), (1, "Hubble", 11): (0.5, 2, True), (1, "Hubble constant", 12): (0.0, 1, False)}
    assert not any(v[2] for v in found([(10, 40), (11, 10)]).values())


def test_a_name_of_many_entities_is_ranked_once_and_dealt_in_packs(spark):
    n = 2 * mentions.PACK + 3
    q = spark.range(20).selectExpr("id", "'the Hubble' as q")
    names = spark.range(n).selectExpr("id as entity", "'hubble' as name", "if(id % 2 = 0, 'mission', 'person') as type")
    counts = spark.range(1, n).selectExpr("id as entity", "id as papers")
    found = mentions.query_mentions(q, "id", "q", names, counts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "windowspecdefinition(id" not in plan  # none over the rows of all queries
    rows = found.collect()
    assert len(rows) == 20 * n and {(r.entity, r.papers, r["rank"], r.ambiguous) for r in rows} == {(e, e, n - e, True) for e in range(n)}
    assert all(r.score == r.papers / (n - 1) for r in rows)


def test_records_surfaces_and_common_words(spark):
    r = spark.createDataFrame([(1, '{"methods": [" a ", ""], "entities": ["x"]}'), (2, '{"entities": ["x"]}'), (3, "{"), (4, None)], "id int, p string")
    assert sorted(map(tuple, mentions.record_mentions(r, "id", "p").collect())) == [(1, "a", "methods"), (2, "x", "entities")]
    d = spark.createDataFrame([("  PyTorch \t (Paszke et al.) ", "software"), ("Genes", "gene"), ("genes", "method"), (None, "gene"), ("data", None)], "n string, k string")
    got = d.select(mentions.surface(F.col("n")), mentions.names_nothing(F.col("n"), F.col("k"))).collect()
    assert [tuple(x) for x in got] == [("pytorch", False), ("genes", True), ("genes", False), (None, False), ("data", False)]


def test_bodies_without_two_headings_have_no_sections(spark):
    b = spark.createDataFrame([(1, "x 1. Introduction is 2 Data\x01 end"), (2, "data and data"), (3, ""), (4, None), (5, "appendix a, Appendix  B")], "id int, body string")
    got = sorted(map(tuple, mentions.body_sections(b, "id", "body").select("id", "at", "heading", "start", "text").collect()))
    assert got == [(1, 0, "INTRODUCTION", 2, " is "), (1, 1, "DATA", 21, "  end"), (5, 0, "APPENDIX A", 0, ", "), (5, 1, "APPENDIX B", 12, "")]


def test_a_run_done_again_replaces_its_links(spark, tmp_path):
    table, log = f"{tmp_path}/links", f"{tmp_path}/log"
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "id int, d string").selectExpr("id", "cast(d as timestamp) as at")
    assert mentions.last_watermark(spark, log) is None
    rows.where("id = 1").select("id").write.parquet(f"{table}/run=1")  # a run that died before its log line
    mentions.link_new(spark, rows, "at", lambda r: r.select("id"), table, log, 1)
    mentions.link_new(spark, rows, "at", lambda r: r.select("id"), table, log, 2)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, 1), (2, 1)]
    assert mentions.last_watermark(spark, log).day == 2


def test_clauses_of_queries(spark):
    d = spark.createDataFrame([(1, "Kepler, TESS exoplanets; kepler Telescope"), (2, "Kepler"), (3, "s-type S-type z-type"), (4, ""), (5, None)], "id int, q string")
    got = {r.id: [tuple(c) for c in r.c] for r in d.select("id", mentions.query_clauses(F.col("q")).alias("c")).collect()}
    assert got[1] == [("exoplanet", None, None), ("telescope", None, None), ("exoplanet", "mission", "Kepler"), ("exoplanet", "mission", "TESS")]
    assert got[3] == [("asteroid", "taxonomy", "S")] and got[2] == got[4] == got[5] == []

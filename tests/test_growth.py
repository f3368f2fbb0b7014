"""What keeps queries within bounds as their tables grow."""

from pyspark.sql import functions as F

from quarry.operators import graph, provenance
from quarry.queries.base import Tables


def test_keyset_batches_are_pages_in_one_pass(spark):
    rows = spark.range(0, 3000, 3).select((F.col("id") * 7 % 3001).alias("k")).repartition(5)
    rows = rows.union(spark.createDataFrame([(None,)], "k long"))
    got = provenance.keyset_batches(rows, "k", 100, 40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0
    pages, after = {}, 100
    while page := [r.k for r in provenance.keyset_page(rows, "k", after, 40).collect()]:
        pages |= {k: len(set(pages.values())) for k in page}
        after = max(page)
    assert dict(tuple(r) for r in got.collect()) == pages and max(pages.values()) > 10
    assert provenance.keyset_batches(rows.where("k < 0"), "k", None, 40).count() == 0


def test_saved_frames_are_columns(spark):
    kept = graph._saved(spark.range(1000).toDF("n"))
    assert kept.count() == 1000 and all(f.endswith(".parquet") for f in kept.inputFiles())


def test_parts_of_the_graph_follow_the_size_of_its_files(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = {tuple(r) for r in t.graph().collect()}
    monkeypatch.setattr(graph, "PART_BYTES", 4096)
    many = t.graph()
    assert "RepartitionByExpression [src" in many._jdf.queryExecution().analyzed().toString() and graph.parts(t.lineitem) > 20
    assert {tuple(r) for r in many.collect()} == want


def test_lists_of_links_are_cut_and_hubs_stay(spark, monkeypatch):
    monkeypatch.setattr(graph, "RUN", 4)
    edges = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(20, 21), (3, 0), (5, 0)], "src long, dst long")
    cut = graph._dealt(edges, "src", "dst").collect()
    assert max(len(r.held) for r in cut) == 4 and sum(len(r.held) for r in cut) == 14
    assert {r.node: r.component for r in graph.components(edges).collect()} == {**{i: 0 for i in range(12)}, 20: 20, 21: 20}
    ranks = {r.node: (round(r.hub, 6), round(r.authority, 6)) for r in graph.hits(edges, 2).collect()}
    assert ranks[0][0] == 1.0 and all(ranks[i][1] == 1.0 for i in range(1, 12)) and ranks[21][0] == 0.0

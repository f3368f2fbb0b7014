from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import entities, graph, reviews


def test_markers_expand_ranges(spark):
    df = spark.createDataFrame([("a [1, 3-5] b [7]",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(text.citation_markers(F.col("t"))).collect()] == [[1, 3, 4, 5, 7], [], None]


def test_roles_and_negatives(spark):
    df = spark.createDataFrame([("3. Methods", "We failed to detect it."), ("Coda", "It rained.")], "h string, t string")
    got = df.select(text.section_role(F.col("h")), text.negative_tier(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("method", "high"), ("other", None)]


def test_path_and_components(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (9, 8)], "src long, dst long")
    assert graph.shortest_path(e, 1, 4) == [1, 2, 4]
    assert graph.shortest_path(e, 4, 1) == []
    assert graph.shortest_path(e, 1, 1) == [1]
    assert {tuple(r) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.pagerank(e, 2).count() == graph.components(e).count() == graph.hits(e, 1).count() == 0


def test_ladder_prefers_canonical(spark):
    m = spark.createDataFrame([("HST",), ("X",)], "mention string")
    n = spark.createDataFrame([("a", "hst", "canonical"), ("b", "HST", "alias"), ("c", "x", "alias")], "entity string, name string, kind string")
    assert {tuple(r) for r in entities.resolve(m, n).collect()} == {("HST", "a", 1.0), ("X", "c", 0.9)}


def test_relations_of_citing_texts(spark):
    rows = ["Our result partially agrees with it", "It disagrees with A", "This extends A", "We confirm A", "It may confirm A", "Maybe A", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(reviews.relation(F.col("t")), reviews.hedged(F.col("t"))).collect()]
    assert got == [("partial", False), ("refutes", False), ("qualifies", False), ("replicates", False), ("qualifies", True), ("unknown", False), ("unknown", False), ("unknown", False)]


def test_inverted_index_round_trip(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None)], "i int, t string")
    back = reviews.inverted_index(df, "i", "t").select("i", reviews.from_inverted_index(F.col("index")))
    assert {tuple(r) for r in back.collect()} == {(1, "a b a c"), (2, "")}


def test_loads_and_gaps_of_nothing(spark):
    none = spark.createDataFrame([], "k long, v string")
    some = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "k long, v string")
    assert {tuple(r) for r in reviews.fresh_rows(some, some.where("k = 2"), ["k"], [F.asc("v")]).collect()} == {(1, "a"), (None, "d")}
    assert reviews.fresh_rows(some, some, ["k"], [F.asc("v")]).count() == 0
    assert reviews.fresh_rows(none, some, ["k"], [F.asc("v")]).count() == reviews.gaps(none, none, "k").count() == 0
    assert {tuple(r) for r in reviews.gaps(some, some.where("v <> 'a'"), "k").collect()} == {(1, 2, 1, 1)}

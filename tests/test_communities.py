import itertools

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import extraction, stats
from quarry.operators import communities, retrieval, search


def test_planted_communities(spark):
    groups = [range(0, 6), range(10, 16), range(20, 26)]
    e = [p for g in groups for p in itertools.combinations(g, 2)] + [(0, 10), (15, 20)]
    edges = spark.createDataFrame(e, "src long, dst long")
    found = dict(tuple(r) for r in communities.louvain(edges).collect())
    assert found == {n: min(g) for g in groups for n in g}
    labels = spark.createDataFrame(list(found.items()), "node long, label long")
    m = communities.modularity(communities.collapsed(edges), labels).first()
    assert m.communities == 3 and 0.5 < m.modularity < 0.7
    assert communities.louvain(edges.limit(0)).count() == 0


def test_sign_codes_recall_and_clusters(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(5, 16))
    rows = [(i, (centre[i % 5] + rng.normal(size=16) * 0.3).tolist()) for i in range(300)] + [(900, [0.0] * 16), (901, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    hit = 0
    for i in range(5):
        want = {r.id for r in retrieval.vector_search(df, "id", "v", rows[i][1], 10).collect()}
        hit += len(want & {r.id for r in communities.sign_codes(df, "id", "v", rows[i][1], 10).collect()})
    assert hit >= 45
    own = dict(tuple(r) for r in communities.clusters(df, "id", "v", 5).collect())
    assert len(own) == 300 and all(own[i] == own[i % 5] for i in range(300))
    near = retrieval.nearest_in_blocks(df, df.where("id < 7"), "id", "v", 3, block=2)
    exact = retrieval.vector_search(df.where("id <> 4"), "id", "v", rows[4][1], 3).collect()
    assert [(r.id, r.score) for r in near.where("q = 4").orderBy("rk").collect()] == [(r.id, r.score) for r in exact]


def test_queries_and_names(spark):
    assert search.parse('The -"new york" or x-ray') == [[("the", True), ("new york", False)], [("x ray", True)]]
    assert search.parse("") == [] and search.parse("or") == []
    df = spark.createDataFrame([(1, "T", "a new york story"), (2, None, "the york"), (3, "the", None)], "i int, t string, b string")
    got = search.keyword_search(df, "i", F.col("t"), F.col("b"), 'the -"new york" or story', 9).collect()
    assert [r.i for r in got] == [3, 1, 2] or sorted(r.i for r in got) == [1, 2, 3]
    assert search.keyword_search(df, "i", F.col("t"), F.col("b"), "", 9).count() == 0
    assert search.author_variants("Stephanie G. Jarmak") == ["Jarmak, Stephanie G.", "Jarmak, Stephanie", "Jarmak, S. G.", "Jarmak, S."]
    assert search.author_variants("Plato") == ["Plato"]
    assert search.merge_filters({"entity_ids": [1]}, [], [1, 2]) == {"entity_ids": [1, 2]}


def test_ranges_and_pages(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(101)], "k int, v int").repartition(5)
    got = {r.k: r.t for r in stats.ntile(df, ["v", "k"], 4, "t").collect()}
    order = sorted(range(101), key=lambda i: (i % 7, i))
    assert [got[k] for k in order] == [1] * 26 + [2] * 25 + [3] * 25 + [4] * 25
    page = spark.createDataFrame([(1, "<p>Hi<h2>A <b>b</b></h2>x &amp; y<script>z</script><table></table><a href='u'>l</a>"), (2, None)], "i int, h string")
    one, two = extraction.pages(page, "i", "h").orderBy("i").collect()
    assert [tuple(s) for s in one.sections] == [(0, "", "Hi"), (2, "A b", "x & y l")] and (one.links, one.tables) == (["u"], 1)
    assert two.sections == [] and two.links == []

from collections import Counter

import corpus_pipeline
from test_operators import plain_components, plain_secrets, shingles

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DIR).toPandas())
        seen.append((name, docs))
    by = dict(seen)
    for name in list(by)[:-1]:
        assert by[name].columns == corpus_pipeline.COLUMNS
    before = {r.doc_id: r.text for r in by["quality_classifier"].collect()}
    after = {r.doc_id for r in by["ngram_jaccard_join"].collect()}
    comps = plain_components({i: shingles(t) for i, t in before.items()})
    assert after == set(comps.values())
    clean = by["secret_scan"].collect()
    assert {r.doc_id for r in clean} == after and not any(plain_secrets(r.text) for r in clean)
    assert {r.doc_id for r in by["best_fit_packing"].collect()} == after


def test_near_duplicates_go_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (None, "c d"), (None, "c d"), (4, None), (5, ""), (5, ""), (6, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"]
    got = Counter((r.doc_id, r.text) for r in stage(spark, docs, DIR).collect())
    assert got == Counter([(1, a), (2, b), (None, "c d"), (4, None), (5, ""), (6, " ")])
    assert stage(spark, docs.limit(0), DIR).count() == 0

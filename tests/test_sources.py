import gzip
import lzma

import pytest

from quarry.sources import files, records


def test_scans_go_by_extension(spark, tmp_path):
    lines = '{"k": 1}\n\n{"k": 2}\nno json\n'
    (tmp_path / "a.jsonl").write_text(lines)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(lines)
    with lzma.open(tmp_path / "c.jsonl.xz", "wt") as f:
        f.write(lines)
    names = files.file_names(spark, str(tmp_path))
    assert [n.rsplit("/", 1)[1] for n in names] == ["a.jsonl", "b.jsonl.gz", "c.jsonl.xz"]
    assert sorted(str(r.k) for r in files.scan_json(spark, names, "k int").collect()) == sorted(["1", "2", "None"] * 3)
    assert files.scan_lines(spark, []).count() == 0 and files.file_names(spark, str(tmp_path / "none")) == []


def test_a_load_runs_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"k": 1, "v": "b"}\n{"k": 1, "v": "a"}\n{"k": 2, "v": "c"}\n')
    args = (spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "log"), lambda p: files.scan_json(spark, p, "k int, v string"), ["k"])
    assert [n for _, n in files.load_files(*args)] == [2] and files.load_files(*args) == []
    (tmp_path / "in" / "0.jsonl").write_text('{"k": 2, "v": "z"}\n{"k": 3, "v": "d"}\n')
    assert [n for _, n in files.load_files(*args)] == [1]
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("k", "v").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_records_of_odd_shapes(spark):
    rows = ['{"bibcode": "a", "title": "plain", "year": 1999, "author": "x", "reference": ["b", "", null]}', '{"bibcode": "b", "title": [], "year": "19xx", "citation_count": "7", "x": [1], "grant": [{"g": 1}, "h"]}']
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    a, b = records.papers(df).orderBy("bibcode").collect()
    assert (a.title, a.year, a.authors, a.raw) == ("plain", 1999, None, '{"reference":"[\\"b\\",\\"\\",null]"}')
    assert (b.title, b.year, b.citation_count, b.grant_facet, b.raw) == (None, None, 7, ['{"g":1}', "h"], '{"x":"[1]"}')
    assert [tuple(r) for r in records.reference_edges(df).collect()] == [("a", "b")]
    with pytest.raises(Exception, match="no bibcode"):
        records.papers(spark.createDataFrame([('{"title": "t"}',)], "value string")).collect()

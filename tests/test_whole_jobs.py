"""Queries without SQL, and indexes, against brute force."""

import re
from collections import Counter

from lumengraph.operators import fulltext, numbering, tree
from lumengraph.plans import all_queries
from lumengraph.sources import views

SMALL = "/root/testdata/sf0.001"


def test_snippets(spark):
    notes = {r.source_file: r for r in views.notes(spark, SMALL).collect()}
    got = all_queries.QUERIES["fts_snippets"](spark, SMALL).collect()
    assert len(got) == 20
    for r in got:
        assert r.breadcrumb == notes[r.note_path].title
        assert r.content == notes[r.note_path].full_text.encode()[:500].decode(errors="ignore")


def test_index_has_all_postings(spark, tmp_path):
    notes = views.notes(spark, SMALL).select("doc_id", "full_text")
    index = fulltext.Index.build(notes, str(tmp_path / "i"), buckets=4)
    uses = Counter((r.doc_id, t) for r in notes.collect() for t in re.findall(r"[^\W_]+", r.full_text.lower()))
    for term in ("the", "nicht", "zzz"):
        assert {(r.doc_id, r.tf) for r in index.rows([term]).collect()} == {(d, n) for (d, t), n in uses.items() if t == term}
    a, b = (sorted((r.doc_id, round(r.bm25, 9)) for r in x.collect()) for x in (index.bm25(["the", "est"]), fulltext.bm25(notes, ["the", "est"])))
    assert a == b and a


def test_dense_numbers(spark):
    rows = [(f"n{i % 7}", i % 5, i) for i in range(50)]
    got = numbering.dense(spark.createDataFrame(rows, "a string, b int, c int"), ["a", "b", "c"]).collect()
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r.id)] == sorted(rows) and sorted(r.id for r in got) == list(range(50))
    assert numbering.dense(spark.createDataFrame([], "a string"), ["a"]).count() == 0


def test_trees_of_few_notes(spark):
    notes = spark.createDataFrame([("r.md",), ("b/x.md",), ("a/y.md",), ("a/c/z.md",), ("a/c/d/w.md",)], "path string")
    got = [tuple(r) for r in tree.limited(notes, 2, 10, files=True).orderBy("place").collect()]
    assert got == [(0, "", True, 0, 4), (1, "r.md", False, 1, None), (2, "a", True, 1, 1), (3, "a/y.md", False, 2, None), (4, "a/c", True, 2, 1), (5, "a/c/z.md", False, 3, None), (6, "b", True, 1, 1), (7, "b/x.md", False, 2, None)]
    assert [r.entry for r in tree.limited(notes, 1, 1).orderBy("place").collect()] == ["", "a"]

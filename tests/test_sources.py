import json
from datetime import datetime, timezone

import pytest

from lumengraph.operators import changes
from lumengraph.sources import vault
from lumengraph.sources.index import VaultIndex
from lumengraph.sources.store import VersionedTable
from lumengraph.sources.writing import Settings, Writer
from lumengraph.streaming import refresh


def write(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)


def test_walk_leaves_out_what_is_ignored(spark, tmp_path):
    names = ["One.md", "a/Two.md", "a/skip/Three.md", ".hidden/Four.md", "a/.five.md", "_six.md", "drafts/Seven.md", "drafts/keep.md", "b/build/Eight.md", "b/nine.tmp.md", "a/other.txt", "é%20 x/Ten.md"]
    write(tmp_path, dict.fromkeys(names, "x") | {".gitignore": "# no\ndrafts/*\n!drafts/keep.md\nbuild/\n", "b/.gitignore": "*.tmp.md\n"})
    got = vault.walk(spark, str(tmp_path), ["skip"]).collect()
    assert {r.path for r in got if not r.is_dir} == {"One.md", "a/Two.md", "_six.md", "drafts/keep.md", "é%20 x/Ten.md"}
    assert {r.path for r in got if r.is_dir} == {"a", "drafts", "é%20 x"}
    assert {r.path for r in vault.scan_all(spark, str(tmp_path)).collect()} == {n for n in names if n.endswith(".md")}
    assert {(r.path, r.content) for r in vault.scan(spark, str(tmp_path), ["skip"]).collect()} == {(r.path, "x") for r in got if not r.is_dir}
    (tmp_path / "empty").mkdir()
    assert vault.scan(spark, str(tmp_path / "empty")).count() == 0


def test_scan_documents_chunks_and_links(spark, tmp_path):
    write(tmp_path, {"a/One.md": "---\ntags: [x]\ncreated: 2024-01-02\n---\n# First\nSome words go to [[Two]] from here.\n## Links\n[[Three]]\n", "Two.md": "Text that is long enough to be kept, zażółć.", "skip/Three.md": "no"})
    docs = vault.documents(vault.scan(spark, str(tmp_path), ["skip"]))
    rows = {r.source_file: r for r in docs.collect()}
    assert set(rows) == {"a/One.md", "Two.md"}
    assert rows["a/One.md"].title == "First" and rows["a/One.md"].tags == ["x"] and rows["a/One.md"].last_modified == 1704153600.0
    chunks = vault.chunks(docs)
    assert {r.breadcrumb for r in chunks.collect()} == {"a/One.md > First", "Two.md"}
    assert [tuple(r) for r in vault.resolved_links(chunks, vault.scan_all(spark, str(tmp_path))).collect()] == [("a/One.md", "Two.md")]


def test_index_whole_by_differences_and_for_paths(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {"a/One.md": "Words enough to be kept, and [[Two]] linked.", "Two.md": "Text that is long enough to be kept.", "b/Three.md": "More text that is long enough, [[One]] too."})
    index = VaultIndex(spark, str(root), str(tmp_path / "t"))
    assert index.documents.read() is None
    assert {tuple(r) for r in index.incremental().collect()} == {(p, "added") for p in ("a/One.md", "Two.md", "b/Three.md")}
    assert tuple(index.stats().first())[:3] == (3, 3, 2) and index.stats().first().last_indexed > 1.7e9
    assert {len(r.vector) for r in index.chunks.read().collect()} == {64}
    write(root, {"a/One.md": "# H\nOther words enough to be kept.\n# I\nAnd [[Three]] linked from a second part.", "New.md": "A new text that is long enough, to [[Two]]."})
    (root / "b" / "Three.md").unlink()
    assert {tuple(r) for r in index.incremental().collect()} == {("a/One.md", "modified"), ("New.md", "added"), ("b/Three.md", "deleted")}
    assert {r.source_file for r in index.documents.read().collect()} == {"a/One.md", "Two.md", "New.md"}
    assert sorted((r.note_path, r.chunk_index) for r in index.chunks.read().collect()) == [("New.md", 0), ("Two.md", 0), ("a/One.md", 0), ("a/One.md", 1)]
    assert {tuple(r) for r in index.links.read().collect()} == {("New.md", "Two.md")}
    write(root, {"c/Four.md": "Not asked for, though it is long enough.", "a/Five.md": "Asked for by its folder, long enough."})
    (root / "New.md").unlink()
    assert {tuple(r) for r in index.reindex(["a", "New.md"]).collect()} == {("a/One.md", "reindex"), ("a/Five.md", "reindex"), ("New.md", "delete")}
    assert {r.source_file for r in index.documents.read().collect()} == {"a/One.md", "Two.md", "a/Five.md"}


def test_notes_are_created_edited_and_backed_up(tmp_path):
    times = iter(datetime(2024, 1, 2, 3, 4, s, tzinfo=timezone.utc) for s in range(50))
    w = Writer(str(tmp_path / "v"), str(tmp_path / "s"), Settings(default_tags=["note"], backups=2), now=lambda: next(times))
    (tmp_path / "v").mkdir()
    assert w.create("a\\First", "Body\n", ["x"]) == "a/First.md"
    path = tmp_path / "v" / "a" / "First.md"
    assert path.read_text() == '---\ntitle: "First"\ntags: [x, note]\ncreated: 2024-01-02T03:04:00\nmodified: 2024-01-02T03:04:00\n---\nBody\n'
    for bad, error in (("a/First.md", FileExistsError), ("../x", ValueError)):
        with pytest.raises(error):
            w.create(bad, "x")
    assert w.edit("first", "append", "more") == ("a/First.md", None)
    assert path.read_text().endswith("modified: 2024-01-02T03:04:01\n---\nBody\nmore\n")
    kept = [w.edit("[[a/First|x]]", "replace_text", old, new)[1] for old, new in (("more", "less"), ("less", "none"), ("none", "all"))]
    assert len(list((tmp_path / "s" / "backups").iterdir())) == 2 and kept[-1].endswith("_First.md")
    assert w.edit_tags("a/First", ["z"], ["x"])[1].added == 1 and "- note\n- z\n" in path.read_text()
    w.create("b/First.md", "x")
    for bad, error in (("first", LookupError), ("nothing", LookupError), ("../x", ValueError)):
        with pytest.raises(error):
            w.resolve(bad)
    with pytest.raises(ValueError):
        w.edit("a/First", "replace_text", "not there", "x")


def test_table_rewrites_touched_buckets_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    assert t.read() is None and t.written() is None
    t.upsert(spark.createDataFrame([(i, "a") for i in range(40)], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, "c"), (43, "d")], "k int, v string"))
    first, second = (json.loads((tmp_path / "t" / f"manifest{v}.json").read_text())["buckets"] for v in (1, 2))
    assert 1 <= len([b for b in second if second[b] == 2]) <= 2 and {b: v for b, v in second.items() if v == 1}.items() <= first.items()
    t.delete(spark.createDataFrame([(1,)], "k int"), "k")
    want = sorted([(i, "a") for i in range(40) if i not in (1, 2)] + [(2, "c"), (43, "d")])
    assert sorted(map(tuple, t.read().collect())) == want
    t.vacuum(1)
    assert t.versions() == [3] and sorted(map(tuple, t.read().collect())) == want
    t.upsert(spark.createDataFrame([("x",)], "k string"))
    assert [tuple(r) for r in t.read().collect()] == [("x",)]


def test_stream_keeps_the_latest_row(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string").write.parquet(str(tmp_path / "in"))
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    stream = refresh.rows_of(spark, str(tmp_path / "in"), "k int, n int, v string", 1)
    refresh.keep_current(stream, t, str(tmp_path / "c"), "n").awaitTermination(120)
    assert sorted(map(tuple, t.read().collect())) == [(1, 2, "b"), (2, 1, "c")]


def test_stream_holds_the_last_rows(spark, tmp_path):
    spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = refresh.last_rows_stream(refresh.rows_of(spark, str(tmp_path / "in"), "k string, n long"), "k", "n", 3)
    q = stream.writeStream.format("memory").queryName("lasts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.k, tuple(r.n), r.seen) for r in spark.table("lasts").collect()} == {("a", (8, 7, 6), 9), ("b", (1,), 1)}


def test_watch_applies_differences(spark, tmp_path):
    root = tmp_path / "v"
    write(root, {"One.md": "Words enough to be kept in a chunk."})
    index = VaultIndex(spark, str(root), str(tmp_path / "t"))
    q = refresh.watch(index, str(tmp_path / "c"), 0.5)
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if index.documents.versions():
                break
        write(root, {"Two.md": "More words enough to be kept in a chunk."})
        for _ in range(60):
            q.awaitTermination(1)
            if index.documents.read().count() == 2:
                break
    finally:
        q.stop()
    assert index.documents.read().count() == 2


def test_newest_of_each_key(spark):
    rows = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1)], "k string, n int")
    assert sorted(map(tuple, changes.newest(rows, "k", "n", 2).collect())) == [("a", 198, 2), ("a", 199, 1), ("b", 1, 1)]


def test_every_sink_gets_every_batch(spark, tmp_path):
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}
    sinks = [lambda b, n: got.setdefault("count", []).append(b.count()), lambda b, n: got.setdefault("sum", []).append(b.groupBy().sum("id").first()[0])]
    refresh.fan_out(refresh.rows_of(spark, str(tmp_path / "in"), "id long"), sinks, str(tmp_path / "c")).awaitTermination(120)
    assert got == {"count": [7], "sum": [21]}

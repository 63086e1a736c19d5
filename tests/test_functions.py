from datetime import date

import pytest
from pyspark.sql import functions as F

from lumengraph.functions import dates, edits, embedding, frontmatter, markdown, paths, text
from lumengraph.operators import graph, predicates, vectors


# Vectors and dates in words with known results (fixed values).
def test_neighbours_of_four_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.8, 0.6, 0.0]), (2, [0.6, 0.8, 0.0]), (3, [-1.0, 0.0, 0.0])]
    found = vectors.knn_graph(spark.createDataFrame(rows, "vec_id long, vector array<double>"), 2).collect()
    got = {(r.i, r.rank): (r.j, round(r.sim, 6)) for r in found}
    assert got == {(0, 1): (1, 0.8), (0, 2): (2, 0.6), (1, 1): (2, 0.96), (1, 2): (0, 0.8), (2, 1): (1, 0.96), (2, 2): (0, 0.6), (3, 1): (2, -0.6), (3, 2): (1, -0.8)}
    assert len(vectors.knn_graph(spark.createDataFrame(rows[:3], "vec_id long, vector array<double>"), 32).collect()) == 6


def test_distances_are_bounded_and_symmetric(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "src long, dst long")
    one = spark.createDataFrame([(1,), (4,), (7,)], "node long")
    got = {(r.src, r.node): r.distance for r in graph.distances(links, one, 2).collect()}
    assert got[(1, 3)] == 2 and (1, 4) not in got and got[(4, 2)] == 2 and got[(7, 7)] == 0 and (1, 8) not in got


def test_pair_distances_meet_in_the_middle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(20, 21)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 8), (0, 9), (3, 3), (2, 5), (1, 20)], "a long, b long")
    assert {tuple(r) for r in graph.pair_distances(links, pairs, 8).collect()} == {(0, 8, 8), (3, 3, 0), (2, 5, 3)}


def plain_tree(links, root, depth, limit, dedup, fits, traverse):
    """A queue of notes, one after the other: (node, depth, parent, cycle) in order."""
    near, both = {}, {(a, b) for a, b in links} | {(b, a) for a, b in links}
    for a, b in both:
        near.setdefault(a, set()).add(b)
    shown, queue, seen, at = [(root, 0, None, False)], [(root, 0, root, True, [root])], {root}, 0
    if traverse and not fits(root):
        return shown
    while at < len(queue):
        node, d, anchor, visible, line = queue[at]
        at += 1
        if d == depth:
            continue
        for n in sorted(near.get(node, ()), key=lambda x: (-len(near[x]), x)):
            if traverse and not fits(n):
                continue
            cycle = n in line or (dedup and n in seen)
            show = (visible and fits(root)) if n == root else fits(n)
            if show:
                if len(shown) >= limit:
                    return shown
                shown.append((n, d + 1, anchor, cycle))
            if not cycle:
                seen.add(n)
                queue.append((n, d + 1, n if show else anchor, show, [*line, n]))
    return shown


@pytest.mark.parametrize("seed", range(8))
def test_tree_of_links(spark, seed):
    import random

    rnd = random.Random(seed)
    links = list({(rnd.randrange(9), rnd.randrange(9)) for _ in range(14)})
    links = [x for x in links if x[0] != x[1]]
    dedup, traverse, depth, limit = seed % 2 == 0, seed % 4 < 2, 3, [1000, 9][seed // 4 % 2]
    able = None if seed == 6 else {n for n in range(9) if rnd.random() < 0.7}
    want = plain_tree(links, links[0][0], depth, limit, dedup, lambda n: able is None or n in able, traverse)
    matching = None if able is None else spark.createDataFrame([(n,) for n in able], "node long")
    got = graph.explore_tree(spark.createDataFrame(links, "src long, dst long"), links[0][0], depth, limit, dedup=dedup, matching=matching, traverse=traverse).collect()
    got = sorted(got, key=lambda r: r["rank"])
    assert [(r.node, r.depth, r.parent, r.cycle) for r in got] == want
    assert all(r.parent_rank is None or got[r.parent_rank - 1].node == r.parent for r in got)


def test_traversal_takes_neighbours_of_higher_degree_first(spark):
    links = spark.createDataFrame([(1, 2), (3, 1), (4, 2)], "src long, dst long")
    rows = sorted(graph.explore(links, 1, 2).collect(), key=lambda r: r["rank"])
    assert [(r.node, r.depth, r.parent) for r in rows] == [(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2)]


def test_tags_match_whatever_their_case(spark):
    d = spark.createDataFrame([(["#Rust", "Code"],), (["python"],), ([],)], "tags array<string>")
    assert d.filter(predicates.has_tags(F.col("tags"), ["rust", "#CODE"])).count() == 1
    assert d.filter(predicates.has_tags(F.col("tags"), [])).count() == 3


def test_fuzzy_paths(spark):
    from lumengraph.operators import search

    notes = spark.createDataFrame([("a/B.md",), ("b.md",), ("c/a/b.md",), ("xb.md",)], "source_file string")
    asked = ["b", "B.MD", "a\\b", "c/a/b.md", "x", ""]
    wanted = spark.createDataFrame(list(enumerate(asked)), "position int, path string")
    got = {tuple(r) for r in search.path_matches(wanted, notes).collect()}
    plain = notes.crossJoin(wanted).filter(predicates.fuzzy_path(F.col("source_file"), F.col("path"), fold=True)).select("position", "source_file")
    assert got == {tuple(r) for r in plain.collect()} == {(0, "a/B.md"), (0, "b.md"), (0, "c/a/b.md"), (1, "a/B.md"), (1, "b.md"), (1, "c/a/b.md"), (2, "a/B.md"), (2, "c/a/b.md"), (3, "c/a/b.md")}


@pytest.mark.parametrize(
    ("phrase", "end", "day"),
    [
        ("2025-01", False, date(2025, 1, 1)),
        ("2025-01", True, date(2025, 1, 31)),
        ("2024-02", True, date(2024, 2, 29)),
        ("2025-02", True, date(2025, 2, 28)),
        ("yesterday", False, date(2025, 3, 11)),
        ("last week", True, date(2025, 3, 9)),
        ("in january", False, date(2025, 1, 1)),
        ("w maju", True, date(2024, 5, 31)),
    ],
)
def test_dates_in_words(phrase, end, day):
    assert dates.parse_date(phrase, end, date(2025, 3, 12)) == day


def test_sections_know_levels_and_fences():
    t = "intro\n# A\na\n```\n# no\n```\n## B\nb\nC\n---\nc\n# D\nd"
    assert [(s.level, s.title) for s in markdown.sections(t)] == [(1, "A"), (2, "B"), (2, "C"), (1, "D")]
    c = markdown.chunks("# A\n" + "words " * 10 + "\n## B\n" + "more " * 10, "n")
    assert [x[1] for x in c] == ["n > A", "n > A > B"]


def test_large_sections_are_split():
    parts = markdown.split_large("\n\n".join(f"paragraph {i} " + "x" * 20 for i in range(10)), 100, 20)
    assert len(parts) > 1 and all(len(p.encode()) <= 125 for p in parts)
    assert markdown.split_large("ab\n\ncdé\n\nef", 6, 4) == ["ab", "ab\n\ncdé", "é\n\nef"]
    assert markdown.paragraphs("a\n```\nb\n\nc\n```\n\n\nd") == ["a\n```\nb\n\nc\n```", "d"]


def test_chunks_leave_out_changelogs_and_their_links():
    t = "# A\nwords that are enough to be kept [[X|y]]\n## Log\n- 2024-01-01 one [[Z]]\n- 2024-01-02 two\n"
    assert markdown.chunks(t, "p.md") == [(0, "p.md > A", "words that are enough to be kept y", [("X", "y")])]


def test_edits():
    assert edits.append("a", "b") == ("a\nb\n", None) and edits.append("", "b") == ("\nb\n", None)
    assert edits.prepend("---\nt: 1\n---\n\nx", "b")[0] == "---\nt: 1\n---\nb\nx\n" and edits.prepend("", "b")[0] == "b\n"
    assert edits.overwrite("---\nt: 1\n---\nx", "b")[0] == "---\nt: 1\n---\nb\n"
    error = edits.replace_text("a b\na", "a", "c")[1]
    assert error == "found 2 times: line 1, column 1: ...a b\\na...; line 2, column 1: ...a b\\na..."
    assert edits.replace_text("x", "a", "c")[1] == "not found"
    assert edits.insert_after("x\ny\nz", "y", "w") == ("x\ny\nw\nz", None) and edits.insert_after("xyz", "y", "w") == ("xy\nw\nz", None)
    t = "# A\nold\n\n## B\nb\n# C\nc"
    assert edits.replace_section(t, "# C", "# C\nnew")[0] == "# A\nold\n\n## B\nb\n# C\nnew\n"
    assert edits.append(t, "more", "A")[0] == "# A\nold\n\n## B\nb\nmore\n\n# C\nc"
    assert edits.prepend(t, "more", "## B")[0] == "# A\nold\n\n## B\nmore\nb\n# C\nc"
    assert edits.append(t, "more", "D") == (None, "no such section") and edits.append(t + "\n# C\n", "x", "C")[1] == "found 2 sections"
    assert edits.edit_tags(["a", "b"], ["c", "b"], ["a"]) == ["b", "c"]


def test_frontmatter():
    assert frontmatter.new('a "b"', ["x"], ["x", "y"], stamp="T", modified="") == '---\ntitle: "a \\"b\\""\ntags: [x, y]\ncreated: T\n---\n'
    assert frontmatter.with_field("text", "a", "1") == "---\na: 1\n---\ntext" and frontmatter.with_field("text", "a", "1", add=False) == "text"
    assert frontmatter.with_field("---\n---\nx", "a", "1") == "---\na: 1\n---\nx"
    t = "---\nk: v\ntags:\n- a\n- 'b c'\nz: 1\n---\nx"
    assert frontmatter.add_tags(t, ["a", "d"]) == "---\nk: v\ntags:\n- a\n- b c\n- d\nz: 1\n---\nx"
    assert frontmatter.remove_tags(t, ["a", "b c"]) == "---\nk: v\ntags: []\nz: 1\n---\nx" and frontmatter.remove_tags("x", ["a"]) == "x"
    assert frontmatter.add_tags("x", ["a", "b"]) == "---\ntags: [a, b]\n---\nx" and frontmatter.add_tags("---\ntags: a, b\n---\n", ["b", "c"]) == "---\ntags:\n- a\n- b\n- c\n---\n"
    e = frontmatter.edit_tags("---\nmodified: 1\ntags: [a]\n---\n", ["b"], ["a", "q"], ("modified", "2"))
    assert (e.text, e.added, e.removed, e.stamped) == ("---\nmodified: 2\ntags:\n- b\n---\n", 1, 2, True)


def test_guards_of_paths(tmp_path):
    assert paths.ensure_inside("a/b.md") == "a/b.md"
    for bad in ("../x", "a/../../x", "/etc/x", "C:/x", "a\\..\\x"):
        with pytest.raises(ValueError):
            paths.ensure_inside(bad)
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "out").symlink_to(tmp_path)
    paths.ensure_really_inside(str(tmp_path / "v" / "new" / "x.md"), str(tmp_path / "v"))
    with pytest.raises(ValueError):
        paths.ensure_really_inside(str(tmp_path / "v" / "out" / "x.md"), str(tmp_path / "v"))
    assert paths.is_synced("/home/me/Dropbox/notes") and not paths.is_synced("/home/me/notes")


def test_embedding_helpers(monkeypatch):
    import io
    import json
    import urllib.error

    assert embedding.reordered(2, [(1, [2.0]), (0, [1.0])]) == [[1.0], [2.0]] and embedding.reordered(0, []) == []
    for found in ([(0, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, []), (1, [])]):
        with pytest.raises(ValueError):
            embedding.reordered(2, found)
    assert embedding.Limits(512, 16384, 8).batch_and_requests(4) == (8, 4) and embedding.Limits(batch_requests=2).batch_and_requests(4) == (8, 2)
    assert embedding.batch_limit("error: maximum allowed batch size 32") == 32 and embedding.batch_limit("no") is None
    calls = []

    def answer(request, timeout):
        texts = json.loads(request.data)["input"]
        calls.append(len(texts))
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 503, "busy", {}, io.BytesIO(b""))
        if len(texts) > 2:
            raise urllib.error.HTTPError("u", 422, "large", {}, io.BytesIO(b"maximum allowed batch size 2"))
        return io.BytesIO(json.dumps({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts)))]}).encode())

    monkeypatch.setattr(embedding.urllib.request, "urlopen", answer)
    monkeypatch.setattr(embedding.time, "sleep", lambda s: None)
    assert embedding.HttpEmbedder("http://host/v1/embeddings", "m", batch=3)(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]] and calls == [3, 3, 2, 1]
    assert embedding.hashed_words(8)(["", "a b"])[0] == [0.0] * 8


def test_requests():
    from lumengraph.operators.filters import request

    today = date(2024, 5, 6)
    asked = request("q", mode="odd", first="2024-05-01", today=today)
    assert asked.mode == "hybrid" and (asked.filters.low, asked.filters.high) == (1714521600.0, 1715039999.0)
    assert request(tags=["x"], today=today).query is None
    for bad in ({}, {"tags": []}, {"first": "2024-05-03", "last": "2024-05-01"}):
        with pytest.raises(ValueError):
            request(today=today, **bad)


def test_stamps():
    from datetime import datetime, timezone

    now = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert dates.stamp(now) == "2024-01-02T03:04:05" and dates.stamp(now, "obsidian", "Europe/Warsaw") == "2024-01-02 04:04" and dates.stamp(now, "%d.%m.") == "02.01."


def test_cuts_by_bytes(spark):
    d = spark.createDataFrame([("aéb漢c",), ("",)], "t string")
    got = d.select(text.byte_slice(F.col("t"), 2, 4).alias("s"), text.first_bytes(F.col("t"), 5).alias("f")).collect()
    assert [tuple(r) for r in got] == [("éb", "aéb"), ("", "")]


def test_saved_graphs_are_checked(spark, tmp_path):
    g = spark.createDataFrame([(0, 1, 0.5, 1), (1, 0, 0.5, 1)], "i long, j long, sim double, rank int")
    vectors.save_graph(g, str(tmp_path / "g"))
    assert vectors.load_graph(spark, str(tmp_path / "g")).count() == 2
    vectors.save_graph(g.filter("i = 0"), str(tmp_path / "g"))
    with pytest.raises(ValueError):
        vectors.load_graph(spark, str(tmp_path / "g"))


def test_text_columns(spark):
    rows = [("---\ntags:\n- x\n- 'y z'\n---\nSee [[Note]] and [[Target|alias]] here.",), ("plain ęęę",), ("- 2024-01-02 a\n- [[2024-01-03]] b",)]
    d = spark.createDataFrame(rows, "t string")
    got = d.select(
        text.tags(text.frontmatter(F.col("t"))).alias("tags"), text.without_wikilinks(text.body(F.col("t"))).alias("body"), text.is_changelog(F.col("t")).alias("log"), text.truncated(F.col("t"), 7).alias("cut")
    ).collect()
    assert got[0].tags == ["x", "y z"] and got[0].body.strip() == "See Note and alias here."
    assert [r["log"] for r in got] == [False, False, True]
    assert got[1].cut == "plain ..." and text is not None

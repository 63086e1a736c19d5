import re
from collections import Counter

import corpus_pipeline
import pytest

from tests.llm.test_operators import components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "uid", "slot", "score"]


def stage(spark, docs, name, folder):
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    return corpus_pipeline.common.write_table(made, f"test-{name}")


def bag(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


def test_stages_by_content(spark, folder, rows):
    """Each stage against a plain version of it on what its predecessor kept."""
    from lumengraph.llm import toxicity

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = stage(spark, docs, "toxicity", folder)
    want = [r for r in docs.collect() if model.scores([toxicity.terms().of(r.text)])[0] < 0.5]
    assert clean.columns == COLUMNS and bag(clean.collect(), *COLUMNS) == bag(want, *COLUMNS) and len(want) < len(rows)

    once = stage(spark, clean, "jaccard_join", folder)
    own = clean.collect()
    _, root = components([(r.doc_id, r.text) for r in own])
    groups = {}
    for r, k in zip(own, root, strict=True):
        groups.setdefault(k, []).append(r)
    least = [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert once.columns == COLUMNS and bag(once.collect(), *COLUMNS) == bag(least, *COLUMNS)

    cut = stage(spark, once, "suffix_dedup", folder)
    own = once.collect()
    seen = Counter(t[i : i + 400] for t in ((r.text or "").encode() for r in own) for i in range(len(t) - 399))
    want = Counter()
    for r in own:
        t = (r.text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        for m in re.finditer(b"\1+", bytes(gone)):  # parts of characters stay
            a, z = m.span()
            while a < z and t[a] & 0xC0 == 0x80:
                gone[a], a = 0, a + 1
            while z > a and z < len(t) and t[z] & 0xC0 == 0x80:
                z -= 1
                gone[z] = 0
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode()
        want[(r.doc_id, None if r.text is None else kept, r.source)] += 1
    assert cut.columns == COLUMNS and bag(cut.collect(), "doc_id", "text", "source") == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())

    mixed = stage(spark, cut, "mixing", folder)
    own = cut.collect()
    count, words = bag(mixed.collect(), "doc_id", "text", "source"), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have = bag(own, "doc_id", "text", "source")
    assert mixed.columns == COLUMNS and all(n <= 2 * have[k] for k, n in count.items()) and all(words(t) for _, t, _ in count)
    sizes = Counter()
    for (_, t, s), n in have.items():
        sizes[s] += n * words(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    while any(left * weight[s] / sum(weight[x] for x in order if x not in full) > 2 * sizes[s] for s in order if s not in full):
        over = [s for s in order if s not in full and left * weight[s] / sum(weight[x] for x in order if x not in full) > 2 * sizes[s]]
        full |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
    target = {s: full.get(s, left * weight[s] / sum([weight[x] for x in order if x not in full] or [1])) for s in order}
    taken, longest = Counter(), {s: max(words(t) for _, t, x in have if x == s) for s in order}
    for (_, t, s), n in count.items():
        taken[s] += n * words(t)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in order)

    out = stage(spark, mixed, "sentencepieces", folder).collect()
    ids = {}
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.sentencepieces.model_path())
    for r in mixed.collect():
        ids.setdefault(r.doc_id, []).append(p.encode(r.text or ""))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(list(r.ids))
        assert r.n_tokens == len(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in ids.items()}


def test_repeated_passages_of_over_50_words_are_cut(spark, tmp_path):
    """Also those of fewer than 400 bytes, down to words of one byte; shorter ones stay. At that length all repeats are found."""
    import random

    from lumengraph.llm import common, suffix_dedup

    rnd = random.Random(8)
    text = lambda n, size=6: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(1, size))) for _ in range(n))
    passages = {"long": text(51), "least": text(51, 1), "short": text(49), "many": text(60)}
    assert all(len(p) < 400 for p in passages.values()) and len(passages["least"]) == 101
    docs = [(k, f"A{i}. {text(20)} <{i}> {p} <{i + 500}> Z{i}. {text(20)}") for k, p in passages.items() for i in range(30 if k == "many" else 2)]
    docs += [("once", text(300)), ("one", "".join(passages["long"].split()) * 2)]
    rows = [(i, t, "en", "s", len(t)) for i, (_, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in stage(spark, read, "suffix_dedup", str(tmp_path)).collect()}
    for i, (k, t) in enumerate(docs):
        if k in ("long", "least", "many"):  # with the passage go bytes beside it that all have in common
            assert len(t) - len(passages[k]) - 12 < len(got[i]) < len(t) - len(passages[k]) and passages[k] not in got[i], k
        else:
            assert got[i] == t, k

    seen = Counter(t[a : a + 101] for _, t in docs for a in range(len(t) - 100))
    found = {r.doc_id: r.n_removed for r in common.write_table(suffix_dedup.dedup(read, length=101), "test-101").collect()}
    for i, (_, t) in enumerate(docs):
        gone = bytearray(len(t))
        for a in range(len(t) - 100):
            if seen[t[a : a + 101]] > 1:
                gone[a : a + 101] = b"\1" * 101
        assert found[i] == sum(gone)


@pytest.mark.parametrize("name", ["toxicity", "jaccard_join", "suffix_dedup", "mixing"])
def test_file_splits_may_change_within_a_stage(spark, folder, tmp_path, monkeypatch, name):
    """Rows keep their numbers when Spark cuts the files otherwise between the jobs of a stage; new columns' names may be taken."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnsRenamed({"uid": "_uid", "slot": "_KEPT", "score": "_score"})
    docs.withColumns({"_copies": docs["n_chars"], "_toxic": docs["n_chars"]}).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = bag(stage(spark, docs, name, folder).collect(), *docs.columns)
    common, parts = corpus_pipeline.common, iter(range(1, 1000))
    write = common.write_table

    def shifting(df, *a, **k):
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 7 * next(parts) % 23))
        return write(df, *a, **k)

    monkeypatch.setattr(common, "write_table", shifting)
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = bag(write(dict(corpus_pipeline.STAGES)[name](spark, docs, folder), "shifted").collect(), *docs.columns)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == want


def test_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0

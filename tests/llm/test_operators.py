"""Every operator against a brute-force version, on documents with nulls, copies, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from lumengraph.llm import jpeg, registry, sstable


def by_row(frame):
    """Rows by id, in the order of their other values: repeated ids keep all theirs."""
    out = defaultdict(list)
    for r in frame.collect():
        out[r.doc_id].append(r)
    return out


def texts(rows):
    out = defaultdict(list)
    for r in rows:
        out[r[0]].append(r[1] or "")
    return out


def compare(found, rows, expect):
    """``expect``: from a text to the values that its row must have."""
    got = by_row(found)
    want = texts(rows)
    assert got.keys() == want.keys()
    for k, own in want.items():
        assert sorted(tuple(r[c] for c in expect("x")) for r in got[k]) == sorted(tuple(expect(t).values()) for t in own), k


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


def test_op1_shards(spark, folder, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(registry.QUERIES["op1_token_shards"](spark, folder).collect(), key=lambda r: r.start)
    want = defaultdict(list)
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, seen = 0, defaultdict(list)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        seen[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_sorted_string_table(tmp_path):
    path = tmp_path / "t"
    with path.open("wb") as f:
        w = sstable.Writer(f, block_bytes=64, tag=2)
        for i in [None, -5, 3, 3, *range(10, 200)]:
            w.add(sstable.key_of(i), str(i).encode() * 3)
        size = w.close()
    with path.open("rb") as f:
        r = sstable.Reader(f, size)
        assert r.tag == 2 and r.entries == 194 and len(r.blocks) > 10
        assert r.get(sstable.key_of(3)) == [b"333", b"333"] and r.get(sstable.key_of(150)) == [b"150150150"] and r.get(sstable.key_of(4)) == []
        assert [sstable.id_of(k) for k, _ in r.scan()][:4] == [None, -5, 3, 3]


def test_op1_lookup(spark, folder, rows):
    from tokenizers import Tokenizer

    from lumengraph.llm import token_shards

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    manifest, where = token_shards.write_shards(spark.read.parquet(f"{folder}/documents.parquet"), path, shard_bytes=1500)
    assert manifest.count() > 2
    asked = [None, rows[20][0], rows[3][0], rows[40][0], 1, 10**9]
    got = token_shards.lookup(manifest, where, asked)
    want = {i: sorted(np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows if r[0] == i) for i in asked}
    assert {k: sorted(v) for k, v in got.items()} == want and len(got[rows[20][0]]) == 3


def test_op2_library_ids(spark, folder, rows):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def expect(t):
        ids = p.encode(t)
        return {"n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<i4").tobytes()), "decoded_crc32": zlib.crc32(t.encode())}

    compare(registry.QUERIES["op2_sentencepieces"](spark, folder), rows, expect)


def test_op2_unigram_file(spark, tmp_path):
    """A made-up unigram vocabulary with ties, longer pieces and characters without a piece."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from lumengraph.llm import sentencepieces

    spec = pb.ModelProto()
    spec.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    spec.trainer_spec.model_type = 1
    kept = [x for x in spec.pieces if x.type not in (x.NORMAL, x.USER_DEFINED)]
    del spec.pieces[:]
    spec.pieces.extend(kept)
    rnd = random.Random(3)
    own = {*"▁abcd", "ab", "cd", "abcd", "▁a", "bc", "▁ab", "aba"} | {"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 5))) for _ in range(30)}
    for x in sorted(own):
        spec.pieces.add(piece=x, score=-1.5 * len(x) if rnd.random() < 0.5 else -rnd.choice([2.0, 3.25, 4.0, 7.1]))
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(spec.SerializeToString())
    texts = [" ".join("".join(rnd.choice("aabbccdé漢") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepieces.encode(docs, path).collect()}
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [got[i] for i in range(len(texts))] == [p.encode(t) for t in texts]
    back = sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))


def test_op2_long_texts_in_parts(monkeypatch):
    """Parts of a text end where units end, and units that only share a hash aren't taken for one another."""
    import pyarrow as pa
    import sentencepiece

    from lumengraph.llm import sentencepieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepieces.Model(path)
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abeéö漢0.") for _ in range(rnd.randint(0, 9))) for _ in range(n)) for n in (0, 1, 50, 400)] + ["x" * 300, None]

    def ids():
        book, out = sentencepieces.Dictionary(m, []), []
        for part, of in m.parts(texts):
            units = m.cut(part)
            words = units.strings(np.arange(len(units.start)))
            table = pa.table({"unit": words, "ids": pa.array([np.array(m.library.encode(w.replace("▁", " ")), "<i4").tobytes() for w in words.to_pylist()], pa.binary())})
            flat, n = sentencepieces._looked_up(m, units, [book, sentencepieces.Dictionary(m, [table])])
            upto = np.append(0, np.cumsum(n))[np.append(0, units.ends)]
            out += [(k, flat[a:z].tolist()) for k, a, z in zip(of, upto, upto[1:])]
        return [[i for k, x in out if k == j for i in x] for j in range(len(texts))]

    want = [p.encode(t or "") for t in texts]
    assert ids() == want
    monkeypatch.setattr(sentencepieces, "BLOCK", 64)
    assert ids() == want
    m.spread = m.spread * np.uint64(0) + np.uint64(1)  # units of one size have one hash
    assert ids() == want


def test_op3_and_op6_oracles(spark, folder, same_rows):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet') WHERE doc_id IS NOT NULL")
    kept = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept.write.mode("overwrite").parquet(f"{folder}-once/documents.parquet")
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}-once/documents.parquet/*.parquet')")
    for name in ("op3_license_scan", "op6_mixing"):
        same_rows(registry.QUERIES[name](spark, f"{folder}-once"), con.sql(registry.ORACLES[name]))


def test_op3_known_texts(spark):
    from lumengraph.llm import licenses

    mit = licenses.KNOWN["MIT"]
    own = [mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,"), mit + " more", "text\nReleased under the MIT licence\nmore", None]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(5)] == ["MIT", "MIT", None, None, None] and got[3].notices == "MIT (notice)"


def test_op3_more_licences_and_notices(spark):
    from lumengraph.llm import licenses

    def whole(name):
        return (licenses.Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text("utf-8")

    mit, names = licenses.KNOWN["MIT"], ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    heads = ["Copyright (c) Jane Doe", "(c) Copyright 2020 X", "Copyright (c) <year> <copyright holders>", "Copyright The Jane Authors", "© Copyright Jane Doe"]
    lines = ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under CC BY-SA 4.0.", "This program is licensed under the GNU General Public License, version 2", "Licensed under the Mozilla Public License, Version 2.0."]
    wrapped = mit.replace("above copyright notice and", "above\ncopyright notice and").replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS")
    own = [whole(n) for n in names] + [f"{h}\n\n{mit}" for h in heads] + [wrapped] + [f"some text\n{x}\nmore" for x in lines]
    own = [(i, t) for i, t in enumerate(own)]
    got = [(r.license, r.notices) for r in licenses.scan(spark.createDataFrame(own, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [x[0] for x in got] == names + ["MIT"] * 6 + [None] * 4
    assert [x[1] for x in got[-4:]] == [f"{x} (notice)" for x in ("BSD-3-Clause", "CC-BY-SA-4.0", "GPL-2.0", "MPL-2.0")]


def test_op3_lines_that_are_no_notices(spark):
    from pyspark.sql import functions as F

    from lumengraph.llm import licenses

    own = [("1000 users signed up\n2019 was a warm year\nCopyright Jane Doe 2020\n(c) 2020 X\nversion 2.0 and version 2.0.1, version 3.0.",), (None,)]
    got = spark.createDataFrame(own, "t string").select(licenses.canonical_lines(F.col("t")).alias("x")).collect()
    assert got[0].x == ["1000 users signed up", "2019 was a warm year", "version 2 and version 2 0 1 version 3"] and got[1].x == []
    ids = spark.createDataFrame([(1, licenses.KNOWN["MIT"]), (1, None), (None, licenses.KNOWN["ISC"]), (1, licenses.KNOWN["MIT"])], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license or "") for r in licenses.scan(ids).collect()) == [(0, "ISC"), (1, ""), (1, "MIT"), (1, "MIT")]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(own):
    sets, parent = [shingles(r[1]) for r in own], list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(own))]


def test_op4_components(spark, folder, rows):
    sets, root = components(rows)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    want = Counter((r[0], len(s), least.get(k)) for r, s, k in zip(rows, sets, root, strict=True))
    assert Counter(map(tuple, registry.QUERIES["op4_jaccard_join"](spark, folder).collect())) == want


def test_op4_components_of_shuffled_chains(spark):
    from lumengraph.llm.components import components

    p = random.Random(11).sample(range(10_000), 4000)
    one, two = p[:3000], p[3000:]  # links to the next; links to the five next
    edges = list(zip(one, one[1:])) + [(a, b) for k in range(1, 6) for a, b in zip(two, two[k:])]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: min(c) for c in (one, two) for x in c}


@pytest.mark.parametrize("few", [0, 500, 1_000_000])
def test_op4_components_by_rounds_and_in_a_task(spark, monkeypatch, few):
    from lumengraph.llm import common
    from lumengraph.llm.components import components

    p = random.Random(7).sample(range(10_000), 3000)
    chain, star, pairs = p[:1000], p[1000:2000], p[2000:]
    edges = [*zip(chain, chain[1:]), *((star[500], x) for x in star if x != star[500]), *zip(pairs[::2], pairs[1::2]), (-5, -5)]
    table = common.write_table(spark.createDataFrame(edges, "a long, b long"), "edges")
    written = []
    monkeypatch.setattr(common, "write_table", lambda df, tag, f=common.write_table, **k: (written.append(tag), f(df, tag, **k))[1])
    got = dict(map(tuple, components(table, few).collect()))
    assert got == {x: min(c) for c in (chain, star, *zip(pairs[::2], pairs[1::2]), (-5,)) for x in c}
    # few links: a single table rather than some of each round
    assert (len(written) == 1) == (few > len(edges)) and written.count("parents") < 20


def test_op4_components_of_no_links(spark):
    from lumengraph.llm.components import components

    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components(spark.createDataFrame([], "a long, b long"), 0).collect() == []


def test_op5_counts(spark, folder, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def expect(t):
        n = len(tok.encode(t, add_special_tokens=False).ids)
        return {"n_bytes": len(t.encode()), "n_tokens": n, "over_limit": n > 1024}

    compare(registry.QUERIES["op5_token_counts"](spark, folder), rows, expect)


def test_op6_budgets(spark, folder):
    got = registry.QUERIES["op6_mixing"](spark, folder).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, registry.QUERIES["op6_mixing"](spark, folder).collect()))


def test_op7_scores(spark, folder, rows):
    got = registry.QUERIES["op7_toxicity"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)


def test_op7_learns(spark):
    from lumengraph.llm.toxicity import FactorizationMachine, terms

    rng = np.random.default_rng(0)
    own = [" ".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    y = np.array([float("a" in t and "b" in t) for t in own])
    rows = [terms().of(t) for t in own]
    m = FactorizationMachine()
    m.fit(rows[:300], y[:300])
    assert ((m.scores(rows[300:]) >= 0.5) == (y[300:] > 0)).mean() > 0.85


def test_op7_pairs_without_effect_alone():
    """Labels that only a pair of terms tells: an insult or a group's mention, but not both."""
    from lumengraph.llm.toxicity import FactorizationMachine, terms

    rng = np.random.default_rng(0)
    hit = rng.random((4000, 2)) < 0.5
    own = [" ".join(["insult"] * a + ["group"] * b + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 300, 20)]) for a, b in hit.tolist()]
    y, rows = (hit[:, 0] ^ hit[:, 1]).astype(float), [terms().of(t) for t in own]
    m = FactorizationMachine()
    m.fit(rows[:3000], y[:3000])
    assert ((m.scores(rows[3000:]) >= 0.5) == (y[3000:] > 0)).mean() > 0.95


def test_op7_against_loops(monkeypatch):
    """The machine's features, steps and scores as plain loops have them."""
    import math

    from lumengraph.llm import toxicity

    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 14, rng.integers(0, 8))) for _ in range(260)]
    y = np.array([float(({1, 2} <= set(r.tolist())) or 5 in r) for r in rows])
    m = toxicity.FactorizationMachine()
    m.fit(rows, y)
    n, p = len(y), y.sum()

    def chi2(having):
        k, bad = sum(having), sum(v for h, v in zip(having, y, strict=True) if h)
        return k, n * (bad * n - k * p) ** 2 / max(k * (n - k) * p * (n - p), 1)

    sets = [set(r.tolist()) for r in rows]
    alone = {t: chi2([t in s for s in sets]) for t in range(14)}
    kept = {t for t, (k, c) in alone.items() if k >= 5 and c >= 15}
    for a in range(14):
        for b in range(a):
            k, c = chi2([a in s and b in s for s in sets])
            if k >= 10 and c >= 60 and c >= 1.5 * max(alone[a][1], alone[b][1]) and min(alone[a][0], alone[b][0]) >= 10:
                kept |= {a, b}
    assert m.features.tolist() == sorted(kept)

    start = toxicity.FactorizationMachine()
    start._keep(m.features)
    w, v, bias = dict.fromkeys(sorted(kept), 0.0), {t: start.v[i].astype(float).copy() for i, t in enumerate(sorted(kept))}, math.log((p + 0.5) / (n + 1) / (1 - (p + 0.5) / (n + 1)))
    gw, gv, gb = dict.fromkeys(w, 1e-6), {t: np.full(toxicity.FACTORS, 1e-4) for t in w}, 1e-6

    def margin(s):
        own = sorted(s & kept)
        x = 1 / math.sqrt(len(own)) if own else 0
        return own, x, bias + sum(w[t] * x for t in own) + sum(float(v[a] @ v[b]) * x * x for i, a in enumerate(own) for b in own[:i])

    order = np.random.default_rng(11)
    for _ in range(2):
        shuffled = order.permutation(n).tolist()
        for a in range(0, n, toxicity.BATCH):
            errors, dw, dv = 0.0, {}, {}
            for i in shuffled[a : a + toxicity.BATCH]:
                own, x, z = margin(sets[i])
                e = 1 / (1 + math.exp(-z)) - y[i]
                errors += e
                for t in own:
                    dw[t] = dw.get(t, 0) + e * x
                    dv[t] = dv.get(t, 0) + e * x * sum((v[u] * x for u in own if u != t), np.zeros(toxicity.FACTORS))
            gb += errors**2
            bias -= toxicity.RATE * errors / math.sqrt(gb)
            for t in dw:
                g, h = dw[t] + toxicity.RIDGE * w[t], dv[t] + toxicity.RIDGE * v[t]
                gw[t] += g * g
                gv[t] += h * h
                w[t] -= toxicity.RATE * g / math.sqrt(gw[t])
                v[t] = v[t] - toxicity.RATE / 3 * h / np.sqrt(gv[t])
    assert m.margins(rows) == pytest.approx([margin(s)[2] for s in sets], abs=2e-3)


def test_op7_held_out_accuracy(spark):
    from lumengraph.llm import toxicity

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.QUERIES["op7_toxicity"](spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").collect()]
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.93
    docs = spark.createDataFrame([(1, "x", 0.5, 7), (1, "y", None, None)], "doc_id long, text string, score double, predicted int")
    assert toxicity.score(docs, toxicity.FactorizationMachine()).columns == ["doc_id", "text", "score", "predicted"]


def sketched(t, k=128):
    """Fingerprint by loops: the least hashes of five successive words."""

    def hashed(v, seed):
        return xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed=seed)

    w = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
    out = set()
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = hashed(x, h if len(w) >= 5 else hashed(h, 42))
        out.add(h - 2**64 if h >= 2**63 else h)
    return sorted(out if w else [])[:k]


def likeness(a, b, k=128):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if a and b else float(not a and not b)


def test_op8_sketches(spark, folder, rows):
    """Every row: the last is followed by the first, null ids come last, rows of one id in any order of their own."""
    got = registry.QUERIES["op8_fingerprints"](spark, folder).collect()
    order = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == Counter(x[:2] for x in order)
    want = Counter()
    for (null, i, t), (_, _, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        a, b, c = sketched(t), sketched(e), sketched(n)
        text = lambda s: "".join(f"{v & (2**64 - 1):016X}" for v in s)
        want[(None if null else i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(a), text(b), round(likeness(a, b), 9), round(likeness(a, c), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_op8_one_id_in_many_ranges(spark, tmp_path):
    """Rows of one id are dealt to several ranges, and each has the one after it in the files as its next."""
    from pyspark.sql import functions as F

    from lumengraph.llm import common, fingerprints

    own = [(None if i % 3 else 7, f"t{i}") for i in range(900)]
    spark.createDataFrame(own, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    d = docs.select("text", F.coalesce("doc_id", F.lit(99)).alias("at"), common.row_ids(docs).alias("uid"))
    assert len(fingerprints._firsts(d, 8)) > 5 and fingerprints.SAMPLED < 100
    order = [t for i, t in own if i == 7] + [t for i, t in own if i is None]
    got = {r.text: r.next_text for r in fingerprints.with_next(d, ["text"], 8).collect()}
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_op8_estimates(spark):
    """Parts merge into the whole; resemblance, containment and counts come near the truth."""
    from pyspark.sql import functions as F

    from lumengraph.llm import fingerprints as fp

    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    d = spark.createDataFrame([(a, b, " ".join(words))], "a string, b string, whole string")
    x, y = fp.sketch(F.col("a")), fp.sketch(F.col("b"))
    r = d.select(
        (fp.merge(x, y) == fp.sketch(F.col("whole"))).alias("same"), fp.resemblance(x, y).alias("r"), fp.containment(x, fp.sketch(F.col("whole"))).alias("c"), fp.distinct_count(x).alias("n"),
        fp.distinct_count(fp.sketch(F.lit("a b c d e f"))).alias("few"), fp.containment(fp.sketch(F.lit("")), x).alias("none"), fp.containment(x, fp.sketch(F.lit(""))).alias("nothing"),
    ).first()
    assert r.same and abs(r.r - 1 / 3) < 0.13 and r.c == 1.0 and abs(r.n - 1996) < 500 and (r.few, r.none, r.nothing) == (2.0, 1.0, 0.0)


def test_op9_payloads(spark, folder, rows):
    def expect(t):
        b = t.encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        m = jpeg.encode(p)
        return {"n_bytes": len(b), "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-16:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()}

    compare(registry.QUERIES["op9_media_columns"](spark, folder), rows, expect)


def test_op9_any_bytes():
    rng = np.random.default_rng(1)
    for n in (1, 3, 70, 200):
        p = rng.integers(0, 256, 192 * n).astype(np.uint8).tobytes()
        image = jpeg.parse(jpeg.encode(p))
        assert jpeg.payload(image, jpeg.coefficients([image])[0]) == p


class Bits:
    """A scan's bits, with a zero byte after each of 255."""

    def __init__(self):
        self.text = ""

    def code(self, n, size):
        self.text += f"{n:0{size}b}" if size else ""

    def value(self, v):
        size = abs(v).bit_length()
        self.code(v if v >= 0 else v + (1 << size) - 1, size)

    def bytes(self):
        self.text += "1" * (-len(self.text) % 8)
        return bytes(int(self.text[i : i + 8], 2) for i in range(0, len(self.text), 8)).replace(b"\xff", b"\xff\x00")


@pytest.mark.parametrize("interval", [0, 2])
def test_op9_files_of_other_writers(interval):
    """A file with quantisers, two by two luminance blocks to a unit, runs of zeros and ends of blocks, and several tables."""
    import struct

    rng = np.random.default_rng(4)
    across, down = 3, 2
    dc_symbols, ac_symbols = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    dc = {s: (i, 4) for i, s in enumerate(dc_symbols)}
    ac = {s: (i, 8) for i, s in enumerate(ac_symbols)}
    blocks = np.zeros((across * down * 6, 64), int)
    for b in blocks:
        b[0] = rng.integers(-400, 400)
        at = rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False)
        b[at] = rng.integers(1, 200, len(at)) * rng.choice([-1, 1], len(at))
    blocks[3, 1:] = 0
    blocks[4, 1:63], blocks[4, 63] = 0, 7  # three runs of sixteen zeros, and no end of block
    scan, bits, before = b"", Bits(), [0, 0, 0]
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])
            bits, before = Bits(), [0, 0, 0]
        for k in range(6):
            b, part = blocks[unit * 6 + k], max(0, k - 3)
            step = int(b[0]) - before[part]
            before[part] = int(b[0])
            bits.code(*dc[abs(step).bit_length()])
            bits.value(step)
            run = 0
            for v in b[1:].tolist():
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.code(*ac[0xF0])
                    run -= 16
                bits.code(*ac[run << 4 | abs(v).bit_length()])
                bits.value(v)
                run = 0
            if run:
                bits.code(*ac[0])
    scan += bits.bytes()

    def segment(marker, body):
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    counts = lambda size, n: bytes(n if i == size else 0 for i in range(1, 17))
    quant = bytes(range(2, 66)), bytes([9] * 64)
    data = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + quant[0] + b"\1" + quant[1])
    data += segment(0xC0, struct.pack(">BHHB", 8, 16 * down - 5, 16 * across - 9, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    data += segment(0xC4, b"\x00" + counts(4, 12) + bytes(dc_symbols) + b"\x10" + counts(8, len(ac)) + bytes(ac_symbols))
    data += segment(0xC4, b"\x01" + counts(4, 12) + bytes(dc_symbols)) + segment(0xC4, b"\x11" + counts(8, len(ac)) + bytes(ac_symbols))
    data += (segment(0xDD, struct.pack(">H", interval)) if interval else b"") + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + b"\xff\xd9"
    image = jpeg.parse(data)
    assert (image.width, image.height, image.units) == (39, 27, (3, 2))
    found = jpeg.coefficients([image])[0]
    assert np.array_equal(found, blocks)
    light = jpeg.luminance(image, found)
    want = np.zeros((2 * down, 2 * across))
    for unit in range(across * down):
        for k in range(4):
            want[unit // across * 2 + k // 2, unit % across * 2 + k % 2] = min(255, max(0, blocks[unit * 6 + k, 0] * 2 / 8 + 128))
    assert np.allclose(light, want)
    mean, step = jpeg.thumbnail_hashes(light)
    assert len(mean) == len(step) == 16


def test_op9_features(spark, folder, rows):
    """The feature is the stored image's size and its thumbnail's hashes, from a plain thumbnail of mean luminance."""
    got = by_row(registry.QUERIES["op9_media_columns"](spark, folder))
    for k, own in texts(rows).items():
        feats = set()
        for t in own:
            image = jpeg.parse(jpeg.encode((t.encode()).ljust(max(1, -(-len(t.encode()) // 192)) * 192)))
            c = jpeg.coefficients([image])[0]
            grid = np.array([[min(255.0, max(0.0, c[(y * image.units[0] + x) * 3, 0] / 8 + 128)) for x in range(image.units[0])] for y in range(image.units[1])])
            feats.add(f"{image.width}x{image.height}:" + ":".join(jpeg.thumbnail_hashes(grid)))
        assert {r.feature for r in got[k]} == feats


def test_op10_repeats(spark, folder, rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    want = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[(r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = registry.QUERIES["op10_suffix_dedup"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_op10_passages(spark, folder, rows, tmp_path):
    """Documents with 51 words in a row that are found elsewhere too, also where they have fewer than 400 bytes; 50 words aren't enough."""
    rnd = random.Random(8)
    text = lambda n: [f"{rnd.randrange(10**6)}" for _ in range(n)]
    p51, p50, tight, twice = text(51), text(50), [rnd.choice("abcdefgh") for _ in range(51)], text(51)
    made = [text(5) + p51 + text(9), text(70) + p51, text(5) + p50 + text(60), text(8) + p50, text(3) + tight, tight + text(4)]
    made += [twice + text(3) + twice, text(300), ["a"] * 60, p51[1:] + text(4), ["b"] * 51]
    spark.createDataFrame([(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(made)], "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert {k for k, r in got.items() if r.has_passages} == {0, 1, 4, 5, 6, 8} and not got[0].has_repeats and len(got) == len(made)

    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    want = Counter((r[0], int(any(seen[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50)))) for r, w in zip(rows, words, strict=True))
    assert Counter((r.doc_id, r.has_passages) for r in registry.QUERIES["op10_suffix_dedup"](spark, folder).collect()) == want
    assert len({x for _, x in want}) == 2


def test_op10_passages_in_blocks(monkeypatch):
    """Records stay the same in blocks, with rows of far files too; equal hashes of anchors alone don't make windows equal."""
    from lumengraph.llm import passages

    rnd = random.Random(3)
    passage = [f"w{rnd.randrange(300)}" for _ in range(80)]
    texts = [" ".join([f"{rnd.randrange(10**6)}" for _ in range(rnd.randrange(90))] + passage[rnd.randrange(25) :][: rnd.randrange(48, 60)]).encode() for _ in range(60)] + [b"", b" "]
    rows = np.arange(62) - 5
    rows[30:] += 1 << 40
    found = passages.records(texts, rows)
    for at in (slice(0, 1), slice(None)):
        part = passages.Records([found]).take(np.arange(len(found[0]))[at])
        assert all((a == b).all() for a, b in zip(passages._unblock(passages._block(*part)), part, strict=True))
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    want = [r for r, w in zip(rows.tolist(), words, strict=True) if any(seen[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50))]
    assert passages._repeated_rows(passages.Records([found])).tolist() == want and 5 < len(want) < 60
    many = np.bincount((passages.records([" ".join(map(str, range(20000))).encode()], rows[:1])[0] >> np.uint64(61)).astype(int), minlength=8)
    assert many.max() < 2 * many.min()
    one = passages.Records([(found[0] * np.uint64(0), *found[1:])])
    assert passages._repeated_rows(one).tolist() == want


def test_op10_windows_that_share_a_hash(monkeypatch):
    """What only has another window's hash isn't removed: with one hash for all windows of a bucket, results stay."""
    from lumengraph.llm import suffix_dedup

    keys = [bytes([65 + i % 3]) * 60 + bytes([97 + i]) * (suffix_dedup.KEY - 60) for i in range(9)]
    bucket = suffix_dedup.Bucket(keys, [0] * 9, [5] * 9, [b"\0" * 16] * 9)
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_64_intdigest", lambda b: 7)
    assert not any(flags.any() for _, flags, _ in bucket.resolve())


def test_rows_are_numbered_by_place(spark, tmp_path):
    """Numbers are distinct and stay the same however files are cut; what isn't a scan is stored first; scratch tables can be removed."""
    import os

    from pyspark.sql import functions as F

    from lumengraph.llm import common

    spark.range(5000).repartition(5).write.parquet(f"{tmp_path}/é x")
    docs = spark.read.parquet(f"{tmp_path}/é x")
    assert common.stored(docs) is docs and common.stored(docs.filter("id > 3")) is not None
    a = {r.id: r.n for r in docs.select("id", common.row_ids(docs).alias("n")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    b = {r.id: r.n for r in docs.select("id", common.row_ids(docs).alias("n")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert a == b and len(set(a.values())) == 5000
    copy = common.stored(docs.groupBy("id").agg(F.lit(1).alias("one")))
    assert copy.select(common.row_ids(copy).alias("n")).distinct().count() == 5000
    path = common._SCRATCH[-1]
    assert path.split("/")[-1] in " ".join(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    common._SCRATCH[:-1] = []
    assert common.remove_scratch(spark) == 1 and path.split("/")[-1] not in os.listdir(spark.conf.get("spark.checkpoint.dir"))

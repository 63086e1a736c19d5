import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, slot int, score double"


def made() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and a null id."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = text(120), text(90).split()
    out = ["", None, " \t\n", "one", "one two three", "ONE  two three", "x" * 900, "Σίσυφος İstanbul <|endoftext|> 'll ok", "a b\x1cc d"]
    out += [text(rnd.randint(3, 120)) for _ in range(25)]
    out += [out[-1]] * 6 + [text(6000)]
    for _ in range(12):
        w = list(base)
        w[rnd.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [f"{text(30)} {passage} {text(9)}" for _ in range(8)]
    out += [f"you are {rnd.choice(['vile', 'foul'])} {text(20)}" for _ in range(12)]
    rows = [(i * 3, t, "en", ["s1", "s2", None, "s1", "s1"][i % 5], len(t or ""), "u", 1, 0.5) for i, t in enumerate(out)]
    rows += [(None, "null id here " + passage, "en", "s2", 5, "u", 1, 0.5), rows[20], rows[20]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, rows):
    """A scale directory with ``documents`` and ``labels``."""
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0, int("you are" in (r[1] or ""))) for r in rows if r[0] is not None] + [(1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path

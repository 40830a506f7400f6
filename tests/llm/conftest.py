import random

import pytest

ODD = [
    (1, None, "en", "s1", 0, "x"),
    (2, "", "en", "s1", 0, "x"),
    (None, "a line of its own here\nshared line number one", "en", None, 5, "x"),
    (4, "shared line number one\nShared Line Number One  \nother words in here", None, "s2", 5, None),
    (4, "shared line number one\nShared Line Number One  \nother words in here", None, "s2", 5, None),  # repeated row
    (4, "the same id with another text", "de", "s2", 5, "y"),
    (5, "\n\n \t\n", "fr", "s3", 4, "x"),
    (6, "tie\ntie\ntie", "fr", "s3", 11, "x"),
    (7, "word " * 30000, "en", "s1", 150000, "x"),
]
#: Columns whose names clash with what operators add or use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact copies, near copies, shared passages and lines."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(2, 9))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(words(60)), " ".join(words(6))
    texts = []
    for i in range(120):
        w = words(rng.choice([1, 3, 20, 60, 200]))
        kind = i % 8
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind == 2 and texts:
            near = rng.choice(texts).split(" ")
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
            continue
        t = " ".join(w)
        if kind == 3:
            t += " " + passage + " " + " ".join(words(20))
        if kind == 4:
            t += "\n" + line + "\n" + " ".join(words(4)).upper()
        texts.append(t)
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 5 if i % 3 else 0}", len(t)) for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)

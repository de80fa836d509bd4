import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, size string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "über", "naïve"]) + str(rng.randint(0, 999)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, columns with clashing names."""
    rng = random.Random(5)
    shared = "This very line stands in many of the documents."
    base = words(rng, 120).split()
    out = []
    for i in range(60):
        text = words(rng, rng.randint(1, 60))
        if i % 4 == 0:
            text += f"\n{shared}\n  {shared.upper()} \n" + words(rng, 9)
        if i % 10 == 3:
            near = list(base)
            near[i % 100] = f"changed{i}"
            text = " ".join(near)
        out.append((i, text, ["en", "de", None][i % 3], ["a", "b", None, "z", "a"][i % 5], len(text), "x", "y", "z"))
    out += [(60, None, "en", "a", None, None, None, None), (61, "", "de", "b", 0, "", "", ""), (62, "!!! ... ???", None, None, 11, "", "", "")]
    out += [(63, words(rng, 30_000), "en", "a", 1, "", "", ""), (None, "no id here at all", None, None, None, None, None, None)]
    out += [(64, "Twice the same row.", "en", "b", 3, "", "", "")] * 2
    out += [(70 + i, "copy " + " ".join(base), "en", "a", 1, "", "", "") for i in range(12)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, spans string"


def edge_rows():
    """What operators must survive: nulls, emptiness, repeats, odd white space, long texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    texts = [None, "", " \t\n", "!!! ... 123", " ", "one", "one two", "ONE two", "a\x1cb c\x0bd", "é É ß 語 語",
             "<|turn|>\\ </s>", long, long + " end", " ".join(base), " ".join(base), "A  " + " ".join(base) + " \n"]
    for edits in (4, 8, 12, 16, 24, 40, 80):  # a chain of ever more distant copies
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    chain = list(base)
    for step in range(12):  # each near to the one before, the ends far from each other
        chain[step * 30:step * 30 + 8] = [f"c{step}x{i}" for i in range(8)]
        texts.append(" ".join(chain))
    langs = [None, "en", "de", "zz"]
    rows = [(100_000 + i, t, langs[i % 4], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[12], rows[13], (100_013, "another text under a used id " * 12, "en", "s1", 348),
             (None, "no id " * 60, "en", "s1", 360), (None, None, None, None, None), (None, rows[13][1], "en", None, 5)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    return [tuple(r) for r in real.select("doc_id", "text", "lang", "source", "n_chars").collect()] + edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", "z", "p") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def sort_key(row):
    return [(v is None, str(v)) for v in row]


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=sort_key)

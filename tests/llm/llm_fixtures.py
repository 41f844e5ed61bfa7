import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # extra columns named like columns that operators add
    T.StructField("score", T.StringType()), T.StructField("kept", T.IntegerType()), T.StructField("n_words", T.StringType()),
    T.StructField("slot", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.StringType()),
])


def prose(rng, n, kinds=400):
    return " ".join(rng.choice(["Ab", "re", "lö", "st"]) + format(rng.randrange(kinds), "x") + rng.choice(["", "", ".", ",", "\n"])
                    for _ in range(n))


def corpus(seed=5):
    """Plain texts, exact and near copies, shared passages, repeats, junk,
    null and empty texts, a repeated row, null ids, one very long text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(5, 300)) for _ in range(50)]
    passage, line = prose(rng, 90), prose(rng, 12)
    for i in range(12):
        texts.append(prose(rng, 40) + " " + passage + " " + prose(rng, 30))
    base = prose(rng, 220).split(" ")
    for i in range(8):  # near copies
        w = list(base)
        w[20 * i % 200] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [texts[3]] * 4 + [texts[60]] * 2
    texts += ["Shti " * 400, "ab" * 900, (line + "\n") * 20, "### $$$ " * 40, "a | b | c |\n" * 30]
    texts += [None, "", "   \n", "x", "one two three", "ONE two Three", "　ße é  \x1c𝄞 a▁b <|endoftext|>", prose(rng, 9000)]
    rows = [(i, t, "en", "src0" if i % 3 else None, None if t is None else len(t), "x", 1, "y", "z", "w", "v")
            for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "null id one two three four five six", "de", "s", 3, "x", 1, "y", "z", "w", "v"),
                   (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)

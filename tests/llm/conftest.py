import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """documents-like rows from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows, lang="en"):
        full = [(r[0], r[1], r[2] if len(r) > 2 else lang, r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd(table):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i}. Next{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "A"), (None, "a"), (None, None), (5, long), (6, long), (7, "!!! ??"), (8, "é ü 世界 \x00 x"), (9, " \n\t ")]
    names = ("id", "key", "h", "content", "fp", "label", "slot", "shard", "__key", "__md5", "kept", "score", "piece", "start", "length", "text_sha256", "n", "size")
    return table(rows).withColumns({c: F.lit("x") for c in names})


@pytest.fixture
def prose():
    """Random words in sentences, the same on every run."""
    import random

    def make(n, words=(5, 60), seed=1, vocabulary=400):
        r = random.Random(seed)
        pool = ["".join(r.choice("abcdeiounrst") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
        out = []
        for _ in range(n):
            text = [r.choice(pool) for _ in range(r.randint(*words))]
            for i in range(0, len(text), 9):
                text[i] = text[i].capitalize()
                if i:
                    text[i - 1] += "."
            out.append(" ".join(text) + ".")
        return out

    return make

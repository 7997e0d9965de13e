import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, n):
    words = ["the", "river", "Stone", "holds", "a", "quiet", "mill", "über", "naïve", "漢字", "and", "wheel", "turns", "slowly", "past", "Old", "gates"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, empty, blank, long, copied and nearly copied texts."""
    rng = random.Random(11)
    rows = [(i, sentences(rng, rng.randint(1, 300))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(110 + i, rows[i][1].upper()) for i in range(4)]
    rows += [(120 + i, rows[20][1][: 200 + i] + "!" + rows[20][1][200 + i :]) for i in range(6)]
    rows += [(200, None), (201, ""), (202, "  \n\t "), (203, "one"), (204, "word " * 4000), (205, "x" * 30_000), (206, "🙂 'll 're" * 50)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a documents table in three partitions, with columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA).repartition(3)
    clash = ["fp", "h", "cut", "recipe", "row_no", "kept", "key", "known", "spans", "bucket", "score", "held_out", "id", "y", "count", "first", "n", "level", "status", "lost_id", "component_id"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    rows = [(None, "same text here"), (None, None), (1, "same text here"), (1, "same text here"), (1, "another"), (2, "SAME text here"), (3, None), (3, None)]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)

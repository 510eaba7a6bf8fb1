import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, n int, match string, place int, x double"


def passage(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, near copies, and columns of internal names."""
    rng = random.Random(7)
    base = passage(rng, 300)
    words = base.split()
    near = " ".join(words[:150] + ["changed"] + words[151:])
    rows = [
        (1, base), (2, base), (3, near), (3, near), (3, "another text of the same id"), (4, None), (5, ""), (6, " \n\t "), (None, "no id here at all"), (None, base), (None, None),
        (7, "one"), (8, "one"), (9, "one two three four"), (10, passage(rng, 30_000, 50_000)), (11, " ".join(["the"] * 500)), (12, "ünï côdé — テキスト 🎈 " * 30), (13, words[0] + " " + " ".join(words[100:160]) + " end"),
        (-5, passage(rng, 40)), (14, "<|im_start|>x\u0000y" + "\r\n" * 3),
    ]
    rows = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t), "k", k, k, "m", k, 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

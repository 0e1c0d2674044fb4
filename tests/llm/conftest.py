import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("an", "ble", "tion", "her", "or", "sh", "wh", "nd") for b in ("er", "the", "ing", "es", "ou", "ly", "at", "in")]
CLASH = ("key", "hash", "size", "h", "value", "score", "gif", "samples", "frames", "kept", "n_bytes", "batch", "digest", "part", "block", "item", "pos", "draw", "bucket", "__own1")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def substituted(rng, text, n):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(WORDS)
    return " ".join(words)


def table(spark, rows):
    """documents with null keys, and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): prose, copies, near copies, repeated rows, null and empty and very long texts, ties in keys."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + i, t) for i, t in enumerate(base[:6])]  # copies
    rows += [(200 + i, substituted(rng, t, 1)) for i, t in enumerate(base[:8]) for _ in range(3)]  # near copies, tied keys
    rows += [rows[3], rows[3], (None, base[9]), (None, None), (300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "one two")]
    rows += [(305, "x" * 5000), (306, prose(rng, 30_000)), (307, "é ü 日本語 \U0001f642 </s>[INST]\\"), ((1 << 60) + 1, "large key")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, texts):
    rows = [(i, t, "en", None if k % 9 == 0 else f"s{k % 4}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    return table(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])

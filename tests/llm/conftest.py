import random

import pytest
from pyspark.sql import functions as F

from tracefuse.llm.common import ship_package

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves: they must neither clash nor change a result
CLASH = ("fingerprint", "component_id", "score", "kept", "shard", "slot", "size", "line", "docs", "n", "count", "root", "fp",
         "row_no", "host", "digest", "ids", "a", "b", "variant", "rest", "item_id", "quality", "held_out", "_keep_id", "tie")


@pytest.fixture(scope="session")
def lspark(spark):
    ship_package(spark)
    return spark


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("th", "er", "on", "an", "re", "ou", "st", "é") for b in ("in", "ed", "ing", "ion", "ent", "er,")] + \
    ["the", "of", "and", "to", "a"]


def edge_rows(seed: int = 1):
    """NULLs in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rnd = random.Random(seed)
    base = sentence(rnd, 120)
    near = base.replace("the", "teh", 1)
    rows = [(None, None, None, None, None), (None, "", "en", None, 0), (1, None, "en", "s0", None), (2, "", None, "s0", 0),
            (3, " \t\n\r\x0b\x0c ", "en", "s0", 5), (4, "One", "en", "s1", 3), (5, "two Words", "en", "s1", 9),
            (6, base, "en", "s0", 1), (7, base, "en", "s1", 1), (7, base, "en", "s1", 1), (8, near, "en", "s0", 1),
            (9, "x" * 5000, "en", "s2", 5000), (10, sentence(rnd, 6000), "en", "s2", 1),
            (11, "a b c d e f g h " * 40, "en", "s2", 1), (12, "same line here\n" * 6 + base, "en", None, 1),
            (13, "é ß 中文 \U0001f600 ### $$", "fr", "s0", 1)]
    rows += [(100 + i, sentence(rnd, rnd.randint(1, 60)) + "\n" + sentence(rnd, 9), "en", f"s{i % 3}", 1) for i in range(60)]
    return rows


def frame(spark, rows, clash: bool = False):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]) if clash else df

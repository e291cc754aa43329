"""Small documents with every odd case, and brute force of what words are."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("score", T.DoubleType())])


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def docs(spark, texts, ids=None):
    """Rows with a column that clashes with names the operators use (``score``)."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, 0.5) for i, t in zip(ids, texts)], DOCS)


def prose(rng, n):
    syllables = "ta ro mi ne lu so ka vi den por sul mar".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

"""Small inputs shared by the tests of the text operators."""

import random
import zlib

from ..conftest import TABLES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0):
    """Documents of the texts with rising ids."""
    return spark.createDataFrame([(first + i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], DOCS)


def saved(df, folder, name="documents"):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def table(spark, name):
    return spark.read.parquet(f"{TABLES}/{name}.parquet")


def prose(n, seed, words=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("amber bolt cedar delta ember flint grove hazel inlet jetty krill larch maple noble ocean".split()) + str(rng.randrange(words)) for _ in range(n))


def crc(text):
    return zlib.crc32((text or "").encode())

"""Small inputs and plain reference code for the training-data operators."""

import random
import re

from conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = ", kept string, line string, row string, node string, label string, _text string, bucket string, length string, start string, id string, h1 string, chunk string, key string"


def low(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = [a + b + c for a in ("ba", "ko", "ri", "su", "te", "mo") for b in ("la", "ne", "pi", "du", "") for c in ("n", "r", "st", "")]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank, repeated and long texts, and columns with clashing names."""
    rows = [
        (None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s1", 0), (3, " \n\t\n", None, "s2", 4), (4, prose(1, 80), "en", "s3", None),
        (4, prose(1, 80), "en", "s3", None), (4, prose(2, 90), "de", "s3", 7), (5, prose(1, 80) + " tail", "en", "s4", 1), (None, prose(3, 70), "en", None, 1),
        (6, "a", "en", "s5", 1), (7, "ß\x00 \u2028é <|endoftext|> \ud7ff 日本語 &amp;", "en", "s6", 1), (8, "x" * 50_000, "en", "s7", 1), (9, prose(4, 60_000), "en", "s8", 1),
        (10, "same line here\n" * 40, "en", "s9", 1),
    ]
    return spark.createDataFrame([(*r, *["?"] * EXTRA.count(" string")) for r in rows], COLUMNS + EXTRA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")

"""Small documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(seed=5):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 90)) for _ in range(24)]
    texts = [*base, base[3], base[3], None, "", " \t\n", prose(rng, 9000), "one\n\ntwo\none", "Ünïcode – ß\x00\n", "<|endoftext|> x"]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None), rows[2], rows[2]]
    return rows


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(documents() if rows is None else rows, schema)

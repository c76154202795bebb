from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None,
    "",
    "   \t\n\x0b\f\r ",
    "one",
    "one two",
    "Released under the MIT License.",
    "Mixed\x85space\xa0here  and\x1fthere é́ é ß İstanbul ΟΔΟΣ ﬁ 漢字 x² ½ <|endoftext|> don't I'LL",
    "a" * 5000,
    " " * 3000 + "x" + "\n" * 40,
    "b c d " * 900,
    "# $ % & | < >" * 30,
    "\U0001f600\U0001f468‍\U0001f469 emoji ‮ tail",
]


def sample_texts(n: int = 60, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("th", "er", "on", "ré", "ung", "ción") for b in ("an", "ou", "ing", "e", "st", "ble")]
    out = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 400))]
        out.append(" ".join(w + rng.choice(["", "", "", ".", ",", "\n"]) for w in words))
    out += [out[0], out[1], out[1] + " extra", out[2].replace("an", "an", 1) + "."]
    return out


@pytest.fixture(scope="session")
def rows():
    texts = [*ODD, *sample_texts()]
    made = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*made, made[3], made[20], (None, texts[20], "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """Documents whose other columns have the names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("score", "predicted", "ids", "bytes", "fp", "key", "k", "n_words", "failed", "kept", "spans", "start", "length", "bucket", "offset", "sequence_id", "w", "component_id", "label", "__x", "__w", "__l", "__text", "__scored_text", "ls", "row", "text_hash", "places", "run", "gram", "template", "node", "path", "part", "ord", "shard", "dim", "payload", "bitmap", "posts")
    return spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", *[F.lit(f"<{c}>").alias(c) for c in names])


@pytest.fixture(scope="session")
def write(tmp_path_factory):
    """Writes tables to a folder, to be read as an ``sf_dir``."""

    def put(**tables):
        at = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return put

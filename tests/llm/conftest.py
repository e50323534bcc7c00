import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bins string"
TINY = "/root/testdata/sf0.001"


def texts() -> list[str | None]:
    r = random.Random(5)
    words = ["the", "of", "Ähre", "größe", "naïve", "licence", "thorin", "don't", "x1", "42", "MIT", "apache", "license", "—", "été", "日本語", "🙂", "²", " z"]
    made: list[str | None] = [None, "", " ", "\n\n", "a", "<|endoftext|> mid<|endoftext|>dle", "word " * 3000, "x" * 9000, "no letters 123".replace("no letters ", ""), "Released under the MIT License.", "GNU General Public License GNU General Public License", "it's we'll they'RE  two  spaces\t\ttabs\r\n"]
    shared = " ".join(r.choice(words) for _ in range(700))
    for n in (3, 20, 300):
        made += [" ".join(r.choice(words) for _ in range(n)) for _ in range(3)]
    made += [shared, shared + " tail one", "head two " + shared, shared, shared.replace("thorin", "thorim", 1)]
    return made


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, repeated rows and columns whose names clash."""
    made = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 2}", -1, 0.5, "b") for i, t in enumerate(texts())]
    return [*made, made[9], (None, "no id here", None, None, None, None, None), (500, "far away", "de", "s0", 1, 0.1, "c")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

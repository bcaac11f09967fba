import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, part string"


@pytest.fixture(scope="session")
def tokenizer_path():
    from lodestone.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows."""
    rng = random.Random(11)
    voc = [f"w{k}" for k in range(150)] + ["the", "B", "é", "x|y"]
    text = lambda n: [rng.choice(voc) for _ in range(n)]
    passages = [text(80) for _ in range(3)]
    rows = [(0, None, "en", "s0"), (1, "", "en", "s0"), (2, " \n\t", None, None), (3, "a " * 300, "en", "s1"), (4, "a b " * 120, "de", None), (5, "z" * 60_000, "en", "s1"), (None, "null id " + " ".join(passages[0]), "en", "s1"), (6, "<|endoftext|> don't  stop\n\n", "fr", "s2")]
    for i in range(7, 90):
        pick = rng.random()
        body = text(rng.randint(0, 120))
        if pick < 0.4:
            body += rng.choice(passages)[rng.randint(0, 20) :] + text(rng.randint(0, 30))
        elif pick < 0.6 and i > 12:
            body = (rows[rng.randint(8, i - 1)][1] or "").split() + ["edit"] * rng.randint(0, 1)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(body), rng.choice(["en", "de"]), rng.choice(["s0", "s1", "s2"])))
    rows += [rows[-1], rows[20], (40, "another text with the id of forty", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, None, "x", 1, None) for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

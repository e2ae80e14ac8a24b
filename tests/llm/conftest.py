from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, target string, passes int"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def fixture_texts() -> list[tuple]:
    """Rows with nulls, empty and long texts, ties, repeated rows and copies, under columns whose names clash."""
    rng = random.Random(7)
    texts: list[str | None] = [prose(rng, rng.randint(60, 200)) for _ in range(40)]
    texts += [texts[0], texts[1] + " extra words here", texts[2], None, "", "   \n\t ", "word", "two words", prose(rng, 9000), "x" * 5000]
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(3)]
    texts += ["spam " * 120, "ab cd " * 60, "spam " * 40 + prose(rng, 30), "日本語 テキスト é ü " * 20, "Of Of the the " * 30]
    rows = [(3 * i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or ""), "s", "t", i) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[3], None, "src1", 1, None, None, None), (rows[7][0], texts[8], "en", "src2", 1, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return fixture_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

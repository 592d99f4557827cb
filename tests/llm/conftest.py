from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def made_up_docs():
    """Rows of a small corpus: exact and near copies, shared passages, a hot line, nulls, empty and long texts."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(2, 7))) for _ in range(400)]

    def prose(n: int) -> str:
        out = [draw.choice(words) for _ in range(n)]
        return " ".join(w + (draw.choice((".\n", ". ", " "))) if draw.random() < 0.1 else w for w in out)

    passage, base = prose(60), prose(200)
    texts = [prose(draw.randint(1, 150)) for _ in range(60)]
    texts += [base] * 8 + [base.upper()]
    for _ in range(25):  # near copies of a base, and of each other
        copy = base.split(" ")
        for _ in range(draw.randint(1, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        texts.append(" ".join(copy))
    texts += [f"{prose(20)}\n{passage}\n{prose(20)}" for _ in range(10)]
    texts += [f"{prose(15)}\nsubscribe to our letter\n{prose(15)}" for _ in range(20)]
    texts += ["", None, " \n\t ", "one", "one two", "A b C", "a B c", "x" * 350, "ab" * 300, prose(9000), "é" * 130]
    texts += [f"{prose(12)} you utter scum and idiot you moron" for _ in range(10)]
    draw.shuffle(texts)
    return [(3 * i, t, "en", f"src{0 if i % 3 else i % 5}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark: SparkSession, made_up_docs):
    return spark.createDataFrame(made_up_docs, DOCS).repartition(5)

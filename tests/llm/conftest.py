from __future__ import annotations

import random

import pytest
from odd import documents, text_of

from edgelog.llm.shared import prepare_workers

@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    prepare_workers(spark)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Copies, near copies, shared passages, empty, null, short and very long texts; texts of one word many times."""
    draw = random.Random(3)
    base = [text_of(draw, draw.randint(1, 90)) for _ in range(30)]
    passage = text_of(draw, 60)
    texts: list[str | None] = [*base, None, "", " \t\n", "a", "a b", "Ähre süß ÇA", "a b c d", "A, b! c d"]
    texts += [base[3]] * 4 + [base[3] + " tail", "head " + base[3]]
    long = text_of(draw, 400)
    for k in range(12):
        w = long.split()
        w[k * 3] = "changed"
        texts.append(" ".join(w))
    texts += [f"{text_of(draw, 30)} {passage} {text_of(draw, 30)}" for _ in range(9)]
    texts += ["same " * 500, "same " * 499, "x" * 50_000, text_of(draw, 30_000), "é" * 3_000]
    texts += [f'{text_of(draw, 20)} api_token = "{draw.getrandbits(160):040x}" {text_of(draw, 9)}' for _ in range(8)]
    texts += [f"{text_of(draw, 20)} {draw.getrandbits(50):016d} {text_of(draw, 9)}" for _ in range(8)]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return documents(spark, odd_rows)

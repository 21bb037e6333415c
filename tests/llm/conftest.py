from __future__ import annotations

import random

import pytest

from lakemeta.llm.common import importable


@pytest.fixture(autouse=True)
def _workers_find_the_package(spark):
    importable(spark)


def awkward_texts() -> list[tuple]:
    """(doc_id, text): null id and text, empty, blank, a very long text, repeats of rows and of passages."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "a", "the"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = said(60), said(120)
    near = base.split()
    near[50] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, passage), (6, said(30) + "\n" + passage + " " + said(20)),
        (7, base), (8, base), (8, base), (9, " ".join(near)), (None, said(50)), (None, said(50)), (10, said(6000)),
        (11, "x" * 5000), (12, "ab " * 400), (13, said(90) + "\x0b" + said(3)), (14, "A" + base[1:].upper())]


@pytest.fixture
def awkward(spark):
    """The awkward texts with columns whose names the operators use inside."""
    rows = [(i, t, "s", 5, "k", 1, "m") for i, t in awkward_texts()]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, m INT, key STRING, row INT, ranges STRING")


@pytest.fixture
def no_documents(awkward):
    return awkward.limit(0)

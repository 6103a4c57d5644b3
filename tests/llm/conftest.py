import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def docs_of(spark):
    """A documents table with columns whose names clash with what operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, class_id string, block int"
        )

    return make

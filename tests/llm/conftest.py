"""Small documents with the awkward cases: nulls, blanks, ties, repeated rows and clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """Rows (doc_id, text) or (doc_id, text, lang, source) as a documents table."""
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def prose():
    def text(seed, n, words="the of and house river stone light paper garden winter open quiet green letter morning".split()):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))

    return text

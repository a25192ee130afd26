"""Many terms in many texts, against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import patterns as P


def made(seed):
    rng = random.Random(seed)
    letters = "ab é日"
    terms = [(rng.choice([1, 2, 3, None]), "".join(rng.choice(letters) for _ in range(rng.randint(0, 4)))) for _ in range(120)] + [(1, None), (4, "a"), (1, "ab"), (1, "ab")]
    texts = [(rng.choice([1, 1, 1, 2, 3, 5, None]), i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(1, 900, None), (1, 901, "ab" * 5000), (1, 902, "")]
    return terms, texts


@pytest.mark.parametrize("texts_per_cell,terms_per_cell", [(20_000, 20_000), (7, 5), (1000, 3), (9, 1000)])
def test_counts(spark, texts_per_cell, terms_per_cell):
    terms, texts = made(3)
    t, x = spark.createDataFrame(terms, "g int, term string"), spark.createDataFrame(texts, "g int, id int, body string")
    want = {}
    for g, term in set(terms):
        n = sum(g == h and g is not None and body is not None and term in body for h, _, body in texts) if term else 0
        if n:
            want[g, term] = n
    got = P.count_texts(t, x, "g", "term", "body", F.col("id"), texts_per_cell, terms_per_cell).collect()
    assert {(r["g"], r["term"]): r["records"] for r in got} == want and len(got) == len(want)
    pairs = P.terms_in_texts(t, x, "g", "term", "body", ["id"], texts_per_cell, terms_per_cell).collect()
    wanted = {(g, i, term) for g, term in set(terms) for h, i, body in texts if term and g == h and g is not None and body is not None and term in body}
    assert {tuple(r) for r in pairs} == wanted and len(pairs) == len(wanted)


def test_nothing_to_find(spark):
    t, x = spark.createDataFrame([], "g string, term string"), spark.createDataFrame([("a", 1, "x")], "g string, id int, body string")
    assert P.count_texts(t, x, "g", "term", "body", F.col("id")).count() == 0
    assert P.terms_in_texts(t, x.limit(0), "g", "term", "body", ["id"]).count() == 0

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed="42", fim_share=50, spm_share=80):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_share:
        return (doc_id, len(tokens), "plain", None, None, text)
    if h[3] % 100 < spm_share:
        return (doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(" \t\nab<é日"), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=6), st.integers(1, 9))
def test_cuts(rows, chunk):
    texts = [t for t, _, _ in rows]
    found = fim.cuts(texts, np.array([a for _, a, _ in rows], np.int64), np.array([b for _, _, b in rows], np.int64), chunk)
    for (text, a, b), n, one, two in zip(rows, *found, strict=True):
        tokens = TOKEN.findall(text)
        lo, hi = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
        assert (n, one, two) == (len(tokens), len("".join(tokens[:lo])), len("".join(tokens[:hi])))


@settings(max_examples=100, deadline=None)
@given(st.text(" \na"), st.lists(st.integers(0, 30), max_size=4))
def test_functions_compose(text, at):
    """Any way of cutting a text into chunks gives the function of the whole."""
    kinds, edges = fim.classes(text), sorted({0, len(text), *(x for x in at if x < len(text))})
    starts, lengths = np.array(edges[:-1], np.int64), np.diff(edges)
    if not len(starts):
        return
    state, closed = fim.running(*fim.scan(kinds, starts, lengths), np.arange(len(starts)))
    one, count = fim.scan(kinds, np.array([0]), np.array([len(text)]))
    assert (state[-1], closed[-1]) == (one[0, fim.BETWEEN], count[0, fim.BETWEEN])


@pytest.fixture(scope="module")
def odd(make, prose):
    texts = [None, "", " ", "a", " a b ", "x<P>y", "<S>", "a < b <", "日本 語\tx", "\n\n", prose(1, 4000), "w" * 3000, " " * 700 + "end", prose(2, 300) + "\n"]
    rows = [(i, t) for i, t in enumerate(texts * 6)]
    return rows + [(None, "no id here"), (None, None), (3, "a"), (3, "a")]


@pytest.mark.parametrize("sizes", [{}, {"giant_chars": 0, "piece_chars": 7}, {"giant_chars": 500, "piece_chars": 600}])
def test_every_row(make, odd, sizes):
    """Whole documents in a task and pieces over the cluster give the same rows."""
    got = fim.transform(make(odd), **sizes).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(*r)) for r in odd)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_outputs_restore(make, odd):
    found = fim.transform(make(odd), fim_share=100, spm_share=50)
    back = found.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in odd)


def test_empty_table_and_clashing_columns(spark, make):
    assert fim.transform(make([])).count() == 0
    docs = make([(1, "a b c")]).selectExpr("*", "1 AS h1", "'x' AS form", "'y' AS t", "2 AS n", "3 AS id", "4 AS row")
    assert [tuple(r) for r in fim.transform(docs).collect()] == [brute(1, "a b c")]

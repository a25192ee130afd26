import random
import re

from pyspark.sql import functions as F

from evidentia.llm import secrets_ledger as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    None, "", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "Secret: token: abcdefghijklmnop", "API_KEY=short passwd='abcdefghijkl'",
    "AKIAAKIAABCDEFGHIJ AKIA123 AKIAABCDEFGHIJKLMN", "é deadbeefdeadbeef 0123456789abcdef0", "toKen=abcdefghijkl ſecret=abcdefghijkl", "x" * 100_000 + " password=aaaaaaaaaaaa",
    "-----BEGIN RSA PRIVATE KEY-----", "http://u:pw@h/ Bearer abcdefghijklmnopqrstu", "pass word=1",
]


def base(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", ASSIGN, 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [x for _, _, x in sorted(found)]


def test_base_spans():
    for text in TEXTS:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in S.spans_of(text or "") if s["kind"] in S.BASE] == base(text)


def test_added_spans():
    assert [s["kind"] for s in S.spans_of(TEXTS[9])] == ["pem"] and [s["kind"] for s in S.spans_of(TEXTS[10])] == ["url_login", "bearer"]


def test_ledger_scans_each_version_once(spark, make):
    first = make([*enumerate(TEXTS), (50, TEXTS[2]), (50, TEXTS[2]), (None, TEXTS[2])]).withColumns({"blob": F.lit(1), "spans": F.lit(2), "_salt": F.lit(0)})
    found, ledger = S.scan_history(first)
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 3
    assert ledger.count() == len(set(t or "" for t in TEXTS))
    for r in rows:
        text = TEXTS[2] if r["doc_id"] in (50, None) else TEXTS[r["doc_id"]]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r["spans"] if s.kind in S.BASE] == base(text)
    more = make([(1, TEXTS[2]), (2, "new password=abcdefghijklmnop")])
    assert S.unseen(more, ledger).count() == 1
    again, grown = S.scan_history(more, ledger)
    assert grown.count() == ledger.count() + 1 and {r["doc_id"]: len(r["spans"]) for r in again.collect()} == {1: 2, 2: 1}
    stale = ledger.withColumn("rules", F.lit("old"))
    assert S.unseen(more, stale).count() == 2  # other rules, other scan


def test_nothing(make):
    found, ledger = S.scan_history(make([]))
    assert found.collect() == [] and ledger.collect() == []


def test_very_long_runs():
    """Runs without an end are scanned once, not once for each place in them."""
    assert S.spans_of("x://" + "z" * 400_000 + " eyJ" * 2 + "eyJ" * 100_000) == []
    assert [s["kind"] for s in S.spans_of("z" * 400_000 + "://u:pw@h")] == ["url_login"]


def test_glued_jwt():
    """Tokens behind a letter, digit, '_' or '-' are found as by the plain pattern."""
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    token = "eyJhbGciOiJ.eyJzdWIiOiIx.c2lnbmF0dXJl"
    rng = random.Random(6)
    mixed = ["".join(rng.choice(["eyJ", "ey", ".", " ", "_", "abcdefgh", "Zz9-"]) for _ in range(60)) for _ in range(3000)]
    texts = [f"session_{token}", f"x-{token} {token}", f"9{token}.{token}", f"eyJ.{token}", f"eyJeyJ{token}", token[:20], *mixed]
    got = [[(s["start"], s["end"]) for s in S.spans_of(t) if s["kind"] == "jwt"] for t in texts]
    assert got == [[m.span() for m in plain.finditer(t)] for t in texts] and all(got[:5]) and sum(map(bool, got)) > 20

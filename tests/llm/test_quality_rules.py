import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import quality_rules as Q
from evidentia.llm.queries import WORD_PARTS, vocabulary

BOTH = {"piece": (Q.PieceVocabulary, (vocabulary("piece_bpe_32k.model"),)), "byte": (Q.ByteVocabulary, (vocabulary("byte_bpe_50k.tiktoken"), WORD_PARTS))}
NAMES = list(BOTH)
TEXTS = [
    None, "", " \n ", "one two three", "a b c d e a b c d e", "a a a a a a a a a a a a", "# $ % & | < > * x\nx\nx\n\nx y", "l1 l1\nl1 l1\n l1 l1\n\n",
    "p q r s t u v w x y z p q r s t", "ünï cödé wörds hére " * 4, "tab\tand\x0bvt\x0cff nbsp\xa0stays \x1fsame", "z" * 50_000,
]


def base(text):
    words, word, chars = [], "", set(" \t\n\x0b\x0c\r")
    for c in (text or "") + " ":
        if c in chars:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in chars for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.fixture(scope="module")
def vocabularies():
    return {name: kind(*args) for name, (kind, args) in BOTH.items()}


def fertility(text, name, vocabulary):
    """(tokens, characters for each token, byte share, entropy), word by word and token by token."""
    words = (text or "").encode().split()
    ids = []
    for w in words:
        ids += vocabulary.sp.encode(w.decode()) if name == "piece" else vocabulary.encoding.encode_ordinary(" " + w.decode())
    if not words:
        return 0, None, None, None
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
    return len(ids), sum(len(w.decode()) for w in words) / len(ids), sum(bool(vocabulary.is_byte[i]) for i in ids) / len(ids), entropy


def test_counts_and_measures_equal_a_plain_evaluation(make, vocabularies):
    df = make([(i, t) for i, t in enumerate(TEXTS)]).withColumns({"n_words": F.lit(0), "_m": F.lit(0), "vocabulary": F.lit("x"), "bands": F.lit(1)})
    rows = Q.measure(df, BOTH, table_size=3).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]]
        assert tuple(r[c] for c in Q.COUNTS) == base(text)
        for name, v in vocabularies.items():
            want = fertility(text, name, v)
            assert r[f"{name}_tokens"] == want[0]
            for m, x in zip(Q.MEASURES, want[1:], strict=True):
                assert r[f"{name}_{m}"] == (None if x is None else pytest.approx(x, abs=1e-9))


def judged_by_hand(rows, least_group):
    """{doc_id: kept} of measured rows, group by group."""
    step = lambda x: math.floor(min(x, Q.LAST) * Q.STEPS)
    groups = defaultdict(list)
    for r in rows:
        for name in NAMES:
            if r[f"{name}_tokens"]:
                length = int(math.log2(r[f"{name}_tokens"]))
                for m in Q.MEASURES:
                    groups[name, length, m, r["lang"]].append(step(r[f"{name}_{m}"]))
                    groups[name, length, m, "any language"].append(step(r[f"{name}_{m}"]))

    def merged(name, m):
        """{length: lengths measured together}: rare long classes are one, so are rare short ones."""
        lengths = sorted({k[1] for k in groups if k[0] == name and k[2] == m and k[3] == "any language"})
        size = {n: len(groups[name, n, m, "any language"]) for n in lengths}
        top = max((n for n in lengths if sum(size[x] for x in lengths if x >= n) >= least_group), default=lengths[0])
        bottom = min((n for n in lengths if sum(size[x] for x in lengths if x <= n) >= least_group), default=top)
        to = {n: min(max(n, bottom), top) for n in lengths}
        return {n: [x for x in lengths if to[x] == to[n]] for n in lengths}

    def shared(name, length, m):
        together = merged(name, m)
        for n in [*(x for x in sorted(together, reverse=True) if x <= length), *(x for x in sorted(together) if x > length)]:
            values = [v for x in together[n] for v in groups[name, x, m, "any language"]]
            if len(values) >= least_group:
                at = min(together[n]) if max(together[n]) == max(together) else max(together[n])  # the class that others were merged into
                low, high = band_of(values, m)
                wider = (2 ** (max(at - length, 0) / 2) - 1) * (high - low) / 2
                low, high = low - wider, high + wider
                if m == "token_entropy":
                    low, high = (-math.inf if length < at else low), (math.inf if length > at else high)
                return low, high
        return None

    def band(key):
        return band_of(groups[key], key[2]) if len(groups[key]) >= least_group else None

    def band_of(values, m):
        values, key = sorted(values), (None, None, m)
        q1, q3 = (values[math.ceil(len(values) * q / 4) - 1] / Q.STEPS for q in (1, 3))
        low, high = (max(fence[key[2]] * (q3 - q1), Q.LEAST_WIDTH[key[2]]) for fence in (Q.FENCE_LOW, Q.FENCE_HIGH))
        return q1 - low, q3 + high

    out = {}
    for r in rows:
        bad = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        for m in Q.MEASURES:
            outside = []
            for name in NAMES:
                n = r[f"{name}_tokens"]
                found = n and (band((name, int(math.log2(n)), m, r["lang"])) or shared(name, int(math.log2(n)), m))
                outside.append(bool(found) and not found[0] <= step(r[f"{name}_{m}"]) / Q.STEPS <= found[1])
            bad = bad or all(outside)
        out[r["doc_id"]] = not bad
    return out


def junk(seed, n=200):
    rng = random.Random(seed)
    return " ".join(rng.choice(["%%", "q", "zx"]) + rng.choice("####$$&&") * 2 + rng.choice("ab") for _ in range(n))


def test_verdicts_equal_a_plain_evaluation(make, prose):
    rows = [(i, prose(i, 20 + 7 * (i % 40)), ["en", "de", None][i % 3], "s") for i in range(300)]
    rows += [(1000 + i, junk(i), "en", "s") for i in range(8)] + [(2000, "a b c", "en", "s"), (2001, None, None, "s"), (2002, prose(7, 5) * 9, None, None), (2003, "ü" * 40_000, "xx", "s")]
    rows += [rows[0], rows[0]]
    measured = Q.measure(make(rows), BOTH).cache()
    for least in (5, 30, 10_000):
        got = Q.judge(measured, Q.bands(measured, NAMES, least), NAMES).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["kept"] for r in got} == judged_by_hand(measured.collect(), least)
    assert {r["doc_id"] for r in got if not r["kept"]} == {2000, 2001, 2002, 2003}  # without a band only base rules judge


def test_poor_text_is_rejected_by_fertility_alone(make, prose):
    rows = [(i, prose(i, 150 + 4 * i), "en", "s") for i in range(300)] + [(1000 + i, junk(i), "en", "s") for i in range(5)]
    measured = Q.measure(make(rows), BOTH)
    got = {r["doc_id"]: r for r in Q.judge(measured, Q.bands(measured, NAMES), NAMES).collect()}
    assert all(got[1000 + i]["fertility_failed"] and not got[1000 + i]["base_failed"] for i in range(5))
    assert sum(not got[i]["kept"] for i in range(300)) <= 3


def test_nothing(make):
    measured = Q.measure(make([]), BOTH)
    assert Q.judge(measured, Q.bands(measured, NAMES), NAMES).collect() == []


def test_tables_that_are_emptied_give_the_same(monkeypatch):
    documents = [(t or "").encode().split() for t in TEXTS]
    chars = Q.np.array([Q.line_counts((t or "").encode())[0] for t in TEXTS])
    want = Q.TokenTable(BOTH, 10_000).measures(documents, chars)
    monkeypatch.setattr(Q, "TABLE_BYTES", 10)
    table = Q.TokenTable(BOTH, 10_000)
    for i, d in enumerate(documents):
        repeats, found = table.measures([d], chars[i : i + 1])
        assert repeats[0] == want[0][i] and all(a[0] == b[i] for name in NAMES for a, b in zip(found[name], want[1][name], strict=True))


def test_every_length_is_judged(make, prose):
    """A few documents longer, or shorter, than all others are measured against their neighbours: the one of junk is found."""
    rows = [(i, prose(i, 400), "en", "s") for i in range(60)] + [(100, junk(1, 60_000), "en", "s"), (101, prose(9, 9_000), "en", "s"), (102, prose(10, 20), "en", "s")]
    measured = Q.measure(make(rows), BOTH)
    bands = Q.bands(measured, NAMES)
    got = {r["doc_id"]: r["kept"] for r in Q.judge(measured, bands, NAMES).collect()}
    lengths = {(r["vocabulary"], r["length"]) for r in bands.collect()}
    assert lengths == {(n, int(math.log2(r[f"{n}_tokens"]))) for r in measured.collect() for n in NAMES}
    assert (got[100], got[101], got[102]) == (False, True, True)

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.llm import langid as L

PARTS = {"aa": ["th", "er", "ing", "on", "the"], "bb": ["ü", "sch", "ung", "ge", "ei"], "cc": ["ción", "os", "que", "la", "ñ"]}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    return [(i, text(lang, i), lang, "s") for i in range(n) for lang in [["aa", "bb", "cc"][i % 3]]]


def test_interpolated_model_sums_to_one():
    words = ["abab", "abba", "b", "ab"]
    levels = L.estimate(words, np.array([3, 1, 2, 5]))
    p = L.positions(words)
    for k in range(1, L.ORDER + 1):
        level = levels[k - 1]
        for c in level.contexts:
            own = {g for g, ctx, d in zip(p.grams[k - 1], p.contexts[k - 1], p.depth, strict=True) if ctx == c and d >= k - 1}
            mass = sum(level.share[np.searchsorted(level.grams, g)] for g in own)
            assert abs(mass + level.gamma[np.searchsorted(level.contexts, c)] - 1.0) < 1e-9


def test_word_scores_equal_a_plain_evaluation():
    words = {"x": (["abc", "abd", "bca"], np.array([2, 1, 4])), "y": (["zab", "cab"], np.array([1, 1]))}
    model = L.assemble(words)
    levels = {lang: L.estimate(*w) for lang, w in words.items()}
    probes = ["abc", "zzz", "cabd", "qa", "é"]

    def plain(lang, p, at):
        prob = L.UNSEEN
        for k in range(1, L.ORDER + 1):
            if p.depth[at] < k - 1:
                break
            level = levels[lang][k - 1]
            i, j = np.searchsorted(level.grams, p.grams[k - 1][at]), np.searchsorted(level.contexts, p.contexts[k - 1][at])
            share = level.share[i] if i < len(level.grams) and level.grams[i] == p.grams[k - 1][at] else 0.0
            gamma = level.gamma[j] if j < len(level.contexts) and level.contexts[j] == p.contexts[k - 1][at] else 1.0
            prob = share + gamma * prob
        return np.log(prob)

    p = L.positions(probes)
    want = np.zeros((len(probes), 2))
    for at in range(len(p.word)):
        for i, lang in enumerate(model.languages):
            want[p.word[at], i] += plain(lang, p, at)
    assert np.allclose(model.word_scores(probes), want, rtol=1e-4)


def test_held_out_accuracy(make):
    df = make(corpus()).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1), "_id": F.lit(0)})
    model = L.train(df, sample_chars=30_000)
    got = L.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").filter(L.held_out(F.col("doc_id"))).collect()
    assert len(got) > 60 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_rows_teach_nothing(make):
    rows = corpus(120)
    model = L.train(make(rows))
    import zlib

    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    other = L.train(make(changed))
    assert other.languages == model.languages and all((a == b).all() for a, b in zip(model.logs, other.logs, strict=True))


def test_odd_texts(make):
    model = L.train(make(corpus(90)))
    texts = [None, "", "12 !? ###", text("bb", 999).upper(), text("cc", 5) + " 77%", "日本", text("aa", 1, 20_000)]
    got = model.predict(pa.array(texts)).to_pylist()
    assert [g["lang_pred"] for g in got[:3]] == ["und"] * 3 and [g["score"] for g in got[:3]] == [0.0] * 3
    assert got[3]["lang_pred"] == "bb" and got[4]["lang_pred"] == "cc" and got[6]["lang_pred"] == "aa" and got[5]["lang_pred"] in PARTS
    rows = make([(None, "x", None, None), (1, None, "aa", "s"), (1, None, "aa", "s")])
    assert L.train(rows) is None
    assert [r["lang_pred"] for r in L.identify(rows, None).collect()] == ["und"] * 3
    assert L.train(make([])) is None and L.identify(make([]), model).collect() == []


def test_text_entropy_equals_a_plain_sum():
    model = L.assemble({"x": (["abc", "abd", "bca"], np.array([2, 1, 4])), "y": (["zab", "cab"], np.array([1, 1]))})
    texts = ["Abc abd!", "", None, "zab 12 cab zab", "é" * 300, "abc"]
    entropy, sizes = model.entropies(pa.array(texts), block=4)
    for text, own, n in zip(texts, entropy, sizes, strict=True):
        words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
        assert n == sum(len(w) + 1 for w in words)
        want = -sum((model.word_scores([w])[0] for w in words), np.zeros(2)) / max(n, 1)
        assert np.allclose(own, want, rtol=1e-6)
    alone, _ = model.entropies(pa.array(texts[3:4]))
    assert (alone[0] == entropy[3]).all()  # whatever stands beside it


def test_languages_of_long_texts_only_are_learned(make):
    rows = [(i, text("aa", i), "short", "s") for i in range(60)] + [(100 + i, text("cc", i, 12_000), "long", "s") for i in range(30)]
    model = L.train(make(rows), sample_chars=60_000)
    assert model.languages == ["long", "short"]
    got = L.identify(make(rows), model).collect()
    assert all(r["lang_pred"] == ("long" if r["doc_id"] >= 100 else "short") for r in got)


def test_a_language_with_calibration_rows_only_is_learned(make):
    import zlib

    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) // 3 % 5 == 0][:4]
    rows = [(i, text("aa", i), "aa", "s") for i in range(1000, 1060)] + [(i, text("bb", i), "bb", "s") for i in own]
    assert L.train(make(rows)).languages == ["aa", "bb"]


def test_threshold_keeps_the_target():
    score, right = np.repeat([0.95, 0.92, 0.8, 0.6, 0.3], 100), np.ones(500)
    assert L.lowest_threshold(score, right) == 0.5
    right[200::2] = 0  # half of what scores 0.8 or less is wrong
    assert L.lowest_threshold(score, right) == 0.92
    right[::5] = 0  # 80 % at most
    assert L.lowest_threshold(score, right) == 2.0 and L.lowest_threshold(score, right, target=0.8) == 0.92
    rng = np.random.default_rng(1)
    margin, right = rng.random(1000), (rng.random(1000) < 0.8).astype(float)
    model = L.calibrate(L.assemble({"x": (["a"], np.array([1]))}), margin, right)
    accepted = right[L.sigmoid(model.curve[0] + model.curve[1] * margin) >= model.threshold]
    assert accepted.mean() >= L.TARGET_PRECISION if len(accepted) else model.threshold > 1


def test_repeated_rows_and_ties(make):
    rows = corpus(90)
    model = L.train(make(rows + rows[:10] * 3))
    got = L.identify(make(rows[:3] * 3), model).collect()
    assert len(got) == 9 and len({(r["doc_id"], r["lang_pred"], r["score"]) for r in got}) == 3
    assert model.predict(pa.array(["日本"])).to_pylist()[0]["lang_pred"] == model.languages[int(model.entropies(pa.array(["日本"]))[0][0].argmin())]

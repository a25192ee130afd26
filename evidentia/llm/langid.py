"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased and cut into words of letters; each language has a character model of order 5 over words between
boundary marks.  A text gets the language with the lowest cross-entropy per predicted character.

Training.  A bounded sample: texts of every length are cut into pieces of ``PIECE_CHARS`` characters, and each language's pieces
are drawn by a hash of id and place at the rate that gives ``sample_chars`` characters of it (all where there are fewer).
Spark counts the sample's distinct words; they are at most that many, so the driver can estimate the models from them.  A
fifth of the learning rows is kept for calibration (a language that has no other rows is learned from these); about
``calibration_rows`` of them fit a logistic curve from the margin between the two best languages to the probability of
being right, and the score below which a prediction counts as rejected: the lowest, from 0.5 up, at which the accepted
ones are right at a rate of ``TARGET_PRECISION``.  Where none is, all are rejected.

Tables.  For each order, the n-grams of all languages are one sorted array of 64-bit hashes with a row of log-probabilities
(one for each language, backed off where a language lacks the n-gram), and contexts another with their back-off weights.
A lookup is one binary search for all languages.

Since models see one word at a time, a word's scores are the same wherever it stands: within a block of texts every distinct
word is scored once and the scores are added up by position.

Null texts and texts without a letter are ``und`` with score 0.  Rejected predictions keep their language and are marked in
``rejected``.  Without any learning row all texts are ``und``.  Very long texts are scored whole.  Of languages with equal
entropy the first by name is taken.  Rows that repeat are predicted, and teach, each for itself.  An empty table gives no rows.
Extra columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm import groups, store

ORDER = 5
SAMPLE_CHARS = 400_000
PIECE_CHARS = 10_000
CALIBRATION_ROWS = 2_000
TARGET_PRECISION = 0.99
UNSEEN = 1e-5  # share of a character that no language has seen
RESULT = "lang_pred string, score double, margin double, rejected boolean"
UND = "und"
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, (ORDER + 1, ORDER), np.uint64) | np.uint64(1)


def normalise(texts: pa.Array) -> pa.Array:
    """Lower-cased words of letters and their marks, one space between them."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    return pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " "), " ")


@dataclass
class Positions:
    """The predicted characters of some words: hashes of the n-grams that end there and of their contexts, by order."""

    word: np.ndarray
    depth: np.ndarray  # characters of the word before it, with the boundary
    grams: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    suffixes: list[np.ndarray] = field(default_factory=list)


def positions(words: list[str]) -> Positions:
    joined = " " + " ".join(words) + " "
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = chars == 32
    at = np.arange(1, len(chars))
    begins = np.maximum.accumulate(np.where(space[:-1], at - 1, 0))
    out = Positions(np.cumsum(space[:-1]) - 1, at - begins)
    for k in range(1, ORDER + 1):
        gram = np.full(len(at), k, np.uint64)
        for j in range(k):
            gram += chars[np.maximum(at - j, 0)] * _MULTIPLIERS[k, j]
        context = np.full(len(at), 100 + k, np.uint64)
        for j in range(1, k):
            context += chars[np.maximum(at - j, 0)] * _MULTIPLIERS[k, j]
        out.grams.append(_mixed(gram))
        out.contexts.append(_mixed(context))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums of weights, a place of each)."""
    distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(where, weights, len(distinct)), first


@dataclass
class Level:
    """One order of one language."""

    grams: np.ndarray
    share: np.ndarray  # max(count - discount, 0) / total of the context
    contexts: np.ndarray
    gamma: np.ndarray


def estimate(words: list[str], counts: np.ndarray) -> list[Level]:
    """Interpolated Kneser-Ney levels of one language, lowest order first."""
    p = positions(words)
    weights = counts[p.word].astype(float)
    levels: list[Level] = []
    for k in range(ORDER, 0, -1):
        fits = p.depth >= k - 1
        keys, raw, first = _counted(p.grams[k - 1][fits], weights[fits])
        places = np.flatnonzero(fits)[first]
        if k == ORDER:
            used = raw
        else:
            # continuation counts: distinct characters before the n-gram; none can stand before a boundary
            longer = p.depth >= k
            wide, at = np.unique(p.grams[k][longer], return_index=True)
            ends = p.grams[k - 1][np.flatnonzero(longer)[at]]
            own, kinds = np.unique(ends, return_counts=True)
            used = np.zeros(len(keys))
            used[np.searchsorted(keys, own)] = kinds
            bounded = p.depth[places] == k - 1
            used = np.where(bounded & (k > 1), raw, used)
        ones, twos = (used == 1).sum(), (used == 2).sum()
        discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
        contexts, total, _ = _counted(p.contexts[k - 1][places], used)
        kinds = np.bincount(np.searchsorted(contexts, p.contexts[k - 1][places]), minlength=len(contexts))
        of = np.searchsorted(contexts, p.contexts[k - 1][places])
        total = np.maximum(total, 1e-9)
        levels.append(Level(keys, np.maximum(used - discount, 0) / total[of], contexts, np.minimum(discount * kinds / total, 1.0)))
    return levels[::-1]


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order: sorted hashes
    logs: list[np.ndarray]  # by order: log-probabilities, a row for each n-gram
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]  # by order: log back-off weights
    floor: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    threshold: float = 0.5

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum of the log-probabilities of each word's characters, a row for each word."""
        p = positions(words)
        total = np.zeros((len(p.word), len(self.languages)), np.float32)
        left = np.arange(len(p.word))
        for k in range(ORDER, 0, -1):
            fits = p.depth[left] >= k - 1
            now, later = left[fits], left[~fits]
            at, hit = _found(self.grams[k - 1], p.grams[k - 1][now])
            total[now[hit]] += self.logs[k - 1][at[hit]]
            missed = now[~hit]
            if k == 1:
                total[missed] += self.floor
            else:
                at, hit = _found(self.contexts[k - 1], p.contexts[k - 1][missed])
                total[missed[hit]] += self.gammas[k - 1][at[hit]]
            left = np.concatenate([later, missed])
        sums = np.zeros((len(words), len(self.languages)))
        starts = np.flatnonzero(np.diff(p.word, prepend=-1))
        if len(starts):
            sums[p.word[starts]] = np.add.reduceat(total, starts, axis=0)
        return sums

    def entropies(self, texts: pa.Array, block: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy of each text in each language, predicted characters of each text)."""
        rows, sizes = [np.empty((0, len(self.languages)))], [np.empty(0, np.int64)]
        for begin in range(0, len(texts), block):
            lists = pc.split_pattern(normalise(texts[begin : begin + block]), " ")
            coded = lists.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            scores = np.zeros((len(distinct), len(self.languages)))
            lengths = np.array([len(w) + 1 if w else 0 for w in distinct], np.int64)
            real = np.flatnonzero(lengths)
            if len(real):
                for part in np.array_split(real, max(1, int(lengths.sum()) // 1_000_000)):
                    scores[part] = self.word_scores([distinct[i] for i in part])
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            # every text has at least the empty word, so no segment is empty; a text's sum doesn't depend on its neighbours
            n = np.add.reduceat(lengths[codes], ends[:-1])
            rows.append(-np.add.reduceat(scores[codes], ends[:-1], axis=0) / np.maximum(n, 1)[:, None])
            sizes.append(n)
        return np.vstack(rows), np.concatenate(sizes)

    def predict(self, texts: pa.Array) -> pa.StructArray:
        entropy, _ = self.entropies(texts)
        letters = pc.match_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)
        best = entropy.argmin(axis=1) if len(entropy) else np.empty(0, int)
        margin = margins(entropy)
        score = np.where(letters, sigmoid(self.curve[0] + self.curve[1] * margin), 0.0)
        names = np.array(self.languages, object)
        named = [names[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
        columns = [pa.array(named, pa.string()), pa.array(score), pa.array(np.where(letters, margin, 0.0)), pa.array(score < self.threshold)]
        return pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "margin", "rejected"])


def margins(entropy: np.ndarray) -> np.ndarray:
    """How far the second best language is behind, in nats for each character."""
    if entropy.shape[1] < 2:
        return np.full(len(entropy), 10.0)
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return two[:, 1] - two[:, 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def assemble(words: dict[str, tuple[list[str], np.ndarray]]) -> Model:
    """One table for each order from the counted words of each language."""
    languages = sorted(words)
    levels = {lang: estimate(*words[lang]) for lang in languages}
    p = positions(sorted(set().union(*(w for w, _ in words.values()))))
    n = len(languages)
    floor = np.array([levels[x][0].gamma[0] if len(levels[x][0].gamma) else 1.0 for x in languages]) * UNSEEN
    model = Model(languages, [], [], [], [], np.log(floor).astype(np.float32))
    below: np.ndarray | None = None
    for k in range(1, ORDER + 1):
        fits = p.depth >= k - 1
        grams, first = np.unique(p.grams[k - 1][fits], return_index=True)
        places = np.flatnonzero(fits)[first]
        contexts = np.unique(p.contexts[k - 1][places])
        of = np.searchsorted(contexts, p.contexts[k - 1][places])
        gammas = np.ones((len(contexts), n))
        logs = np.empty((len(grams), n))
        for i, lang in enumerate(languages):
            level = levels[lang][k - 1]
            at, hit = _found(level.contexts, contexts)
            gammas[hit, i] = level.gamma[at[hit]]
            at, hit = _found(level.grams, grams)
            share = np.where(hit, level.share[at], 0.0)
            lower = UNSEEN if below is None else below[np.searchsorted(model.grams[k - 2], p.grams[k - 2][places]), i]
            logs[:, i] = share + gammas[of, i] * lower
        below = logs
        model.grams.append(grams)
        model.logs.append(np.log(np.maximum(logs, 1e-30)).astype(np.float32))
        model.contexts.append(contexts)
        model.gammas.append(np.log(np.maximum(gammas, 1e-30)).astype(np.float32))
    return model


def learning(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % 3 != 1, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) % 3 == 1, F.lit(False))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def train(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    sample_chars: int = SAMPLE_CHARS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model | None:
    """A calibrated model from the learning rows of ``df``, or None if there are none."""
    store.bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(learning(F.col("_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    calibrates = F.floor(fold(F.col("_id")) / 3) % 5 == 0
    chars = rows.groupBy("lang").agg(F.sum(F.when(~calibrates, F.length("text"))).alias("own"), F.sum(F.length("text")).alias("all")).collect()
    sizes = {r["lang"]: r["own"] or r["all"] for r in chars if r["all"]}
    if not sizes:
        return None
    usable = rows.filter(~calibrates | F.col("lang").isin([r["lang"] for r in chars if not r["own"]]))
    rates = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_chars / n))))

    def draw(*more: Column) -> Column:
        return groups.uniform(F.col("_id"), *more, F.lit("langid"))

    places = F.sequence(F.lit(0), F.floor(F.length("text") / PIECE_CHARS).cast("int"))
    # places are drawn before any piece is cut: a cut reads its text from the start
    drawn = usable.select("lang", "text", F.explode(F.filter(places, lambda i: draw(i) < F.element_at(rates, F.col("lang")))).alias("_at"))
    pieces = drawn.select("lang", F.substring("text", F.col("_at") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece"))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def words(texts: pa.Array) -> pa.Array:
        return pc.split_pattern(normalise(texts), " ")

    sample = pieces.select("lang", F.explode(words("piece")).alias("word"))
    counted: dict[str, tuple[list[str], list[int]]] = {}
    for r in sample.filter("word != ''").groupBy("lang", "word").count().orderBy("lang", "word").collect():
        own = counted.setdefault(r["lang"], ([], []))
        own[0].append(r["word"])
        own[1].append(r["count"])
    if not counted:
        return None
    model = assemble({lang: (w, np.array(n, np.int64)) for lang, (w, n) in counted.items()})
    total = rows.filter(calibrates).count()
    some = rows.filter(calibrates & (F.col("lang").isin(*model.languages)) & (draw() < min(1.0, calibration_rows / max(total, 1))))
    predict = predictor(df, model)
    checked = some.select("lang", predict("text").alias("r")).select((F.col("lang") == F.col("r.lang_pred")).alias("right"), "r.margin").collect()
    return calibrate(model, np.array([r["margin"] for r in checked]), np.array([r["right"] for r in checked], float))


def calibrate(model: Model, margin: np.ndarray, right: np.ndarray) -> Model:
    """Fit the curve by Newton steps with a weak prior, then the lowest threshold from 0.5 up that keeps ``TARGET_PRECISION``."""
    if not len(margin):
        return model
    x = np.stack([np.ones(len(margin)), margin], axis=1)
    y = right * (right.sum() + 1) / (right.sum() + 2) + (1 - right) / ((1 - right).sum() + 2)
    beta, prior = np.array([0.0, 5.0]), np.diag([1e-3, 5.0])
    for _ in range(50):
        q = sigmoid(x @ beta)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + prior, x.T @ (y - q) - prior @ (beta - [0.0, 5.0]))
        beta = beta + np.clip(step, -5, 5)
    model.curve = np.array([beta[0], max(beta[1], 1e-3)])
    score = sigmoid(model.curve[0] + model.curve[1] * margin)
    model.threshold = lowest_threshold(score, right)
    return model


def lowest_threshold(score: np.ndarray, right: np.ndarray, target: float = TARGET_PRECISION, least: float = 0.5) -> float:
    """The lowest of ``least`` and the scores above it at which rows of that score or more are right at the target rate; 2 if none is."""
    order = np.argsort(-score, kind="stable")
    score, right = score[order], right[order]
    precision = np.cumsum(right) / np.arange(1, len(score) + 1)
    for cut in np.unique(np.append(score[score >= least], least)):
        accepted = int((score >= cut).sum())
        if not accepted or precision[accepted - 1] >= target:
            return float(cut) if accepted or not len(score) else 2.0
    return 2.0


def predictor(df: DataFrame, model: Model):
    """A column function text -> (lang_pred, score, margin, rejected); the model travels as one broadcast of bounded size."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        return shared.value.predict(texts)

    return predict


def identify(df: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, margin, rejected) of every whole text."""
    if model is None:
        return df.select(id_col, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    rows = df.select(F.col(id_col), predictor(df, model)(F.col(text_col)).alias("_r"))
    return rows.select(id_col, "_r.*")

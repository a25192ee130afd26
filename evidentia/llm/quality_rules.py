"""Quality rules: counts of words, symbols and repeats, and tokeniser fertility with rejection bands.

Public vocabularies measure each text, word by word (a word with the blank before it): characters for each token, the share of
byte tokens (byte fallback, or in a byte-level vocabulary tokens that are parts of a character) and the entropy of the tokens.

Bands.  Fertility depends on the language and, its entropy above all, on the length.  Documents are therefore grouped by language
(null is one more) and length class, the binary logarithm of the number of tokens.  For each group, vocabulary and measure
the quartiles of all its documents, widened by Tukey's fences for outliers, are the band: the inner fence where text is poor
(few characters for each token, many bytes, little entropy), the outer one on the other side.  A group of fewer than ``least_group`` documents has no quartiles to speak of and takes the band of its length class over all
languages; a length class that is rarer still has no band.  Quartiles are read from histograms of fixed steps, so they are
the same in every run.

Verdict.  A document whose ``chars_per_token`` or ``byte_share`` or ``token_entropy`` lies outside the band under every
vocabulary is rejected; so is one that fails a base rule.  Texts of every length are measured and judged.

Null and empty texts have no words, fail the base rules and have null measures.  Very long texts are measured whole: scratch
arrays are in proportion to one text.  Rows that repeat or tie are measured and judged each for itself; an empty table has
no bands and gives no rows.  Extra columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import base64
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import store

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Tukey's fences, in quartile distances from the quartiles: the inner one on the side of poor text, the outer one on the other.
FENCE_LOW = {"chars_per_token": 1.5, "byte_share": 3.0, "token_entropy": 1.5}
FENCE_HIGH = {"chars_per_token": 3.0, "byte_share": 1.5, "token_entropy": 3.0}
#: A band is never narrower than this on either side of its quartiles: byte shares of most texts are 0.
LEAST_WIDTH = {"chars_per_token": 0.1, "byte_share": 0.02, "token_entropy": 0.1}
LEAST_GROUP = 30
#: Histograms of the measures: steps for each unit, and the value at which they end.
STEPS, LAST = 1000, 64
#: Bytes of words that a table of tokens holds at most before it is emptied: text without spaces has few, but long words.
TABLE_BYTES = 16_000_000
BLOCK_WORDS = 500_000
LINE = 256
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACE = bytes([0x20, *range(0x09, 0x0E)])
_WINDOW_HASH = np.random.default_rng(5).integers(1, 2**63, WINDOW, np.uint64) | np.uint64(1)


class PieceVocabulary:
    """A SentencePiece vocabulary with byte fallback; it never joins characters over a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        self.starts_word = np.array([self.sp.id_to_piece(i).startswith("▁") for i in range(n)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words one after another, number of ids of each)."""
        if any("▁" in w for w in words):
            parts = self.sp.encode(words, num_threads=1)
            return np.fromiter(chain.from_iterable(parts), np.int64), np.array([len(x) for x in parts], np.int64)
        ids = np.array(self.sp.encode(" ".join(words)), np.int64)
        return ids, np.diff(np.append(np.flatnonzero(self.starts_word[ids]), len(ids)))


class ByteVocabulary:
    """A byte-level BPE vocabulary of ranks (token in base64, rank); its byte tokens are those that are no whole characters."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.is_byte, self.bytes = np.zeros(max(ranks.values()) + 1, bool), np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.is_byte[rank], self.bytes[rank] = not _is_text(token), len(token)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words one after another, number of ids of each); in one call, unless words hold other blanks."""
        one = self.encoding.encode_ordinary
        if any(not w.isascii() and len(w.split()) != 1 for w in words):
            parts = [one(" " + w) for w in words]
            return np.fromiter(chain.from_iterable(parts), np.int64), np.array([len(x) for x in parts], np.int64)
        ids = np.array(one(" " + " ".join(words)), np.int64)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])  # no token crosses the blank before a word
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1, prepend=0)


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


#: name -> how to open it: what a task needs to measure, as (class, arguments).
Vocabularies = dict[str, tuple[type, tuple]]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words which comes twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def line_counts(raw: bytes) -> tuple[int, int, int]:
    """(word_chars, n_symbols, n_dup_lines) of a text in UTF-8."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(raw.translate(None, SPACE).decode()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))


class TokenTable:
    """The distinct words that a task has met, numbered, with their tokens in each vocabulary; emptied at a size."""

    def __init__(self, vocabularies: Vocabularies, size: int):
        self.vocabularies = {name: kind(*args) for name, (kind, args) in vocabularies.items()}
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.index: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.held = 0
        self.flat = {name: np.empty(0, np.int64) for name in self.vocabularies}
        self.lengths = {name: np.empty(0, np.int64) for name in self.vocabularies}

    def codes(self, documents: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words, one document after another."""
        if len(self.index) > self.size or self.held > TABLE_BYTES:
            self.clear()
        known = len(self.index)
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(documents)), np.int64)
        new = list(islice(self.index, known, None))
        self.held += sum(map(len, new))
        texts = [w.decode() for w in new]
        for name, vocabulary in self.vocabularies.items():
            # in lines of many words: a call for each word is slow, and so is the merging of a very long line
            parts = [vocabulary.encode(texts[i : i + LINE]) for i in range(0, len(texts), LINE)]
            self.flat[name] = np.concatenate([self.flat[name], *(ids for ids, _ in parts)])
            self.lengths[name] = np.concatenate([self.lengths[name], *(n for _, n in parts)])
        return codes

    def repeats(self, codes: np.ndarray, doc: np.ndarray, documents: list[list[bytes]]) -> np.ndarray:
        """n_repeat_words of each document: those with two windows of one hash are counted exactly, the others have none."""
        out = np.zeros(len(documents), np.int64)
        n = len(codes) - WINDOW + 1
        if n < 2:
            return out
        spread = _mixed(codes.astype(np.uint64) + np.uint64(1))
        keys = _mixed(doc[:n].astype(np.uint64) + np.uint64(1))
        for i in range(WINDOW):
            keys = keys + spread[i : i + n] * _WINDOW_HASH[i]
        keys, of = keys[doc[:n] == doc[WINDOW - 1 :]], doc[:n][doc[:n] == doc[WINDOW - 1 :]]
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            for i in np.unique(of[twice[at] == keys]).tolist():
                out[i] = repeat_words(documents[i])
        return out

    def measures(self, documents: list[list[bytes]], word_chars: np.ndarray) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
        """(n_repeat_words, [tokens, characters for each token, byte share, entropy in bits] by vocabulary) of each document."""
        codes = self.codes(documents)
        doc = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
        width = max(len(self.index), 1)
        pairs, times = np.unique(doc * width + codes, return_counts=True)
        own, word = pairs // width, pairs % width
        found = {}
        for name, vocabulary in self.vocabularies.items():
            lengths = self.lengths[name]
            starts, taken = np.cumsum(lengths) - lengths, lengths[word]
            ends = np.cumsum(taken)
            places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[word] - (ends - taken), taken)
            ids, of, weight = self.flat[name][places], np.repeat(own, taken), np.repeat(times, taken)
            total = np.bincount(of, weight, len(documents))
            bytes_ = np.bincount(of, weight * vocabulary.is_byte[ids], len(documents))
            size = len(vocabulary.is_byte)
            keys = of * size + ids
            order = np.argsort(keys)
            heads = np.flatnonzero(np.diff(keys[order], prepend=-1))
            sums = np.add.reduceat(weight[order], heads) if len(heads) else np.empty(0)
            logs = np.bincount(keys[order][heads] // size, sums * np.log2(np.maximum(sums, 1)), len(documents))
            some = np.maximum(total, 1)
            found[name] = [total.astype(np.int64), word_chars / some, bytes_ / some, np.maximum(np.log2(some) - logs / some, 0.0)]
        return self.repeats(codes, doc, documents), found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def measured_columns(names: list[str]) -> list[tuple[str, str]]:
    out = [(c, "bigint") for c in COUNTS]
    for name in names:
        out += [(f"{name}_tokens", "bigint"), *((f"{name}_{m}", "double") for m in MEASURES)]
    return out


def measure(df: DataFrame, vocabularies: Vocabularies, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", table_size: int = 300_000) -> DataFrame:
    """(id, lang, counts, and for each vocabulary: tokens and the three measures) of every whole text."""
    store.bound_batches(df.sparkSession)
    columns = measured_columns(list(vocabularies))
    kinds = {"bigint": pa.int64(), "double": pa.float64()}

    def block(table: TokenTable, raws: list[bytes]) -> pa.StructArray:
        documents = [raw.split() for raw in raws]  # bytes.split() parts at exactly the six ASCII white-space characters
        chars, symbols, lines = np.array([line_counts(raw) for raw in raws], np.int64).reshape(-1, 3).T
        repeats, found = table.measures(documents, chars)
        sizes = np.array([len(d) for d in documents], np.int64)
        values = [sizes, chars, symbols, lines, repeats, *chain.from_iterable(found.values())]
        arrays = [pa.array(v, kinds[k], mask=(sizes == 0) if k == "double" else None) for v, (_, k) in zip(values, columns, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=[n for n, _ in columns])

    @F.arrow_udf(", ".join(f"{n} {k}" for n, k in columns))
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = TokenTable(vocabularies, table_size)
        for texts in batches:
            parts, waiting, held = [], [], 0
            for value in texts.cast(pa.binary()):
                waiting.append(value.as_py() or b"")
                held += len(waiting[-1]) // 5
                if held >= BLOCK_WORDS:
                    parts.append(block(table, waiting))
                    waiting, held = [], 0
            parts.append(block(table, waiting))
            yield pa.concat_arrays(parts)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), measured(F.col(text_col)).alias("_m"))
    return rows.select("doc_id", "lang", "_m.*")


def length_class(tokens: Column) -> Column:
    return F.when(tokens > 0, F.floor(F.log2(tokens.cast("double"))).cast("int"))


def merged_lengths(sizes: DataFrame, least_group: int) -> DataFrame:
    """(vocabulary, length, merged): the class that each length class is measured with.

    The longest classes are one class as far down as it takes to have ``least_group`` documents in all, and so are the shortest.
    ``sizes`` has (vocabulary, length, n), some dozen rows a vocabulary, as classes double."""
    by = Window.partitionBy("vocabulary")
    above = F.sum("n").over(by.orderBy(F.desc("length")))
    below = F.sum("n").over(by.orderBy("length"))
    rows = sizes.withColumns({"_above": above, "_below": below})
    top = F.coalesce(F.max(F.when(F.col("_above") >= least_group, F.col("length"))).over(by), F.min("length").over(by))
    bottom = F.coalesce(F.min(F.when(F.col("_below") >= least_group, F.col("length"))).over(by), top)
    return rows.withColumns({"_top": top, "_bottom": bottom}).select("vocabulary", "length", F.least(F.greatest("length", "_bottom"), "_top").alias("merged"))


def bands(measured: DataFrame, names: list[str], least_group: int = LEAST_GROUP) -> DataFrame:
    """(vocabulary, lang, length, measure, low, high): a row for each group of documents, with its own band or the one shared by all languages.

    A group of fewer than ``least_group`` documents has no band of its own, and a length class with fewer over all languages shares that of its
    neighbours (``merged_lengths``), of entropy only the side that length does not explain and wider for shorter texts, so every length is judged; only a
    table with fewer documents in all has no bands.

    Values are counted in steps of 1/``STEPS`` first; a group's histogram has a bounded number of rows, however many documents
    it has, and its quartiles are the steps at which its running count passes a quarter and three quarters."""
    stacked = []
    for name in names:
        values = F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.least(F.col(f"{name}_{m}"), F.lit(LAST)) * STEPS).cast("int").alias("step")) for m in MEASURES))
        stacked.append(F.struct(F.lit(name).alias("vocabulary"), length_class(F.col(f"{name}_tokens")).alias("length"), values.alias("values")))
    rows = measured.filter("n_words > 0").select("lang", F.inline(F.array(*stacked))).select("lang", "vocabulary", "length", F.inline("values"))
    counted = rows.groupBy("vocabulary", "lang", "length", "measure", "step").agg(F.count("*").alias("n")).withColumn("any_lang", F.lit(False))
    sizes = counted.filter(F.col("measure") == MEASURES[0]).groupBy("vocabulary", "length").agg(F.sum("n").alias("n"))
    merged = merged_lengths(sizes, least_group)
    everywhere = counted.join(merged, ["vocabulary", "length"]).withColumn("length", F.col("merged")).groupBy("vocabulary", "length", "measure", "step").agg(F.sum("n").alias("n"))
    everywhere = everywhere.withColumns({"any_lang": F.lit(True), "lang": F.lit(None).cast("string")})
    steps = counted.unionByName(everywhere)
    group = Window.partitionBy("vocabulary", "any_lang", "lang", "length", "measure")
    upto = F.sum("n").over(group.orderBy("step"))
    steps = steps.withColumns({"_upto": upto, "_all": F.sum("n").over(group)})
    quartile = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("step"))) / F.lit(STEPS)
    found = steps.groupBy("vocabulary", "any_lang", "lang", "length", "measure").agg(F.sum("n").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    by = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col("measure"))
    margin = lambda fence: F.greatest(by(fence) * (F.col("q3") - F.col("q1")), by(LEAST_WIDTH))
    band = F.when(F.col("n") >= least_group, F.struct((F.col("q1") - margin(FENCE_LOW)).alias("low"), (F.col("q3") + margin(FENCE_HIGH)).alias("high")))
    found = found.withColumn("band", band)
    at = F.when(F.col("band").isNotNull(), F.struct(F.col("length").alias("at"), "band.low", "band.high"))
    shared = found.filter("any_lang").select("vocabulary", F.col("length").alias("merged"), "measure", at.alias("_own"))
    # a class that is rare between common ones takes the band of the next shorter class that has one, else of the next longer
    places = merged.join(shared, ["vocabulary", "merged"], "left")
    along = Window.partitionBy("vocabulary", "measure").orderBy("length")
    filled = F.coalesce(F.last("_own", ignorenulls=True).over(along), F.first("_own", ignorenulls=True).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # entropy grows with length: a text longer than those of its band may have more, a shorter one less
    of_entropy = F.col("measure") == "token_entropy"
    # and the means of a text half as long scatter by the root of two more
    shorter = F.greatest(F.col("_f.at") - F.col("length"), F.lit(0))
    wider = (F.pow(F.lit(2.0), shorter / 2) - 1) * (F.col("_f.high") - F.col("_f.low")) / 2
    low = F.when(of_entropy & (F.col("length") < F.col("_f.at")), float("-inf")).otherwise(F.col("_f.low") - wider)
    high = F.when(of_entropy & (F.col("length") > F.col("_f.at")), float("inf")).otherwise(F.col("_f.high") + wider)
    fitted = F.when(F.col("_f").isNotNull(), F.struct(low.alias("low"), high.alias("high")))
    shared = places.withColumn("_f", filled).select("vocabulary", "length", "measure", fitted.alias("_shared"))
    own = found.filter(~F.col("any_lang")).join(shared, ["vocabulary", "length", "measure"]).withColumn("band", F.coalesce("band", "_shared"))
    return own.filter("band is not null").select("vocabulary", "lang", "length", "measure", "band.low", "band.high")


def judge(measured: DataFrame, limits: DataFrame, names: list[str]) -> DataFrame:
    """The measured rows with base_failed, fertility_failed and kept.

    ``limits`` has a row for each language and length class: it is joined as maps from length class to bands, one row a language."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    key = F.concat_ws(":", "vocabulary", F.col("length").cast("string"), "measure")
    maps = limits.groupBy(F.col("lang").alias("_lang")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.struct("low", "high").alias("v")))).alias("_bands"))
    rows = measured.join(maps, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    outside = F.lit(False)
    for m in MEASURES:
        everywhere = F.lit(True)
        for name in names:
            k = F.concat_ws(":", F.lit(name), length_class(F.col(f"{name}_tokens")).cast("string"), F.lit(m))
            band = F.try_element_at("_bands", k)
            # as coarse as the histograms, so that a value is not told apart from a quartile that it equals
            value = F.floor(F.least(F.col(f"{name}_{m}"), F.lit(LAST)) * STEPS) / F.lit(STEPS)
            everywhere = everywhere & F.coalesce((value < band["low"]) | (value > band["high"]), F.lit(False))
        outside = outside | everywhere
    rows = rows.withColumn("base_failed", failed).withColumn("fertility_failed", outside).drop("_bands")
    return rows.withColumn("kept", ~(F.col("base_failed") | F.col("fertility_failed")))

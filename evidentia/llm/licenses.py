"""License scan: a trained paragraph classifier with an unknown class, confirmed by comparing with templates.

Everything runs in Spark's own operators (SQL functions and ML's DataFrame estimators); no Python runs on the executors.

1. Paragraphs are lines, cut further behind sentence ends; a line break within a sentence (a letter, digit or comma before
   it, a lower-case letter behind it) is a hard wrap and no end of a paragraph.
2. A multinomial logistic regression with an L1 penalty over word 1- to 3-grams names the family.  It learns from the public texts of
   the licences (``license_texts``, paragraph by paragraph, as wrapped and unwrapped; a paragraph that several have is the first one's), from
   sentences generated from ``NAMES``, ``SHORT_NAMES``, ``SPDX`` and their forms and from ``SENTENCES``, and, for the class "unknown", from
   ``NOT_LICENSES``, from ``NOT_NAMES`` in the same forms and from a sample of about ``SAMPLE_CHARS`` characters of the scanned table
   (pieces of texts of every length, drawn by a hash of id and place; paragraphs that a template confirms are left out of it).
3. The probability below which a prediction counts as unknown is the lowest, from 0.5 up, at which predictions on a fifth of the forms
   and of the paragraphs, which a first model has not seen, that templates confirm are right at ``TARGET_PRECISION``.  The model in use is then fitted on all.
4. A prediction is confirmed if the paragraph holds ``CONFIRMED`` of the 2-grams of a template of that family (all of them where
   a template has at most ``SHORT``), or if so many of its own, more than ``SHORT``, stand in one template: then it is a part of the text.

Candidates.  Every paragraph is judged, but most without work: if unknown has the largest intercept, a paragraph can only come out
as a family if it holds an n-gram that speaks more for some family than for unknown.  ``triggers`` has a word of each such
n-gram, so a paragraph without any of them is unknown by proof, not by a rule of thumb.

The result has a row for each input row.  Null and empty texts have no candidates; very long texts are scanned whole; rows that
repeat id and text get the same result each; of equally likely families the first is taken; without rows there is none.  Extra
columns of the input, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import groups

HARD_WRAP = r"(?<=[\p{L}\p{N},])[ \t]*\r?\n[ \t]*(?=\p{Ll})"
PARAGRAPH = r"[\r\n]+|(?<=[.!?])[ \t]+(?=\p{Lu})"
NOT_WORD = r"[^\p{L}\p{N}]+"
UNKNOWN = "unknown"
SAMPLE_CHARS = 500_000
PIECE_CHARS = 2_000
TARGET_PRECISION = 0.98
CONFIRMED, SHORT = 0.6, 4
PENALTY = 2e-5
FAMILY_GRAMS = 400
LEAST_WORDS = 4
#: Words that make no n-gram telling by themselves.
FUNCTION_WORDS = frozenset(
    "a all an and any are as at be by can do for from has have he her his if in is it its may no not of on or our shall she so such that the their there these they this to"
    " under was we were which who will with without you your".split()
)
#: What the licence families are called.
NAMES = {
    "MIT": ["MIT License", "MIT license", "The MIT License (MIT)", "Expat License"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache Software License 2.0"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-2.0-or-later license", "GPLv3 license"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "LGPL-2.1 license", "GNU LGPL v3"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPL-3.0 license", "GNU AGPL v3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD license", "BSD-3-Clause license"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0 license"],
    "ISC": ["ISC License", "ISC license"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal public domain dedication", "Creative Commons Zero license"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Boost": ["Boost Software License, Version 1.0", "BSL-1.0 license"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License - v 1.0", "EPL-2.0 license"],
    "Proprietary": ["All rights reserved"],
}
#: What families are called for short.
SHORT_NAMES = {
    "MIT": ["MIT"], "Apache": ["Apache 2.0", "Apache 2", "Apache v2", "Apache"], "GPL": ["GPL", "GPL v3", "GPL v2", "GPLv2", "GPLv3", "GNU GPL"], "LGPL": ["LGPL", "LGPL v2.1", "LGPLv3", "GNU LGPL"],
    "AGPL": ["AGPL", "AGPLv3", "AGPL v3", "GNU AGPL"], "BSD": ["BSD", "3-clause BSD", "2-clause BSD", "simplified BSD", "modified BSD"], "MPL": ["MPL", "MPL 2.0", "Mozilla Public"], "ISC": ["ISC"],
    "CC0": ["CC0"], "CC-BY": ["CC BY"], "CC-BY-SA": ["CC BY-SA"], "CC-BY-NC": ["CC BY-NC"], "CC-BY-ND": ["CC BY-ND"], "Boost": ["Boost", "Boost Software"], "Zlib": ["zlib"], "EPL": ["EPL", "EPL 2.0", "Eclipse Public"],
}
#: How notices name a licence for short; the first ones are also templates.
SHORT_TEMPLATES = ("{} licensed", "{} license", "{} licence", "license {}", "licence {}", "licensed under {}", "under the {}", "terms of the {}")
SHORT_FORMS = (
    *SHORT_TEMPLATES, "{} licensed code", "This project is {} licensed.", "The {} licence applies.", "The {} license applies to this package.", "License :: {}", "licence = {}", "Software under the {} licence.",
    "You may use it under the {} license.", "All code is under the {} licence unless noted.", "Made available under the {} license by its authors.", "Released as {} licensed software.", "Dual licensed, {} license or commercial.",
    "Its license is {}.", "We chose the {} license.", "Contributions are accepted under the {} licence.", "Sources are published under the {} license.", "It is licensed under {} or later.",
)
#: How notices name a licence.
FORMS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.",
    "This software is made available under {}.", "SPDX-License-Identifier: {}", "See LICENSE: {}", "{}", "This project uses the {}, see the LICENSE file for details.",
    "This file is subject to the terms and conditions of the {}.", "The code is provided under the {} as found in the root of this repository.",
)
#: Sentences from the public texts of the licences.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights"],
    "Zlib": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "Proprietary": ["Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
#: Identifiers as file headers carry them.
SPDX = {
    "MIT": ["MIT"], "Apache": ["Apache-2.0"], "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL": ["MPL-2.0"],
    "ISC": ["ISC"], "Unlicense": ["Unlicense"], "CC0": ["CC0-1.0"], "CC-BY": ["CC-BY-4.0", "CC-BY-3.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0"], "Boost": ["BSL-1.0"], "Zlib": ["Zlib"], "EPL": ["EPL-2.0"],
}
#: What stands in the same forms without being a licence.
NOT_NAMES = (
    "city bylaws", "state plumbing board", "terms of the lease", "peace treaty", "old label", "rules of the club", "agreement of 1921", "school regulations", "building code",
    "supervision of a teacher", "insurance policy", "name of the author", "road traffic act", "health authority", "fishing rules", "second edition", "sales contract", "house rules",
)
#: Sentences about licences, copyright and rights that license nothing.
NOT_LICENSES = (
    "Her driving license was renewed last week.", "The council issued a license to sell food.", "A license plate was found near the road.",
    "Copyright law differs from country to country.", "The lecture was about copyright and patents.", "The police had a search warrant.",
    "The results warrant further study.", "The product comes with a warranty of two years.", "Taxes redistribute income between regions.",
    "The shop lost its liquor license.", "Permission is needed to enter the building.", "A fishing license costs ten euros a year.",
    "The singer has a license to record the songs.", "All rights of way are shown on the map.", "The station applied for a broadcast licence.",
    "They licensed the technology to a partner for a fee.", "Poetic licence allows such lines.", "The warrant officer read the orders.",
    "The painting is in the public domain, the curator said.", "The pilot's licence was suspended by the authority.",
    "The students of MIT won the contest.", "The apache tribe lived in the south west.", "The public was asked for its general opinion.", "Free software conferences are held every year.",
    "The committee reserved the room and all seats.", "The software was sold without any documentation.", "You may obtain a copy of the map at the office.", "The foundation published its yearly report.",
    "Redistribution of land was the aim of the reform.", "The source of the river lies in the hills.", "Creative people need common rooms.", "The eclipse was visible to the public.",
    "Mozilla released a new version of its browser.", "The universal remedy was a dedication to work.", "The materials provided with the course are in binders.", "Copying of keys is prohibited by the landlord.",
    "The confidential letter was lost in the mail.", "Every person obtaining a ticket may enter.", "The conditions are met by few countries.", "A notice about permission hangs on the door.",
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a word array, joined by blanks."""
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def with_grams(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``pairs`` (2-grams) and ``grams`` (distinct 1- to 3-grams)."""
    tokens = df.withColumn("_w", words(F.col(text_col)))
    tokens = tokens.withColumn("pairs", F.array_distinct(ngrams(F.col("_w"), 2)))
    return tokens.withColumn("grams", F.array_distinct(F.concat("_w", "pairs", ngrams(F.col("_w"), 3)))).drop("_w")


def paragraphs(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, pos, paragraph) of all paragraphs."""
    joined = F.regexp_replace(F.col(text_col), HARD_WRAP, " ")
    parts = df.select(*keys, F.posexplode(F.split(joined, PARAGRAPH)).alias("pos", "paragraph"))
    return parts.filter(F.trim("paragraph") != "")


def family_of(file: str) -> str:
    """The family of a licence text: the longest name that its file's name begins with."""
    return max((f for f in NAMES if file.startswith(f)), key=len)


def licence_texts(spark: SparkSession) -> DataFrame:
    """(family, text) of the public licence texts, some hundred thousand characters in all."""
    rows = [(family_of(f.stem), f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return spark.createDataFrame(rows, "family string, text string")


def text_paragraphs(spark: SparkSession) -> DataFrame:
    """(family, text) of the distinct paragraphs of ``LEAST_WORDS`` words or more of the licence texts, as their lines are wrapped and as if they were not."""
    texts = licence_texts(spark)
    unwrapped = texts.withColumn("text", F.regexp_replace("text", r"(?<=\S)[ \t]*\r?\n[ \t]*(?=\S)", " "))
    found = paragraphs(texts.unionByName(unwrapped), "text", ["family"]).withColumn("_w", words(F.col("paragraph"))).filter(F.size("_w") >= LEAST_WORDS)
    rank = F.array_position(F.array(*map(F.lit, NAMES)), F.col("family"))
    return found.groupBy(F.array_join("_w", " ").alias("_k")).agg(F.min_by("family", rank).alias("family"), F.min("paragraph").alias("text")).select("family", "text")


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, text): names, identifiers, sentences and paragraphs."""
    rows = [(f, t) for source in (NAMES, SENTENCES) for f, texts in source.items() for t in texts]
    rows += [(f, f"SPDX-License-Identifier: {t}") for f, ids in SPDX.items() for t in ids]
    rows += [(f, form.format(n)) for f, names in SHORT_NAMES.items() for n in names for form in SHORT_TEMPLATES]
    named = spark.createDataFrame(rows, "family string, text string").unionByName(text_paragraphs(spark))
    return named.select(F.xxhash64("family", "text").alias("template"), "family", "text")


def generated(spark: SparkSession) -> DataFrame:
    """(i, family, text, unit): every name in every form, identifiers, sentences, paragraphs of licence texts, and what is no licence.

    Rows of one ``unit``, a form or a wording, are kept out together.  Sentences and paragraphs count several times: they are few beside the forms."""
    rows = [(f, form.format(n), form) for f, names in NAMES.items() for n in names for form in FORMS]
    rows += [(f, form.format(n), form) for f, names in SHORT_NAMES.items() for n in names for form in SHORT_FORMS]
    rows += [(f, f"SPDX-License-Identifier: {t}", t) for f, ids in SPDX.items() for t in ids for _ in range(2)]
    rows += [(f, t, t) for f, texts in SENTENCES.items() for t in texts for _ in range(4)]
    rows += [(UNKNOWN, form.format(n), n) for n in NOT_NAMES for form in (*FORMS, *SHORT_FORMS) if not form.startswith("SPDX")]
    rows += [(UNKNOWN, t, t) for t in NOT_LICENSES for _ in range(4)]
    listed = spark.createDataFrame(rows, "family string, text string, unit string")
    again = text_paragraphs(spark).select("family", "text", F.col("text").alias("unit"), F.explode(F.array(F.lit(0), F.lit(1)))).drop("col")
    return listed.unionByName(again).select(F.abs(F.xxhash64("family", "text")).alias("i"), "family", "text", "unit")


class LicenseModel:
    def __init__(self, vectors: CountVectorizerModel, regression: LogisticRegressionModel, families: list[str], threshold: float):
        self.vectors, self.regression, self.families, self.threshold = vectors, regression, families, threshold

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows with ``grams`` get ``predicted`` (before the threshold) and ``probability``."""
        scored = self.regression.transform(self.vectors.transform(df)).withColumn("_p", vector_to_array("probability"))
        named = F.element_at(F.array(*map(F.lit, self.families)), F.col("prediction").cast("int") + 1)
        return scored.withColumn("predicted", named).withColumn("probability", F.array_max("_p")).drop("_p", "rawPrediction", "prediction", "features")

    def triggers(self) -> list[str] | None:
        """A word of each n-gram that speaks more for some family than for unknown; None if a paragraph without any could be a family."""
        base, weights = self.regression.interceptVector.toArray(), self.regression.coefficientMatrix.toArray()
        at = self.families.index(UNKNOWN)
        if (base > base[at]).any() or (base == base[at]).sum() > 1:
            return None
        found: set[str] = set()
        for gram, speaks in zip(self.vectors.vocabulary, (weights > weights[at]).any(axis=0), strict=True):
            own = [w for w in gram.split(" ") if w not in FUNCTION_WORDS]
            if speaks and not found.intersection(own):
                found.add(max(own, key=lambda w: (len(w), w)))
        return sorted(found)


def background(df: DataFrame, text_col: str, id_col: str, sample_chars: int) -> DataFrame:
    """(i, family, text): paragraphs of a sample of pieces of the texts, unknown unless a template confirms them."""
    total = df.agg(F.sum(F.length(text_col))).first()[0] or 0
    rate = min(1.0, sample_chars / max(total, 1))
    places = F.sequence(F.lit(0), F.floor(F.length(text_col) / PIECE_CHARS).cast("int"))
    chosen = F.filter(places, lambda i: groups.uniform(F.col(id_col), i, F.lit("license")) < rate)
    drawn = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.explode(chosen).alias("_at"))
    pieces = drawn.select("_id", "_at", F.substring("_t", F.col("_at") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("_piece"))
    keys = ["_id", "_at", "pos"]
    some = with_grams(paragraphs(pieces, "_piece", ["_id", "_at"]), "paragraph").select(*keys, "paragraph", "pairs")
    shapes = with_grams(templates(df.sparkSession), "text").select("template", F.size("pairs").alias("_n"), F.explode("pairs").alias("pair"))
    own = some.select(*keys, F.size("pairs").alias("_own"), F.explode("pairs").alias("pair"))
    held = own.join(F.broadcast(shapes), "pair").groupBy(*keys, "_own", "template", "_n").agg(F.count_distinct("pair").alias("_held"))
    confirmed = held.filter(enough(F.col("_held"), F.col("_n"), F.col("_own"))).select(*(F.col(k).alias(f"{k}_c") for k in keys)).distinct()
    free = some.join(confirmed, F.col("_id").eqNullSafe(F.col("_id_c")) & (F.col("_at") == F.col("_at_c")) & (F.col("pos") == F.col("pos_c")), "left_anti")
    return free.select(F.lit(-1).cast("bigint").alias("i"), F.lit(UNKNOWN).alias("family"), F.col("paragraph").alias("text"), F.col("paragraph").alias("unit"))


def enough(held: Column, of: Column, own: Column) -> Column:
    """Whether so many common 2-grams confirm a template with ``of`` by a paragraph with ``own``: most of the template's, or most of the paragraph's."""
    whole = (of > 0) & (held >= F.when(of <= SHORT, of.cast("double")).otherwise(of * CONFIRMED))
    return whole | ((own > SHORT) & (held >= own * CONFIRMED))


def fitted(rows: DataFrame) -> tuple[CountVectorizerModel, LogisticRegressionModel]:
    """A vocabulary of the ``FAMILY_GRAMS`` most common n-grams of each family's own rows, without those of function words alone, and weights from all rows.

    Weights travel with every step of the fit, so the vocabulary is kept small, and no family's long text fills it."""
    counted = rows.filter("i >= 0").select("family", F.explode("grams").alias("gram")).groupBy("family", "gram").count().filter("count > 1")
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("count"), "gram"))
    common = counted.withColumn("_n", place).filter(F.col("_n") <= FAMILY_GRAMS).select("gram").distinct().orderBy("gram").collect()
    telling = [r["gram"] for r in common if not FUNCTION_WORDS.issuperset(r["gram"].split(" "))]
    vectors = CountVectorizerModel.from_vocabulary(telling, inputCol="grams", outputCol="features", binary=True)
    regression = LogisticRegression(family="multinomial", regParam=PENALTY, elasticNetParam=1.0, maxIter=40, standardization=False, weightCol="weight")
    return vectors, regression.fit(vectors.transform(rows))


def train(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS) -> LicenseModel:
    spark = df.sparkSession
    families = [UNKNOWN, *NAMES]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    rows = with_grams(generated(spark).unionByName(background(df, text_col, id_col, sample_chars)), "text").withColumn("label", number)
    # by form or wording, so that neither a held-out form nor a copy of a held-out sentence teaches the first model
    rows = rows.withColumn("holdout", F.pmod(F.xxhash64(F.array_join(words(F.col("unit")), " ")), F.lit(5)) == 0)
    # half of the weight is unknown's, so that it has the largest intercept; families weigh by the root of their rows, as some have long texts
    sizes = rows.groupBy("family").count().withColumn("_r", F.sqrt("count"))
    mass = F.sum(F.when(F.col("family") != UNKNOWN, F.col("_r"))).over(Window.partitionBy(F.lit(0)))
    weights = sizes.select("family", (F.when(F.col("family") == UNKNOWN, mass / F.col("count")).otherwise(F.col("_r") / F.col("count")) * F.sum("count").over(Window.partitionBy(F.lit(0))) / (2 * mass)).alias("weight"))
    rows = rows.join(F.broadcast(weights), "family")  # one row a family
    rows = rows.repartition(1).sortWithinPartitions("i", "text").cache()  # a sample of bounded size, in one order, so that reruns agree
    first = LicenseModel(*fitted(rows.filter("not holdout")), families, 0.5)
    checked = first.predict(rows.filter("holdout and i >= 0")).filter(F.col("predicted") != UNKNOWN).withColumn("_likely", F.col("predicted"))
    results = compared(checked).filter("_m.sure").select("probability", (F.col("predicted") == F.col("family")).alias("right")).collect()
    model = LicenseModel(*fitted(rows), families, lowest_threshold([(r["probability"], r["right"]) for r in results]))
    rows.unpersist()
    return model


def lowest_threshold(results: list[tuple[float, bool]], target: float = TARGET_PRECISION, least: float = 0.5) -> float:
    """The lowest of ``least`` and the probabilities above it at which what is accepted is right at the target rate; 2 if none is."""
    for cut in sorted({least, *(p for p, _ in results if p >= least)}):
        accepted = [right for p, right in results if p >= cut]
        if sum(accepted) >= target * len(accepted):
            return cut if accepted or not results else 2.0
    return 2.0


def compared(scored: DataFrame) -> DataFrame:
    """Rows with ``pairs`` and ``_likely``, a family or null, get ``_m``: whether a template of that family confirms it, and the largest share in common."""
    # one array of 2-gram sets for each family: as large as the licence texts
    shapes = with_grams(templates(scored.sparkSession), "text").groupBy(F.col("family").alias("_of")).agg(F.collect_list("pairs").alias("_shapes"))
    judged = scored.join(F.broadcast(shapes), F.col("_likely") == F.col("_of"), "left")
    own = F.size("pairs")

    def likeness(held: Column, shape: Column) -> Column:
        of = F.size(shape)
        part = F.when(own > SHORT, held / own).otherwise(0.0)
        return F.struct(enough(held, of, own).alias("sure"), F.greatest(held / F.greatest(of, F.lit(1)), part).alias("share"))

    # the number of common 2-grams is the variable of a lambda, so that sets are compared once
    common = F.transform("_shapes", lambda s: F.struct(F.size(F.array_intersect(s, F.col("pairs"))).alias("held"), s.alias("shape")))
    matched = F.transform(common, lambda c: likeness(c["held"], c["shape"]))
    return judged.withColumn("_m", F.array_max(matched)).drop("_of", "_shapes")


def classify(df: DataFrame, model: LicenseModel, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, pos, paragraph, family, probability, likeness) of the candidate paragraphs; family is unknown unless confirmed."""
    spark, triggers = df.sparkSession, model.triggers()
    holds = lambda c: F.lit(True) if triggers is None else F.arrays_overlap(F.split(F.lower(c), NOT_WORD), F.array(*map(F.lit, triggers)))
    candidates = paragraphs(df.filter(holds(F.col(text_col))), text_col, keys).filter(holds(F.col("paragraph")))
    scored = model.predict(with_grams(candidates, "paragraph"))
    known = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= model.threshold)
    scored = scored.withColumn("_likely", F.when(known, F.col("predicted")))
    judged = compared(scored)
    confirmed, best = F.coalesce(F.col("_m.sure"), F.lit(False)), F.col("_m.share")
    family = F.when(confirmed, F.col("_likely")).otherwise(F.lit(UNKNOWN))
    return judged.select(*keys, "pos", "paragraph", family.alias("family"), "probability", F.coalesce(best, F.lit(0.0)).alias("likeness"))


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: LicenseModel | None = None) -> DataFrame:
    """(id, families, n_candidates, n_unknown, probability): a row for each row of ``df``, by a model that is trained for it unless one is given."""
    if df.isEmpty():
        none = F.array().cast("array<string>").alias("families")
        return df.select(id_col, none, *(F.lit(0).cast("bigint").alias(n) for n in ("n_candidates", "n_unknown")), F.lit(None).cast("double").alias("probability"))
    model = model or train(df, text_col, id_col)
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    keys = ["_id", "_h"]
    found = classify(rows, model, keys, "_t").dropDuplicates([*keys, "pos"])
    named = F.when(F.col("family") != UNKNOWN, F.col("family"))
    per_text = found.groupBy(*keys).agg(
        F.array_sort(F.collect_set(named)).alias("families"),
        F.count("*").alias("n_candidates"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.max(F.when(named.isNotNull(), F.col("probability"))).alias("probability"),
    )
    per_text = per_text.withColumnsRenamed({"_id": "_i", "_h": "_g"})
    joined = rows.select(*keys).join(per_text, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
        "probability",
    )

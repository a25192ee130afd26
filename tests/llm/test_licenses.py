import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import licenses as L

CASES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "This program uses the GNU Lesser General Public License, version 3.": "LGPL",
    "All rights reserved.": "Proprietary",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.": "Zlib",
    "Released under the GNU LGPL v3.": "LGPL",
    "Distributed under the terms of the GNU AGPL v3.": "AGPL",
    "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.": "Proprietary",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: ISC": "ISC",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL",
    "Redistribution and use in source and binary forms,\nwith or without modification, are\npermitted provided that the following conditions are met:": "BSD",
}
#: None of these, nor sentences like them, teaches the model.
OTHERS = [
    "The dentist needs a license to practise in this state.", "Her marriage licence was signed by the mayor.", "Copyright expires seventy years after the death of the author.",
    "All rights to the film were sold to a studio.", "The public library is open on Sundays.", "Software engineers wrote the code in two weeks.", "The MIT campus lies on the river.",
    "An apache helicopter flew over the town.", "Licensed under the supervision of a pharmacist.", "Released under the Sony label in 1994.", "Distributed under the terms of a truce.",
    "The warranty is void if the seal is broken.", "A general public meeting was held.", "Permission to land was refused by the tower.", "This file is subject to review.",
]
#: Notices as people write them, and parts of licence texts; none is made from the module's forms.
WORDINGS = [
    ("MIT", "Covered under the MIT licence."), ("MIT", "MIT-licensed"), ("MIT", "License: MIT (see LICENSE.txt)"), ("MIT", "Feel free to use this, it's MIT licensed."), ("MIT", "Copyright 2019 J. Doe, MIT license."),
    ("MIT", "the code in this gist is under the MIT license, do what you want"), ("MIT", "Licence - MIT"), ("MIT", "This library is open source and available under the MIT License."), ("MIT", "* @license MIT"),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE"),
    ("Apache", "Code is Apache 2 licensed."), ("Apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("Apache", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"), ("Apache", "License: Apache 2.0"),
    ("Apache", "you may not use this file except in compliance with the License."), ("Apache", "This plugin is distributed under the Apache License, Version 2.0 (the \"License\")"), ("Apache", "// Apache-2.0 license"),
    ("Apache", "Apache v2 licence, same as the upstream project"), ("Apache", "The docs and the samples are both under the Apache 2.0 license."),
    ("GPL", "License: GPL v3 or later"), ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."), ("GPL", "See the GNU General Public License for more details."),
    ("GPL", "released under GPLv2, patches welcome"), ("GPL", "the kernel module is GPL licensed"), ("GPL", "You can redistribute it under the GNU General Public License (GPL) version 2."), ("GPL", "license='GPLv3'"),
    ("GPL", "Licensed under the GNU GPL, version 2 or any later version."), ("GPL", "either version 3 of the License, or (at your option) any later version."), ("GPL", "The source is under the GPL v2 license."),
    ("LGPL", "This library is licensed under the LGPL."), ("LGPL", "License: LGPL v2.1 or later"), ("LGPL", "the bindings are LGPLv3 licensed"), ("LGPL", "See the GNU Lesser General Public License for more details."),
    ("LGPL", "Linking is allowed under the terms of the GNU Lesser General Public License 2.1."), ("AGPL", "The server is licensed under the AGPL v3."), ("AGPL", "License: AGPLv3"), ("AGPL", "This is AGPL licensed software, sources are on our site."),
    ("AGPL", "published under the GNU Affero General Public License version 3 or later"), ("BSD", "BSD licensed"), ("BSD", "3-clause BSD license"), ("BSD", "This is free software under the 2-clause BSD licence."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO'), ("BSD", "Use is governed by a BSD-style license, the BSD license text is in COPYING."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."), ("MPL", "Licence: MPL 2.0"), ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."), ("MPL", "The add-on is released under the Mozilla Public License."), ("ISC", "ISC licensed, see COPYING"), ("ISC", "License: ISC"),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"), ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."), ("CC0", "To the extent possible under law we waive our rights: CC0 license"),
    ("CC0", "This data set is under CC0 1.0 Universal."), ("CC-BY", "Text is available under CC BY 4.0."), ("CC-BY", "Photo: licensed under the Creative Commons Attribution 4.0 licence"), ("CC-BY-SA", "Content on this wiki is under CC BY-SA 3.0."),
    ("CC-BY-SA", "Articles may be shared under the Creative Commons Attribution-ShareAlike licence."), ("CC-BY-NC", "Pictures: CC BY-NC 4.0, no commercial use"), ("CC-BY-NC", "under a Creative Commons Attribution-NonCommercial 4.0 International licence"),
    ("Boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."), ("Zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty."), ("EPL", "The plug-in is licensed under the Eclipse Public License 2.0."), ("EPL", "License: EPL 2.0"),
]
NONE = ["The fishing license of my uncle expired in May.", "Copyright is a topic of this course.", "no cue here", "", None, "It is a warrant for nothing at all, she said."]


@pytest.fixture(scope="module")
def model(make, prose):
    return L.train(make([(i, f"{prose(i, 30)}\n{prose(i + 500, 25)}.") for i in range(60)]))


def test_families(make, prose, model):
    rows = [(i, f"{prose(i, 20)}.\n{line}\n{prose(i + 9, 30).capitalize()}") for i, line in enumerate(CASES)]
    found = {r["doc_id"]: r["family"] for r in L.classify(make(rows), model, ["doc_id"]).filter("family <> 'unknown'").collect()}
    assert [found.get(i) for i in range(len(CASES))] == list(CASES.values())


def test_all_generated_sentences_are_found(make, model):
    rows = [(i, f, form.format(n)) for f, names in L.NAMES.items() for n in names for form in L.FORMS for i in [0]]
    rows += [(0, f, t) for f, texts in L.SENTENCES.items() for t in texts] + [(0, f, f"SPDX-License-Identifier: {t}") for f, ids in L.SPDX.items() for t in ids]
    wrong = [(i, rows[i]) for i, found in families_of(make, model, [r[2] for r in rows]).items() if found != {rows[i][1]}]
    assert len(wrong) <= 0.01 * len(rows), wrong


def families_of(make, model, texts):
    out = {i: set() for i in range(len(texts))}
    for r in L.classify(make(list(enumerate(texts))), model, ["doc_id"]).filter("family <> 'unknown'").collect():
        out[r["doc_id"]].add(r["family"])
    return out


def test_what_is_no_licence_comes_out_unknown(make, model):
    found = families_of(make, model, OTHERS)
    assert not any(found.values()), [(OTHERS[i], f) for i, f in found.items() if f]
    rows = L.classify(make(list(enumerate(OTHERS))), model, ["doc_id"]).collect()
    assert rows and all(r["family"] == "unknown" for r in rows)  # judged, not passed over


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def by_hand(model, shapes, text):
    """(family, probability) of a paragraph without any gate."""
    w = words_of(text)
    grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    x = np.array([g in grams for g in model.vectors.vocabulary], float)
    logits = model.regression.coefficientMatrix.toArray() @ x + model.regression.interceptVector.toArray()
    p = np.exp(logits - logits.max())
    p /= p.sum()
    family = model.families[int(p.argmax())]
    pairs = {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    sure = False
    for t in shapes.get(family, []):
        own = {" ".join(words_of(t)[i : i + 2]) for i in range(len(words_of(t)) - 1)}
        sure |= bool(own) and len(own & pairs) / len(own) >= (1.0 if len(own) <= L.SHORT else L.CONFIRMED)
        sure |= len(pairs) > L.SHORT and len(own & pairs) / len(pairs) >= L.CONFIRMED
    return (family if family != "unknown" and p.max() >= model.threshold and sure else "unknown"), p.max()


def test_prediction_and_confirmation_equal_a_plain_evaluation(spark, make, prose, model):
    shapes = {}
    for r in L.templates(spark).collect():
        shapes.setdefault(r["family"], []).append(r["text"])
    texts = [*(c for c in CASES if ". " not in c and "\n" not in c), *OTHERS, *L.NOT_LICENSES, *(w for _, w in WORDINGS if not re.search(r"[.!?] [A-Z]", w)), *(prose(i, 12) + "." for i in range(20))]
    got = {r["doc_id"]: r for r in L.classify(make(list(enumerate(texts))), model, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        family, probability = by_hand(model, shapes, text)
        if i in got:
            assert got[i]["family"] == family and got[i]["probability"] == pytest.approx(probability, abs=1e-9), text
        else:
            assert family == "unknown", text  # what has no trigger could not be a family
    assert model.triggers() is not None and len(got) > 30


def test_threshold_keeps_the_target():
    rows = [(0.9, True)] * 98 + [(0.9, False)] * 2 + [(0.6, False)] * 50
    assert L.lowest_threshold(rows) == 0.9 and L.lowest_threshold(rows[:100]) == 0.5
    assert L.lowest_threshold([(0.9, False)]) == 2.0 and L.lowest_threshold([]) == 0.5


def test_unknown(make, model):
    assert L.classify(make(list(enumerate(NONE))), model, ["doc_id"]).filter("family <> 'unknown'").collect() == []


def test_scan_returns_every_row(make, prose, model):
    rows = [(i, prose(i, 40)) for i in range(20)] + [(50, None), (51, ""), (52, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (52, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), (53, "word " * 50_000 + "\nReleased under the MIT License.")]
    got = L.scan(make(rows).withColumns({"features": F.lit(1), "family": F.lit(2), "pos": F.lit(3), "grams": F.lit(4)}), model=model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["families"], r["n_candidates"]))
    assert by[52] == [(["CC-BY-NC", "MIT"], 2)] * 2 and by[None] == [(["MIT"], 1)] and by[53] == [(["MIT"], 1)] and by[50] == by[51] == [([], 0)]


def test_nothing(make):
    assert L.scan(make([])).collect() == []


def test_independent_wordings(make, model):
    found = families_of(make, model, [w for _, w in WORDINGS])
    hit = [i for i, (f, _) in enumerate(WORDINGS) if found[i] == {f}]
    named = [i for i in found if found[i]]
    assert len(WORDINGS) >= 60 and len(hit) >= 0.9 * len(WORDINGS), [(WORDINGS[i], found[i]) for i in found if i not in hit]
    assert len(hit) >= 0.98 * len(named), [(WORDINGS[i], found[i]) for i in named if i not in hit]


@pytest.mark.parametrize("file", ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"])
def test_whole_texts(make, model, file):
    """A licence as it is distributed, hard-wrapped, is named, and nothing that it does not name itself."""
    text = (Path(L.__file__).parent / "license_texts" / f"{file}.txt").read_text()
    rows = L.classify(make([(1, text)]), model, ["doc_id"]).collect()
    counts = Counter(r["family"] for r in rows if r["family"] != "unknown")
    assert counts.most_common(1)[0][0] == L.family_of(file) and counts[L.family_of(file)] >= 0.8 * sum(counts.values()), counts
    whole = {r["family"] for r in L.classify(make([(1, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", text))]), model, ["doc_id"]).collect()}
    assert L.family_of(file) in whole


def test_tiny_rates(make, prose):
    """A sample of a table far above its size is small, not empty by rounding."""
    docs = make([(i, prose(i, 200)) for i in range(400)])
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert L.background(docs, "text", "doc_id", total // 40).count() > 0
    rates = docs.select(L.groups.uniform(F.col("doc_id")).alias("u")).filter("u >= 0 and u < 1")
    assert rates.count() == 400 and rates.select(F.min(F.col("u") * 1e6 % 1)).first()[0] > 0

"""Licence scans: a trained paragraph classifier whose findings a template comparison confirms.

A paragraph is a run of lines: wrapped lines (the next line's first word would not have fitted into the width of their
block) are joined, a blank line or a line that had room to spare ends it. Its sentences are judged, and the paragraph
as a whole if no sentence names a licence. Features are 1- to 3-grams of words with at least one key word (a word of
the notices that is not a common one); the model is a multinomial logistic regression over `none`, `unknown` (other
licences) and the licence families, trained with an L1 penalty, so most weights are zero. Training rows are the notices
below and seeded variations of them (dropped, doubled and swapped words, cut ends, text around them), notices of other
licences and of invented ones as `unknown`, against word salads of the same words, phrases that only sound alike, and a
bounded sample of the corpus' own paragraphs (those that resemble a notice are left out of it). Half of the variations
are kept out of the fit: they set the temperature of the probabilities and, at the highest threshold that leaves 98 %
of them accepted, the border towards `unknown`.

A sentence without any key word has no feature, and with the intercepts alone the model says `none`: such sentences are
passed over after one set test, which changes no result. A sentence is of a family if its calibrated probability
reaches the threshold and the templates confirm it: one of the family's notices shares `confirm` or more of the word
pairs of the shorter of the two, that notice is a long one or the sentence has the family's name, and nothing in it
names a neighbouring licence or another version. A sentence that speaks of licences without being confirmed is unknown.
Findings are counted once per paragraph and family, unknown ones once per paragraph without a family.

All bounds of the fit are parameters (`Bounds`); the scan covers all rows and whole texts.

Defined cases: null or empty text has no findings; repeated rows and null doc_ids keep their rows; an empty table gives
no rows; texts and lines of any length take memory in proportion to themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn_texts, pick, slices

#: Short notices by which texts name their licence.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "To view a copy of this license, visit https://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Copyright (c) the company. All rights reserved.",
        "All rights reserved.",
        "This document is confidential and proprietary; unauthorized copying or distribution is strictly prohibited.",
    ],
}
#: Sentences that speak of neighbouring things but name no licence.
ALIKE = [
    "He lost his driving license on the way to the public library.", "The Apache helicopter landed at the base this morning.", "She studied physics at MIT and then moved to Berlin.",
    "The general public was free to visit the foundation.", "The version of events that he gave was different.", "The council may grant a permit to any person who applies.",
    "The terms of the agreement were published later.", "Work on the new road is under way, and will last until May.", "The following conditions were reported by the weather service.",
    "The software was distributed to all the schools in the region.", "Free copies of the book are available at the front desk.", "A creative person needs common sense as well.",
    "The source of the river lies in the hills.", "The author of this work would like to thank his readers.", "Their attribution of the painting to Vermeer is disputed.", "No warranty was given on the used car.",
]
#: Notices that name licences outside of the families.
OTHERS = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "ISC License", "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    "Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Apache License, Version 1.1", "The Apache Software License, Version 1.0", "Licensed under the GNU AGPL v3.",
    "This work is licensed under the GNU Affero General Public License, version 3.", "Released under the zlib license.", "Licensed under the Eclipse Public License 2.0", "Licensed under the European Union Public Licence 1.2",
    "Distributed under the Artistic License 2.0", "Licensed under the Microsoft Public License", "Do what the fuck you want to public license", "Licensed under the Open Software License version 3.0", "Licensed under CC BY-ND 4.0.",
]
#: How a family is named, and what names a neighbour or another version instead.
NAMED = {
    "Apache-2.0": (r"apache", r"\b(?:version|licen[sc]e|apache|v\.?)[ ,-]+(?!2(?:\.0)?\b)\d+(?:\.\d+)*"), "BSD": (r"\bbsd\b", r""), "CC-BY": (r"\bcc[ -]by\b|creative ?commons attribution|licenses/by/", r"\b(?:nc|sa|nd)\b|non-?commercial|share-?alike|no-?deriv"),
    "CC-BY-NC": (r"\bby-nc|non-?commercial", r"\bnd\b|no-?deriv"), "CC-BY-SA": (r"\bby-sa|share-?alike", r"\bnc\b|non-?commercial"), "CC0": (r"\bcc0\b|public domain|waived", r""), "GPL": (r"\bgpl\b|gnu general public licen[sc]e|gnu\.org/licenses", r"affero|agpl|lgpl|\blesser\b|library general"),
    "LGPL": (r"\blgpl\b|lesser general public|library general public", r"affero|agpl"), "MIT": (r"\bmit\b", r""), "MPL": (r"\bmpl\b|mozilla public", r""), "proprietary": (r"all rights reserved|proprietary|confidential", r""),
}
#: Words from which a notice is long enough to tell its licence without naming it.
LONG_NOTICE = 8
#: Words too common to be a key word.
COMMON = frozenset("a able above all along also an and any are as at be been both but by can do either else even every file find following for form found free from general given had has have he her his if in information into is it its kind last later law list made may more must name names nor not notice of on one or other our part person possible provided public published receive required see shall she should source such terms text that the their them this those time to under use used useful version view visit was were which will with without work works would you your".split())
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
SENTENCE = re.compile(r"(?<=[.!?:;])[\"')\]]*\s+(?=[\"'(\[]?[A-Z])")
NONE, UNKNOWN, CONFIRM = "none", "unknown", 0.6
#: Blocks with longer lines are not wrapped.
WRAPPED_WIDTH = 120


@dataclass(frozen=True)
class Bounds:
    """What the classifier is fitted on, at most; nothing else of the operator is bounded."""

    documents: int = 1500  # sampled by a hash of their id
    bytes: int = 32 << 20  # of their whole texts
    paragraphs: int = 5000  # of theirs, drawn by the seed
    filler_paragraphs: int = 500  # whose words surround the training notices
    filler_words: int = 2000
    salads: int = 1200  # rows of random words, as `none`
    negatives: int = 400  # paragraphs with a key word that resemble no notice, as `none`
    negative_words: int = 60  # of each of those
    invented: int = 400  # notices of invented licences, as `unknown`
    each: int = 40  # variations of a notice, at least


BOUNDS = Bounds()


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def grams(words: list[str], keys: frozenset[str]) -> set[str]:
    out = set()
    for i, w in enumerate(words):
        if w in keys:
            for a in range(max(0, i - 2), i + 1):
                for z in range(i + 1, min(len(words), a + 3) + 1):
                    out.add(" ".join(words[a:z]))
    return out


def pairs(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)


def overlap(a: Counter, b: Counter) -> float:
    """Shared word pairs, as a share of the shorter text's."""
    return sum((a & b).values()) / max(1, min(sum(a.values()), sum(b.values())))


@dataclass
class Model:
    families: list[str]
    keys: frozenset[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, list[Counter]]
    confirm: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        found = [self.features[g] for g in grams(words, self.keys) if g in self.features]
        z = (self.bias + (self.weights[found].sum(axis=0) / np.sqrt(len(found)) if found else 0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, sentence: str) -> tuple[str, float]:
        """(family, probability), (UNKNOWN, probability of some licence) or (NONE, probability)."""
        words = words_of(sentence)
        p = self.probabilities(words)
        if p[0] >= 0.5:
            return NONE, float(p[0])
        best = int(p.argmax()) if p[1:].argmax() else 1
        family = self.families[best]
        if best > 1 and p[best] >= self.threshold and self.confirmed(family, words, sentence.lower()):
            return family, float(p[best])
        return UNKNOWN, float(1 - p[0])

    def confirmed(self, family: str, words: list[str], lowered: str) -> bool:
        named, otherwise = NAMED[family]
        if otherwise and re.search(otherwise, lowered):
            return False
        own, has_name = pairs(words), bool(re.search(named, lowered))
        return any(overlap(own, t) >= self.confirm for t in self.templates[family] if has_name or min(sum(t.values()), sum(own.values())) >= LONG_NOTICE)

    def paragraph(self, text: str) -> tuple[dict[str, float], bool]:
        """Families with their best probabilities, and whether it speaks of another licence instead."""
        found: dict[str, float] = {}
        other = False
        for sentence in [*(parts := SENTENCE.split(text)), *([text] if len(parts) > 1 else [])]:
            if sentence is text and len(parts) > 1 and found:
                break  # the whole is asked only if no part names a licence
            if not self.keys.isdisjoint(words_of(sentence)):
                family, p = self.judge(sentence)
                if family == UNKNOWN:
                    other = True
                elif family != NONE:
                    found[family] = max(p, found.get(family, 0.0))
        return found, other and not found


def paragraphs(text: str) -> Iterator[str]:
    """Wrapped lines joined; see above."""
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line.strip())
            continue
        width, held = max(map(len, block), default=0), ""
        for i, own in enumerate(block):
            held = f"{held} {own}" if held else own
            after = block[i + 1] if i + 1 < len(block) else ""
            if not after or width > WRAPPED_WIDTH or len(own) + 1 + len(after.split(None, 1)[0]) <= width:
                yield held
                held = ""
        block = []


def _variations(rng: np.random.Generator, sentence: list[str], filler: list[str], n: int) -> list[list[str]]:
    out = []
    for _ in range(n):
        w = [x for x in sentence if len(sentence) < 6 or rng.random() > 0.06]
        if len(w) > 8 and rng.random() < 0.3:
            cut = int(rng.integers(len(w) // 2, len(w)))
            w = w[:cut] if rng.random() < 0.5 else w[-cut:]
        if len(w) > 5 and rng.random() < 0.2:
            i = int(rng.integers(0, len(w) - 1))
            w[i], w[i + 1] = w[i + 1], w[i]
        around = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 7)))]
        at = int(rng.integers(0, len(around) + 1))
        out.append(around[:at] + w + around[at:])
    return out


def fit(sample: list[str], seed: int = 5, rounds: int = 300, rate: float = 0.5, l1: float = 2e-4, confirm: float = CONFIRM, bounds: Bounds = BOUNDS) -> Model:
    """Train on the notices and on paragraphs of the corpus (a bounded sample)."""
    rng = np.random.default_rng(seed)
    families = [NONE, UNKNOWN, *sorted(NOTICES)]
    templates = {f: [pairs(words_of(s)) for s in NOTICES[f]] for f in families[2:]}
    said = [words_of(s) for f in families[2:] for s in NOTICES[f]]
    keys = frozenset(w for s in said for w in s if w not in COMMON and not w.isdigit())
    lines = [w for s in sorted(set(sample)) if (w := words_of(s))]
    lines = [lines[i] for i in np.sort(rng.permutation(len(lines))[: bounds.paragraphs])]
    lines = [w for w in lines if keys.isdisjoint(w) or max(overlap(pairs(w), t) for own in templates.values() for t in own) < 0.3]
    filler = sorted({x for w in lines[: bounds.filler_paragraphs] for x in w if x not in keys})[: bounds.filler_words] or ["lorem", "ipsum", "dolor"]
    rows, label = [], []

    def add(some: list[list[str]], family: int) -> None:
        rows.extend(some)
        label.extend([family] * len(some))

    for f, family in enumerate(families[2:], 2):
        per = max(bounds.each, 8 * bounds.each // len(NOTICES[family]))
        for s in NOTICES[family]:
            add(_variations(rng, words_of(s), filler, per), f)
    for s in OTHERS:
        add(_variations(rng, words_of(s), filler, bounds.each), 1)
    short = [w for w in said if len(w) < LONG_NOTICE and "license" in w]
    for _ in range(bounds.invented):  # a short notice with another name: its key words but those about licences replaced
        w = short[int(rng.integers(0, len(short)))]
        add([[x if x in COMMON or x in ("license", "licensed", "released", "work") else filler[int(rng.integers(0, len(filler)))] for x in w]], 1)
    pool = [x for s in said for x in s]
    for _ in range(bounds.salads):
        add([[pool[i] if rng.random() < 0.4 else filler[i % len(filler)] for i in rng.integers(0, len(pool), int(rng.integers(1, 25)))]], 0)
    for s in ALIKE:
        add(_variations(rng, words_of(s), filler, bounds.each), 0)
    add([w[: bounds.negative_words] for w in lines if not keys.isdisjoint(w)][: bounds.negatives], 0)
    add([[]] * 50, 0)
    label = np.array(label)
    seen = Counter(g for w in rows for g in grams(w, keys))
    features = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, w in enumerate(rows):
        own = [features[g] for g in grams(w, keys) if g in features]
        x[i, own] = 1 / np.sqrt(max(1, len(own)))
    train = np.arange(len(rows)) % 2 == 0
    weights, bias, target = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32), np.eye(len(families), dtype=np.float32)[label]
    speed = np.zeros_like(weights)
    a, t = x[train], target[train]
    for _ in range(rounds):
        z = a @ weights + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - t) / len(a)
        speed = 0.9 * speed - rate * 10 * (a.T @ g)
        weights += speed
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * l1 * 10, 0)
        bias -= rate * g.sum(axis=0)
    bias[0] = max(bias[0], bias[1:].max() + 2)  # without a feature a paragraph is `none`
    held = ~train
    z = x[held] @ weights + bias

    def calibrated(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    rows_held = np.arange(held.sum())
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda s: -np.log(calibrated(s)[rows_held, label[held]] + 1e-12).mean())
    p = calibrated(temperature)
    right = (p.argmax(axis=1) == label[held]) & (label[held] > 1)
    threshold = float(np.quantile(p[right].max(axis=1), 0.02)) if right.any() else 0.5
    used = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
    names = sorted(features, key=features.get)
    return Model(families, keys, {names[i]: n for n, i in enumerate(used)}, weights[used], bias, temperature, max(0.5, threshold), templates, confirm)


def training_sample(docs: DataFrame, bounds: Bounds = BOUNDS) -> list[str]:
    """Paragraphs of whole texts: of the documents with the smallest hashes of their ids, within the bounds."""
    own = pick(docs, "doc_id", "text").where("doc_id is not null").withColumn("all", F.lit(0))
    n = own.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = own.select("doc_id").where(draw * n <= 2 * bounds.documents).orderBy(draw, "doc_id").limit(bounds.documents).distinct()
    return [x for r in drawn_texts(own, ids, bounds.bytes, "all").collect() for x in paragraphs(r.text)]  # bounded by rows and bytes


SCHEMA = "doc_id long, licences array<string>, n_findings long, n_unknown long, confidence double"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, licences (families found, in order of name), n_findings, n_unknown, confidence (the best finding's probability)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged: dict[str, tuple[dict[str, float], bool]] = {}
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                families, n, unknown, confidence = set(), 0, 0, 0.0
                if text and not model.keys.isdisjoint(words_of(text)):
                    for paragraph in paragraphs(text):
                        verdict = judged.get(paragraph)
                        if verdict is None:
                            verdict = model.paragraph(paragraph)
                            if len(paragraph) < 500 and len(judged) < 20_000:
                                judged[paragraph] = verdict
                        found, other = verdict
                        families |= found.keys()
                        n += len(found)
                        unknown += other
                        confidence = max([confidence, *found.values()])
                rows.append((sorted(families), n, unknown, confidence))
            yield pa.record_batch([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.string()), pa.int64(), pa.int64(), pa.float64())))], names=["doc_id", "licences", "n_findings", "n_unknown", "confidence"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def findings(docs: DataFrame, bounds: Bounds = BOUNDS) -> DataFrame:
    return scan(docs, fit(training_sample(docs, bounds), bounds=bounds))

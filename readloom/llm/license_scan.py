"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of the text together with the lines after it that go on
with what it says: a notice that is wrapped over lines is one paragraph, numbered
by its first line. Its features are word 1- to 3-grams; sparse multinomial
logistic regression (an L1 penalty) learns families from texts made out of the
templates below, with words dropped, changed or put around them, and an `unknown`
class from texts about licences that grant none of these and from plain prose. A
temperature fitted on texts kept apart calibrates the probabilities, and whatever
is less likely than `cut` is unknown. A prediction counts as confirmed when
enough of a template of its family is in the paragraph, word pair by word pair.

A line without any n-gram of nonzero weight begins no paragraph: it would get the
bias alone, the same for all, which speaks for unknown. Models and templates don't
grow with the input. Null and empty texts have no rows; repeated rows give
repeated results; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import ship
from readloom.llm.common import Sent, slices

ship(__name__)

#: How files usually name their licence.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright (c) 2020 Example Inc. All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}
#: Texts that speak of licences without granting one of the above.
OTHERS = [
    "You need a driving license to rent a car in this city.", "The license plate was hard to read in the rain.", "Please read the license agreement before you install it.",
    "The software is free of charge for students.", "The general public was not admitted, and this file was closed.", "Use of this source is subject to the terms of the agreement.",
    "The copyright office is open to the public.", "Version 2 of the program was released under a new name.", "The attribution of this work to the painter is in doubt.",
    "He obtained a copy of the book without permission.", "A commercial license can be bought from the vendor.", "The Apache helicopter was licensed to another firm.",
    "All rights of the reader are reserved in the library.", "The MIT campus is open, and no license is needed to visit it.", "The rights to use the hall were granted to the public.",
    "Reserved seats are on the right, all others on the left.", "A creative work with attribution to the commons of the village.", "The Mozilla browser was published as free software in version 2.",
]
WORD = re.compile(rb"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
FAMILIES = ["unknown", *TEMPLATES]


def words_of(paragraph: str) -> list[bytes]:
    return WORD.findall(paragraph.encode("utf-8", "surrogatepass").lower())


def grams(w: list[bytes]) -> set[bytes]:
    return {b" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def pairs(w: list[bytes]) -> set[tuple[bytes, ...]]:
    """Word pairs; of a single word, the word."""
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


@dataclass
class Model:
    features: dict[bytes, np.ndarray]  # weights by family of each feature that has any
    keys: frozenset[bytes]  # a word of each of them, the rarest of its words
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, list[bytes], set[tuple[bytes, ...]]]]
    joints: frozenset[tuple[bytes, ...]]  # the templates' runs of three words
    held_out: tuple[np.ndarray, np.ndarray]  # what was kept apart: probability of the likeliest family, whether it is right

    def probabilities(self, w: list[bytes]) -> np.ndarray:
        z = self.bias.copy()
        hit = [self.features[g] for g in grams(w) if g in self.features]
        if hit:
            z = z + np.sum(hit, 0)
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def goes_on(self, w: list[bytes], line: list[bytes]) -> bool:
        """The line goes on where w ends in a template, or both have much of the same one."""
        if not w or not line:
            return False
        runs = [(*w[-2:], line[0])] * (len(w) > 1) + [(w[-1], *line[:2])] * (len(line) > 1)
        if runs and self.joints.issuperset(runs):
            return True
        mine, its = pairs(w), pairs(line)
        return any(2 * len(its & t) >= max(6, len(its)) and 2 * len(mine & t) >= max(6, len(mine)) for _, _, t in self.templates)


def _examples(rng: np.random.Generator, plain: list[str], copies: int) -> tuple[list[list[bytes]], list[int]]:
    prose = [w for p in plain for w in words_of(p)] or [b"the", b"of", b"and"]
    some = lambda n: [prose[i] for i in rng.integers(0, len(prose), n)]
    x, y = [], []
    for k, family in enumerate(FAMILIES):
        for t in TEMPLATES.get(family, OTHERS):
            w = words_of(t)
            for c in range(copies):
                v = list(w)
                if c and family != "unknown":
                    for _ in range(int(rng.integers(0, 1 + len(v) // 8))):
                        v[int(rng.integers(0, len(v)))] = some(1)[0]
                v = some(int(rng.integers(0, 8)) * (c % 3 > 0)) + v + some(int(rng.integers(0, 8)) * (c % 3 > 1))
                x.append(v)
                y.append(k)
                if len(w) >= 24:  # a part of a long template
                    n = int(rng.integers(8, len(w)))
                    at = int(rng.integers(0, len(w) - n + 1))
                    x.append(w[at:at + n])
                    y.append(k)
    for p in plain:
        x.append(words_of(p))
        y.append(0)
    for _ in range(copies * 6):  # single words of templates in prose mean nothing
        t = words_of(TEMPLATES[FAMILIES[int(rng.integers(1, len(FAMILIES)))]][0])
        v = some(12)
        for i in rng.integers(0, len(v), 2):
            v[i] = t[int(rng.integers(0, len(t)))]
        x.append(v)
        y.append(0)
    return x, y


def train(plain: list[str], *, copies: int = 12, penalty: float = 4e-4, steps: int = 250, seed: int = 3) -> Model:
    """plain: a bounded sample of paragraphs without a licence, for the unknown class."""
    rng = np.random.default_rng(seed)
    x, y = _examples(rng, plain, copies)
    texts = [grams(w) for w in x]
    count: dict[bytes, int] = {}
    for g in texts:
        for f in g:
            count[f] = count.get(f, 0) + 1
    from_templates = {g for ts in TEMPLATES.values() for t in ts for g in grams(words_of(t))} | {g for t in OTHERS for g in grams(words_of(t))}
    usual: dict[bytes, int] = {}
    for p in plain:
        for f in grams(words_of(p)):
            usual[f] = usual.get(f, 0) + 1
    telling = lambda f: any(usual.get(v, 0) <= len(plain) // 100 for v in f.split(b" "))  # noqa: E731 - words that plain prose often holds don't tell
    names = sorted(f for f, n in count.items() if n >= 3 and f in from_templates and telling(f))
    at = {f: i for i, f in enumerate(names)}
    m = np.zeros((len(x), len(names)), np.float32)
    for i, g in enumerate(texts):
        for f in g:
            if f in at:
                m[i, at[f]] = 1
    label = np.array(y)
    apart = rng.random(len(x)) < 0.2
    fit, k = ~apart, len(FAMILIES)
    target = np.eye(k, dtype=np.float32)[label[fit]]
    a = m[fit]
    w, b = np.zeros((len(names), k), np.float32), np.zeros(k, np.float32)
    zw, t = w.copy(), 1.0
    top = np.ones(len(names), np.float32)
    for _ in range(30):  # the largest eigenvalue, by power iteration
        top = a.T @ (a @ top)
        top /= max(1e-9, float(np.linalg.norm(top)))
    step = 1.8 / max(1e-6, float(np.linalg.norm(a @ top) ** 2) / len(a))
    for _ in range(steps):
        s = a @ zw + b
        e = np.exp(s - s.max(1, keepdims=True))
        r = e / e.sum(1, keepdims=True) - target
        new = zw - step * (a.T @ r) / len(a)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= step * r.mean(0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, w, t = new + (t - 1) / nt * (new - w), new, nt
    s = m[apart] @ w + b

    def loss(temp: float) -> float:
        z = s / temp
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(z)), label[apart]] - np.log(np.exp(z).sum(1))).mean())

    temperature = min(np.geomspace(0.2, 5, 40), key=loss) if apart.any() else 1.0
    features = {f: w[i].astype(float) for f, i in at.items() if np.abs(w[i]).max() > 0}
    templates = [(family, words_of(t), pairs(words_of(t))) for family, ts in TEMPLATES.items() for t in ts]
    keys = frozenset(min(f.split(b" "), key=lambda v: (usual.get(v, 0), v)) for f in features)
    joints = frozenset(run for _, v, _ in templates for run in zip(v, v[1:], v[2:]))
    z = s / temperature
    e = np.exp(z - z.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    return Model(features, keys, b.astype(float), float(temperature), templates, joints, (e.max(1), e.argmax(1) == label[apart]))


def classify(w: list[bytes], model: Model, cut: float, share: float) -> tuple[str, float, float, bool] | None:
    """(family, probability, similarity, confirmed) of a paragraph's words; None if it is unknown."""
    p = model.probabilities(w)
    k = int(p.argmax())
    if k == 0 or p[k] < cut:
        return None
    mine = pairs(w) | {(v,) for v in w}
    near = max((len(t & mine) / len(t) for family, _, t in model.templates if family == FAMILIES[k]), default=0.0)
    return FAMILIES[k], float(p[k]), near, near >= share


def scan_text(text: str | None, model: Model, cut: float = 0.5, share: float = 0.7) -> list[tuple[int, int, str, float, float, bool]]:
    """(first line, lines, family, probability, similarity, confirmed) of each known paragraph."""
    out, at = [], 0
    lines = (text or "").split("\n")
    while at < len(lines):
        first, w = at, words_of(lines[at])
        at += 1
        if model.keys.isdisjoint(w):
            continue
        while at < len(lines) and model.goes_on(w, line := words_of(lines[at])):
            w = w + line
            at += 1
        if found := classify(w, model, cut, share):
            out.append((first, at - first, *found))
    return out


def scan_licenses(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, cut: float = 0.5, share: float = 0.7) -> DataFrame:
    """A row for each paragraph with a known family: doc_id, paragraph (its first line), n_lines, family, probability, similarity, confirmed."""
    kind = df.schema[id_col].dataType.simpleString()
    sent = Sent(df.sparkSession, model)
    names = ["doc_id", "paragraph", "n_lines", "family", "probability", "similarity", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, got = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = scan_text(text, sent.value, cut, share)
                at += [i] * len(found)
                got += found
            cols = list(zip(*got, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, paragraph int, n_lines int, family string, probability double, similarity double, confirmed boolean")


def plain_sample(docs: DataFrame, text_col: str = "text", *, max_rows: int = 300, max_chars: int = 2000) -> list[str]:
    """At most `max_rows` lines that don't speak of licences, each of at most `max_chars`, one of a text, by hashes.

    A threshold on the hash leaves about twenty times `max_rows` lines to sort, whatever the table's size.
    """
    lines = F.split(F.col(text_col).cast("string"), "\n")
    line = F.get(lines, F.pmod(F.xxhash64(F.col(text_col)), F.size(lines)).cast("int"))
    keep = max(1, docs.count() // (20 * max_rows))
    rows = docs.select(line.alias("line")).where(F.pmod(F.xxhash64("line"), F.lit(keep)) == 0)
    rows = rows.where((F.length("line") <= max_chars) & ~F.col("line").rlike(r"(?i)licen|copyright|spdx|warrant|permission|rights reserved|^\s*$")).distinct()
    return [r.line for r in rows.orderBy(F.xxhash64("line", F.lit(1)), "line").limit(max_rows).collect()]

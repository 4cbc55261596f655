"""License scans: a trained classifier of paragraphs, confirmed by templates.

A sparse multinomial logistic regression over word 1- to 3-grams names the
license family of a paragraph, or ``unknown``. It is trained in numpy on notices
written from the templates below and on sentences that only sound like them;
its temperature and the least probability of a family are set on notices it has
not seen. A family stands only if one of its templates is contained in the
paragraph. Scoring is one expression over Spark's own functions: a document's
paragraphs never leave its row.

A paragraph is what lies between blank lines, however it is wrapped; of one of
several lines each line is judged too, as a notice may stand alone among others.
Only paragraphs with an anchor are judged. Anchors are derived from the
templates so that what confirms a family always has one: nothing that could be
confirmed is passed over.
"""

from __future__ import annotations

import itertools
import json
import re
from dataclasses import dataclass
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, lower_ascii
from .syncmers import let

UNKNOWN = "unknown"
#: Names by which notices call a license, and the openings of their texts.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache Software License 2.0"],
    "mit": ["MIT License", "MIT license terms", "MIT software license", "Expat License"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3", "GNU GPL version 3 or later", "GPL-3.0-or-later"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2", "GNU GPL version 2 or later", "GPL-2.0-only"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv3", "LGPL-3.0"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "Affero GPL version 3"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "new BSD license", "BSD License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "public-domain": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0", "the Unlicense", "public domain dedication"],
    "isc": ["ISC License", "ISC license terms", "ISC software license"],
    "epl": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v1.0", "EPL-2.0", "EPL-1.0"],
}
BODIES = {
    "apache-2.0": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at apache.org licenses LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT", "licensed under MIT", "released under MIT"],
    "gpl-3.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "gpl-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"],
    "lgpl": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "has waived all copyright and related or neighboring rights to this work"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "SPDX-License-Identifier: ISC", "licensed under ISC"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
}
FRAMES = ["{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This project is available under the {}.", "SPDX-License-Identifier: {}", "Code is covered by the {}; see LICENSE.", "You can redistribute it under the {}.", "Copyright the authors. {}", "All content here is published under a {} license."]
LIKE_NOTICES = [
    "The driver's license expired in May", "A fishing license is sold at the office", "Her poetic license went too far", "The album was released under a new name", "The film was released in the public square", "He asked permission to leave", "Copyright is a difficult subject", "Copyright 2019 by the newspaper",
    "All rights reserved", "The warranty covers parts and labour for two years", "The city issued the restaurant a license", "A license to sell wine is required", "Terms and conditions apply", "This work is the result of ten years", "The project is available in three sizes", "Version 3 of the report is out",
    "Version 2.0 of the plan was shown", "The general public is invited", "The public license office is closed", "Apache helicopters flew over the base", "MIT researchers built a robot", "Mozilla released a browser", "Students at MIT wrote a paper on license plates", "The foundation published its terms",
    "Creative people have things in common", "The commons are open to the public", "Attribution of the painting is disputed", "Source and binary stars were observed", "A clause of the contract was void", "The terms of the lease were changed", "Licensed plumbers are hard to find", "Licensed under the counter by nobody",
    "The software license fee has doubled", "Our license agreement with the vendor ends soon", "Released under pressure from the press", "He was released under the supervision of a doctor", "This work is licensed by the state board", "Distributed under the bridge", "SPDX is a format for lists", "mit der Lizenz", "released under einem Namen mit", "Copyright und Lizenz mit der Stadt", "Permission is never granted twice",
]
#: Least share of a template's 2-grams that the paragraph has.
CONFIRM = 0.6
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What separates paragraphs: a line without text, of a comment too.
BLANK = r"\n[\s*#/;-]*\n"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def grams_of(words: list[str], sizes=(1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


@dataclass
class Classifier:
    families: list[str]  # the last is UNKNOWN
    grams: dict[str, list[float]]
    bias: list[float]
    temperature: float
    least: float


def _logits(x, w, b):
    return np.array([w[r].sum(0) + b for r in x])


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(seed: int = 5, rounds: int = 300, rate: float = 0.5, l1: float = 2e-4, unseen: int = 4) -> Classifier:
    """Proximal gradient descent with an l1 penalty; every ``unseen``-th frame of a
    notice, every ``unseen``-th look-alike and one form of each text are left for
    calibration."""
    families = [*NAMES, UNKNOWN]
    rows: list[tuple[str, int, bool]] = []
    for k, (f, names) in enumerate(NAMES.items()):
        for (i, frame), name in itertools.product(enumerate(FRAMES), names):
            rows.append((frame.format(name), k, i % unseen == unseen - 1))
        for body in BODIES.get(f, []):
            w, cut = body.split(), max(1, len(body.split()) // 7)
            # whole, without its beginning, without its end; calibration sees it as part of a longer paragraph
            rows += [(body, k, False)] * 2 + [(" ".join(w[cut:] if len(w) > 6 else w), k, False), (" ".join(w[:-cut] if len(w) > 6 else w), k, False), (f"Copyright the author. {body}, subject to what follows", k, True)]
    rows += [(s, len(families) - 1, i % unseen == 0) for i, s in enumerate(LIKE_NOTICES) for _ in range(8)]
    rows += [(frame.format(x), len(families) - 1, i % unseen == 0) for i, frame in enumerate(FRAMES) for x in ("", "city board", "name of the author", "new management", "state office", "house rules", "terms below")]
    vocabulary: dict[str, int] = {}
    for text, _, held in rows:
        if not held:
            for g in sorted(grams_of(words_of(text))):
                vocabulary.setdefault(g, len(vocabulary))
    x = [np.array([vocabulary[g] for g in grams_of(words_of(t)) if g in vocabulary], int) for t, _, _ in rows]
    y, held = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    dense = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(x):
        dense[i, r] = 1
    a, ya = dense[~held], np.eye(len(families))[y[~held]]
    weight = 1 / np.bincount(y[~held], minlength=len(families))[y[~held]]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    b[-1] = 1.0
    for _ in range(rounds):
        g = (_softmax(a @ w + b) - ya) * weight
        w -= rate * (a.T @ g) * 8
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * g.sum(0)
    z, yh = _logits([x[i] for i in np.flatnonzero(held)], w, b), y[held]
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(yh)), yh], 1e-12)).mean() for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    temperature = min(loss, key=loss.get)
    p = _softmax(z / temperature)
    # the least probability of a family, at most 0.5, that no look-alike reaches
    false = p[yh == len(families) - 1, :-1].max(initial=0.0)
    used = {g: [round(float(v), 5) for v in w[k]] for g, k in vocabulary.items() if np.abs(w[k]).max() > 1e-4}
    return Classifier(families, used, [float(v) for v in b], temperature, float(min(0.5, max(0.3, false + 0.02))))


def templates() -> list[tuple[str, list[str]]]:
    """(family, 2-grams) of names of two words and more and of bodies; 1-grams of shorter names."""
    out = []
    for f, names in NAMES.items():
        for t in [*names, *BODIES.get(f, [])]:
            w = words_of(t)
            out.append((f, sorted(grams_of(w, (2,) if len(w) > 1 else (1,)))))
    return out


def anchors() -> list[str]:
    """Words of which every paragraph that confirms a template has one.

    ``CONFIRM`` of a template's n grams are at least one of any n - ceil(CONFIRM n) + 1
    of them. For each template so many are covered by words: by anchors that
    another has already, then by telling words before common ones, by the word in
    most grams, by the longest.
    """
    found: set[str] = set()
    for _, grams in sorted(templates(), key=lambda t: (len(t[1]), t[1])):
        left = {g: set(g.split()) for g in grams}
        need = len(left) - ceil(CONFIRM * len(left)) + 1
        while True:
            open_ = {g for g, w in left.items() if not w & found}
            if len(left) - len(open_) >= need:
                break
            telling = [w for g in open_ for w in left[g]]
            found.add(max(sorted(set(telling)), key=lambda w: (any(x in w for x in _TELLING), w not in _COMMON and w.isalpha(), telling.count(w), len(w))))
    return sorted(found)


#: Parts of words that are preferred as anchors, as little else has them, and words that are avoided, as all has them.
_TELLING = ("licen", "gpl", "copyright", "redistribut", "spdx", "cc-by", "cc0", "permission")
_COMMON = frozenset("a all an and any are as at be by for general in is it made may not of on or public that the this to under use used version with you".split())


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def found_licenses(text: Column, model: Classifier) -> Column:
    """array<struct<paragraph int, family, probability, similarity, confirmed>>
    of the paragraphs with an anchor and of their lines, in order; whole text. A
    paragraph of several lines is left out if one of them names its family, its
    lines if none is confirmed."""
    weights = _constant(model.grams, "map<string,array<double>>")
    vocabulary = F.array(*map(F.lit, model.grams)) if model.grams else F.array().cast("array<string>")
    known_templates = _constant([{"f": f, "g": g} for f, g in templates()], "array<struct<f:string,g:array<string>>>")
    families = F.array(*map(F.lit, model.families))

    def judged(paragraph: Column, at: Column) -> Column:
        words = F.regexp_extract_all(paragraph, F.lit(_WORD), 0)

        def of_words(w: Column) -> Column:
            def n_grams(n: int) -> Column:
                if n == 1:
                    return w
                return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + k) for k in range(1, n))))

            grams = F.array_intersect(F.concat(n_grams(1), n_grams(2), n_grams(3)), vocabulary)
            logits = F.aggregate(grams, F.array(*map(F.lit, model.bias)), lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
            odds = F.transform(logits, lambda z: F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z / model.temperature))))
            shares = let(odds, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s)))
            seen = F.array_distinct(F.concat(n_grams(1), n_grams(2)))

            def decide(p: Column) -> Column:
                best = F.array_max(F.slice(p, 1, len(model.families) - 1))
                family = F.get(families, F.array_position(p, best).cast("int") - 1)
                own = F.transform(F.filter(known_templates, lambda t: t["f"] == family), lambda t: F.size(F.array_intersect(t["g"], seen)) / F.size(t["g"]))
                similarity = F.coalesce(F.array_max(own), F.lit(0.0))
                sure = (best >= model.least) & (similarity >= CONFIRM)
                return F.struct(
                    at.alias("paragraph"), F.when(sure, family).otherwise(F.lit(UNKNOWN)).alias("family"),
                    F.when(sure, best).otherwise(F.greatest(F.element_at(p, -1), 1 - best)).alias("probability"), similarity.alias("similarity"), sure.alias("confirmed"),
                )

            return let(shares, decide)

        return let(words, of_words)

    kind = "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>"
    none = F.array().cast(kind)
    anchored = lambda c: c.rlike(ANCHOR)

    def of_paragraph(p: Column) -> Column:
        lines = F.filter(F.split(p["p"], "\n"), anchored)
        by_line = F.filter(F.transform(lines, lambda x: judged(x, p["i"])), lambda x: x["confirmed"])

        def both(own: Column, found: Column) -> Column:
            named = F.exists(found, lambda x: x["family"] == own["family"])
            return F.when(F.size(found) == 0, F.array(own)).when(own["confirmed"] & ~named, F.concat(F.array(own), found)).otherwise(found)

        alone = F.array(judged(p["p"], p["i"]))
        several = let(judged(p["p"], p["i"]), lambda own: let(by_line, lambda found: both(own, found)))
        return F.when(F.position(F.lit("\n"), p["p"]) > 0, several).otherwise(alone)

    def of_text(t: Column) -> Column:
        numbered = F.transform(F.split(t, BLANK), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        return F.when(anchored(t), F.flatten(F.transform(F.filter(numbered, lambda s: anchored(s["p"])), of_paragraph))).otherwise(none)

    return let(lower_ascii(text), of_text)


#: An anchor in lower-case text, as a word or a part of one between dots and hyphens.
ANCHOR = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors())) + ")(?![a-z0-9])"


def license_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """One row per input row: doc_id, n_candidates (paragraphs with an anchor),
    n_licenses (notices confirmed), families (their distinct names, sorted,
    comma-joined), best_family, best_probability, best_similarity, found (all).

    The best is the confirmed paragraph of greatest probability, the first on a
    tie; without one it is ``none``, or ``unknown`` if a paragraph looked like a
    notice to the classifier but no family stood. Null and empty texts have none.
    Repeated rows get equal results. Other columns aren't read.
    """
    model = model or train()
    found = found_licenses(F.coalesce(F.col("text"), F.lit("")), model)
    rows = docs.select("doc_id", found.alias("found"))
    sure = F.filter("found", lambda s: s["confirmed"])
    rows = rows.withColumn("sure", sure)
    best = F.get(F.filter("sure", lambda s: s["probability"] == F.array_max(F.transform("sure", lambda t: t["probability"]))), 0)
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size(F.array_distinct(F.transform("found", lambda s: s["paragraph"]))).cast("bigint").alias("n_candidates"),
        F.size("sure").cast("bigint").alias("n_licenses"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("sure", lambda s: s["family"]))), ",").alias("families"),
        F.when(F.col("best").isNotNull(), F.col("best.family")).when(F.size("found") > 0, F.lit(UNKNOWN)).otherwise(F.lit("none")).alias("best_family"),
        F.coalesce(F.col("best.probability"), F.lit(0.0)).alias("best_probability"),
        F.coalesce(F.col("best.similarity"), F.lit(0.0)).alias("best_similarity"),
        F.to_json("found").alias("found"),
    )


def query(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))

"""Licence scan: a trained classifier of paragraphs, confirmed by comparison with templates.

Logistic regression over sparse word n-grams gives each paragraph a chance for each licence family and for none of
them ("unknown"). Chances are calibrated by a temperature, fitted where a model meets templates that it wasn't trained
on. A prediction counts where it is likely enough and a template of the family has a passage that is close to one of the
paragraph. A paragraph is judged as a whole, in windows if it is long, and by the parts that "or", "and" and the like
join, so that each licence of several is found.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, flat_map_rows

# Statements by which texts name their licences, and opening passages of the licences, by family.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "This software is licensed under the MIT license.", "Distributed under the terms of the MIT License; see the file LICENSE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT", "MIT License", "License: MIT", "the MIT License", "Licensed under MIT.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0", "License: Apache-2.0", "the Apache License", "Apache License, Version 2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2 or later.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later", "GNU General Public License v3.0", "License: GPL-3.0", "GPL-3.0 license", "GNU GPL",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Released under the GNU LGPL version 3.", "SPDX-License-Identifier: LGPL-2.1-only", "GNU Lesser General Public License v2.1", "License: LGPL-3.0",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the GNU AGPL version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "License: AGPL-3.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause", "BSD 3-Clause License", "License: BSD", "the BSD License", "BSD 2-Clause License",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0 license.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License 2.0", "License: MPL-2.0"),
    "isc": ("Released under the ISC License.", "ISC License", "License: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "epl": ("This program is made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "License: EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    "zlib": ("Licensed under the zlib license.", "zlib License", "License: Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"),
    "cc": (
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Available under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense.", "SPDX-License-Identifier: Unlicense"),
    "proprietary": ("All rights reserved.", "Copyright 2020 Example Corporation. All rights reserved.", "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.", "This document is confidential and proprietary."),
}
# Paragraphs that share words with licences and are none.
OTHERS = (
    "The committee granted a license to the radio station last year.", "She renewed her driving license in the spring.", "Software is distributed to all offices of the company every month.", "The general public was invited to the opening of the new library.",
    "Version 2.0 of the program was released in May.", "You can copy the table and modify the values.", "All seats are reserved for members.", "Human rights were discussed at the meeting.", "The MIT campus lies on the river.", "Apache is a town in the county.",
    "This work is part of a larger series on history.", "Creative people share what they have in common.", "The terms of the agreement were published under pressure.", "Permission to enter the building was granted to any person with a pass.", "No part of the road was closed.",
    "The free concert takes place in a public park.", "See the file for more details.", "Please read the notice before use.", "The foundation supports free schools.", "Any later train is slower.", "Reserved tables are marked.", "The public domain of the king was large.", "Copyright law is taught in the second year.",
)
UNKNOWN = "unknown"
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SPLIT_AT = re.compile(r"\n")
PARTS_AT = re.compile(r"\b(?:or|and)\b|[;/|]", re.I)


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def pairs_of(words: list[str]) -> list[tuple[str, str]]:
    """Words two by two; one word alone with nothing."""
    return list(zip(words, words[1:])) or [(w, "") for w in words]


def grams(words: list[str]) -> set[str]:
    """Words, pairs and triples, each once; figures are alike."""
    w = ["0" if x[0].isdigit() else x for x in words]
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *(f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]))}


@dataclass
class Model:
    families: list[str]
    place: dict[str, int]
    w: np.ndarray  # n-grams x classes, the last row the offsets
    temperature: float
    templates: dict[str, list[set[tuple[str, str]]]]
    seeds: set[str]

    def chances(self, found: set[str]) -> np.ndarray:
        z = (self.w[[i for g in found if (i := self.place.get(g)) is not None]].sum(0) + self.w[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def closeness(self, family: str, words: list[str]) -> float:
        """Largest share of a template's pairs that the paragraph holds, or of a long paragraph's within a template."""
        pairs = set(pairs_of(words))
        best = 0.0
        for own in self.templates[family]:
            shared = len(pairs & own)
            best = max(best, shared / len(own), shared / len(pairs) if len(pairs) >= 6 else 0.0)
        return best


def labelled_rows(copies: int = 12, seed: int = 11) -> list[tuple[str, str, int]]:
    """(family, paragraph, number of its template): templates and other paragraphs, with surroundings, figures and gaps varied at random."""
    rng = random.Random(seed)
    filler = [w for t in OTHERS for w in t.split()] + ["lorem", "ipsum", "dolor", "und", "der", "les", "que", "para", "von", "con", "thing", "data", "by", "in", "1998", "2024"]
    rows = []
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for number, text in enumerate(texts):
            for _ in range(copies):
                words = text.split()
                if len(words) > 12 and rng.random() < 0.4:
                    start = rng.randrange(len(words) - 8)
                    words = words[start : start + rng.randint(8, len(words))]
                elif len(words) > 4 and rng.random() < 0.2:
                    del words[rng.randrange(len(words))]
                before, after = ([rng.choice(filler) for _ in range(rng.choice([0, 0, 0, 2, 8]))] for _ in range(2))
                rows.append((family, " ".join(before + words + after), number))
    for i in range(40 * copies):
        rows.append((UNKNOWN, " ".join(rng.choice(filler) for _ in range(rng.randint(1, 25))), i))
    return rows


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def regression(x: np.ndarray, target: np.ndarray, rounds: int, decay: float) -> np.ndarray:
    """Weights of softmax regression with squared decay, by accelerated full-batch steps."""
    w = np.zeros((x.shape[1], target.shape[1]), np.float32)
    v, step = w.copy(), 4.0 / float(np.mean((x**2).sum(1)))
    for t in range(rounds):
        new = v - step * (x.T @ (softmax(x @ v) - target) / len(x) + decay * v)
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def train(rows: list[tuple[str, str, int]] | None = None, rounds: int = 300, decay: float = 2e-3) -> Model:
    """Softmax regression over all rows; its temperature is that at which a model without every fourth template fits those best."""
    rows = labelled_rows() if rows is None else rows
    families = [*sorted({f for f, _, _ in rows} - {UNKNOWN}), UNKNOWN]
    sets = [grams(tokens(t)) for _, t, _ in rows]
    y = np.array([families.index(f) for f, _, _ in rows])
    held = np.array([n % 4 == 3 for _, _, n in rows])
    seen: dict[str, int] = {}
    for s in sets:
        for g in s:
            seen[g] = seen.get(g, 0) + 1
    place = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 4))}
    x = np.zeros((len(rows), len(place) + 1), np.float32)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, [place[g] for g in s if g in place]] = 1
    target = np.eye(len(families), dtype=np.float32)[y]
    z, yh = x[held] @ regression(x[~held], target[~held], rounds, decay), y[held]
    losses = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(yh)), yh], 1e-12)).mean() for t in np.geomspace(0.2, 3, 40)}
    templates = {f: [set(pairs_of(tokens(t))) for t in texts] for f, texts in TEMPLATES.items()}
    seeds = {w for texts in TEMPLATES.values() for t in texts for w in tokens(t)}
    return Model(families, place, regression(x, target, rounds, decay), float(min(losses, key=losses.get)), templates, seeds)


def paragraphs(text: str | None) -> list[str]:
    """Lines of the whole text."""
    return SPLIT_AT.split(text) if text else []


def judge(model: Model, paragraph: str, least_chance: float, least_close: float, size: int = 60) -> list[tuple[str, float, float]]:
    """(family, chance, closeness) of each licence that a paragraph states, by family; the likeliest statement of each.

    Windows of ``size`` words, half of them new each time, and the parts of the paragraph that are joined by "or", "and",
    a slash, a bar or a semicolon.
    """
    words = tokens(paragraph)
    if len(model.seeds.intersection(words)) < 2:  # a template shares two neighbouring words at least with what states it
        return []
    found: dict[str, tuple[float, float]] = {}
    parts = [words[i : i + size] for i in range(0, max(1, len(words) - size // 2), size // 2)]
    pieces = PARTS_AT.split(paragraph)
    if len(pieces) > 1:
        parts += [w[i : i + size] for w in map(tokens, pieces) for i in range(0, max(1, len(w) - size // 2), size // 2)]
    for part in parts:
        if len(model.seeds.intersection(part)) < 2:
            continue
        p = model.chances(grams(part))
        i = int(np.argmax(p[:-1]))
        family = model.families[i]
        if p[i] >= least_chance and p[i] > p[-1] and (close := model.closeness(family, part)) >= least_close:
            found[family] = max(found.get(family, (0.0, 0.0)), (float(p[i]), close))
    return [(family, *scores) for family, scores in sorted(found.items())]


def scan(docs: DataFrame, least_chance: float = 0.5, least_close: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, chance, closeness) for each licence that a paragraph (line, from 0) states.

    Whole texts, whatever the length of their lines; families of equal chance go by name. Null, empty and wordless texts state none. Null ids and repeated rows give rows of their own; other columns are
    not read; an empty table gives an empty result.
    """
    model = train()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def one(row):
        out = []
        for i, paragraph in enumerate(paragraphs(row[1])):
            if paragraph.strip(SEPARATORS):
                out += [(row[0], i, *found) for found in judge(model, paragraph, least_chance, least_close)]
        return out

    return flat_map_rows(rows, lambda: one, f"doc_id {kind}, paragraph long, family string, chance double, closeness double")

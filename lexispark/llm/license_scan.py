"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

Paragraphs are the lines of a text, and lines without an empty one between them joined (licences are often wrapped); if
such lines hold most of a template, also the fewest of them that do. A multinomial logistic regression over sparse word
n-grams (one to three words) gives each paragraph a probability for every licence family, for ``unknown`` (a licence, but
none of these) and for ``none``. It learns from standard notices and pieces of them, from short references made by rule
(phrases times names of the families), from ordinary sentences with words of licences, and from a bounded sample of the
corpus's own paragraphs; its probabilities are calibrated by a temperature on held-out examples. A family counts only
if the paragraph also holds most of the word pairs of one of the family's notices, or all pairs of one of its names;
else a likely licence is ``unknown``.

A joined paragraph is named by its first line. It counts if none of its lines has its family, and its lines with words of
that family's templates are no longer ``unknown``; an ``unknown`` one counts if none of its lines is a licence.

Defined results: a null or empty text has no paragraphs and no licence; a paragraph without a known n-gram is ``none``;
repeated rows get equal results; rows without an id are scanned like others; texts are read whole, very long ones too; an
empty table gives an empty result and trains without corpus paragraphs; of families that hold equally much of a
template the likeliest counts; other columns, whatever their names, pass unread.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.runtime import bounded_batches

# The notices that the licences ask for or consist of.
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",),
    "CC-BY-SA-4.0": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",),
    "CC-BY-NC-4.0": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",),
    "CC0-1.0": (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        "this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
}
# The names of the families; "*" stands for both spellings of the word licence.
NAMES = {
    "MIT": ("MIT *", "Expat *"), "Apache-2.0": ("Apache *, Version 2.0", "Apache * 2.0", "Apache 2.0 *", "Apache * v2.0"),
    "GPL-3.0": ("GNU General Public *, version 3", "GNU General Public * v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPLv3 *"),
    "GPL-2.0": ("GNU General Public *, version 2", "GNU General Public * v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPLv2 *"),
    "LGPL": ("GNU Lesser General Public *", "GNU Library General Public *", "GNU LGPL", "LGPL *"), "AGPL-3.0": ("GNU Affero General Public *", "GNU AGPL", "AGPL version 3"),
    "BSD-3-Clause": ("BSD 3-Clause *", "3-Clause BSD *", "New BSD *", "Modified BSD *"), "MPL-2.0": ("Mozilla Public *", "MPL 2.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0", "CC BY 4.0"), "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"), "CC0-1.0": ("CC0 1.0", "Creative Commons Zero", "CC0 *"), "ISC": ("ISC *",),
    "Unlicense": ("the Unlicense",), "Zlib": ("zlib *",), "BSL-1.0": ("Boost Software *",), "EPL-2.0": ("Eclipse Public *",),
}
# How texts refer to a licence by its name, and to one without a known name.
PHRASES = (
    "Licensed under {}", "Released under the {}", "Distributed under the terms of the {}.", "This project is licensed under the {} - see the LICENSE file for details", "Code in this folder is available under the {}.",
    "This document may be used under {}", "covered by the {}", "published under {}, see below", "The text is made available under the terms of {}.", "You may use it under the {}", "Use is permitted under {}.", "License: {}", "Dedicated to the public domain under {}.", "{}",
)
UNKNOWN_PHRASES = (
    "Licensed under the terms of the {} license.", "This file is distributed under the {} license agreement.", "Copyright (c) {} and others. All rights reserved.", "All rights reserved by {}.", "Released under the {} Community License, version 1.0.",
    "Use of this software is governed by the {} customer agreement and its license terms.", "Distributed under the {} Public License.", "No part of this {} publication may be reproduced without written permission. All rights reserved.",
    "© {} All rights reserved", "SPDX-License-Identifier: LicenseRef-{}", "The {} license applies to all files of this package.",
)
HOLDERS = ("project", "vendor", "Example", "Sample", "Northwind", "the authors", "2019", "Acme Ltd", "publisher", "enterprise", "")
# Ordinary sentences with words of licences.
ORDINARY = (
    "He lost his driving license in the city.", "She got a fishing licence for the summer.", "The restaurant needs a license to serve wine.", "They were released under pressure from the public.", "The film was released in May under a new title.",
    "Permission to enter the building was granted by the guard.", "Mozilla and Apache were mentioned in a paper on copyright.", "A lecture on copyright law is held at MIT every spring.", "The general public was asked to leave the square.",
    "The apache helicopter landed near the village.", "Creative people met in the commons room.", "The software was distributed on floppy disks in those days.", "Version 2.0 of the game has better sound.", "Free software is often discussed at the club.",
    "All seats in the first row are reserved.", "The rights of the workers were defended in court.", "Public transport is free of charge on Sundays.", "Terms like these are hard to translate.", "The driver showed the police a licence and a permit.",
    "The dog license must be renewed every year.", "You may use the garden when the weather is good.", "The patent was granted to two engineers from Boston.", "Her attribution of the painting to Rembrandt is disputed.", "The bridge is open to the public, without restriction.",
    "The bookshop has a notice in the window: closed for repairs.", "Students at MIT built a small robot.", "The clause in the contract was hard to read.", "A gnu and her calf crossed the river.", "The boost in sales came from the eclipse tours.", "Please see the file on the table for the details.",
)


def _spelled(name: str) -> tuple[str, ...]:
    return (name.replace("*", "License"), name.replace("*", "Licence")) if "*" in name else (name,)


#: What a paragraph must hold to be of a family: its notices for the most part, or one of its names whole.
TEMPLATES = {f: (*NOTICES[f], *(s for n in NAMES[f] for s in _spelled(n)), f"SPDX-License-Identifier: {f}") for f in NOTICES}
NONE, UNKNOWN = "none", "unknown"
#: Bounds of the corpus sample that gives the class ``none``: documents, and paragraphs of all of them.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS = 600, 1500
#: n-grams that the model knows at most: the most frequent ones, those of licences first.
MOST_NGRAMS = 8000
#: Least calibrated probability of a licence; least share of a notice's word pairs in the paragraph, and from how many
#: pairs on a template is a notice (a shorter one, a name, must be there whole).
LIKELY, CONFIRM, NOTICE_PAIRS = 0.5, 0.6, 10
#: More than the difference between the two ways to sum a paragraph's weights, and words whose weights are summed at once.
ROUNDING, WORDS_AT_ONCE = 1e-3, 100_000

_WORD = re.compile(r"[^\W_]+(?:[.-][0-9]+)*")


def ngrams(paragraph: str) -> set[str]:
    w = _WORD.findall(paragraph.lower())
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:])), *(f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]))}


def pairs(paragraph: str) -> set[tuple[str, str]]:
    w = _WORD.findall(paragraph.lower())
    return set(zip(w, w[1:]))


def needed(template: set) -> float:
    """How many of a template's pairs a paragraph must hold."""
    return CONFIRM * len(template) if len(template) >= NOTICE_PAIRS else len(template)


@dataclass
class LicenseModel:
    classes: list[str]
    index: dict[str, int]
    weight: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float

    def __post_init__(self):
        """The n-grams as numbers: those of their words, 0 for an unknown one, in sorted arrays for each length."""
        self.pairs = {f: [pairs(t) for t in texts] for f, texts in TEMPLATES.items()}
        templates = [x for texts in self.pairs.values() for x in texts]
        self.number = {w: i for i, w in enumerate(sorted({w for g in [*self.index, *(w for x in templates for p in x for w in p)] for w in g.split()}), 1)}
        self.base = len(self.number) + 1
        self.known = []
        for size in (1, 2, 3):
            found = sorted((self._key([self.number[w] for w in g.split()]), i) for g, i in self.index.items() if g.count(" ") == size - 1)
            self.known.append((np.array([k for k, _ in found], np.int64), np.array([i for _, i in found], np.int64)))

        held = sorted((self._key([self.number[w] for w in x]), i) for i, t in enumerate(templates) for x in t)
        self.pair = np.unique(np.array([k for k, _ in held], np.int64))
        self.share = np.zeros((len(self.pair), len(templates)))  # what a pair is of what each template needs
        for k, i in held:
            self.share[np.searchsorted(self.pair, k), i] = 1.0 / needed(templates[i])

    def _key(self, numbers):
        key = numbers[0]
        for n in numbers[1:]:
            key = key * self.base + n
        return key

    def numbers(self, paragraph: str) -> list[int]:
        get = self.number.get
        return [get(w, 0) for w in _WORD.findall(paragraph.lower())]

    def likely(self, number: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The calibrated probability of a licence of each paragraph, given all their words' numbers and their counts
        of words; 0 without a known n-gram."""
        row, base, parts = np.repeat(np.arange(len(size)), size), len(self.index), []
        for n, (keys, at) in enumerate(self.known):
            m = len(number) - n
            if m <= 0 or not len(keys):
                continue
            on = np.flatnonzero((row[:m] == row[n:]) & np.logical_and.reduce([number[i : i + m] > 0 for i in range(n + 1)]))
            key = self._key([number[on + i] for i in range(n + 1)])
            pos = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[pos] == key
            parts.append(row[on[hit]] * base + at[pos[hit]])
        out = np.zeros(len(size))
        if parts and len(here := np.unique(np.concatenate(parts))):
            rows, start, count = np.unique(here // base, return_index=True, return_counts=True)
            z = (self.bias + np.add.reduceat(self.weight[here % base], start) / np.sqrt(count)[:, None]) / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[rows] = 1.0 - p[:, self.classes.index(NONE)] / p.sum(axis=1)
        return out

    def holds_template(self, number: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each paragraph, given as ``likely`` takes it, holds what a template needs."""
        out, row = np.zeros(len(size), bool), np.repeat(np.arange(len(size)), size)
        if len(number) > 1:
            key = self._key([number[:-1], number[1:]])
            pos = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = (self.pair[pos] == key) & (row[:-1] == row[1:])
            if hit.any():
                here = np.unique(row[:-1][hit] * len(self.pair) + pos[hit])
                rows, start = np.unique(here // len(self.pair), return_index=True)
                out[rows] = np.add.reduceat(self.share[here % len(self.pair)], start).max(axis=1) >= 1 - ROUNDING
        return out

    def probabilities(self, grams: set[str]) -> np.ndarray:
        at = [self.index[g] for g in grams if g in self.index]
        z = (self.bias + self.weight[at].sum(axis=0) / max(1.0, len(at) ** 0.5)) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family or unknown, probability of a licence, template's share), or None for no licence."""
        grams = ngrams(paragraph)
        if self.index.keys().isdisjoint(grams):
            return None
        p = self.probabilities(grams)
        likely = 1.0 - float(p[self.classes.index(NONE)])
        if likely < LIKELY:
            return None
        here = pairs(paragraph)
        # Of each family the template that is held best; the longest one that is held whole tells families apart whose
        # names contain each other.
        held = {f: max(((len(x & here) / len(x), len(x)) if len(x & here) >= needed(x) else (0.0, 0)) for x in texts) for f, texts in self.pairs.items()}
        family = max(TEMPLATES, key=lambda f: (held[f], p[self.classes.index(f)]))
        share = held[family][0]
        return (family if share else UNKNOWN), likely, share


def _held(paragraphs: list[set], template: set, start: int, seen: int) -> tuple[int, int] | None:
    """First and last of the next lines from ``start`` on that hold what a template needs; ``seen``: the last
    of the ones before, which these go beyond. As few lines as do, then those beside them that hold more."""
    count: dict[tuple, int] = {}
    need, first = needed(template), start
    for last in range(start, len(paragraphs)):
        for x in paragraphs[last] & template:
            count[x] = count.get(x, 0) + 1
        if last <= seen or len(count) < need:
            continue
        while len(count) - sum(count[x] == 1 for x in paragraphs[first] & template) >= need:
            for x in paragraphs[first] & template:
                count[x] -= 1
                if not count[x]:
                    del count[x]
            first += 1
        while last + 1 < len(paragraphs) and (paragraphs[last + 1] & template) - count.keys():
            last += 1
            count |= dict.fromkeys(paragraphs[last] & template, 1)
        while first > start and (paragraphs[first - 1] & template) - count.keys():
            first -= 1
            count |= dict.fromkeys(paragraphs[first] & template, 1)
        return first, last
    return None


def wrapped(model: LicenseModel, lines: list[str], likely: bool, confirmed: bool) -> list[tuple[int, int, tuple]]:
    """(first, last, result) of the licences of joined lines: of all of them, and of the fewest that hold a template.

    ``likely`` and ``confirmed``: whether all of them may be a licence, and may hold a template.
    """
    out = []
    if likely and (hit := model.classify(" ".join(lines))):
        out.append((0, len(lines) - 1, hit))
    if confirmed:
        here = [pairs(x) for x in lines]
        word = [_WORD.findall(x.lower()) for x in lines]
        back = None
        for i, w in enumerate(word):  # the pair of a line's last word and the next line's first
            if w and back:
                here[i].add((back, w[0]))
            back = w[-1] if w else back
        for texts in model.pairs.values():
            for template in texts:
                start, seen = 0, -1
                while at := _held(here, template, start, seen):
                    first, last = at
                    hit = model.classify(" ".join(lines[first : last + 1])) if last > first else None
                    if hit and hit[0] != UNKNOWN:
                        out.append((first, last, hit))
                    start, seen = (last + 1, last) if last == first or hit else (first + 1, last)
    return out


def found_in(model: LicenseModel, lines: list[str], likely: np.ndarray, runs: list[tuple[int, int, bool, bool]]) -> list[tuple]:
    """(line, family, probability, share) of a text's licence paragraphs; ``runs``: first line, the one after the last,
    and what ``wrapped`` takes."""
    alone = {int(i): hit for i in np.flatnonzero(likely >= LIKELY - ROUNDING) if (hit := model.classify(lines[i]))}
    joined: dict[tuple[int, str], tuple] = {}
    for a, b, may, confirmed in runs:
        taken = []
        for first, last, hit in sorted(wrapped(model, lines[a:b], may, confirmed), key=lambda x: (x[2][0] == UNKNOWN, x[1] - x[0], x[0])):
            first, last, family = a + first, a + last, hit[0]
            inside = [alone[i] for i in range(first, last + 1) if i in alone]
            if family == UNKNOWN and (inside or taken) or any(x[0] == family for x in inside) or any(f == family and first <= j and i <= last for i, j, f in taken):
                continue
            taken.append((first, last, family))
            joined[first, family] = (first, *hit)
            if family != UNKNOWN:
                own = set().union(*model.pairs[family])
                for i in range(first, last + 1):
                    if i in alone and alone[i][0] == UNKNOWN and pairs(lines[i]) & own:
                        del alone[i]
    # An unknown line beside one of a family, without a full stop between them, is of the same sentence.
    family = {i: hit[0] for i, hit in alone.items() if hit[0] != UNKNOWN}
    for i in [i for i, hit in alone.items() if hit[0] == UNKNOWN]:
        for a, b in ((i - 1, i), (i, i + 1)):
            other = family.get(a + b - i)
            if other and not lines[a].rstrip().endswith((".", "!", "?", ":", ";")) and (hit := model.classify(f"{lines[a]} {lines[b]}")) and hit[0] == other:
                del alone[i]
                break
    return sorted([*((i, *hit) for i, hit in alone.items()), *joined.values()])


def perturbed(text: str, rng: random.Random, filler: list[str]) -> str:
    """A template with words dropped or strange ones put in, at its ends or inside."""
    w = [x for x in text.split() if rng.random() > 0.06]
    for _ in range(rng.choice((0, 0, 1, 2, 4))):
        w.insert(rng.randint(0, len(w)), rng.choice(filler))
    return " ".join(w)


def examples(rng: random.Random, filler: list[str], copies: int) -> list[tuple[str, str]]:
    """(paragraph, class) made from the fixed values: notices and pieces of them, references by rule, ordinary sentences."""
    rows = []
    for family, texts in NOTICES.items():
        for text in texts:
            w = text.split()
            for _ in range(copies):
                n = rng.randint(7, 20)
                at = rng.randint(0, max(0, len(w) - n))
                rows += [(perturbed(text, rng, filler), family), (" ".join(w[at : at + n]), family)]
        names = [s for n in NAMES[family] for s in _spelled(n)]
        rows += [(perturbed(rng.choice(PHRASES).format(rng.choice(names)), rng, filler), family) for _ in range(2 * copies)]
        rows += [(f"SPDX-License-Identifier: {family}", family)] * 3
    rows += [(perturbed(rng.choice(UNKNOWN_PHRASES).format(rng.choice(HOLDERS)), rng, filler), UNKNOWN) for _ in range(8 * copies)]
    loose = sorted({w for texts in TEMPLATES.values() for x in texts for w in x.split()})  # words of licences that say nothing alone
    rows += [(w, NONE) for w in loose] + [(" ".join(rng.choices(loose, k=rng.randint(1, 4))), NONE) for _ in range(len(loose))]
    rows += [(perturbed(x, rng, filler), NONE) for x in ORDINARY for _ in range(max(1, copies // 4))]
    return rows


def fit(background: list[str], seed: int = 23, copies: int = 20) -> LicenseModel:
    """Train on made examples and background paragraphs; a fifth of the examples calibrates."""
    rng = random.Random(seed)
    filler = sorted({w for b in background[:200] for w in b.split()})[:2000] or ["lorem", "2024", "copyright", "authors"]
    classes = [*TEMPLATES, UNKNOWN, NONE]
    rows = examples(rng, filler, copies)
    rows += [(b, NONE) for b in background] + [(" ".join(rng.choices(filler, k=rng.choice((1, 1, 2, 3, 8, 30)))), NONE) for _ in range(600)]
    rng.shuffle(rows)
    grams = [ngrams(t) for t, _ in rows]
    y = np.array([classes.index(c) for _, c in rows])
    licence = y != classes.index(NONE)
    seen: dict[str, int] = {}
    for g in grams:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    of_licence = {v for g, lic in zip(grams, licence) if lic for v in g}
    keep = sorted((x for x, n in seen.items() if n >= 3), key=lambda v: (v not in of_licence, -seen[v], v))[:MOST_NGRAMS]
    index = {x: i for i, x in enumerate(keep)}
    x = np.zeros((len(rows), len(keep)), dtype=np.float32)  # some thousand examples
    for i, g in enumerate(grams):
        at = [index[w] for w in g if w in index]
        x[i, at] = 1.0 / max(1.0, len(at) ** 0.5)
    held = np.arange(len(rows)) % 5 == 4
    w, b = np.zeros((len(keep), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    onehot = np.eye(len(classes), dtype=np.float32)[y]
    g2, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(100):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - onehot[~held]
        dw, db = x[~held].T @ p / len(p) + 1e-5 * w, p.mean(axis=0)
        g2 += dw * dw
        gb += db * db
        w -= 0.3 * dw / np.sqrt(g2)
        b -= 0.3 * db / np.sqrt(gb)
    z = x[held] @ w + b

    def loss(t: float) -> float:
        s = z / t
        return float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), y[held]]).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return LicenseModel(classes, index, w, b, temperature)


def train(docs: DataFrame) -> LicenseModel:
    """Fit with at most ``SAMPLE_PARAGRAPHS`` paragraphs of the ``SAMPLE_DOCS`` documents with the lowest hashes of doc_id as the class ``none``.

    Paragraphs that hold most of a template are left out of that class.
    """
    ids = F.broadcast(docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    lines = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("p")).where(F.trim("p") != "")
    found = sorted(r["p"] for r in lines.distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLE_PARAGRAPHS).collect())
    known = [pairs(t) for texts in TEMPLATES.values() for t in texts] + [pairs("all rights reserved"), pairs("the license agreement"), pairs("public license")]
    return fit([x for x in found if not any(len(k & p) >= 0.3 * len(k) for p in [pairs(x)] for k in known)])


def _runs(lines: list[str]) -> list[tuple[int, int]]:
    """First line, and the one after the last, of each two or more lines without an empty one between them."""
    full = np.array([False, *(bool(x.strip()) for x in lines), False])
    edge = np.flatnonzero(full[1:] != full[:-1])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a > 1]


def _scored(model: LicenseModel, texts: list[str | None]):
    """(lines, their probabilities of a licence, runs as ``found_in`` takes them) of each text."""
    waiting, words, ends = [], [], [0]
    for k, text in enumerate(texts, 1):
        lines = text.split("\n") if text else []
        waiting.append((lines, _runs(lines), len(ends) - 1))
        for line in lines:
            words += model.numbers(line)
            ends.append(len(words))
        if len(words) >= WORDS_AT_ONCE or k == len(texts):
            number, end = np.array(words, np.int64), np.array(ends, np.int64)
            p = model.likely(number, np.diff(end))
            first, after = (end[np.array([at + r[i] for _, runs, at in waiting for r in runs], np.int64)] for i in (0, 1))
            size = after - first
            number = number[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
            joined = iter(zip(model.likely(number, size) >= LIKELY - ROUNDING, model.holds_template(number, size)))
            for lines, runs, at in waiting:
                yield lines, p[at : at + len(lines)], [(a, b, *map(bool, next(joined))) for a, b in runs]
            waiting, words, ends = [], [], [0]


FOUND = "array<struct<paragraph:int,family:string,probability:double,share:double>>"


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, n_paragraphs and the licence paragraphs of every whole text; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scanned(batches):
        m = shared.value
        for batch in batches:
            counts, found, ends = [], [], [0]
            for lines, likely, runs in _scored(m, batch.column("text").to_pylist()):
                counts.append(sum(1 for x in lines if x.strip()))
                found += found_in(m, lines, likely, runs)
                ends.append(len(found))
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64())
            fields = [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["paragraph", "family", "probability", "share"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists], ["doc_id", "n_paragraphs", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, n_paragraphs long, found {FOUND}")


def licences(docs: DataFrame) -> DataFrame:
    """Every document's licence families, with the paragraphs that name them."""
    found = scan(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    where = F.transform("found", lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"]))
    return found.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.array_join(families, ",").alias("families"),
        F.array_join(where, ",").alias("paragraphs"), F.coalesce(F.array_max(F.transform("found", lambda x: x["probability"])), F.lit(0.0)).alias("score"),
    )

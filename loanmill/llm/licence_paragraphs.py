"""Licence scans by a trained paragraph classifier.

Sparse word n-grams (one to three words) of a paragraph go into a multinomial logistic
regression over licence families and "unknown". It is trained here, on the templates below,
varied, and on a bounded sample of the corpus' own paragraphs as the unknown class, and its
probabilities are calibrated on the half that was not trained on. A predicted family counts
only if the paragraph holds enough of one of the family's templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanmill.llm.base import ship

#: Paragraphs of the corpus the unknown class is learnt from, at most about so many.
MAX_UNKNOWN = 6000
UNKNOWN = "unknown"

# Customary notices of licence families.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "CC BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "has waived all copyright and related rights under CC0 1.0 Universal",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ],
}

# Titles and SPDX lines. A title counts as the whole of a line, SPDX anywhere.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "Apache": ["Apache License", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Apache-2.0"],
    "GPL": ["GNU General Public License", "The GNU General Public License", "GPL-3.0", "GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "LGPL-2.1", "LGPLv3"],
    "AGPL": ["GNU Affero General Public License", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause"],
    "MPL": ["Mozilla Public License", "Mozilla Public License Version 2.0", "MPL-2.0"],
    "CC BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal"],
    "ISC": ["ISC License", "The ISC License"],
}
_SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache", "GPL-3.0": "GPL", "LGPL-2.1": "LGPL", "AGPL-3.0": "AGPL",
    "BSD-3-Clause": "BSD", "MPL-2.0": "MPL", "CC-BY-4.0": "CC BY", "CC-BY-SA-4.0": "CC BY-SA",
    "CC-BY-NC-4.0": "CC BY-NC", "CC0-1.0": "CC0", "ISC": "ISC",
}
for _name, _family in _SPDX.items():
    TITLES[_family].append(f"SPDX-License-Identifier: {_name}")

# How families are called in running text.
NAMES = {
    "MIT": ["MIT"],
    "Apache": ["Apache License", "Apache 2.0", "Apache v2"],
    "GPL": ["GPL", "GPLv3", "GPL v3", "GNU GPL", "GNU General Public License"],
    "LGPL": ["LGPL", "LGPLv3", "LGPL v3", "GNU LGPL", "GNU Lesser General Public License"],
    "AGPL": ["AGPL", "AGPLv3", "AGPL v3", "GNU AGPL", "GNU Affero General Public License"],
    "BSD": ["BSD", "3-Clause BSD"],
    "MPL": ["MPL", "MPL 2.0", "Mozilla Public License"],
    "CC BY": ["CC BY 4.0", "CC Attribution License", "Creative Commons Attribution License"],
    "CC BY-SA": ["CC BY-SA", "CC Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike"],
    "CC BY-NC": ["CC BY-NC", "CC Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial"],
    "CC0": ["CC0"],
    "ISC": ["ISC"],
}
for _family, _names in NAMES.items():
    TITLES[_family] += [f"{_names[0]} licensed", *(f"{n} License" for n in _names if "License" not in n)]
# Wordings that grant a licence, wherever they stand in a paragraph.
WORDINGS = [
    "licensed under {}", "licensed under the {}", "released under the {}", "distributed under the {}",
    "available under {}", "available under the {}", "under the terms of the {}", "{} or later",
]
# What takes a grant back, before its verb; little stands between.
NEGATIONS = [
    "not", "never", "no longer", "isn't", "wasn't", "aren't", "not been", "never been", "cannot be",
    "not be", "not yet", "neither", "nor",
]
_VERBS = {"licensed", "released", "distributed", "available", "dedicated", "subject", "under"}
_NOT = {"not", "never", "cannot", "neither", "nor", "no longer", "isn t", "wasn t", "aren t"}
_BETWEEN = {"been", "be", "yet", "currently", "being"}
# The feature of a paragraph in which a grant is taken back; no word reads so.
_DENIED = "<denied>"

# Words that only mark a line as a comment; other marks hold no word.
_MARK = re.compile(r"^\s*(?:rem|dnl)\b", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
_EXPRESSION = re.compile(r"SPDX-License-Identifier:(.*)", re.IGNORECASE)
_OPERATOR = re.compile(r"\s(?:OR|AND)\s", re.IGNORECASE)


def tokens(paragraph: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", paragraph.lower()))


def _grams(words: list[str]) -> set[str]:
    return {
        " ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)
    }


@dataclass
class LicenceModel:
    families: list[str]
    place: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[list[set[int]]]
    titles: list[dict[tuple[str, ...], set[int]]]
    wordings: list[dict[tuple[str, ...], set[int]]]
    longest: int

    def __post_init__(self):
        # One n-gram of every title and wording, without which it isn't there.
        self.signs = {
            self.place[" ".join(t[-3:])] for ts in self.titles + self.wordings for t in ts
        }

    def _found(self, words: list[str]) -> list[int]:
        """Model n-grams in the paragraph; longer ones only where all their words are known."""
        place, out, run = self.place, set(), []
        for i, w in enumerate(words):
            if w not in place:
                run = []
                continue
            if w in _VERBS and _denied_at(words, i):
                out.add(place[_DENIED])
            run = [*run[-2:], w]
            out.add(place[w])
            for n in (2, 3):
                at = place.get(" ".join(run[-n:])) if len(run) >= n else None
                if at is not None:
                    out.add(at)
        return list(out)

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = (self.bias + self.weights[self._found(words)].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def similarity(self, family: int, words: list[str], held: set[int] | None = None) -> float:
        """Largest share of a template's n-grams that the paragraph holds; 1 for a title and
        for a wording that it holds.
        """
        held = set(self._found(words)) if held is None else held
        if any(grams <= held and _holds(words, t) for t, grams in self.wordings[family].items()):
            return 1.0
        if any(_titled(t, words) for t, grams in self.titles[family].items() if grams <= held):
            return 1.0
        return max(len(t & held) / len(t) for t in self.templates[family])

    def may_hold(self, words: list[str], alike: float) -> bool:
        """Whether a part of these words can be alike to a template or be a title."""
        held = set(self._found(words))
        return bool(held) and (
            any(len(t & held) >= alike * len(t) for ts in self.templates for t in ts)
            or not held.isdisjoint(self.signs)
            and any(grams <= held for ts in self.titles + self.wordings for grams in ts.values())
        )

    def classify_words(self, words: list[str], sure: float, alike: float) -> tuple[str, float, float] | None:
        p = self.probabilities(words)
        best = int(p.argmax())
        if best == len(self.families) or p[best] < sure:
            return None
        similarity = self.similarity(best, words)
        return (self.families[best], float(p[best]), similarity) if similarity >= alike else None

    def classify(self, paragraph: str, sure: float, alike: float) -> tuple[str, float, float] | None:
        return self.classify_words(tokens(paragraph), sure, alike)

    def licences(self, text: str, sure: float, alike: float) -> list[tuple]:
        """First line, family, probability and similarity of every licence in a text."""
        out, block = [], []
        for i, line in enumerate([*text.split("\n"), ""]):
            if several := _identifiers(line):
                hits = [self.classify(f"SPDX-License-Identifier: {x}", sure, alike) for x in several]
                out += [(i, *hit) for hit in dict.fromkeys(hits) if hit]
                continue
            words = tokens(_MARK.sub("", line))
            if words:
                block.append((i, words))
            elif block:
                out += self._in_block(block, sure, alike)
                block = []
        return sorted(out, key=lambda hit: hit[0])

    def _in_block(self, block: list[tuple[int, list[str]]], sure: float, alike: float) -> list[tuple]:
        """Single lines first, then runs of the lines left between, then the whole block."""
        joined = [w for _, words in block for w in words]
        if not self.may_hold(joined, alike):
            return []
        lines = [words for _, words in block]
        found = {}
        for at, words in enumerate(lines):
            if hit := self.classify_words(words, sure, alike):
                found[at] = hit
        singles, free = set(found), 0
        for end in range(len(lines)):
            if end in singles:
                free = end + 1
                continue
            words, inner = lines[end], 0
            # All lines of a notice but the first and last hold nothing else.
            for start in range(end - 1, free - 1, -1):
                words = lines[start] + words
                if hit := self.may_hold(words, alike) and self.classify_words(words, sure, alike):
                    while start > free:
                        more = self.classify_words(lines[start - 1] + words, sure, alike)
                        if not more or more[0] != hit[0] or more[2] <= hit[2]:
                            break
                        start, words, hit = start - 1, lines[start - 1] + words, more
                    last = end + 1
                    while last < len(lines) and last not in singles:
                        more = self.classify_words(words + lines[last], sure, alike)
                        if not more or more[0] != hit[0] or more[2] <= hit[2]:
                            break
                        words, hit, last = words + lines[last], more, last + 1
                    found[start], free = hit, last
                    break
                inner += len(lines[start])
                if inner > 2 * self.longest:
                    break
        if not found and (hit := self.classify_words(joined, sure, alike)):
            found[0] = hit
        return [(block[at][0], *found[at]) for at in sorted(found)]


def _titled(title: tuple[str, ...], words: list[str]) -> bool:
    return _holds(words, title) if title[0] == "spdx" else tuple(words) == title


def _holds(words: list[str], part: tuple[str, ...]) -> bool:
    n = len(part)
    return any(tuple(words[i : i + n]) == part for i in range(len(words) - n + 1))


def _identifiers(line: str) -> list[str]:
    """The identifiers of an SPDX expression that joins several."""
    expression = _EXPRESSION.search(line)
    parts = _OPERATOR.split(expression[1]) if expression else []
    return [p.strip(" ()\t\r*/") for p in parts] if len(parts) > 1 else []


def _denied_at(words: list[str], verb: int) -> bool:
    """Whether a negation stands before the verb, with no more than a few words between."""
    at = verb - 1
    while at >= 0 and words[at] in _BETWEEN:
        at -= 1
    return at >= 0 and (words[at] in _NOT or " ".join(words[max(0, at - 1) : at + 1]) in _NOT)


def _denied(words: list[str], negation: list[str]) -> list[str]:
    """A grant taken back: the negation before its first verb, or before all of it."""
    at = next((i for i, w in enumerate(words) if w in _VERBS), 0)
    return words[:at] + negation + words[at:]


def _fitted(x: np.ndarray, y: np.ndarray, classes: int, penalty: float, steps: int):
    """Multinomial logistic regression by accelerated gradient descent."""
    n, weight = len(y), np.zeros((x.shape[1] + 1, classes))
    x1, target = np.column_stack([x, np.ones(n)]), np.eye(classes)[y]
    rate = 4.0 / (np.square(x1).sum(1).mean() + 1)
    ahead, t = weight, 1.0
    for _ in range(steps):
        z = x1 @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        slope = x1.T @ (e / e.sum(1, keepdims=True) - target) / n + penalty * ahead
        new, t_new = ahead - rate * slope, (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - weight)
        weight, t = new, t_new
    return weight[:-1], weight[-1]


def train(docs: DataFrame, max_unknown: int = MAX_UNKNOWN, seed: int = 3) -> LicenceModel:
    """Trains on the varied templates and a hash sample of the paragraphs of all documents."""
    paragraphs = docs.select(F.explode(F.split("text", "\n")).alias("p")).where("length(p) > 0")
    share = min(1.0, max_unknown / max(1, paragraphs.count()))
    order = F.shiftrightunsigned(F.xxhash64("p", F.lit(seed)), 11) / F.lit(2.0**53)
    sample = [tokens(r.p) for r in paragraphs.where(order < share).distinct().orderBy("p").limit(2 * max_unknown).collect()]

    families = list(TEMPLATES)
    words = [[tokens(t) for t in TEMPLATES[f]] for f in families]
    titles = [[tokens(t) for t in TITLES[f]] for f in families]
    granted = [[tokens(w.format(n)) for n in NAMES[f] for w in WORDINGS] for f in families]
    negations = [tokens(n) for n in NEGATIONS]
    known = {g for ts in words + titles + granted for t in ts for g in _grams(t)}
    known.add(_DENIED)
    place = {g: i for i, g in enumerate(sorted(known))}
    templates = [[{place[g] for g in _grams(t)} for t in ts] for ts in words]
    of_titles = [{tuple(t): {place[g] for g in _grams(t)} for t in ts} for ts in titles]
    of_granted = [{tuple(t): {place[g] for g in _grams(t)} for t in ts} for ts in granted]
    model = LicenceModel(
        families, place, np.zeros((len(place), len(families) + 1)), np.zeros(len(families) + 1),
        1.0, templates, of_titles, of_granted, max(len(t) for ts in words for t in ts),
    )
    random = np.random.default_rng(seed)
    # Paragraphs that hold a template aren't unknown; pieces of templates in other words are.
    unknown = []
    for w in sample:
        held = set(model._found(w))
        if max(model.similarity(i, w, held) for i in range(len(families))) < 0.5:
            unknown.append(w)
    filler = unknown or [["some", "other", "words"]]

    def apart(most: int) -> list[str]:
        """Some other words, often after a negation, which says nothing of the licence there."""
        if random.random() < 0.3:
            return []
        line = filler[random.integers(len(filler))]
        at = random.integers(len(line)) if line else 0
        said = negations[random.integers(len(negations))] if random.random() < 0.5 else []
        return said + (line[at : at + random.integers(1, most)] or ["so"])

    rows, y = [], []
    for i, family in enumerate(words):
        for _ in range(150):
            base = family[random.integers(len(family))]
            kept = [w for w in base if random.random() > 0.06]
            around = filler[random.integers(len(filler))][: random.integers(0, 25)]
            around += apart(3)
            rows.append(around + kept if random.random() < 0.5 else kept + around)
            y.append(i)
        for _ in range(40):
            base = family[random.integers(len(family))]
            at = random.integers(max(1, len(base) - 2))
            rows.append(filler[random.integers(len(filler))] + base[at : at + random.integers(1, 4)])
            y.append(len(families))
        for title in titles[i]:
            rows += [title] * 30
            y += [i] * 30
        # Grants in running text, and the same taken back.
        for grant in granted[i]:
            for _ in range(4):
                rows.append(apart(12) + grant + apart(6))
                y.append(i)
                rows.append(apart(12) + _denied(grant, negations[random.integers(len(negations))]) + apart(6))
                y.append(len(families))
        for _ in range(40):
            base = family[random.integers(len(family))]
            if _VERBS & set(base):
                rows.append(_denied(base, negations[random.integers(len(negations))]))
                y.append(len(families))
    rows += unknown
    y = np.array(y + [len(families)] * len(unknown))
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, w in enumerate(rows):
        x[i, model._found(w)] = 1
    train_half = random.random(len(rows)) < 0.5
    model.weights, model.bias = _fitted(x[train_half], y[train_half], len(families) + 1, 1e-4, 400)
    z, known = x[~train_half] @ model.weights + model.bias, y[~train_half]

    def loss(t):
        s = z / t
        s -= s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), known]).mean()

    model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss)) if len(known) else 1.0
    return model


def scan(docs: DataFrame, model: LicenceModel, sure: float = 0.5, alike: float = 0.6) -> DataFrame:
    """`doc_id`, `paragraph` (its first line), `family`, `probability`, `similarity` per licence.

    Paragraphs are single lines, runs of lines and what stands between blank lines; lines of
    comment marks alone are blank. The lines of a run but its first and last hold nothing but
    the notice, so a run ends where these have twice as many words as the longest template. A
    paragraph that takes a grant back ("never released under ...") holds none. An SPDX expression gives a row for
    each family it joins. Null and empty texts hold none, nor does an empty table. Equal rows
    give equal findings, each for itself; of equally likely families the first counts.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *found) for found in model.licences(text or "", sure, alike)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "paragraph", "family", "probability", "similarity"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, paragraph int, family string, probability double, similarity double"
    )

"""Operator 6: license scans by a trained paragraph classifier.

Paragraphs end at blank lines; lines and rolling windows of words within a paragraph are scored, so that
wrapped and embedded notices are seen whole. A logistic regression for each licence family, siblings such as versions and
clauses being families of their own, over the word one- and two-grams of known notices is trained on these
in many wordings, alone and amid corpus words; against it stand corpus lines, sentences that only mention a name, and
the notices of the other families. One more class, "unknown", learns notices of some other licences.
Probabilities are calibrated on wordings that training doesn't hold, and a family counts from a bar
of its own on (0.99 at most) that no corpus line and no notice of the licences held out as a whole passes.

Only what the classifier finds is compared with templates: names and texts of the families found and their siblings
are laid over the words there, the best fitting first, and each takes its words. A family is
confirmed where one of its own templates fits by CONFIRM at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake.llm.shared import documents
from vistalake.llm.words import Words, chunks, runs, split_words, text_bytes

# Names and sentences of licences as they are commonly written.
GNU = {"gpl": ("GPL", "GNU General Public License"), "lgpl": ("LGPL", "GNU Lesser General Public License"), "agpl": ("AGPL", "GNU Affero General Public License")}
GNU_NAMES = ("{long}, version {v}", "{long} v{v}.0", "{long} {v}", "{short} v{v}", "{short}v{v}", "{short} version {v}", "{short}-{v}.0", "GNU {short} v{v}", "GNU {short} v{v} or later", "{short}-{v}.0-only", "{short}-{v}.0-or-later", "{short}v{v}+")
GNU_TEXT = "you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation, either version {v} of the License"
CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_NAMES = ("CC {short} 4.0", "CC-{short}-4.0", "Creative Commons {long} 4.0 International License", "Creative Commons {long} 4.0 International", "Creative Commons {long} License 4.0", "Creative Commons {long} 4.0")
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2.0", "Apache Software License, version 2", "Apache-2.0"],
    "apache-1.1": ["Apache License, Version 1.1", "Apache Software License 1.1", "Apache-1.1", "Apache 1.1 license"],
    "mit": ["MIT License", "MIT licence", "MIT License (MIT)", "Expat License"],
    "mit-0": ["MIT No Attribution License", "MIT-0", "MIT No Attribution"],
    "isc": ["ISC License", "ISC licence"],
    "bsd-2-clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "two-clause BSD license", "2-clause BSD license"],
    "bsd-3-clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "three-clause BSD license", "3-clause BSD license"],
    "bsd-3-clause-clear": ["BSD 3-Clause Clear License", "BSD-3-Clause-Clear", "Clear BSD License"],
    "bsd-4-clause": ["BSD 4-Clause License", "BSD-4-Clause", "Original BSD License", "four-clause BSD license"],
    "mpl-1.1": ["Mozilla Public License, v. 1.1", "Mozilla Public License Version 1.1", "MPL 1.1", "MPL-1.1"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPLv2"],
    "epl-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL 1.0", "EPL-1.0"],
    "epl-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 Public Domain Dedication"],
    "unlicense": ["Unlicense", "Unlicense public domain dedication"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "bsl-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
    "artistic-2.0": ["Artistic License 2.0", "Artistic-2.0"],
}
#: Names that tell something only after such words.
SHORT = {"mit": ["MIT"], "isc": ["ISC"], "zlib": ["zlib"]}
TEXTS = {
    "apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd-3-clause": ["Neither the name of the copyright holder", "Neither the name of the University", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-4-clause": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
}
for _kind, _v in (("gpl", "2"), ("gpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("agpl", "3")):
    _short, _long = GNU[_kind]
    _family = f"{_kind}-{_v if '.' in _v else _v + '.0'}"
    NAMES[_family] = [n.format(short=_short, long=_long, v=_v).replace("2.1.0", "2.1") for n in GNU_NAMES]
    TEXTS[_family] = [GNU_TEXT.format(long=_long, v=_v)]
for _kind, _long in CC.items():
    NAMES[f"cc-{_kind}-4.0"] = [n.format(short=_kind.upper(), long=_long) for n in CC_NAMES]
#: What a name stands in; the last is the name alone.
FRAMES = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.", "This file is available under {}", "License: {}", "under the {}",
          "licensed under {}", "may be used under the {} license", "SPDX-License-Identifier: {}", "{}")
PAIRED = ("Dual licensed under {} or {}", "{} or {}", "licensed under the {} and the {}", "SPDX-License-Identifier: {} OR {}")
BEFORE_SHORT = ("under", "under the", "license", "identifier", "licensed", "or")
#: Licences that are no family here: those of the first list teach "unknown", those of the second are seen by the calibration only.
UNKNOWN = ["Artistic License 1.0", "SIL Open Font License, Version 1.1", "Common Development and Distribution License 1.0", "Microsoft Public License", "Academic Free License 3.0", "CeCILL Free Software License", "Python Software Foundation License"]
HELD_OUT = ["European Union Public Licence 1.2", "Open Data Commons Attribution License", "University of Illinois/NCSA Open Source License", "Do What The Fuck You Want To Public License", "PostgreSQL License", "OpenSSL License", "Server Side Public License 1"]
SHARED = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice",
          "You should have received a copy of the license along with this program"]
#: Sentences with a name, or with the words of notices, that are none.
MENTIONS = ["the MIT license plate", "a license plate of MIT", "she studied at MIT in Boston", "the MIT laboratory", "an Apache helicopter", "the Apache web server version 2", "Apache people of the region", "a licence to fish", "plain text about a licence to fish", "his driver license",
            "the license of the restaurant was renewed", "version 2 of the plan", "the general public may enter", "public license plates", "a permission slip", "the university press", "Mozilla browser version 2", "an Eclipse of the sun", "creative work in common", "the boost of the software market",
            "a zlib stream", "BSD systems such as these", "the GNU project", "under the old oak", "under the bridge", "released under pressure", "available under the counter", "licensed doctors only", "distributed under the table", "the terms of the peace", "see the license for details"]
UNKNOWN_CLASS = "unknown"
FAMILIES = list(NAMES)
CLASSES = [*FAMILIES, UNKNOWN_CLASS]
#: Families whose text is part of another's: within so many lines after a notice of that one they are no notice of their own.
INSIDE, INSIDE_LINES = {"bsd-3-clause": "bsd-4-clause"}, 12
#: Windows of so many words, every quarter of them; words around a find that templates are laid over; lines sampled from the corpus; least share of a template's word pairs.
WINDOWS, AROUND, SAMPLE_LINES, CONFIRM = (8, 16, 32, 64), 24, 4000, 0.6
#: Characters of a sampled line; those of a word that is set beside a notice in training.
LINE_CHARACTERS, WORD_CHARACTERS = 2000, 40
#: Weight of a mention in training; the bar of "unknown"; words within which a gram counts once, so that a phrase repeated over and over weighs no more than once.
MENTION_WEIGHT, UNKNOWN_BAR, APART = 25.0, 0.5, 16


def _group(family: str) -> str:
    return "gnu" if family.split("-")[0] in GNU else family.split("-")[0].replace("cc0", "cc")


SIBLINGS = {f: [g for g in FAMILIES if _group(g) == _group(f)] for f in FAMILIES}


def read(texts: pa.Array) -> Words:
    return split_words(texts, lower=True, letters=True)


def all_pairs(words: Words) -> np.ndarray:
    """The hash of each word and the next one of its text; 0 at a text's end."""
    out = np.zeros(len(words.hashes), np.uint64)
    at, hashes = runs(words, 2)
    out[at] = hashes
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def templates_of(family: str) -> list[str]:
    return [*NAMES[family], *TEXTS.get(family, []), *[f"{w} {s}" for s in SHORT.get(family, []) for w in BEFORE_SHORT]]


@dataclass
class Model:
    keys: np.ndarray  #: hashes of the known one- and two-grams, sorted
    weights: np.ndarray  #: class x (gram, ..., 0 for unknown grams)
    bias: np.ndarray
    slope: np.ndarray  #: calibration of each class: probability = sigmoid(slope * score + shift)
    shift: np.ndarray
    bars: np.ndarray  #: least probability that counts, by class

    def grams(self, hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Numbers of known grams; an unknown gram, and one that the text had less than APART words before, is none."""
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = np.flatnonzero(self.keys[place] == hashes)
        order = at[np.argsort(place[at], kind="stable")]
        again = (place[order][1:] == place[order][:-1]) & (text_of[order][1:] == text_of[order][:-1]) & (np.diff(order) < APART)
        out = np.full(len(hashes), len(self.keys))
        new = order[np.append(True, ~again)] if len(order) else order
        out[new] = place[new]
        return out

    def scores(self, words: Words, pairs: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each class the calibrated log odds of all stretches (words low to high); a stretch's grams weigh 1/sqrt of their number."""
        one, two = self.grams(words.hashes, words.text_of), self.grams(pairs, words.text_of)
        last = np.maximum(high - 1, low)
        scale = np.where(high > low, 1 / np.sqrt(np.maximum(high - low + last - low, 1)), 0.0)
        for c, w in enumerate(self.weights):
            ones, twos = np.concatenate([[0.0], np.cumsum(w[one])]), np.concatenate([[0.0], np.cumsum(w[two])])
            yield c, ((ones[high] - ones[low] + twos[last] - twos[low]) * scale + self.bias[c]) * self.slope[c] + self.shift[c]

    def of_texts(self, texts: list[str]) -> np.ndarray:
        words = read(pa.array(texts, pa.string()))
        return np.stack([s for _, s in self.scores(words, all_pairs(words), words.first[:-1], words.first[1:])], axis=1)


def _plain(lines: list[str]) -> list[list[str]]:
    """Words of lines that can stand beside a notice."""
    return [w for w in ([x for x in line.split() if len(x) <= WORD_CHARACTERS] for line in lines) if w]


def _amid(rng: np.random.Generator, text: str, plain: list[list[str]], size: int) -> str:
    """The text with corpus words before and after it, `size` words in all."""
    words = text.split()
    more = max(0, size - len(words))
    if not plain or not more:
        return text
    line = plain[int(rng.integers(len(plain)))]
    before = int(rng.integers(more + 1))
    fill = (line * (more // max(1, len(line)) + 1))[:more]
    return " ".join(fill[:before] + words + fill[before:])


def wordings(seed: int, n: int, lines: list[str], names: dict[str, list[str]] | None = None) -> tuple[list[str], np.ndarray]:
    """Notices and the classes that each is of (text x class): names in frames, in pairs, texts whole and in windows, each alone and amid corpus words."""
    rng = np.random.default_rng(seed)
    plain = _plain(lines)
    texts, classes = [], []

    def add(text: str, *found: str) -> None:
        for version in (text, _amid(rng, text, plain, int(rng.choice(WINDOWS)))):
            texts.append(version)
            classes.append([c in found for c in CLASSES])

    pick = lambda x: x[int(rng.integers(len(x)))]
    for family in FAMILIES:
        for k in range(n):
            name = NAMES[family][k % len(NAMES[family])]
            add(FRAMES[int(rng.integers(len(FRAMES)))].format(name) if k >= len(NAMES[family]) else name, family)
            other = pick([f for f in FAMILIES if _group(f) != _group(family)])
            other_name = pick(NAMES[other])
            add(PAIRED[1].format(*((name, other_name) if k % 2 else (other_name, name))), family, other)
            pair = [name if family not in SHORT or rng.random() < 0.5 else pick(SHORT[family]), other_name]
            frame = pick(PAIRED if pair[0] not in SHORT.get(family, []) else (PAIRED[0], PAIRED[3]))
            add(frame.format(*(pair if rng.random() < 0.5 or frame == PAIRED[1] else pair[::-1])), family, other)
            if family in SHORT:
                add(f"{pick(BEFORE_SHORT[:5])} {pick(SHORT[family])}", family)
                add(pick([f for f in FRAMES if "under" in f or "SPDX" in f or "License:" in f]).format(pick(SHORT[family])), family)
            for text in TEXTS.get(family, []) if k % 4 == 0 else []:
                add(text, family)
                words = text.split()
                size = int(rng.choice(WINDOWS[1:3]))
                if len(words) > size:
                    at = int(rng.integers(len(words) - size + 1))
                    add(" ".join(words[at : at + size]), family)
    return texts, np.array(classes, bool)


def _others(seed: int, names: list[str], lines: list[str], n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    plain = _plain(lines)
    return [v for name in names for frame in rng.permutation(FRAMES)[:n] for v in (frame.format(name), _amid(rng, frame.format(name), plain, 16))]


def _windows_of(lines: list[str], seed: int) -> list[str]:
    """A stretch of each line that is longer than the shortest window."""
    rng = np.random.default_rng(seed)
    out = []
    for words in map(str.split, lines):
        if len(words) > (n := int(rng.choice(WINDOWS))):
            at = int(rng.integers(len(words) - n + 1))
            out.append(" ".join(words[at : at + n]))
    return out


def train(lines: list[str], steps: int = 200, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """A model from the notices above and corpus lines without any; three quarters of the lines are for training, the rest for calibration."""
    cut = len(lines) * 3 // 4
    texts, target = wordings(1, 16, lines[:cut])
    plain_words, rng = _plain(lines[:cut]), np.random.default_rng(6)
    unknown = _others(2, UNKNOWN, lines[:cut], 6) + SHARED + [_amid(rng, s, plain_words, 32) for s in SHARED]
    mentions = MENTIONS + [_amid(rng, m, plain_words, size) for m in MENTIONS for size in WINDOWS[:2]]
    none = lines[:cut] + [w for seed in range(3, 7) for w in _windows_of(lines[:cut], seed)] + mentions + [""]
    target = np.concatenate([target, np.zeros((len(unknown) + len(none), len(CLASSES)), bool)])
    target[len(texts) : len(texts) + len(unknown), -1] = True
    texts = texts + unknown + none
    words = read(pa.array(texts, pa.string()))
    pairs = all_pairs(words)
    size = words.counts
    notices = np.repeat(target.any(axis=1), size)
    clue = np.repeat(np.isin(np.arange(len(texts)), np.arange(len(texts) - len(mentions) - 1, len(texts) - 1)), size) | notices
    alone = np.unique(np.concatenate([read(pa.array([t])).hashes for f in FAMILIES for t in (*templates_of(f), *FRAMES)] + [read(pa.array(x)).hashes for x in (UNKNOWN, SHARED, MENTIONS)]))
    known = np.isin(words.hashes, alone)
    keys = np.unique(np.concatenate([alone, pairs[clue & known & np.append(known[1:], False) & (pairs != 0)]]))
    model = Model(keys, np.zeros((len(CLASSES), len(keys) + 1)), np.full(len(CLASSES), -3.0), np.ones(len(CLASSES)), np.zeros(len(CLASSES)), np.full(len(CLASSES), UNKNOWN_BAR))
    gram, owner = np.concatenate([model.grams(words.hashes, words.text_of), model.grams(pairs, words.text_of)]), np.concatenate([words.text_of, words.text_of])
    some = gram < len(keys)
    gram, owner = gram[some], owner[some]
    scale = (1 / np.sqrt(np.maximum(2 * size - (size > 0), 1)))[owner]
    share = np.where(target, np.sqrt((~target).sum(axis=0) / np.maximum(target.sum(axis=0), 1)), 1.0) / len(texts)
    share[len(texts) - len(mentions) - 1 : -1] *= MENTION_WEIGHT
    # Adam over the whole set; the sums over texts and over grams are sparse.
    mean, square, b_mean, b_square = np.zeros((len(CLASSES), len(keys))), np.zeros((len(CLASSES), len(keys))), np.zeros(len(CLASSES)), np.zeros(len(CLASSES))
    w, bias = np.zeros((len(CLASSES), len(keys))), model.bias.copy()
    for step in range(1, steps + 1):
        logits = np.stack([np.bincount(owner, x[gram] * scale, len(texts)) for x in w], axis=1) + bias
        gap = (_sigmoid(logits) - target) * share
        grad = np.stack([np.bincount(gram, g[owner] * scale, len(keys)) for g in gap.T]) + decay * w
        for value, g, m, v in ((w, grad, mean, square), (bias, gap.sum(axis=0), b_mean, b_square)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights[:, :-1], model.bias = w, bias
    _calibrate(model, lines[cut:])
    return model


def _calibrate(model: Model, lines: list[str]) -> None:
    """Slope and shift of each class by Newton's method on wordings, lines and licences that training doesn't hold; then the bar."""
    texts, target = wordings(7, 8, lines)
    wrong = _others(8, HELD_OUT[::2], lines, 6) + _others(9, HELD_OUT[1::2], lines, 6) + lines + [w for seed in range(7, 11) for w in _windows_of(lines, seed)] + [""]
    scores, target = model.of_texts(texts + wrong), np.concatenate([target, np.zeros((len(wrong), len(CLASSES)), bool)])
    first = len(texts)
    target[first : first + len(_others(8, HELD_OUT[::2], [], 6)), -1] = True  # of the held-out licences, every other one tells what "unknown" scores
    for c in range(len(CLASSES)):
        x, y = np.column_stack([scores[:, c], np.ones(len(scores))]), target[:, c]
        b = np.array([1.0, 0.0])
        for _ in range(20):
            p = _sigmoid(x @ b)
            b -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * (b - [1.0, 0.0]))
        model.slope[c], model.shift[c] = max(b[0], 0.1), b[1]
    model.bars = np.append(np.clip(_sigmoid(model.of_texts(wrong)[:, :-1]).max(axis=0) + 0.01, 0.5, 0.99), UNKNOWN_BAR)


def _stretches(words: Words, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word and the word after the last of all lines and windows; and of each word's paragraph."""
    n = len(line)
    text = words.text_of
    begins = np.ones(n, bool)
    begins[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    breaks = np.ones(n, bool)
    breaks[1:] = (text[1:] != text[:-1]) | (line[1:] - line[:-1] > 1)
    at = np.flatnonzero(begins)
    low, high = [at], [np.minimum(np.append(at[1:], n)[: len(at)], at + WINDOWS[-1])]  # windows cover what is longer
    para = np.flatnonzero(breaks)
    number = np.cumsum(breaks) - 1
    first, last = para[number], np.append(para[1:], n)[number] if n else para
    for size in WINDOWS:
        place = np.flatnonzero(((np.arange(n) - first) % (size // 4) == 0) & (np.arange(n) + size * 3 // 4 < last))
        low.append(place)
        high.append(np.minimum(place + size, last[place]))
    return np.concatenate(low), np.concatenate(high), first, last


@dataclass
class Template:
    family: str
    size: int  #: words
    grams: np.ndarray  #: hashes of its word pairs, or of its only word

    @classmethod
    def of(cls, family: str, text: str) -> Template:
        words = read(pa.array([text]))
        return cls(family, len(words.hashes), np.unique(runs(words, 2)[1] if len(words.hashes) > 1 else words.hashes))

    def fit(self, hashes: np.ndarray, pairs: np.ndarray, free: np.ndarray) -> tuple[float, int, int]:
        """(share of the template's grams, their number, first word) where it fits best among words that are free; 0 where it doesn't."""
        if self.size > 1:
            hit = np.isin(pairs, self.grams) & free & np.append(free[1:], False)
        else:
            hit = np.isin(hashes, self.grams) & free
        if not hit.any():
            return 0.0, 0, 0
        at, value = np.flatnonzero(hit), (pairs if self.size > 1 else hashes)[hit]
        best = (0, 0)
        for k in range(len(at)):  # a gram counts once within the template's length and a quarter
            inside = len(np.unique(value[k : np.searchsorted(at, at[k] + self.size + self.size // 4)]))
            best = max(best, (inside, -int(at[k])))
        return best[0] / len(self.grams), best[0], -best[1]


def laid_over(templates: dict[str, list[Template]], found: list[str], hashes: np.ndarray, pairs: np.ndarray) -> dict[str, tuple[float, int]]:
    """(match, first word) of the families in `found`: templates of these and their siblings, the best fitting first, take the words that they fit on."""
    free, out = np.ones(len(hashes), bool), {}
    tried = [t for f in dict.fromkeys(g for f in found for g in SIBLINGS[f]) for t in templates[f]]
    while True:
        fits = [(round(share, 9), n, -at, k) for k, t in enumerate(tried) for share, n, at in [t.fit(hashes, pairs, free)] if share >= CONFIRM]
        if not fits:
            return out
        # Of a whole short name and nearly all of a longer one that holds it the whole one counts; of two whole ones the longer.
        share, n, at, k = max(fits)
        family = tried[k].family
        if family in found and family not in out:
            out[family] = share, -at
        free[-at : -at + tried[k].size + (tried[k].size // 4 if share < 1 else 0)] = False


def _notices(model: Model, templates: dict, words: Words, pairs: np.ndarray, line: np.ndarray, a: int, b: int, hits: list[tuple[int, float, int]]) -> list[dict]:
    """Notices in the words a to b; hits: (class, probability, first word) of the stretches there that pass."""
    best: dict[str, tuple[float, int]] = {}
    for c, p, low in hits:
        best[CLASSES[c]] = max(best.get(CLASSES[c], (0.0, 0)), (p, -low))
    found = [f for f in best if f != UNKNOWN_CLASS]
    fits = laid_over(templates, found, words.hashes[a:b], pairs[a:b]) if found else {}
    # What is not confirmed counts only if no sibling is.
    found = [f for f in found if f in fits or not any(g in fits for g in SIBLINGS[f])]
    rows = [{"line": int(line[a + fits[f][1]]) if f in fits else int(line[-best[f][1]]), "family": f, "p": best[f][0], "match": fits[f][0] if f in fits else 0.0} for f in found]
    if UNKNOWN_CLASS in best and not fits:
        rows.append({"line": int(line[-best[UNKNOWN_CLASS][1]]), "family": UNKNOWN_CLASS, "p": best[UNKNOWN_CLASS][0], "match": 0.0})
    return sorted(rows, key=lambda r: (r["line"], r["family"]))


def scan_texts(texts: pa.Array, model: Model, templates: dict) -> tuple[list[list[dict]], np.ndarray]:
    """Notices, and the number of lines, of each text."""
    words = read(texts)
    feeds, at = text_bytes(texts)
    feeds = np.concatenate([[0], np.cumsum(feeds == 10)])
    rows: list[list] = [[] for _ in range(len(texts))]
    n_lines = np.diff(feeds[at]) + 1
    if not len(words.hashes):
        return rows, n_lines
    text = words.text_of
    line = feeds[words.starts] - feeds[at[text]]
    pairs = all_pairs(words)
    low, high, first, last = _stretches(words, line)
    hits = []
    for c, score in model.scores(words, pairs, low, high):
        some = np.flatnonzero(score >= np.log(model.bars[c] / (1 - model.bars[c])))
        hits.append((some, np.full(len(some), c), _sigmoid(score[some])))
    found, kind, p = (np.concatenate(x) for x in zip(*hits))
    # Stretches with a few words around them; where these touch in a paragraph, they are one find.
    a, b = np.maximum(low[found] - AROUND, first[low[found]]), np.minimum(high[found] + AROUND, last[low[found]])
    order = np.lexsort((b, a))
    found, kind, p, a, b = found[order], kind[order], p[order], a[order], b[order]
    new = np.ones(len(found), bool)
    new[1:] = (a[1:] >= np.maximum.accumulate(b)[:-1]) | (first[low[found]][1:] != first[low[found]][:-1])
    cuts = np.append(np.flatnonzero(new), len(found))
    for x, y in zip(cuts[:-1], cuts[1:]):
        some = list(zip(kind[x:y].tolist(), p[x:y].tolist(), low[found[x:y]].tolist()))
        rows[text[a[x]]] += _notices(model, templates, words, pairs, line, int(a[x]), int(b[x:y].max()), some)
    for notices in rows:
        for inner, outer in INSIDE.items():
            around = [n["line"] for n in notices if n["family"] == outer]
            notices[:] = [n for n in notices if n["family"] != inner or not any(0 <= n["line"] - k <= INSIDE_LINES for k in around)]
    return rows, n_lines


def all_templates() -> dict[str, list[Template]]:
    return {f: [Template.of(f, t) for t in templates_of(f)] for f in FAMILIES}


_KIND = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("p", pa.float64()), ("match", pa.float64())]))


def _scan(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = all_templates()
        for big in chunks(batches):
            for low in range(0, big.num_rows, 500):
                chunk = big.slice(low, 500)
                rows, n_lines = scan_texts(chunk.column("text"), model.value, templates)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(rows, _KIND)], names=["doc_id", "n_lines", "notices"])

    return scan


def scan_licenses(docs: DataFrame, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """doc_id, n_lines, notices (line number, family, p, match) for every row of `docs`.

    p is the calibrated probability of the family, at or over the bar; match the share of the word pairs of the family's template
    that fits best, CONFIRM or more, and 0 where none does, so that a notice is confirmed by both.
    "unknown" stands for licences of no listed family and is never confirmed. A notice's line is where the template begins, or else
    the likeliest stretch.

    At most `sample_lines` lines (of a long one a stretch of LINE_CHARACTERS), one for each of the rows with the least hashes of doc_id, stand for
    "no licence" in training; lines that name a licence are left out of them. A null text has one empty
    line and no notice, an empty one as well. Texts are read whole whatever their length. Rows with the same text, and rows that share a
    doc_id, are scanned each; of equal probabilities the earlier place counts. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = F.element_at(F.split("text", "\n"), F.pmod(F.xxhash64("doc_id"), F.size(F.split("text", "\n"))).cast("int") + 1)
    # Only about twice the rows that are wanted are sorted; the bound follows the number of rows.
    share = min(1.0, 2 * sample_lines / max(1, docs.count()))
    bound = int(-(1 << 63) + share * ((1 << 64) - 1025))
    sampled = docs.filter("text is not null").select(F.xxhash64("doc_id").alias("rank"), "doc_id", "text").filter(F.col("rank") <= bound)
    # Of a long line a stretch of LINE_CHARACTERS, so that the sample's size is bounded.
    stretch = F.substr("line", (F.pmod("rank", F.greatest(F.length("line") - LINE_CHARACTERS, F.lit(1))) + 1).cast("int"), F.lit(LINE_CHARACTERS))
    sampled = sampled.select("rank", "doc_id", first.alias("line")).withColumn("line", stretch).orderBy("rank", "doc_id").limit(sample_lines)
    lines = [r["line"] for r in sampled.filter(~F.col("line").rlike("(?i)licen[sc]|copyright|spdx|permission|redistribut")).collect()]
    model = spark.sparkContext.broadcast(train(lines))
    kind = "array<struct<line:long,family:string,p:double,match:double>>"
    return docs.mapInArrow(_scan(model), f"doc_id long, n_lines long, notices {kind}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    sure = F.filter("notices", lambda x: x["match"] >= CONFIRM)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return found.select("doc_id", "n_lines", F.size("notices").cast("long").alias("n_notices"), F.size(sure).cast("long").alias("n_confirmed"), names.alias("licenses"))

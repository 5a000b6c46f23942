"""Licence scans by a trained paragraph classifier, in SQL functions only.

Text is cut into paragraphs at blank lines and those into statements, at the ends
of sentences and at lines that begin with a capital.  Features are word 1- to
3-grams that hold a cue.  Cues are learned: words that the training statements
use, and ordinary prose (``PROSE``, ``COMMON``) does not or hardly.  A statement
without a cue has no feature, so a pattern made of the cues skips it before
anything is computed; no class is at least ``MIN_PROBABILITY`` likely without one.

One logistic model for each licence family is fitted on the driver, with an L1
penalty, to names and passages of the licences' texts in sentences of four
languages (``CARRIERS``), against each other, statements of licences that have no
class, and prose.  "unknown" is a class of its own: licences without a class, and
statements that name none.  Slope and threshold (Platt scaling) come from half of
the statements, held out, and from families that a model was not trained on, which
count as belonging to none.

A prediction is confirmed if at least ``MIN_OVERLAP`` of the adjacent word pairs of
one of the family's names or passages occur in the statement, in their order, and
its version does too.  A statement that says another version only, holds a word of
a related family or denies the licence is "unknown" and not confirmed.

On the data path everything is a narrow projection of the scan: no shuffle, no
join, no Python.

Defined results: null and empty texts have no licence statements; every row of
``docs`` gives one row, repeated rows too; of equally likely families that which
sorts last is taken; very long texts are read whole; an empty table gives an empty
one; if ``docs`` has a column of the new one's name, the new one gets underscores
in front.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import fresh

MIN_PROBABILITY, MIN_OVERLAP, GRAMS = 0.5, 0.6, 3
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Family:
    """Names of a licence, passages of its text, its identifier, words for its version
    and words that make a statement one of another family."""

    names: tuple[str, ...]
    spdx: str
    texts: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    related: tuple[str, ...] = ()


def _gnu(kind: str, short: str, version: str, related: tuple[str, ...]) -> Family:
    number = version.removesuffix(".0")
    full = f"GNU {kind}General Public License"
    grant = f"you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version"
    names = (f"{full}, version {number}", f"{full} v{number}", f"GNU {short} version {number}", f"{short}v{number}", f"{short} {version}")
    return Family(names, f"{short}-{version}-or-later", (f"This program is free software: {grant}.", f"This library is free software; {grant}."), (number[0],), related)


def _creative(parts: tuple[str, ...]) -> Family:
    words = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
    full = "-".join(["Attribution", *(words[p] for p in parts)])
    short = "-".join(["BY", *(p.upper() for p in parts)])
    others = {"nc": ("nc", "noncommercial", "non"), "nd": ("nd", "noderivatives", "noderivs"), "sa": ("sa", "sharealike", "alike")}
    related = tuple(w for p, ws in others.items() if p not in parts for w in ws)
    names = (f"CC {short} 4.0", f"Creative Commons {full} 4.0 International License", f"Creative Commons {full} 4.0")
    return Family(names, f"CC-{short}-4.0", (f"This work is licensed under a Creative Commons {full} 4.0 International License.",), ("4",), related)


_RETAIN = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
#: Licence families, with names and passages of their published texts.
FAMILIES: dict[str, Family] = {
    "0bsd": Family(("BSD Zero Clause License", "Zero-Clause BSD"), "0BSD", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)),
    "agpl-3.0": _gnu("Affero ", "AGPL", "3.0", ("lesser", "lgpl")),
    "apache-2.0": Family(
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"), "Apache-2.0",
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ), ("2", "is"),
    ),
    "bsd": Family((), "BSD", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", _RETAIN)),
    "bsd-2-clause": Family(("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD license, two clauses"), "BSD-2-Clause", (), ("2", "two", "simplified")),
    "bsd-3-clause": Family(
        ("BSD 3-Clause License", "3-clause BSD license", "BSD license, three clauses"), "BSD-3-Clause",
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",), ("3", "three", "neither"),
    ),
    "bsl-1.0": Family(("Boost Software License, Version 1.0", "Boost Software License 1.0"), "BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",), ("1",)),
    "cc-by-4.0": _creative(()),
    "cc-by-nc-4.0": _creative(("nc",)),
    "cc-by-nc-nd-4.0": _creative(("nc", "nd")),
    "cc-by-nc-sa-4.0": _creative(("nc", "sa")),
    "cc-by-nd-4.0": _creative(("nd",)),
    "cc-by-sa-4.0": _creative(("sa",)),
    "cc0-1.0": Family(("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal"), "CC0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",), ("1", "waived")),
    "epl-2.0": Family(("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL 2.0"), "EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",), ("2",)),
    "gpl-2.0": _gnu("", "GPL", "2.0", ("lesser", "library", "affero", "lgpl", "agpl")),
    "gpl-3.0": _gnu("", "GPL", "3.0", ("lesser", "affero", "lgpl", "agpl")),
    "isc": Family(("ISC License",), "ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    "lgpl-2.1": _gnu("Lesser ", "LGPL", "2.1", ("affero", "agpl")),
    "lgpl-3.0": _gnu("Lesser ", "LGPL", "3.0", ("affero", "agpl")),
    "mit": Family(
        ("MIT License", "Expat License"), "MIT",
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ),
    ),
    "mpl-2.0": Family(("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), "MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."), ("2",)),
    "unlicense": Family(
        ("Unlicense",), "Unlicense",
        ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ),
    "zlib": Family(("zlib License",), "Zlib", ("This software is provided 'as-is', without any express or implied warranty.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:")),
}

#: Sentences that carry a licence's name, and their denials.
CARRIERS = (
    "Released under the {}.", "Licensed under {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "Distributed under the {}, see the license file.", "Content is available under the {} license.",
    "Code is licensed under {}, see NOTICE.", "Veröffentlicht unter der {}.", "Lizenziert unter {}.", "Dieses Werk steht unter der {} Lizenz.", "Publié sous licence {}.", "Ce logiciel est distribué sous la licence {}.", "Publicado bajo la licencia {}.",
)
SHORT_CARRIERS = ("Publié sous licence {}.", "Veröffentlicht unter der {}-Lizenz.", "{} Lizenz", "Publicado bajo licencia {}.", "License: {}")
DENIALS = ("This software is not licensed under the {}.", "This is no longer released under the {}.", "Nicht unter der {} veröffentlicht.")

#: Licences that have no class, and statements that name none.
UNLISTED = (
    "Artistic License 2.0", "European Union Public Licence 1.2", "Microsoft Public License", "Common Development and Distribution License", "PostgreSQL License", "Python Software Foundation License", "SIL Open Font License 1.1",
    "Apache License, Version 1.1", "Mozilla Public License 1.1", "GNU General Public License, version 1", "Creative Commons Attribution 3.0 Unported License", "CC BY 2.0", "CC BY-SA 3.0", "WTFPL", "Ruby License", "Vim License", "GNU Free Documentation License 1.3", "Eclipse Public License 1.0",
)
UNNAMED = (
    "All rights reserved.", "All rights reserved, copyright by the authors.", "Licensed under the terms of our own license agreement.", "Released under a custom license, ask the publisher.", "See the license for details.", "This work is licensed to the buyer only.",
    "License version unknown.", "Copyright notices must stay, redistribution is not permitted.", "Copyright 2021, all rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Proprietary and confidential, unauthorized copying of this file is strictly prohibited.",
)

#: Prose that isn't about the licence of a text, and the commonest words.
PROSE = (
    "You need a license to drive a car.", "The licence fee is due every year.", "A commons is land that all may use, and a creative idea too.", "He studied at MIT before he came here.", "Sie kam mit ihm und mit den anderen.", "The apache helicopter flew over the town.",
    "Sold without warranty of any kind.", "The cc of the letter went to the office.", "He has a license to drive, and came with the apache.", "The software was installed on a new version of the system.", "The public library is open to any person from the general public.", "Please read the following notice and conditions with care.",
    "The file has a copy of the text and a list of names.", "He gave permission to use the work in the project.", "The source of the river is far from here, and the program starts at noon.", "La source est claire et le texte est long.", "Das Werk ist alt, und der Text ist lang.", "La obra es larga y el texto es claro.",
)
COMMON = frozenset(
    "a an the this that these those it its he she they we you i his her their our your me him them us who which what and or but if then than as so not no of to in on at by for from with without into out up down over under about after before between "
    "is are was were be been has have had do does did will would can could may might must shall should one two three new old all any some each more most other such only own same any free use used make made see get set also there here when where how very just "
    "der die das den dem des ein eine einen einem einer und oder aber nicht mit von zu im am auf aus bei nach vor für über ist sind war hat haben wird werden sich er sie es wir ihr auch nur noch als wie steht dieses unter "
    "http https www org name names work works version versions later either met above including included team details ask deal content file files general public available provided appear means non common related required possible option except "
    "charge law purpose products written writing specific stay ver serv publi todos tous alle longer python development code form forms source express "
    "le la les un une des du de et ou mais ne pas avec dans sur par pour est sont il elle ce cet cette qui que se au aux ces son el los las uno una y o con en por para es son no su al lo bajo sous".split()
)
#: Numbers that a version begins with.
NUMBERS = "1 2 3 4 two three".split()

#: Words of a part of a passage, half of which the next part repeats.
PASSAGE = 16
_SENTENCE = r"(?<=[.!?])\s+(?=[\p{Lu}])|\n(?=[\s*#/;-]*\p{Lu})"
_PARAGRAPH = r"\n[ \t\r]*\n\s*"
#: GPLv3, LGPL3 and v2 are a name, if any, and a number.
_NUMBERED = r"(?<![a-z0-9])([al]?gpl|(?=v))v?([0-9])(?![0-9])"
_DENIED = r"(?:^| )(?:not|never|no longer|nicht|pas)(?: [a-z0-9]+){0,2} (?:licensed|released|available|distributed|covered|lizenziert|unter|sous)(?: |$)"


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(_NUMBERED, r"\1 \2", text.lower().replace("licenc", "licens")))


def grams_of(words: list[str], cues: set[str]) -> set[str]:
    spans = (words[k : k + n] for n in range(1, GRAMS + 1) for k in range(len(words) - n + 1))
    return {" ".join(s) for s in spans if not cues.isdisjoint(s)}


def pairs_of(words: list[str]) -> list[str]:
    """Adjacent words, or the word of a statement that has one."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])}) if len(words) > 1 else words


def _parts(family: Family) -> list[str]:
    """The passages in overlapping parts: a statement may quote one in part."""
    split = [t.split() for t in family.texts]
    return [" ".join(w[k : k + PASSAGE]) for w in split for k in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2)]


def statements(family: Family) -> list[str]:
    named = [c.format(n) for n in family.names for c in CARRIERS]
    short = [c.format(n.removesuffix(" License")) for n in family.names for c in SHORT_CARRIERS]
    # Twice, so that both halves of the statements have them.
    return [*named, *(s for s in [*short, f"SPDX-License-Identifier: {family.spdx}", *family.texts, *_parts(family)] for _ in range(2))]


def templates(family: Family) -> list[list[str]]:
    """Word pairs of what confirms a family: its names, also behind the word licence or
    as an identifier, and its passages."""
    spdx = family.spdx.removesuffix("-or-later")
    said = [*family.names, f"Identifier: {spdx}", *_parts(family)]
    if not family.versions and family.names:
        base = family.names[0].removesuffix(" License")
        said += [f"licence {base}", f"{base} Lizenz", f"licencia {base}"]
    return [pairs_of(words_of(t)) for t in said]


@dataclass
class LicenseModel:
    families: list[str]
    features: list[str]
    weights: np.ndarray  # families x features
    bias: np.ndarray
    slope: float
    shift: float
    cues: list[str] = field(default_factory=list)

    def probabilities(self, text: str) -> np.ndarray:
        present = grams_of(words_of(text), set(self.cues))
        x = np.array([f in present for f in self.features], float)
        return 1 / (1 + np.exp(-(self.slope * (self.weights @ x + self.bias) + self.shift)))


def _fit(x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> np.ndarray:
    """Logistic regressions, one for each column of ``y``, by accelerated proximal steps;
    rows weigh so that both kinds count alike.  The last column of ``x`` is the bias."""
    pull = np.where(y > 0, 0.5 / np.maximum(y.sum(0), 1), 0.5 / np.maximum((1 - y).sum(0), 1))
    probe = np.ones(x.shape[1])
    for _ in range(8):  # the largest curvature, for the step
        probe = x.T @ (pull.max(1) * (x @ probe))
        size = np.linalg.norm(probe)
        probe /= size
    rate = 4 / (size + 1e-9)
    w = last = np.zeros((x.shape[1], y.shape[1]))
    for step in range(steps):
        ahead = w + step / (step + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        last, w = w, ahead - rate * (x.T @ (pull * (p - y)))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * l1, 0)
    return w


@cache
def train(l1: float = 1e-4, steps: int = 250, folds: int = 3) -> LicenseModel:
    """Fit the families to every other statement; calibrate on the rest, and on families
    that were left out."""
    families = sorted([*FAMILIES, UNKNOWN])
    at = {f: k for k, f in enumerate(families)}
    rows = [(s, at[f]) for f, own in FAMILIES.items() for s in statements(own)]
    earlier = [n.replace("4.0", v) for f, own in FAMILIES.items() if f.startswith("cc-by") for n in own.names for v in ("2.0", "3.0")]
    rows += [(c.format(n), at[UNKNOWN]) for n in UNLISTED for c in CARRIERS] + [(c.format(n), at[UNKNOWN]) for n in earlier for c in CARRIERS[1:9:3]] + [(s, at[UNKNOWN]) for s in UNNAMED for _ in range(4)]
    rows += [(d.format(own.names[0]), at[UNKNOWN]) for own in FAMILIES.values() if own.names for d in DENIALS]
    n_statements = len(rows)
    rows += [(s, -1) for s in PROSE for _ in range(4)] + [(" ".join(sorted(COMMON)), -1)] * 4
    words = [words_of(s) for s, _ in rows]
    held = [set(w) for w in words]
    inside = {w: sum(w in h for h in held[:n_statements]) / n_statements for w in set().union(*held[:n_statements])}
    outside = {w: sum(w in h for h in held[n_statements:]) / (len(rows) - n_statements) for w in inside}
    cues = {w for w in inside if len(w) > 1 and not w.isdigit() and w not in COMMON and (inside[w] + 1e-3) > 1.5 * outside[w]}
    grams = [grams_of(w, cues) for w in words]
    counts: dict[str, int] = {}
    for g in set().union(*grams):
        counts[g] = 0
    for own in grams:
        for g in own:
            counts[g] += 1
    features = sorted(g for g, n in counts.items() if n > 1)
    index = {f: k for k, f in enumerate(features)}
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    x[:, -1] = 1
    for k, own in enumerate(grams):
        x[k, [index[g] for g in own if g in index]] = 1
    truth = np.array([k for _, k in rows])
    y = (truth[:, None] == np.arange(len(families))).astype(np.float32)
    half = np.arange(len(rows)) % 2 == 0
    w = _fit(x[half], y[half], l1, steps)
    margins, targets = [(x[~half] @ w).ravel()], [y[~half].ravel()]
    for fold in range(folds):
        out = np.isin(truth, [at[f] for f in FAMILIES][fold::folds])
        known = [k for k, f in enumerate(families) if k not in set(truth[out]) and f != UNKNOWN]
        some = half & ~out
        margin = x[out] @ _fit(x[some], y[some][:, known], l1, steps // 3)
        margins.append(margin.ravel())
        targets.append(np.zeros(margin.size))
    m, t = np.concatenate(margins)[:, None], np.concatenate(targets)[:, None]
    platt = _fit(np.column_stack([m, np.ones(len(m))]), t, 0.0, 200)
    kept = np.abs(w[:-1]).max(1) > 1e-3
    return LicenseModel(families, [f for f, k in zip(features, kept, strict=True) if k], w[:-1].T[:, kept].astype(float), w[-1].astype(float), float(platt[0, 0]), float(platt[1, 0]), sorted(cues))


def _alternatives(words: list[str]) -> str:
    """A pattern for any of the words that tries each beginning once."""
    branches = []
    for first, own in groupby(sorted(set(words)), key=lambda w: w[:1]):
        rest = [w[1:] for w in own]
        if first:
            inner = _alternatives(rest) if any(rest) else ""
            branches.append(first + (f"(?:{inner})" if "|" in inner else inner) + ("" if all(rest) or not any(rest) else ""))
        else:
            branches.append("")
    return "|".join(sorted(branches, key=lambda b: b == ""))


def cue_pattern(model: LicenseModel) -> str:
    """Matches just the texts whose words hold a cue."""
    cues = _alternatives([c.replace("licens", "licenc") for c in model.cues] + model.cues)
    return rf"(?i)(?<![a-z0-9])(?:{cues}|[al]?gplv?[0-9])(?![a-z0-9])"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``docs`` with an array of licence statements: paragraph and sentence (0-based),
    family (or "unknown"), probability, confirmed."""
    model = model or train()
    n, pattern = len(model.families), cue_pattern(model)
    # One row of weights for each feature, in the order of ``features``; constants of the plan.
    matrix = F.from_json(F.lit(str([[round(float(v), 6) for v in row] for row in model.weights.T])), "array<array<double>>")
    features, cues = _strings(model.features), _strings(model.cues)
    zero = F.from_json(F.lit(str([float(b) for b in model.bias])), "array<double>")
    known = [FAMILIES.get(f) for f in model.families]
    pairs = F.from_json(F.lit(str([templates(f) if f else [] for f in known]).replace("'", '"')), "array<array<array<string>>>")
    versions, related = (F.from_json(F.lit(str([list(getattr(f, part)) if f else [] for f in known]).replace("'", '"')), "array<array<string>>") for part in ("versions", "related"))

    def grams(words: Column) -> Column:
        def of(width: int) -> Column:
            starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - (width - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda k: F.array_join(F.slice(words, k, width), " "))

        return F.concat(words, *[of(width) for width in range(2, GRAMS + 1)])

    def read(s: Column) -> Column:
        plain = F.regexp_replace(F.replace(F.lower(s["text"]), F.lit("licenc"), F.lit("licens")), _NUMBERED, "$1 $2")
        return F.struct(s["paragraph"].alias("paragraph"), s["sentence"].alias("sentence"), F.regexp_extract_all(plain, F.lit("([a-z0-9]+)")).alias("words"))

    def seen(s: Column) -> Column:
        return F.struct(s["paragraph"].alias("paragraph"), s["sentence"].alias("sentence"), s["words"].alias("words"), F.array_intersect(grams(s["words"]), features).alias("present"))

    def judged(s: Column) -> Column:
        add = lambda total, f: F.zip_with(total, F.element_at(matrix, F.array_position(features, f).cast("int")), lambda a, b: a + b)
        margins = F.aggregate(s["present"], zero, add)
        best = F.array_max(F.transform(margins, lambda m, k: F.struct((1 / (1 + F.exp(-(model.slope * m + model.shift)))).alias("p"), k.alias("k"))))
        return F.struct(s["paragraph"].alias("paragraph"), s["sentence"].alias("sentence"), s["words"].alias("words"), best.alias("best"))

    def matched(s: Column) -> Column:
        k, words = s["best"]["k"] + 1, s["words"]
        joined = F.array_join(words, " ")
        own = F.concat(words, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda j: F.array_join(F.slice(words, j, 2), " ")))
        overlap = F.exists(F.element_at(pairs, k), lambda t: (F.size(t) > 0) & (F.size(F.array_intersect(t, own)) >= F.lit(MIN_OVERLAP) * F.size(t)))
        right = (F.size(F.element_at(versions, k)) == 0) | F.arrays_overlap(words, F.element_at(versions, k))
        other = F.arrays_overlap(words, F.element_at(related, k)) | (~right & F.arrays_overlap(words, _strings(NUMBERS))) | F.regexp_like(joined, F.lit(_DENIED))
        family = F.element_at(_strings(model.families), k)
        return F.struct(
            s["paragraph"].alias("paragraph"), s["sentence"].alias("sentence"), F.when(other, UNKNOWN).otherwise(family).alias("family"),
            s["best"]["p"].alias("probability"), (overlap & right & ~other & (family != UNKNOWN)).alias("confirmed"),
        )

    text = F.col(text_col).cast("string")
    has_cue = lambda t: F.regexp_like(t, F.lit(pattern))
    paragraphs = F.filter(F.transform(F.split(text, _PARAGRAPH), lambda p, k: F.struct(k.alias("paragraph"), p.alias("text"))), lambda p: has_cue(p["text"]))
    parts = lambda p: F.transform(F.split(p["text"], _SENTENCE), lambda t, k: F.struct(p["paragraph"].alias("paragraph"), k.alias("sentence"), t.alias("text")))
    candidates = F.when(has_cue(text), F.filter(F.flatten(F.transform(paragraphs, parts)), lambda s: has_cue(s["text"])))
    empty = F.array().cast("array<struct<paragraph: int, sentence: int, family: string, probability: double, confirmed: boolean>>")
    # One step each, so that every step reads what the one before it made.  A statement
    # whose words only looked like a cue (``gpl`` and a long number) has none and goes.
    cued = F.filter(F.transform(candidates, read), lambda s: F.arrays_overlap(s["words"], cues))
    found = F.transform(F.filter(F.transform(F.transform(cued, seen), judged), lambda s: s["best"]["p"] >= MIN_PROBABILITY), matched)
    return docs.withColumn(fresh(docs.columns, out_col), F.coalesce(found, empty))

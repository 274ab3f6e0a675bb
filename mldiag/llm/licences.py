"""Licence scans by a trained paragraph classifier.

A sparse word n-gram softmax regression tells licence families and `unknown` apart. It is trained on variants of public licence
notices (cut, thinned out, embedded in other words) and, as `unknown`, on a bounded sample of the corpus' own paragraphs and on
sentences that merely use licence words. Whole notices and texts that a first fit has not seen calibrate a temperature and the least probability at
which a family is named rather than unknown. A named family counts only if the paragraph holds enough of the two-word shingles of
one of the family's templates, which confirms the prediction.

A paragraph is a line; a line of more than `WINDOW` words is also read in windows that overlap by half, so a notice inside a long
line is found. Windows also run across the line breaks of the whole text, without comment marks, so a hard-wrapped notice is found; it counts
as one paragraph, unless one of its lines has been found to be a notice of the family by itself. Every text is read whole. Cases: a null or empty text has no paragraphs and no licence; rows that repeat are read one
by one; several licences in one document are all listed, the likeliest one first (ties by name); a very long text is read in parts
of whole lines; an empty table gives no rows, and a model of the notices alone; only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mldiag.llm import hashed
from mldiag.llm.common import bytes_of, map_batches

BUCKETS = 1 << 18
BACKGROUND = 4_000
VARIANTS = 60
WINDOW = 48
CONFIRMED = 0.6
#: Characters of a line of the fitting sample.
CUT = 4_000
FALSE_ALARMS = 0.02
SEED = 23
UNKNOWN = "unknown"
MARKS = b".,;:!?()[]{}\"'`*#<>|/-"
#: What a line of a comment may begin with besides marks.
COMMENTS = (b"dnl", b"rem", b"%", b"%%", b"@rem", b"..", b"\\", b"=", b"+")

#: Short notices and sentences of public licences, by family.
TEMPLATES = {
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to copy and redistribute the material in any medium or format and to remix, transform, and build upon the material for any purpose, even commercially, if you give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes. NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same ShareAlike license as the original.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0 Universal.",
        "To the greatest extent permitted by, but not in contravention of, applicable law, Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of the Copyright and Related Rights in the Work.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "You may convey a Combined Work under terms of your choice that, taken together, effectively do not restrict modification of the portions of the Library contained in the Combined Work and reverse engineering for debugging such modifications",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license under intellectual property rights other than patent or trademark Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions",
        "If a copy of the MPL was not distributed with this file, You can obtain one at the website of Mozilla.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Sentences with licence words that grant nothing.
NOT_LICENCES = [
    "He lost his driving license on the way to the public library.",
    "The version of the work that was released in the spring sold well.",
    "Under the terms of the contract the software was delivered without delay.",
    "A license to kill is the title of a film, not a permission.",
    "The general public was free to use the source of the river.",
    "Apache helicopters were seen over the international airport.",
    "The foundation published the second version of its report.",
    "MIT is a university in Cambridge.",
    "All the conditions of the permit were met by the author.",
    "Creative people often work under common constraints.",
    "She got the license and the copyright notice in the post.",
    "The fishing license, version 3, is blue.",
]


def _words(content: bytes) -> list[bytes]:
    return [w for w in (x.strip(MARKS).lower() for x in content.split()) if w]


def _attributes(words: list[bytes]) -> np.ndarray:
    """Hash of the bare lower-case word; 0 for mere marks, which are left out."""
    bare = [w.strip(MARKS).lower() for w in words]
    return np.array([[zlib.crc32(w) | 1 << 32 if w else 0] for w in bare], np.int64).reshape(len(words), 1)


def _hashes(content: bytes) -> np.ndarray:
    return np.array([zlib.crc32(w) | 1 << 32 for w in _words(content)], np.int64)


def _buckets(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of single words, and of pairs of neighbours."""
    one = (hashed.mixed(hashes) % np.uint64(BUCKETS)).astype(np.int64)
    two = (hashed.pair_hashes(hashes) % np.uint64(BUCKETS)).astype(np.int64) if len(hashes) > 1 else np.zeros(0, np.int64)
    return one, two


def containment(hashes: np.ndarray, template: np.ndarray) -> float:
    """Share of the template's two-word shingles that the words hold."""
    return float(np.isin(template, hashed.pair_hashes(hashes)).mean()) if len(hashes) > 1 else 0.0


def _variants(text: str, fillers: list[str], rng: random.Random) -> list[str]:
    """The notice itself, and copies of it cut, thinned out, shouted or embedded in other words."""
    out = [text]
    for _ in range(VARIANTS):
        words = text.split()
        if len(words) > 8 and rng.random() < 0.5:
            size = rng.randrange(max(6, len(words) * 6 // 10), len(words) + 1)
            first = rng.randrange(len(words) - size + 1)
            words = words[first : first + size]
        if len(words) > 6 and rng.random() < 0.3:
            words = [w for w in words if rng.random() > 0.1]
        before, after = (rng.choices(fillers, k=rng.randrange(0, 24)) if fillers and rng.random() < 0.6 else [] for _ in range(2))
        copy = " ".join([*before, *words, *after])
        out.append(copy.upper() if rng.random() < 0.1 else copy)
    return out


@dataclass
class LicenceModel:
    families: list[str]  # the last one is unknown
    linear: hashed.Linear
    least: float
    templates: list[tuple[int, np.ndarray]]  # (family, pair hashes)

    def spans(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(paragraph, first word, end) of paragraphs and of the windows of long ones."""
        ends = np.cumsum(lengths)
        rows = [np.arange(len(lengths)), ends - lengths, ends]
        for i in np.flatnonzero(lengths > WINDOW).tolist():
            first = np.arange(ends[i] - lengths[i], ends[i], WINDOW // 2)
            extra = (np.full(len(first), i), first, np.minimum(first + WINDOW, ends[i]))
            rows = [np.append(a, b) for a, b in zip(rows, extra)]
        return rows[0], rows[1], rows[2]

    def shares(self, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Probabilities of the families for spans of words."""
        one, two = _buckets(hashes)
        sums = np.zeros((len(hashes) + 1, len(self.families)))
        np.cumsum(self.linear.weights[one], axis=0, dtype=np.float64, out=sums[1:])
        pairs = np.zeros((len(hashes) + 1, len(self.families)))
        if len(two):
            np.cumsum(self.linear.weights[two], axis=0, dtype=np.float64, out=pairs[1 : len(two) + 1])
        total = sums[end] - sums[first] + pairs[np.maximum(end - 1, first)] - pairs[first]
        count = np.maximum(1, 2 * (end - first) - 1)
        return self.linear.shares(total / np.sqrt(count)[:, None])

    def found(self, hashes: np.ndarray, lengths: np.ndarray) -> list[tuple[int, float, float, int]]:
        """(family, probability, containment, paragraph) of the confirmed spans."""
        if not len(hashes):
            return []
        paragraph, first, end = self.spans(lengths)
        out = []
        for start in range(0, len(first), 1 << 15):
            part = slice(start, start + (1 << 15))
            low, high = int(first[part].min()), int(end[part].max())
            shares = self.shares(hashes[low:high], first[part] - low, end[part] - low)
            named = shares[:, :-1].argmax(axis=1)
            chance = shares[np.arange(len(shares)), named]
            for i in np.flatnonzero(chance >= self.least).tolist():
                words = hashes[first[start + i] : end[start + i]]
                alike = max(containment(words, t) for f, t in self.templates if f == named[i])
                if alike >= CONFIRMED:
                    out.append((int(named[i]), float(chance[i]), alike, int(paragraph[start + i])))
        return out

    def wrapped(self, hashes: np.ndarray, lines: np.ndarray, found: list[tuple]) -> list[tuple[int, float, float, int, int, int]]:
        """(family, probability, containment, first line, last line, template) of notices that run across line breaks.

        `lines` has the line of each word; `found` are the notices that lines hold by themselves."""
        first = np.arange(0, len(hashes), WINDOW // 2)
        end = np.minimum(first + WINDOW, len(hashes))
        several = lines[first] < lines[end - 1] if len(first) else np.zeros(0, bool)
        first, end = first[several], end[several]
        own = {(f, i) for f, _, _, i in found}
        gnu = [self.families.index(f) for f in ("AGPL", "GPL", "LGPL")]
        out: list[tuple] = []
        for start in range(0, len(first), 1 << 15):
            part = slice(start, start + (1 << 15))
            low, high = int(first[part].min()), int(end[part].max())
            shares = self.shares(hashes[low:high], first[part] - low, end[part] - low)
            named = shares[:, :-1].argmax(axis=1)
            chance = shares[np.arange(len(shares)), named]
            alike_names = np.isin(named, gnu)  # families of the same words but for the name: their shares count together
            chance[alike_names] = shares[alike_names][:, gnu].sum(axis=1)
            for i in np.flatnonzero(chance >= self.least).tolist():
                a, b = int(first[start + i]), int(end[start + i])
                pairs = hashed.pair_hashes(hashes[a:b])
                family = int(named[i])
                if alike_names[i]:
                    family = gnu[0] if np.isin(AFFERO, pairs).any() else gnu[2] if np.isin(LESSER, pairs).any() else family
                alike, number = max((float(np.isin(t, pairs).mean()), k) for k, (f, t) in enumerate(self.templates) if f == family)
                if alike < CONFIRMED:
                    continue
                hit = np.flatnonzero(np.isin(pairs, self.templates[number][1]))
                top, last = int(lines[a + hit[0]]), int(lines[a + hit[-1] + 1])
                if top < last and not any((family, k) in own for k in range(top, last + 1)):
                    out.append((family, float(chance[i]), alike, top, last, number))
        return out


#: Pairs of words that name the relatives of the GPL, and those of the paragraph that all of them have.
AFFERO = hashed.pair_hashes(_hashes(b"Affero General"))
LESSER = np.concatenate([hashed.pair_hashes(_hashes(t)) for t in (b"Lesser General", b"Library General")])
SHARED = hashed.pair_hashes(_hashes(TEMPLATES["GPL"][2].encode()))


def joined(model: LicenceModel, wrapped: list[tuple], found: list[tuple]) -> list[tuple]:
    """(family, probability, containment, first line, last line): wrapped notices of one family whose lines overlap are one.

    The paragraph that the GPL shares with its relatives says nothing where a relative is named."""
    named = {model.families[x[0]] for x in [*found, *wrapped]}
    out: list[tuple] = []
    for f, p, c, top, last, number in sorted(wrapped, key=lambda x: (x[0], x[3], x[4])):
        if model.families[f] == "GPL" and named & {"AGPL", "LGPL"} and np.array_equal(model.templates[number][1], SHARED):
            continue
        if out and out[-1][0] == f and top <= out[-1][4]:
            _, q, d, start, stop = out.pop()
            p, c = max((p, c), (q, d))
            top, last = start, max(stop, last)
        out.append((f, p, c, top, last))
    return out


def background_lines(docs: DataFrame, most: int = BACKGROUND) -> list[str]:
    """At most `most` distinct lines of the corpus, the first `CUT` characters of each, drawn by a hash.

    A threshold for the hash, from an estimate of the distinct lines, is applied where the lines are read, so that a few times `most`
    lines leave the tasks however large the corpus is; a line in a third of all documents leaves each task once."""
    line = F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")
    lines = docs.select(line).filter(F.length("line") > 20).select(F.xxhash64(F.lit(SEED), "line").alias("draw"), F.substring("line", 1, CUT).alias("line"))
    distinct = max(1, lines.agg(F.approx_count_distinct("draw")).first()[0])
    least = -(1 << 63)
    limit = least + min((1 << 64) - 1, int((1 << 64) * (2 * most + 200) / distinct))
    drawn = lines.filter(F.col("draw") <= limit).groupBy("draw").agg(F.min("line").alias("line"))
    return [r.line for r in drawn.orderBy("draw").limit(most).collect()]


def train(docs: DataFrame, background: int = BACKGROUND) -> LicenceModel:
    """Fit on the notices' variants and at most `background` lines of the corpus.

    What is needed to calibrate comes from a first fit without a fifth of the notices, of the sentences that are none, and of the lines, each
    whole with all its variants; the model itself is then fitted on all of them."""
    sample = background_lines(docs, background)
    rng = random.Random(SEED)
    families = [*sorted(TEMPLATES), UNKNOWN]
    templates = [(f, hashed.pair_hashes(_hashes(t.encode()))) for f, name in enumerate(families[:-1]) for t in TEMPLATES[name]]
    template_pairs = [t.tolist() for _, t in templates]
    windows = []
    for line in sample:
        words = line.split()
        first = rng.randrange(max(1, len(words) - WINDOW))
        window = " ".join(words[first : first + WINDOW]) if rng.random() < 0.7 else line
        codes = _hashes(window.encode())
        mine = set(hashed.pair_hashes(codes).tolist()) if len(codes) > 1 else set()
        if max(sum(x in mine for x in t) / len(t) for t in template_pairs) < 0.4:
            windows.append(window)
    fillers = [w for line in windows[:300] for w in line.split()]
    unknown = len(families) - 1
    # texts with their variants: what is held out is held out whole
    groups = [([t], f) for f, name in enumerate(families[:-1]) for t in TEMPLATES[name]]
    groups = [(_variants(t, fillers, rng), f) for (t,), f in groups]
    groups += [(_variants(t, fillers, rng), unknown) for t in NOT_LICENCES]
    groups += [([w], unknown) for w in windows]
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    groups += [([" ".join(rng.choices(vocabulary, k=rng.randrange(4, 25)))], unknown) for _ in range(600)]
    read = [[(h, f) for h in (_hashes(t.encode()) for t in texts) if len(h)] for texts, f in groups]
    fold = [zlib.crc32(texts[0].encode()) % 5 == 0 for texts, _ in groups]
    fitted = [x for part, held in zip(read, fold) if not held for x in part]
    held = [x for part, held in zip(read, fold) if held for x in part]
    rng.shuffle(fitted)
    model = LicenceModel(families, _fitted(fitted, len(families)), 0.5, templates)
    model.linear.temperature, model.least = _calibrated(model, held) if held else (1.0, 0.5)
    temperature = model.linear.temperature
    every = [x for part in read for x in part]
    rng.shuffle(every)
    model.linear = _fitted(every, len(families))
    model.linear.temperature = temperature
    return model


def _fitted(examples: list[tuple[np.ndarray, int]], classes: int) -> hashed.Linear:
    rows, buckets, values = [], [], []
    for i, (h, _) in enumerate(examples):
        both = np.concatenate(_buckets(h))
        rows.append(np.full(len(both), i))
        buckets.append(both)
        values.append(np.full(len(both), 1 / np.sqrt(len(both))))
    targets = np.eye(classes)[[f for _, f in examples]]
    rows, buckets, values = np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)
    shared = np.bincount(buckets, minlength=BUCKETS)[buckets] > 2  # what hardly any text holds can only be learnt by heart
    return hashed.fit(rows[shared], buckets[shared], values[shared], targets, BUCKETS, steps=40)


def _calibrated(model: LicenceModel, held: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """(temperature of the least cross entropy, least probability that a text of no licence rarely reaches)."""
    truth = np.array([f for _, f in held])
    at = np.arange(len(held))

    model.linear.temperature = 1.0
    plain = np.log(np.maximum(np.concatenate([model.shares(h, np.array([0]), np.array([len(h)])) for h, _ in held]), 1e-300))

    def measured(temperature: float) -> np.ndarray:
        e = np.exp(plain / temperature)
        return e / e.sum(axis=1, keepdims=True)

    tried = {t: -np.log(np.maximum(measured(t)[at, truth], 1e-9)).mean() for t in (2.0 ** np.arange(-3, 3.5, 0.5)).tolist()}
    best = min(tried, key=tried.get)
    strangers = np.sort(measured(best)[truth == len(model.families) - 1][:, :-1].max(axis=1))
    return best, float(np.clip(np.quantile(strangers, 1 - FALSE_ALARMS) if len(strangers) else 0.5, 0.05, 0.9))


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per input row: doc_id, n_paragraphs (lines with a word), n_licences (lines and wrapped notices with a confirmed licence), family (the likeliest,
    or unknown), probability and containment of that one, families (all confirmed, by name)."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hashed.WordTable(_attributes, 1)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()))
        names = ["doc_id", "n_paragraphs", "n_licences", "family", "probability", "containment", "families"]

        def read(content: bytes) -> tuple:
            paragraphs, found, across = 0, [], []
            words: list[bytes] = []
            sizes: list[int] = []
            marks: list[int] = []
            rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last words of the part before, and their lines

            def close() -> None:
                """Read the lines that are held: all words at once, less those that are mere marks."""
                nonlocal rest
                hashes = np.concatenate([table.look_up(words[i : i + 200_000])[1][:, 0] for i in range(0, len(words), 200_000)])
                real = hashes > 0
                ends = np.cumsum(sizes)
                before = np.append(0, np.cumsum(real))
                lengths = before[ends] - before[ends - sizes]
                first = paragraphs - len(sizes)
                found.extend((f, p, c, first + i) for f, p, c, i in model.found(hashes[real], lengths))
                real[marks] = False
                lines = np.repeat(np.arange(first, paragraphs), sizes)[real]
                hashes, lines = np.append(rest[0], hashes[real]), np.append(rest[1], lines)
                across.extend(model.wrapped(hashes, lines, found))
                rest = hashes[-WINDOW:], lines[-WINDOW:]
                words.clear(), sizes.clear(), marks.clear()

            for line in content.split(b"\n"):
                mine = line.split()
                if not mine:
                    continue
                paragraphs += 1
                if mine[0].lower() in COMMENTS:
                    marks.append(len(words))
                words.extend(mine)
                sizes.append(len(mine))
                if len(words) > 100_000:  # a long text is read in parts of whole lines
                    close()
            if words:
                close()
            notices = joined(model, across, found)
            licensed = len({i for *_, i in found}) + len({top for *_, top, _ in notices})
            found.extend(x[:4] for x in notices)
            if not found:
                return paragraphs, 0, UNKNOWN, None, None, []
            f, p, c, _ = min(found, key=lambda x: (-x[1], x[0], -x[2]))
            return paragraphs, licensed, model.families[f], p, c, sorted({model.families[x[0]] for x in found})

        for batch in batches:
            columns = list(zip(*[read(t) for t in bytes_of(batch.column(1))])) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, n_paragraphs bigint, n_licences bigint, family string, probability double, containment double, families array<string>"
    return map_batches(rows, run, schema)

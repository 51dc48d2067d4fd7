"""Licence scan: a trained paragraph classifier over word n-grams, with an unknown class and comparison to templates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_words, one, require, sample_below, slices, tidy, unit_hash

#: Customary notices of each licence family; further wordings can be passed in their place.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "Released under the LGPL v2.1.", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "public-domain": ("This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain.", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}
#: Wordings that speak of licences without naming a known family, and of other things in like words.
UNKNOWN = (
    "Licensed under the terms of the vendor agreement.", "All rights reserved; use is governed by the commercial license.", "Released under the Example Community License, version 7.",
    "This work is licensed under a proprietary licence.", "Distributed under the Research Only License.", "SPDX-License-Identifier: LicenseRef-Custom",
)
OTHER = (
    "The driver lost the license after the accident.", "A version of this work was released in the spring.", "The general public is welcome at the free software meeting.", "Permission to enter was granted by the owner.",
    "The university of Massachusetts is commonly called MIT by nobody.", "Apache helicopters flew over the valley.", "Creative people are common in this work.", "Version 2.0 is faster than version 1.", "Use the form to modify the conditions.",
)
NO_LICENCE, UNKNOWN_LICENCE = "none", "unknown"
#: Paragraphs of the corpus, first in a hash order of their documents, that stand for text without a licence.
SAMPLE, PARAGRAPH = 2_000, 400
#: The weight of text without a licence in training: words never seen leave a paragraph with it.
PLAIN_SHARE = 0.7
WIDTH, LONGEST = 1 << 15, 3
DETECT, CERTAIN, CONFIRM, HINT = 0.7, 0.1, 0.8, 0.3
_TRIM = "\"'`.,;:!?()[]{}<>*#-_/|"
_MIX, _MIX2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, code of every word, offsets of texts): lower-cased words without marks at their ends."""
    words, offsets = flat_words(texts)
    coded = words.dictionary_encode()
    clean = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _TRIM)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(clean), 0).to_numpy(zero_copy_only=False)
    if len(codes) and not full.all():
        kept = full[codes]
        offsets, codes = np.concatenate([[0], np.cumsum(kept)])[offsets], codes[kept]
    return clean.to_pylist(), codes, offsets


def grams(names: list[str], codes: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 3: (feature of the n-gram that starts at each word, whether it fits in its text)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[codes]
    size = np.diff(offsets)
    left = np.repeat(offsets[1:], size) - np.arange(len(h))
    rolled, out = h * _MIX, []
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(31))) * _MIX2 + h[n - 1 :] if len(rolled) > 1 else rolled[:0]
        fits = left[: len(rolled)] >= n
        mixed = (rolled ^ (rolled >> np.uint64(29))) * _MIX
        out.append((((mixed >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64), fits))
    return out


@dataclass
class Classifier:
    """weights[feature, class] of a multinomial logistic regression on n-gram counts over the root of their number."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0

    def logits(self, names: list[str], codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        total, n = np.zeros((len(size), len(self.classes)), np.float32), np.zeros(len(size))
        if len(codes):
            each = np.zeros((len(codes), len(self.classes)), np.float32)
            for index, fits in grams(names, codes, offsets):
                each[: len(index)][fits] += self.weights[index[fits]]
            has = size > 0
            total[has] = np.add.reduceat(each, offsets[:-1][has], axis=0)
            n = sum(np.maximum(0, size - k) for k in range(LONGEST))
        return (total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.heat

    def span_logits(self, names: list[str], codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logits of the spans of words from ``starts`` to ``ends``, which may overlap: differences of running sums."""
        total, size = np.zeros((len(starts), len(self.classes))), ends - starts
        for n, (index, _) in enumerate(grams(names, codes, np.array([0, len(codes)])), 1):
            summed = np.zeros((len(index) + 1, len(self.classes)))
            np.cumsum(self.weights[index], axis=0, dtype=np.float64, out=summed[1:])
            has = size >= n
            total[has] += summed[ends[has] - n + 1] - summed[starts[has]]
        n = sum(np.maximum(0, size - k) for k in range(LONGEST))
        return (total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.heat

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(*tokens(pa.array(texts, pa.large_string())))
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


_AROUND = ("Copyright", "(c)", "2021", "the", "authors", "project", "See", "file", "for", "details")


def _variants(text: str, random: np.random.Generator, n: int) -> list[str]:
    """The text with words left out, added around it, or cut, as notices are met in the wild."""
    words, out = text.split(), [text, text.upper(), text.lower()]
    for _ in range(n):
        w = [x for x in words if random.random() > 0.08] or words
        if random.random() < 0.3 and len(w) > 8:
            i = int(random.integers(0, len(w) - 7))
            w = w[i : i + int(random.integers(8, len(w) + 1))]
        if random.random() < 0.4:
            w = [str(x) for x in random.choice(_AROUND, int(random.integers(1, 5)))] + w
        if random.random() < 0.4:
            w = w + [str(x) for x in random.choice(_AROUND, int(random.integers(1, 5)))]
        out.append(" ".join(w))
    return out


def _denied(text: str, random: np.random.Generator, n: int) -> list[str]:
    """The text denied, or beside another party's terms: its family doesn't hold."""
    ends = ("; all rights reserved", "", " without a written agreement", ", but under the terms of the vendor agreement", " and the commercial license")
    low = text[:1].lower() + text[1:]
    return [str(random.choice(("This software is not ", "Not ", "It may not be ", "This work is no longer "))) + low.rstrip(".") + str(random.choice(ends)) for _ in range(n)]


def fit(plain: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, seed: int = 0, rounds: int = 120) -> Classifier:
    """Trains on variants of the templates, on wordings of unknown licences and denied templates, and on ``plain`` paragraphs as text without one.

    Plain paragraphs that hold most of a wording's word pairs are left out, as they aren't plain. For calibration a first
    fit goes without a fifth of the wordings, with all their variants: the heat that divides the logits is the one under
    which these unseen wordings are most likely. The second fit learns from all.
    """
    random = np.random.default_rng(seed)
    classes = [NO_LICENCE, UNKNOWN_LICENCE, *templates]
    wordings = [_pairs(_words(t)) for own in (*templates.values(), UNKNOWN) for t in own]
    plain = [t for t in plain if likeness(_pairs(_words(t)), wordings)[0] < CONFIRM]
    families: list[tuple[int, list[str]]] = [(0, [t, *_variants(t, random, 1)[3:], *t.split()[:1]]) for t in plain]  # class, a wording's variants
    families += [(0, _variants(t, random, 20)) for t in OTHER] + [(0, [*[a] * 5, *(f"{a} {b}" for b in _AROUND)]) for a in _AROUND] + [(0, [""])]
    families += [(k, _variants(t, random, 30)) for k, own in enumerate((UNKNOWN, *templates.values()), 1) for t in own]
    families += [(1, _denied(t, random, 4)) for own in templates.values() for t in own]
    rows = [(v, k, n) for n, (k, own) in enumerate(families) for v in own]
    names, codes, offsets = tokens(pa.array([t for t, _, _ in rows], pa.large_string()))
    target, wording = (np.array([r[k] for r in rows]) for k in (1, 2))
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(rows)), size)
    parts = [(index[fits], owner[: len(index)][fits]) for index, fits in grams(names, codes, offsets)]
    index, of = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(of, kind="stable")
    index, of = index[order], of[order]
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))
    mass = np.where(np.arange(len(classes)) == 0, PLAIN_SHARE, (1 - PLAIN_SHARE) / (len(classes) - 1))
    begin, has = np.flatnonzero(np.diff(of, prepend=-1)), np.unique(of)

    def train(learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, bias, and the logits of all rows, from the rows of ``learn``, by full-batch steps of Adam."""
        weight = (mass / np.maximum(1, np.bincount(target[learn], minlength=len(classes))))[target] * learn
        w, b = np.zeros((WIDTH, len(classes))), np.zeros(len(classes))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]

        def logits() -> np.ndarray:
            z = np.zeros((len(rows), len(classes)))
            if len(index):
                z[has] = np.add.reduceat(w[index], begin, axis=0)
            return z * scale[:, None] + b

        for r in range(1, rounds + 1):
            z = logits()
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target] -= 1
            p *= weight[:, None]
            g = np.stack([np.bincount(index, (p[:, k] * scale)[of], WIDTH) for k in range(len(classes))], axis=1) + 1e-5 * w
            for x, d, m, s in ((w, g, state[0], state[1]), (b, p.sum(axis=0), state[2], state[3])):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                x -= 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(s / (1 - 0.99**r)) + 1e-8)
        return w, b, logits()

    learn = (random.random(wording.max() + 1) > 0.2)[wording]
    z, t = train(learn)[2][~learn], target[~learn]

    def loss(heat: float) -> float:
        y = z / heat
        y -= y.max(axis=1, keepdims=True)
        return float(-(y[np.arange(len(t)), t] - np.log(np.exp(y).sum(axis=1))).mean()) if len(t) else 0.0

    w, b, _ = train(np.ones(len(rows), bool))
    return Classifier(classes, w.astype(np.float32), b, min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss))


def _words(text: str) -> list[str]:
    names, codes, _ = tokens(pa.array([text], pa.large_string()))
    return [names[k] for k in codes]


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


def likeness(own: set[tuple[str, ...]], templates: list[set[tuple[str, ...]]]) -> tuple[float, int]:
    """The largest share of a template's word pairs that ``own`` has, and the number of these pairs."""
    return max(((n / len(p), n) for p in templates for n in (len(own & p),)), default=(0.0, 0))


def paragraphs(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of texts that aren't blank, the paragraph of each, and the offsets of texts in paragraphs.

    A paragraph is a run of lines that no blank line parts.
    """
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    after = np.concatenate([[False], full[:-1]]) if len(full) else full
    after[offsets[:-1][np.diff(offsets) > 0]] = False
    first = full & ~after
    return lines.filter(pa.array(full)), np.cumsum(first)[full] - 1, np.concatenate([[0], np.cumsum(first)])[offsets]


def reach(offsets: np.ndarray, block: np.ndarray, most: int) -> np.ndarray:
    """For every line the last line of its paragraph that a template of ``most`` words can meet which starts in it."""
    own = np.arange(len(block))
    far = np.clip(np.searchsorted(offsets[1:], offsets[1:] + most - 1), own, np.searchsorted(block, block, side="right") - 1)
    return np.where(np.diff(offsets) > 0, far, own)


def _settled(hits: list[tuple]) -> list[tuple]:
    """Of the hits (first line, last line, licence, pairs, ...) of a paragraph those that stay, by their lines.

    Families come before ``unknown``, those with more of a template's pairs and fewer lines first. A hit stays unless its lines meet
    those of one that stays; two families may share lines if neither's lines are all within the other's.
    """
    kept: list[tuple] = []
    for h in sorted(hits, key=lambda h: (h[2] == UNKNOWN_LICENCE, -h[3] if h[2] != UNKNOWN_LICENCE else 0, h[1] - h[0], h[0])):
        meets = [k for k in kept if h[0] <= k[1] and k[0] <= h[1]]
        within = any((k[0] <= h[0] and h[1] <= k[1]) or (h[0] <= k[0] and k[1] <= h[1]) for k in meets)
        if not meets or (h[2] != UNKNOWN_LICENCE and not within and all(k[2] != h[2] for k in meets)):
            kept.append(h)
    return sorted(kept)


def fit_on(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> Classifier:
    """``fit`` with one paragraph as it is scanned, lines between blank ones, cut at PARAGRAPH characters, of each of ``sample`` documents, first in a hash order.

    Documents are chosen by comparing their hash with a bound that follows from their number, so next to no more than
    the sample reaches the driver; rows that repeat an id count once.
    """
    blocks = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda x: F.length(F.trim(x)) > 0)
    own = docs.where(F.length(text_col) > 0).select(F.xxhash64(F.lit("licence"), F.col(id_col)).alias("h"), F.col(text_col))
    chosen = own.where(unit_hash("h") < sample_below(own.count(), sample)).select("h", F.substring(F.get(blocks, F.pmod("h", F.greatest(F.size(blocks), F.lit(1))).cast("int")), 1, PARAGRAPH).alias("p"))
    rows = sorted((r["h"], r["p"]) for r in chosen.where(F.length("p") > 0).groupBy("h").agg(F.min("p").alias("p")).collect())
    return fit([p for _, p in rows[:sample]], templates)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, detect: float = DETECT, certain: float = CERTAIN, confirm: float = CONFIRM) -> DataFrame:
    """For every row: id_col, n_paragraphs long, licences array<string> (sorted, distinct), found array of (paragraph, licence, probability, likeness).

    Paragraphs are the runs of lines between blank lines, of whole texts. Every line of one, and every span of lines from it on that
    the longest template can meet, is classified. A span counts as a licence if all classes but ``none``
    have ``detect`` or more of the probability. Its family is the likeliest one if that is likelier than ``unknown``, has ``certain``
    or more of the rest and the span holds ``confirm`` or more of a template's word pairs; else it is ``unknown``, or no licence
    if it has less than HINT of the word pairs of any wording.
    Of spans that overlap one is told (see ``_settled``). paragraph is its number from 0.
    Null, empty and blank texts have no paragraphs; a very long text is read whole, by one task. Rows that repeat each give a row; an empty table gives no rows; other
    columns are ignored.
    """
    require(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH by classes, whatever the input
    hit = T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("licence", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("likeness", T.DoubleType())])
    shape = T.StructType([docs.schema[id_col], T.StructField("n_paragraphs", T.LongType()), T.StructField("licences", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(hit))])
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("licence", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))

    @tidy
    def run(batches):
        own: Classifier = sent.value
        known = {name: [_pairs(_words(t)) for t in texts] for name, texts in templates.items()}
        every = [*(_pairs(_words(t)) for t in UNKNOWN), *(p for pairs in known.values() for p in pairs)]
        most = max(math.ceil(len(_words(t)) / confirm) for texts in (UNKNOWN, *templates.values()) for t in texts)  # room for words put in
        for batch in (part for b in batches for part in slices(b, 1)):
            lines, block, tops = paragraphs(one(batch.column(1)))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            hits: dict[int, list[tuple]] = {}
            names, codes, offsets = tokens(lines)
            far = reach(offsets, block, most)
            n_spans = np.concatenate([[0], np.cumsum(far - np.arange(len(far)) + 1)])
            i = 0
            while i < len(lines):
                j = max(i + 1, min(int(np.searchsorted(x, x[i] + 200_000, side="right")) - 1 for x in (offsets, n_spans)))
                first = np.repeat(np.arange(i, j), np.diff(n_spans[i : j + 1]))
                last = first + np.arange(n_spans[i], n_spans[j]) - n_spans[first]
                low, starts, ends = offsets[i], offsets[first], offsets[last + 1]
                z = own.span_logits(names, codes[low : ends.max()], starts - low, ends - low)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for k in np.flatnonzero(p[:, 0] <= 1 - detect).tolist():
                    best = 2 + int(p[k, 2:].argmax())
                    pairs, share = _pairs([names[c] for c in codes[starts[k] : ends[k]]]), float(p[k, best] / (1 - p[k, 0]))
                    like, n = likeness(pairs, known[own.classes[best]])
                    # the unknown class decides: a family has to be likelier than it, and a template has to confirm
                    sure = p[k, best] > p[k, 1] and share >= certain and like >= confirm
                    if not sure and max(like, likeness(pairs, every)[0]) < HINT:
                        continue
                    hits.setdefault(int(block[first[k]]), []).append((int(first[k]), int(last[k]), own.classes[best] if sure else UNKNOWN_LICENCE, n, float(1 - p[k, 0]) if not sure else float(p[k, best]), like))
                i = j
            for k, each in sorted(hits.items()):
                doc = int(np.searchsorted(tops, k, side="right")) - 1
                found[doc] += [{"paragraph": k - int(tops[doc]), "licence": h[2], "probability": h[4], "likeness": h[5]} for h in _settled(each)]
            licences = [sorted({x["licence"] for x in f}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(tops), pa.int64()), pa.array(licences, pa.list_(pa.string())), pa.array(found, kind)], names=[f.name for f in shape.fields])

    return docs.select(id_col, text_col).mapInArrow(run, shape)

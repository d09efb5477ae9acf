"""Licence scan: a paragraph classifier over word n-grams, confirmed by comparison with templates.

A paragraph's features are the word unigrams and bigrams that it holds; how often it holds one doesn't matter. A sparse
multinomial logistic regression, trained on variations of the built-in templates and on ordinary pieces of text, gives
each family a score. The margin of the best family over *unknown* is calibrated on ordinary pieces and variations which
training hasn't seen: a logistic curve gives the probability that a piece is a licence, and its threshold is where the
tail of the ordinary margins falls below FALSE_RATE, but never above what held-out variations reach: what lies below is
*unknown*. What remains is compared with the family's templates, and a paragraph is confirmed if enough of a template's words
stand in it in order. Paragraphs lie between blank lines; their sentences, lines and runs of these are scored as well as
the whole.

Ordinary pieces for training and calibration are SAMPLE_PIECES sentences and lines of at most SAMPLE_CHARS characters,
chosen by a hash from about SAMPLE_ROWS documents; scanning covers every paragraph of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The sample for training and calibration: documents, pieces of them, characters of a piece.
SAMPLE_ROWS, SAMPLE_PIECES, SAMPLE_CHARS = 2_000, 24_000, 1_000
#: Share of a template's words which a confirmed paragraph holds in order.
CONFIRMED = 0.6
#: Words from the begin of a run's first piece to that of its last: eight times the longest template.
SPAN = 300
#: Share of ordinary pieces that calibration lets pass, before templates are compared.
FALSE_RATE = 1e-3

TEMPLATES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License, either version 2 or any later version.", "Licensed under the GPL version 2."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL version 3."],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Licensed under the BSD license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this work may be reproduced without written permission.", "This document is confidential and proprietary."],
}
FAMILIES = ("unknown", *TEMPLATES)
_PARAGRAPH = np.zeros(256, bool)
_PARAGRAPH[[10, 13]] = True
SCHEMA = "doc_id long, paragraph int, family string, probability double, overlap double, begin long, end long"


def features(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the unigrams and bigrams of each of the texts of ``w``."""
    text = np.repeat(np.arange(len(w.doc) - 1), np.diff(w.doc))
    two, whole = common.grams(w, 2)
    return np.concatenate([text, text[: len(two)][whole]]), np.concatenate([w.hash, two[whole]])


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end bytes of the paragraphs, the lines of the texts; blank ones have no words and do no harm."""
    cut = np.flatnonzero(_PARAGRAPH[data])
    begin = np.unique(np.r_[offsets[:-1], cut + 1])
    begin = begin[begin < len(data)]
    return begin, np.r_[begin[1:], len(data)].astype(np.int64)


class Model:
    """Weights (families, features) of the sorted feature hashes ``known``, intercepts, and the calibration: threshold and curve.

    ``curve``: intercept and slope of the logistic curve that turns a margin over *unknown* into a probability.
    """

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: np.ndarray, threshold: float = 0.5, curve: tuple[float, float] = (0.0, 1.0)):
        self.known, self.weights, self.bias, self.threshold, self.curve = known, weights, bias, threshold, curve
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(known >> np.uint64(44)).astype(np.int64)] = True

    def held(self, where: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) pairs of known features."""
        may = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, hashes[may]), len(self.known) - 1)
        hit = self.known[at] == hashes[may]
        pairs = np.unique(where[may[hit]] * len(self.known) + at[hit])
        return pairs // len(self.known), pairs % len(self.known)

    def scores(self, rows: int, where: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """(rows, families): sums of the weights of the features present, over the root of the number of all features."""
        out = np.zeros((rows, len(FAMILIES)))
        n = np.maximum(1, np.bincount(where, minlength=rows)) ** 0.5
        text, feature = self.held(where, hashes)
        for f in range(len(FAMILIES)):
            out[:, f] = np.bincount(text, self.weights[f, feature], rows)
        return out / n[:, None] + self.bias

    def margins(self, texts: list[str]) -> np.ndarray:
        s = self.scores(len(texts), *_rows(texts))
        return s[:, 1:].max(1) - s[:, 0]

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30))))


def _variations(rng: np.random.Generator, per_template: int = 40) -> tuple[list[str], list[int]]:
    """Templates with changed versions, years, holders, cases and with words left out or added around."""
    around = ["copyright 2019 example", "see the file for details", "this project is", "note:", "the contents are", "unless stated otherwise"]
    texts, labels = [], []
    for f, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            for i in range(per_template):
                words = template.split()
                if i and len(words) > 6:
                    words = [x for x in words if rng.random() > 0.08]
                text = " ".join(words)
                if i % 3 == 1:
                    text = f"{around[rng.integers(len(around))]} {text}"
                if i % 4 == 2:
                    text = f"{text} {around[rng.integers(len(around))]}"
                texts.append(text.upper() if i % 11 == 5 else text)
                labels.append(f)
    return texts, labels


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return features(common.Words(data, np.cumsum([0, *map(len, raw)]), common.NOT_ALNUM))


_LICENCE = re.compile(r"licen[sc]e|copyright|all rights reserved|creative commons|redistribut|cc[ -]by", re.I)


def fit(ordinary: list[str], steps: int = 200, rate: float = 1.0, penalty: float = 1e-4, seed: int = 11) -> Model:
    """Train on half of the template variations and of the ordinary pieces; calibrate on the other half."""
    rng = np.random.default_rng(seed)
    varied, families = _variations(rng)
    ordinary = [t for t in ordinary if t.strip() and not _LICENCE.search(t)]
    # One word again and again is ordinary, too, and no licence has only words of its own.
    words = sorted({x for f in FAMILIES[1:] for t in TEMPLATES[f] for x in re.findall(r"[A-Za-z0-9]+", t.lower())})
    ordinary += [f"{x}. " * n for i, x in enumerate(words) for n in (1 + i % 3, 40)]
    training, held = ordinary[::2], ordinary[1::2]
    texts, labels = varied[::2] + training, families[::2] + [0] * len(training)
    where, hashes = _rows(texts)
    y = np.eye(len(FAMILIES))[labels]
    # Words that no licence has tell nothing: they get no weights.
    known = np.unique(hashes[np.array(labels)[where] > 0])
    model = Model(known, np.zeros((len(FAMILIES), len(known))), np.zeros(len(FAMILIES)))
    text, feature = model.held(where, hashes)
    n = np.maximum(1, np.bincount(where, minlength=len(texts))) ** 0.5
    # Texts without known features are all alike: one row of them, with their number as weight.
    full = np.unique(np.r_[text, np.flatnonzero(np.array(labels) > 0)])
    x = np.zeros((len(full) + 1, len(known)))
    x[np.searchsorted(full, text), feature] = 1 / n[text]
    balance = 1 / np.maximum(1, np.bincount(labels, minlength=len(FAMILIES)))[labels] / len(FAMILIES)
    weight = np.r_[balance[full], balance.sum() - balance[full].sum()]
    y = np.r_[y[full], np.eye(len(FAMILIES))[:1]]
    w, b = model.weights, model.bias
    for step in range(steps):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) * weight[:, None]
        pace = rate * 20 / (1 + step / 50)
        w -= pace * (g.T @ x + penalty * w)
        b -= pace * g.sum(0)
    w[np.abs(w) < 0.05] = 0  # sparse
    kept = w.any(0)
    model = Model(known[kept], w[:, kept], b)
    return calibrate(model, held, varied[1::2])


def calibrate(model: Model, ordinary: list[str], licences: list[str]) -> Model:
    """Set curve and threshold from pieces that training hasn't seen.

    Both classes weigh the same for the curve. The threshold is the margin of probability one half, or where the tail of the
    ordinary margins, fitted as exponential beyond their 98th percentile so that no single piece decides, falls to
    FALSE_RATE if that is more; but no more than the margin that all but a hundredth of the licences reach.
    """
    good = np.sort(model.margins(licences))
    floor = float(good[len(good) // 100])
    if not ordinary:
        model.threshold = min(0.5, floor)
        return model
    m = model.margins(ordinary)
    x, y = np.r_[m, good], np.r_[np.zeros(len(m)), np.ones(len(good))]
    weight = np.r_[np.full(len(m), 1 / len(m)), np.full(len(good), 1 / len(good))]
    curve, one = np.zeros(2), np.c_[np.ones(len(x)), x]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ curve, -30, 30)))
        step = np.linalg.solve(one.T @ (one * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), one.T @ (weight * (y - p)) - 1e-3 * curve)
        curve += np.clip(step, -2, 2)
    model.curve = (float(curve[0]), float(curve[1]))
    start, share = float(np.quantile(m, 0.98)), 0.02
    beyond = m[m > start]
    scale = float(np.median(beyond) - start) / np.log(2) if len(beyond) else 0.0
    model.threshold = min(max(start + scale * np.log(share / FALSE_RATE), -curve[0] / curve[1]), floor)
    return model


def template_words() -> list[list[list[int]]]:
    """Word hashes of each family's templates."""
    return [[]] + [[common.hash_of(re.findall(r"[A-Za-z0-9]+", t)).tolist() for t in TEMPLATES[f]] for f in FAMILIES[1:]]


def overlap(words: list[int], template: list[int]) -> float:
    """Length of the longest common subsequence over the template's length."""
    row = [0] * (len(template) + 1)
    own = set(template)
    for x in words:
        if x not in own:
            continue
        last = 0
        for j, y in enumerate(template, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / max(1, len(template))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, pieces: int = SAMPLE_PIECES) -> list[str]:
    """Pieces (lines, and what full stops make of them) of about ``rows`` documents, ``pieces`` at most, in the order of a hash.

    Bounds on the hashes come first, so that tasks send little more than that together, however many there are; a piece
    of more than SAMPLE_CHARS characters isn't chosen.
    """
    chosen = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    share = min(1.0, rows / max(1, chosen.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    cut = chosen.where(place < F.lit(int(2**53 * share))).select("doc_id", F.posexplode(F.split("text", r"[\r\n]|(?<=\.)(?=\s)")).alias("at", "piece"))
    cut = cut.where((F.length("piece") <= SAMPLE_CHARS) & (F.length(F.trim("piece")) > 0))
    order = F.xxhash64("doc_id", "at", "piece")
    return [r[0] for r in cut.orderBy(order, "piece").limit(pieces).select("piece").collect()]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train and calibrate on ordinary pieces of ``docs``."""
    return fit(sample(docs, rows))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """SCHEMA: the paragraphs of ``docs`` (doc_id, text) that hold a licence, with byte ranges in the UTF-8 text.

    Scored are each piece (a sentence, or what a line has of it), runs of adjacent pieces of a paragraph and whole
    paragraphs. Of those that overlap and name one family, the one that holds most of a template is given, or else the
    shortest; ``paragraph`` is the number of the line where it begins. Null and empty texts give no rows; repeated rows give repeated rows; other columns are ignored.
    """
    common.bounded_batches(common.session(docs))
    model = model or train(docs)
    fitted = (model.known, model.weights, model.bias, model.threshold, model.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*fitted)
        templates = template_words()
        for batch in batches:
            found = []
            for i, _, data, offsets in common.text_slices(batch.column(1)):
                begin, end = pieces(data, offsets)
                if not len(begin):
                    continue
                w = common.Words(data, np.r_[begin, len(data)], common.NOT_ALNUM)
                lines, _ = paragraphs(data, offsets)
                best = []
                held = confirmed(own, templates, w)
                first, last = runs(w, blocks(data, offsets, begin), templates)
                if len(first):
                    texts = [data[x:y] for x, y in zip(begin[first].tolist(), end[last].tolist(), strict=True)]
                    wide = common.Words(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), common.NOT_ALNUM)
                    best = [(share, n, f, p, int(begin[first[x]]), int(end[last[x]])) for x, share, n, f, p in confirmed(own, templates, wide)]
                best += [(share, n, f, p, int(begin[x]), int(end[x])) for x, share, n, f, p in held]
                chosen: dict[int, list[tuple[int, int]]] = {}
                rows = []
                for share, _, f, p, x, y in sorted(best, key=lambda r: (-r[0], r[1], r[4])):
                    if all(y <= a or x >= b for a, b in chosen.setdefault(f, [])):
                        chosen[f].append((x, y))
                        rows.append((x, y, f, p, share))
                for x, y, f, p, share in sorted(rows):
                    t = int(np.searchsorted(offsets, x, "right") - 1)
                    line = int(np.searchsorted(lines, x, "right") - np.searchsorted(lines, offsets[t], "left") - 1)
                    found.append((batch.column(0)[i + t].as_py(), line, FAMILIES[f], p, share, int(x - offsets[t]), int(y - offsets[t])))
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "paragraph", "family", "probability", "overlap", "begin", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def confirmed(model: Model, templates: list[list[list[int]]], w: common.Words) -> list[tuple[int, float, int, int, float]]:
    """(text, overlap, words, family, probability) of the texts of ``w`` that hold a licence."""
    s = model.scores(len(w.doc) - 1, *features(w))
    top = s[:, 1:].argmax(1) + 1
    out = []
    for x in np.flatnonzero(s[np.arange(len(s)), top] - s[:, 0] > model.threshold).tolist():
        words = w.hash[w.doc[x] : w.doc[x + 1]].tolist()
        share, _, f = max((max(overlap(words, t) for t in templates[f]), float(s[x, f]), -f) for f in range(1, len(FAMILIES)) if s[x, f] - s[x, 0] > 0)
        if share >= CONFIRMED:
            out.append((x, share, len(words), -f, model.probability(float(s[x, -f] - s[x, 0]))))
    return out


def blocks(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each piece the number of its paragraph: blank lines and the texts' begins divide paragraphs."""
    lines, ends = paragraphs(data, offsets)
    ink = np.r_[0, np.cumsum(~_WHITE_AFTER[data])]
    feed = (data[lines] == 10) & (lines > 0) & (data[lines - 1] == 13)  # the second half of a line's end
    new = np.isin(lines, offsets[:-1]) | ((ink[ends] == ink[lines]) & ~feed)
    return np.cumsum(new)[np.searchsorted(lines, begin, "right") - 1]


def runs(w: common.Words, block: np.ndarray, templates: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """First and last piece of the runs of several pieces of a paragraph that may hold a template, and of such paragraphs.

    No order can be kept of words that aren't there: only runs with CONFIRMED of a template's words, in any order, remain,
    and of these, for each last piece and number of words, the shortest.
    """
    vocabulary = np.unique(np.array([x for f in templates for t in f for x in t], np.uint64))
    k = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[k] == w.hash)
    piece, k = np.searchsorted(w.doc, hit, "right") - 1, k[hit]
    names, where = np.unique(block[piece], return_inverse=True)
    counts = np.bincount(where * len(vocabulary) + k, minlength=len(names) * len(vocabulary)).reshape(len(names), len(vocabulary))
    at = np.searchsorted(where, np.arange(len(names) + 1))
    worded = np.flatnonzero(np.diff(w.doc))
    out = set()
    for template in (t for f in templates for t in f):
        own = np.bincount(np.searchsorted(vocabulary, np.array(template, np.uint64)), minlength=len(vocabulary))
        least = CONFIRMED * len(template)
        for x in np.flatnonzero(np.minimum(counts, own).sum(1) >= least - 1e-9).tolist():
            inside = slice(at[x], at[x + 1])
            held: dict[int, list[int]] = {}
            for p, word in zip(piece[inside].tolist(), k[inside].tolist(), strict=True):
                if own[word]:
                    held.setdefault(p, []).append(word)
            if len(held) < 2:
                continue
            these = worded[block[worded] == names[x]]
            out.add((int(these[0]), int(these[-1])))
            places, shortest = list(held), {}
            for n, i in enumerate(places):
                left, size = own.copy(), 0
                for j in places[n:]:
                    if w.doc[j] - w.doc[i] > SPAN:
                        break
                    before = size
                    for word in held[j]:
                        if left[word]:
                            left[word] -= 1
                            size += 1
                    if j > i and size > before and size >= least - 1e-9:
                        shortest[j, size] = i
            out.update((i, j) for (j, _), i in shortest.items())
    both = np.array(sorted(out), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_WHITE_AFTER = np.zeros(256, bool)
_WHITE_AFTER[[32, 9, 10, 13]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs, cut further where a sentence ends: a full stop before white space, unless a digit or short form follows."""
    begin, _ = paragraphs(data, offsets)
    stops = np.flatnonzero(data == 46)
    stops = stops[stops + 1 < len(data)]
    stops = stops[_WHITE_AFTER[data[stops + 1]]] + 1
    begin = np.unique(np.r_[begin, stops])
    return begin, np.r_[begin[1:], len(data)].astype(np.int64)

"""Licence scans: a paragraph classifier over sparse word n-grams, with template comparison to confirm it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.textio import mix, slices, small_batches, span_hashes, text_bytes, word_spans

#: Notices by family, from the licences' public texts.
TEMPLATES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "This article is distributed under the terms of the Creative Commons Attribution License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License."],
    "cc0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
}
#: Paragraphs that speak of licences without granting one, for the unknown class.
UNKNOWN = ["The driving license was renewed in version 2 of the form.", "He was licensed to practise under the old act.", "The general public may visit the works on Sunday.", "She released the book under a new title.", "Permission to enter was granted free of charge to any person.", "The common creative attribution of the work is in doubt.", "All seats reserved. The rights of way are closed.", "The software was distributed without a manual.", "A copy of the notice may be obtained at the office.", "The terms of the agreement were published by the foundation."]

BUCKET_BITS = 20
NGRAMS = 3
#: A letter or digit of ASCII in lower case, a byte of a longer character, a line feed, or a blank.
_KIND = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isalnum() and _b < 128:
        _KIND[_b] = ord(chr(_b).lower())
    elif _b >= 128 or _b == 10:
        _KIND[_b] = _b


def words_in_lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every word, the lines' starts, and the row of each line."""
    kind = _KIND[raw]
    full = np.flatnonzero(np.diff(offsets) > 0)
    lines = np.unique(np.concatenate([offsets[full], np.flatnonzero(kind == 10) + 1]))
    lines = lines[lines < len(raw)]
    row = np.searchsorted(offsets, lines, "right") - 1
    start, end = word_spans(kind)
    cut = offsets[full][1:]
    inner = cut[(kind[cut] != 32) & (kind[cut] != 10) & (kind[cut - 1] != 32) & (kind[cut - 1] != 10)] if len(cut) else cut
    if len(inner):
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return span_hashes(kind, start, end), np.searchsorted(lines, start, "right") - 1, lines, row


def ngrams(word: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word and bucket of all word n-grams whose words have one `within`."""
    first, last, buckets = [], [], []
    h = np.zeros(len(word), np.uint64)
    for n in range(1, NGRAMS + 1):
        if len(word) < n:
            break
        h = mix(h[: len(word) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :] + np.uint64(n))
        at = np.flatnonzero(within[: len(h)] == within[n - 1 :])
        first.append(at)
        last.append(at + n - 1)
        buckets.append((h[at] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(last or [none]), np.concatenate(buckets or [none])


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, bucket) of all word n-grams, the lines' starts, and the row of each line. N-grams stay within a line."""
    word, line, lines, row = words_in_lines(raw, offsets)
    first, _, bucket = ngrams(word, line)
    return line[first], bucket, lines, row


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.replace("\n", " ").encode() + b" " for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


@dataclass
class Scanner:
    """families, the last of them `unknown`; index: bucket -> 1 + feature; weight: features x families."""

    families: list[str]
    index: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    templates: dict[str, list[np.ndarray]] = field(default_factory=dict)
    several: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each template, its n-grams of two words or more

    def logits(self, line: np.ndarray, bucket: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a feature, and their logits; every other line has those of the bias."""
        feature = self.index[bucket]
        on = np.flatnonzero(feature)
        pairs = np.unique(line[on] * np.int64(len(self.weight)) + feature[on] - 1)
        at, feature = pairs // len(self.weight), pairs % len(self.weight)
        some, first, number = np.unique(at, return_index=True, return_counts=True)
        if not len(some):
            return some, np.zeros((0, len(self.families)))
        return some, np.add.reduceat(self.weight[feature], first, axis=0) / np.sqrt(number)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def examples(rng: np.random.Generator, copies: int) -> tuple[list[str], list[str]]:
    """Templates as they are, and worn: words left out, put before or after, years and names added."""
    texts, names = [], []
    noise = "the of and code file project work see more about 2019 2024 copyright c by authors page der und les para".split()
    for name, own in TEMPLATES.items():
        for template in own:
            texts.append(template)
            names.append(name)
            for _ in range(copies):
                words = [w for w in template.split() if rng.random() > 0.06]
                before, after = (list(rng.choice(noise, rng.integers(0, 5))) for _ in range(2))
                texts.append(" ".join([*before, *words, *after]))
                names.append(name)
    for text in UNKNOWN:
        for _ in range(copies):
            texts.append(" ".join(w for w in text.split() if rng.random() > 0.1))
            names.append("unknown")
    return texts, names


def fit(texts: list[str], names: list[str], held: np.ndarray, rounds: int = 300, decay: float = 1e-3) -> Scanner:
    """Multinomial logistic regression; the temperature is fitted on the held-out examples, the weights on the rest."""
    families = [*sorted(set(names) - {"unknown"}), "unknown"]
    label = np.array([families.index(n) for n in names])
    line, bucket, lines, row = grams(*flat(texts))
    line = row[line]
    known = np.unique(bucket[label[line] < len(families) - 1])
    index = np.zeros(1 << BUCKET_BITS, np.int32)
    index[known] = np.arange(1, len(known) + 1)
    model = Scanner(families, index, np.zeros((len(known), len(families))), np.zeros(len(families)))
    feature = index[bucket]
    pairs = np.unique(line[feature > 0] * np.int64(len(known)) + feature[feature > 0] - 1)
    at, feature = pairs // len(known), pairs % len(known)
    value = 1 / np.sqrt(np.bincount(at, minlength=len(texts)))[at]
    one = np.zeros((len(texts), len(families)))
    one[np.arange(len(texts)), label] = 1
    use = ~held[at]
    at_u, feature_u, value_u = at[use], feature[use], value[use]
    n, weight, bias = int((~held).sum()), np.zeros((len(known), len(families))), np.zeros(len(families))
    by_feature, by_row = np.argsort(feature_u, kind="stable"), np.argsort(at_u, kind="stable")
    f_keys, f_first = np.unique(feature_u[by_feature], return_index=True)
    r_keys, r_first = np.unique(at_u[by_row], return_index=True)
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    for t in range(1, rounds + 1):
        z = np.tile(bias, (len(texts), 1))
        z[r_keys] += np.add.reduceat(weight[feature_u[by_row]] * value_u[by_row, None], r_first, axis=0)
        e = np.exp(z - z.max(1, keepdims=True))
        error = (e / e.sum(1, keepdims=True) - one) * (~held)[:, None] / n
        slope = decay * weight / n
        slope[f_keys] += np.add.reduceat(error[at_u[by_feature]] * value_u[by_feature, None], f_first, axis=0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weight -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        bias -= 2.0 * error.sum(0)
    model.weight, model.bias = weight, bias
    logits = np.tile(bias, (len(texts), 1))
    order = np.argsort(at, kind="stable")
    keys, first = np.unique(at[order], return_index=True)
    logits[keys] += np.add.reduceat(weight[feature[order]] * value[order, None], first, axis=0)
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 41):
        z = logits[held] / temperature
        z -= z.max(1, keepdims=True)
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), label[held]]).mean()
        best = min(best, (float(loss), float(temperature)))
    model.temperature = best[1]
    several = []
    for name, own in TEMPLATES.items():
        model.templates[name] = []
        for template in own:
            word, at, _, _ = words_in_lines(*flat([template]))
            _, _, b = ngrams(word, at)
            model.templates[name].append(np.unique(b))
            several.append(len(np.setdiff1d(b, b[: len(word)])))
    model.several = np.array(several)
    return model


def in_blocks(model: Scanner, word: np.ndarray, line: np.ndarray, row: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, bool]]:
    """(row, family, probability, confirmed) of notices in blocks of several lines, n-grams spanning their line feeds.

    A block ends at a line without a word. It is read as a whole, and, where it has enough of a template, by the windows
    of its lines that have `overlap` of that template, so that what stands around a notice doesn't hide it. A window is
    passed over when, with the lines beside it that have more of the template, it is nearest to another family.
    """
    if not len(word):
        return []
    new = np.ones(len(word), bool)
    new[1:] = (np.diff(line) > 1) | (row[line[1:]] != row[line[:-1]])
    start = np.flatnonzero(new)
    long = np.repeat(line[start] != line[np.append(start[1:], len(word)) - 1], np.diff(np.append(start, len(word))))
    block = (np.cumsum(new) - 1)[long]
    word, line, doc = word[long], line[long], row[line[start]]
    first, last, bucket = ngrams(word, block)
    own, unknown, found = block[first], len(model.families) - 1, []
    templates = [(model.families.index(name), t) for name, some in model.templates.items() for t in some]
    some, logits = model.logits(own, bucket, len(start))
    p = model.probabilities(logits) if len(some) else logits
    for i in np.flatnonzero((p.argmax(1) != unknown) & (p.max(1) >= threshold)) if len(some) else ():
        has, best = np.unique(bucket[own == some[i]]), int(p[i].argmax())
        found.append((int(doc[some[i]]), best, float(p[i, best]), any(np.isin(t, has).mean() >= overlap for f, t in templates if f == best)))
    # blocks that may have enough of a template, whose n-grams of one word are taken as there
    of = np.concatenate([np.full(len(t), k) for k, (_, t) in enumerate(templates)])
    keys = np.concatenate([t for _, t in templates])
    by = np.argsort(keys, kind="stable")
    keys, of = keys[by], of[by]
    size, several = np.bincount(of), model.several
    wanted = np.zeros(1 << BUCKET_BITS, bool)
    wanted[keys] = True
    on = np.flatnonzero(wanted[bucket] & (last > first))
    pairs = np.unique(own[on] << BUCKET_BITS | bucket[on])
    low, high = (np.searchsorted(keys, pairs & ((1 << BUCKET_BITS) - 1), side) for side in ("left", "right"))
    take = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    both, count = np.unique(np.repeat(pairs >> BUCKET_BITS, high - low) * len(templates) + of[take], return_counts=True)
    near = both[count + (size - several)[both % len(templates)] >= overlap * size[both % len(templates)]]
    order = np.argsort(own, kind="stable") if len(near) else own[:0]
    for at, k in zip(near // len(templates), near % len(templates), strict=True):
        a, b = np.searchsorted(own[order], [at, at + 1])
        of_block = order[a:b]
        for family, probability in windows(model, line[first[of_block]], line[last[of_block]], bucket[of_block], *templates[k], threshold, overlap):
            found.append((int(doc[at]), family, probability, True))
    return found


def windows(model: Scanner, start: np.ndarray, end: np.ndarray, bucket: np.ndarray, family: int, template: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, float]]:
    """(family, probability) of windows of one block's lines that name the family and have `overlap` of its template, from n-grams' lines and buckets."""
    low = int(start.min())
    keys, of = np.unique(bucket, return_inverse=True)
    inside, feature = np.isin(keys, template), model.index[keys]
    use = np.flatnonzero((inside | (feature > 0))[of])
    start, end, of = start[use] - low, end[use] - low, of[use]
    weight = model.weight[np.maximum(feature, 1) - 1] * (feature > 0)[:, None]
    n, unknown = int(end.max(initial=-1)) + 1, len(model.families) - 1
    by_end, by_start = np.argsort(end, kind="stable"), np.argsort(start, kind="stable")
    end_at, start_at = np.searchsorted(end[by_end], np.arange(n + 1)), np.searchsorted(start[by_start], np.arange(n + 1))
    seen, total, number, cover, i = np.zeros(len(keys), np.int64), np.zeros(len(model.families)), 0, 0, 0
    named = []
    for j in range(n):
        ids = by_end[end_at[j] : end_at[j + 1]]
        these, count = np.unique(of[ids[start[ids] >= i]], return_counts=True)
        fresh = these[seen[these] == 0]
        seen[these] += count
        total, number, cover = total + weight[fresh].sum(0), number + int((feature[fresh] > 0).sum()), cover + int(inside[fresh].sum())
        while cover >= overlap * len(template):
            p = model.probabilities((total / np.sqrt(max(number, 1)) + model.bias)[None])[0]
            if p.argmax() == family and p.max() >= threshold:
                named.append((i, j, cover, family, float(p.max())))
            ids = by_start[start_at[i] : start_at[i + 1]]
            these, count = np.unique(of[ids[end[ids] <= j]], return_counts=True)
            gone = these[seen[these] == count]
            if cover - int(inside[gone].sum()) < overlap * len(template):
                break
            seen[these] -= count
            total, number, cover, i = total - weight[gone].sum(0), number - int((feature[gone] > 0).sum()), cover - int(inside[gone].sum()), i + 1

    def judge(i: int, j: int) -> tuple[int, int]:
        """Template's n-grams in lines i to j, and the nearest family."""
        these = np.unique(of[(start >= i) & (end <= j)])
        logits = weight[these].sum(0) / np.sqrt(max(int((feature[these] > 0).sum()), 1)) + model.bias
        return int(inside[these].sum()), int(logits.argmax())

    out = []
    for i, j, cover, family, probability in named:
        low, high, about = i, j, (cover, family)
        while low > 0 and (wider := judge(low - 1, high))[0] > about[0]:
            low, about = low - 1, wider
        while high < n - 1 and (wider := judge(low, high + 1))[0] > about[0]:
            high, about = high + 1, wider
        if about[1] in (family, unknown):
            out.append((family, probability))
    return out


def plain_passages(docs: DataFrame, most: int, passage: int = 2000) -> list[str]:
    """At most `most` distinct passages of docs' lines, of `passage` characters at most, without a licence word.

    A hash of a passage's own words draws it, and the smallest hashes stay, so copies count once and neither the order
    of rows nor their layout matters. Long lines are drawn from in all of their passages.
    """
    share = min(1.0, 4 * most / max(docs.count(), 1))  # a document has a line at least, most have several
    lines = docs.where(F.col("text").isNotNull()).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    places = F.sequence(F.lit(0), F.floor((F.length("line") - 1) / passage).cast("int"))
    parts = lines.select(F.explode(F.transform(places, lambda i: F.substring(F.col("line"), i * passage + 1, F.lit(passage)))).alias("part"))
    drawn = parts.select("part", F.xxhash64("part").alias("draw")).where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30)))
    plain = drawn.where(~F.lower("part").rlike("licen|copyright|permission|reserved|public domain|spdx|cc.by|gpl"))
    return [r["part"] for r in plain.distinct().orderBy(F.pmod("draw", F.lit(1 << 30)), "part").limit(most).collect()]


def learn(docs: DataFrame, negatives: int = 3000, copies: int = 24, seed: int = 5) -> Scanner:
    """A scanner from the templates and, for the unknown class, at most `negatives` passages of docs without a licence word.

    Only text is read; null and empty texts give no passage, and without any the unknown class has its own examples.
    """
    own = plain_passages(docs, negatives)
    rng = np.random.default_rng(seed)
    texts, names = examples(rng, copies)
    texts, names = texts + own, names + ["unknown"] * len(own)
    return fit(texts, names, rng.random(len(texts)) < 0.25)


def scan(docs: DataFrame, model: Scanner, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs, licences, unconfirmed, score of every row of docs.

    A paragraph is a line; lines without one that has no word between them are read together as well (see in_blocks), so
    that notices may be wrapped. Either names a family when that family's calibrated probability is `threshold` or more,
    and is confirmed when `overlap` of the word n-grams of one of the family's templates are in it. n_paragraphs counts lines. licences: sorted distinct
    confirmed families; unconfirmed: those only named; score: the highest confirmed probability, 0 without one. Null and empty
    texts have no paragraph. Rows keep their multiplicity; only text is read.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        unknown = len(own.families) - 1
        for batch in slices(batches, "text", 4 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            word, line_of, lines, row = words_in_lines(raw, offsets)
            first, _, bucket = ngrams(word, line_of)
            line = line_of[first]
            some, logits = own.logits(line, bucket, len(lines))
            p = own.probabilities(logits)
            best = p.argmax(1)
            named = np.flatnonzero((best != unknown) & (p.max(1) >= threshold)) if len(p) else np.zeros(0, np.int64)
            sure: list[set] = [set() for _ in range(batch.num_rows)]
            unsure: list[set] = [set() for _ in range(batch.num_rows)]
            score = np.zeros(batch.num_rows)
            wanted = np.flatnonzero(np.isin(line, some[named])) if len(named) else np.zeros(0, np.int64)
            for i in named:
                has = np.unique(bucket[wanted[line[wanted] == some[i]]])
                family, doc = own.families[best[i]], row[some[i]]
                if any(np.isin(t, has).mean() >= overlap for t in own.templates[family]):
                    sure[doc].add(family)
                    score[doc] = max(score[doc], p[i, best[i]])
                else:
                    unsure[doc].add(family)
            for doc, number, probability, confirmed in in_blocks(own, word, line_of, row, threshold, overlap):
                (sure if confirmed else unsure)[doc].add(own.families[number])
                if confirmed:
                    score[doc] = max(score[doc], probability)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)), pa.array([sorted(s) for s in sure], strings), pa.array([sorted(u - s) for s, u in zip(sure, unsure, strict=True)], strings), pa.array(score)], names=["doc_id", "n_paragraphs", "licences", "unconfirmed", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, n_paragraphs long, licences array<string>, unconfirmed array<string>, score double")

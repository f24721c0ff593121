"""Licence scan: passages of documents against licence templates by Dice coefficient.

Text is normalised to lower-case words of letters and digits. A passage is a line, a paragraph of
several lines (parted by a blank line), or a whole text of several paragraphs. Passages and
templates are compared as sets of word bigrams: 2 * common / (size + size). At a threshold t no
template is a candidate whose size is outside t / (2 - t) to (2 - t) / t times that of the passage,
so most passages are left out by their size alone; of the others only bigrams that some template has
are counted.

The templates are a fixed list, of notices and of whole licence texts (folder `licences`), or a given
one; its size is checked: up to `TEMPLATE_WORDS` words are
broadcast, more are refused.

Defined cases: a null or empty text has no passage and no licence; passages of one word have no
bigram and match nothing, as do such templates; ties go to the licence first by code point, then to
the earlier passage; a licence with several templates has the best of them; repeated rows are each
judged.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.batches import ALNUM, LOWER, P, Spans, chunks, map_batches, mix

THRESHOLD = 0.8
TEMPLATE_WORDS = 1_000_000

# Notices and passages of licences, as their publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
     "file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met: 1. Redistributions of source code "
     "must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided "
     "with the distribution."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
     "neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under "
     "the terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
     "a copy of the MPL was not distributed with this file, You can obtain one at "
     "https://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met: 1. Redistributions of source code "
     "must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
     "conditions and the following disclaimer in the documentation and/or other materials provided "
     "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission."),
]


def _notice(thing: str, licence: str, version: str) -> str:
    """The notice of three paragraphs that the GNU licences ask for at the head of a file."""
    return (f"This {thing} is free software: you can redistribute it and/or modify it under the terms of "
            f"the {licence} as published by the Free Software Foundation, either version {version} of "
            f"the License, or (at your option) any later version. This {thing} is distributed in the hope "
            "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {licence} for more details. "
            f"You should have received a copy of the {licence} along with this {thing}. If not, see "
            "<https://www.gnu.org/licenses/>.")


TEMPLATES += [(f"{short}-{version if '.' in version else version + '.0'}-or-later", _notice(thing, licence, version))
              for short, licence, versions in (
                  ("GPL", "GNU General Public License", ("2", "3")),
                  ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
                  ("AGPL", "GNU Affero General Public License", ("3",)))
              for thing in (("program", "library") if short == "LGPL" else ("program",))
              for version in versions]
# Whole texts, a file for each licence.
TEMPLATES += [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(
    resources.files("eventide.llm").joinpath("licences").iterdir(), key=lambda f: f.name)
    if f.name.endswith(".txt")]


def _bigrams(s: Spans, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams within passages: (passage, hash), ordered."""
    inside = np.flatnonzero(passage[:-1] == passage[1:])
    h = mix(s.hash[inside] * np.uint64(P) + s.hash[inside + 1])
    p = passage[inside]
    order = np.lexsort((h, p))
    p, h = p[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    return p[new], h[new]


class Templates:
    """Bigram sets of all templates: hashes in order, each with the templates that have it."""

    def __init__(self, rows: list[tuple[str, str]], threshold: float):
        rows = sorted((str(n), t) for n, t in rows if n is not None and t is not None)
        raw = [t.encode() for _, t in rows]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        s = Spans(np.frombuffer(b"".join(raw), np.uint8), offs, ALNUM, LOWER)
        owner, h = _bigrams(s, s.row)
        self.names = [n for n, _ in rows]
        self.size = np.bincount(owner, minlength=len(rows))
        order = np.argsort(h, kind="stable")
        self.hash, self.owner = h[order], owner[order]
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.threshold = threshold

    def best(self, s: Spans, passage: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, template, dice) of all passages and templates at or over the threshold."""
        if not len(self.hash) or not len(passage):
            return []
        p, h = _bigrams(s, passage)
        size = np.bincount(p, minlength=passage[-1] + 1)
        real = self.size[self.size > 0]
        fits = (size >= real.min() * self.low) & (size <= real.max() * self.high)
        use = fits[p]
        p, h = p[use], h[use]
        first = np.searchsorted(self.hash, h, side="left")
        n = np.searchsorted(self.hash, h, side="right") - first
        p, first, n = p[n > 0], first[n > 0], n[n > 0]
        if not len(p):
            return []
        ends = np.cumsum(n)
        template = self.owner[np.repeat(first - (ends - n), n) + np.arange(ends[-1])]
        key, common = np.unique(np.repeat(p, n) * len(self.names) + template, return_counts=True)
        at, template = key // len(self.names), key % len(self.names)
        a, b = size[at], self.size[template]
        near = (a >= b * self.low) & (a <= b * self.high)
        dice = 2 * common / (a + b)
        good = np.flatnonzero(near & (dice >= self.threshold))
        return list(zip(at[good].tolist(), template[good].tolist(), dice[good].tolist(), strict=True))


def _breaks(data: np.ndarray, s: Spans, blank: bool) -> np.ndarray:
    """Passage number of each word: by line, or by lines that hold nothing but white space."""
    line = np.cumsum(data == 0x0A)[s.start] if len(s.start) else s.start
    if blank:
        # A jump of two lines or more between words is no blank line if those lines hold other marks.
        solid = ~np.isin(data, (0x20, 0x09, 0x0B, 0x0C, 0x0D, 0x0A))
        full = np.bincount(np.cumsum(data == 0x0A)[solid], minlength=int((data == 0x0A).sum()) + 1) > 0
        empty = np.cumsum(~full)
        line = empty[line]
    new = np.ones(len(s.start), bool)
    new[1:] = (line[1:] != line[:-1]) | (s.row[1:] != s.row[:-1])
    return np.cumsum(new) - 1


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
            threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, found (array of license, dice: the best of each licence, best first)."""
    if sum(len((t or "").split()) for _, t in templates) > TEMPLATE_WORDS:
        raise ValueError("too many templates for one broadcast; scan with parts of the list")
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold))

    def run(batches):
        t = known.value
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1)):
                s = Spans(data, offs, ALNUM, LOWER)
                found: list[dict] = [{} for _ in range(hi - lo)]
                for passage in (_breaks(data, s, False), _breaks(data, s, True), s.row):
                    word = np.searchsorted(passage, np.arange(passage[-1] + 1)) if len(passage) else []
                    for p, k, dice in t.best(s, passage):
                        best = found[s.row[word[p]]]
                        best[t.names[k]] = max(dice, best.get(t.names[k], 0.0))
                lists = [[{"license": n, "dice": d} for n, d in
                          sorted(f.items(), key=lambda x: (-x[1], x[0]))] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(lists, pa.list_(pa.struct(
                        [("license", pa.string()), ("dice", pa.float64())])))], names=[id_col, "found"])
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    pair = T.StructType([T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())])
    return map_batches(rows, run, T.StructType([docs.schema[id_col],
                                                T.StructField("found", T.ArrayType(pair))]))

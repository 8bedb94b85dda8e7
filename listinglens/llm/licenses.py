"""Licence scans: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglens.llm.common import small_batches

#: Least Dice coefficient of a match.
LEAST = 0.8
#: Public licence notices as they are written in practice. Identifier lines of one word after the colon are not
#: among them: their first three words alone reach the least coefficient, whatever the licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
)
#: Licences whose whole text is a file of license_texts.
BODIES = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "ISC", "Unlicense", "Zlib")
#: Parts of those texts that stand alone in practice: file, first and last words, and the licence where it is another one.
PARTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the", "limitations under the License.", None),
    ("MIT", "Permission is hereby granted", "following conditions:", None),
    ("MIT", "Permission is hereby granted", "portions of the Software.", None),
    ("GPL-3.0", "This program is free software: you", "If not, see", None),
    ("GPL-2.0", "This program is free software; you", "along with this program", None),
    ("LGPL-2.1", "This library is free software; you", "along with this library", None),
    ("BSD-2-Clause", "Redistribution and use", "SUCH DAMAGE.", None),
    ("BSD-3-Clause", "Redistribution and use", "SUCH DAMAGE.", None),
    ("BSD-3-Clause", "Redistribution and use", "without specific prior written permission.", None),
    ("MPL-2.0", "This Source Code Form is subject", "MPL/2.0/.", None),
    ("ISC", "Permission to use, copy", "in all copies.", None),
    ("Unlicense", "Anyone is free to copy", "by any means.", None),
    ("GPL-3.0", "This program is free software: you", "If not, see", "LGPL-3.0"),
    ("GPL-3.0", "This program is free software: you", "If not, see", "AGPL-3.0"),
)
#: The licence that another one is without a part: name, the other's file, first and last words of the part.
WITHOUT = ("BSD-2-Clause", "BSD-3-Clause", "3. Neither the name", "written permission.")
#: Words put before "General Public License" where a part is the header of another licence.
NAMED = {"LGPL-3.0": "Lesser", "AGPL-3.0": "Affero"}
WORD = re.compile(r"[a-z0-9]+")


@functools.cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of the bodies and their parts."""
    folder = resources.files("listinglens.llm") / "license_texts"
    texts = {name: (folder / f"{name}.txt").read_text("utf-8") for name in BODIES}
    new, old, first, last = WITHOUT
    at = texts[old].index(first)
    texts[new] = texts[old][:at] + texts[old][texts[old].index(last, at) + len(last) :]
    found = list(texts.items())
    for name, first, last, other in PARTS:
        text = " ".join(texts[name].split())
        at = text.rindex(first)
        part = text[at : text.index(last, at) + len(last)]
        if other:
            part = part.replace("General Public License", f"{NAMED[other]} General Public License")
        found.append((other or name, part))
    return tuple(found)


@functools.cache
def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words of a template: runs of a-z and 0-9 of the lower-cased text."""
    words = WORD.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class Words:
    """The pairs of neighbouring words of a text by position, and where each pair stands before and after."""

    def __init__(self, words: list[str]):
        self.ids: dict[tuple[str, str], int] = {}
        self.code = np.array([self.ids.setdefault(p, len(self.ids)) for p in zip(words, words[1:])], np.int64)
        n = len(self.code)
        order = np.argsort(self.code, kind="stable")
        same = self.code[order[1:]] == self.code[order[:-1]]
        self.prev, self.next = np.full(n, -1), np.full(n, n)
        self.prev[order[1:][same]] = order[:-1][same]
        self.next[order[:-1][same]] = order[1:][same]

    def runs(self, template: frozenset[tuple[str, str]], least: float) -> list[tuple[float, int, int]]:
        """(Dice coefficient, first pair, last pair) of runs of words that reach the bound: the best, then those apart from it.

        A run whose first pair is not the template's, or comes again inside it,
        is no better without that pair; one with over (2 - least) / least pairs
        for each of the template's is below the bound. No such run is looked at.
        """
        m = len(template)
        known = np.zeros(len(self.ids), bool)
        known[[self.ids[p] for p in template if p in self.ids]] = True
        hit = known[self.code]
        found, most, need = [], m * (2 - least) / least, m * least / (2 - least) - 1e-9
        done = -1
        for start in np.flatnonzero(hit).tolist():
            if start <= done:  # inside a run that is the template
                continue
            size, limit = 2 * m + 64, int(self.next[start])
            while True:
                stop = min(start + size, limit)
                fresh = self.prev[start:stop] < start
                n = np.cumsum(fresh)
                if stop == limit or n[-1] > most:
                    break
                size *= 2
            shared = np.cumsum(fresh & hit[start:stop])
            if shared[-1] < need:
                continue
            dice = 2 * shared / (n + m)
            last = int(dice.argmax())
            if dice[last] >= least:
                found.append((float(dice[last]), start, start + last))
                done = start + last if dice[last] == 1 else done
        return apart(sorted(found, key=lambda r: (-r[0], r[1])))


def apart(runs: list[tuple]) -> list[tuple]:
    """The runs, the best first, that share no pair of words with one before them; a run ends with its first and last pair."""
    kept: list[tuple] = []
    for run in runs:
        if all(run[-1] < other[-2] or other[-1] < run[-2] for other in kept):
            kept.append(run)
    return kept


class Matcher:
    """Templates by the pairs that they hold; a text's segments are compared only with those of which it holds enough pairs."""

    def __init__(self, templates=None, least: float = LEAST):
        every = (*TEMPLATES, *whole_texts()) if templates is None else templates
        self.least = least
        self.templates = [(name, b) for name, text in every if (b := bigrams(text))]
        sizes = [len(b) for _, b in self.templates]
        # a run of n pairs shares at most n of m, so it needs least / (2 - least) of a template's pairs
        self.needs = [least / (2 - least) * m for m in sizes]
        self.low = min(self.needs, default=1)
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, pairs) in enumerate(self.templates):
            for pair in pairs:
                self.holders.setdefault(pair, []).append(i)

    def match(self, text: str | None) -> dict[str, float]:
        """Best Dice coefficient of each licence that reaches the bound."""
        # a pair takes at least two more characters, and a run in range has at least that many
        if not text or len(text) < 2 * self.low:
            return {}
        words = WORD.findall(text.lower())
        held = self.holders.keys() & set(zip(words, words[1:]))
        if len(held) < self.low:
            return {}
        counts = Counter(i for pair in held for i in self.holders[pair])
        placed, runs = None, []
        for i, shared in counts.items():
            if shared >= self.needs[i] - 1e-9:
                placed = placed or Words(words)
                name, pairs = self.templates[i]
                runs += [(dice, name, first, last) for dice, first, last in placed.runs(pairs, self.least)]
        best: dict[str, float] = {}
        for dice, name, _, _ in apart(sorted(runs, key=lambda r: (-r[0], r[2] - r[3], r[1], r[2]))):
            best[name] = max(best.get(name, 0.0), dice)
        return best


def scan(docs: DataFrame, templates=None, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, license, dice): licences whose template a run of the text's words reaches, with the best coefficient.

    Every run of words within a template's size bounds counts, so a notice may
    stand inside a sentence or be wrapped over lines. Of runs that overlap the
    best stays, then the longest, then the first name: the header of one
    version is not also that of another. Templates are the notices, and the
    whole texts and their parts. Null and empty texts match nothing; a null id
    stays null; repeated rows are each scanned; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    matcher = Matcher(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, name, dice) for i, t in enumerate(batch.column(1).to_pylist()) for name, dice in matcher.match(t).items()]
            own = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            cells = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([own, *cells], ["doc_id", "license", "dice"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, license string, dice double")


def oracle(templates=TEMPLATES, least: float = LEAST) -> str:
    """DuckDB SQL over documents, with dice rounded to six digits: the notices in the whole text, its paragraphs and its lines.

    Of units that overlap the best match stays, as in scan(), which looks at every run of words and at the whole texts
    too, so it may find more.
    """
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates)
    return f"""
WITH cut AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n'), string_split(text, chr(10))))) AS unit
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM cut),
pairs AS (
  SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
given(license, body) AS (VALUES {values}),
split AS (SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM given),
templates AS (SELECT license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM split),
scored AS (
  SELECT doc_id, unit, license, max(2.0::DOUBLE * len(list_intersect(b, t)) / (len(b) + len(t))) AS dice
  FROM pairs JOIN templates ON 2 * least(len(b), len(t)) >= {least} * (len(b) + len(t)) GROUP BY doc_id, unit, license HAVING dice >= {least})
SELECT doc_id, license, round(max(dice), 6) AS dice FROM scored s
WHERE NOT EXISTS (
  SELECT 1 FROM scored o WHERE o.doc_id IS NOT DISTINCT FROM s.doc_id AND o.license <> s.license
  AND (o.dice > s.dice OR o.dice = s.dice AND o.license < s.license) AND (contains(o.unit, s.unit) OR contains(s.unit, o.unit)))
GROUP BY doc_id, license
"""

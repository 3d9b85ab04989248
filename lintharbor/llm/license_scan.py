"""License notices in documents, by conditional compression.

Blocks are the lines of a text that hold a license cue, together with lines between them. A block is
compressed alone and with each template as a raw zstandard dictionary; what the dictionary saves,
as a share of the bytes, ranks the confirmed templates; in a long block it is taken on the words around
each cue. All templates that the counts of words do not rule out are compared word by word: a template is
confirmed if the block, or a stretch of it, has the template's words with at most a
`tolerance` share of differences and with every telling word (names, versions) in place. The wording
differences are part of the result.

Defined results: NULL and empty texts have no block. A text's equal blocks are reported each with its
place. Ties of the saving go to the smaller difference, then to the template first in the list.
Rows without an id are reported without one; repeated rows repeat their results. An empty table gives
no rows. Templates are a parameter; `TEMPLATES` are short public notices.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wordings of public license notices, (id, text, telling words).
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software", "permission granted free charge"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License.", "apache 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License",
     "gnu general 2"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License",
     "gnu general 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0.", "mozilla 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "cc by-sa 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by-nc 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0.", "cc by-nc-nd 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal.", "cc0 1.0"),
    ("all-rights-reserved", "All rights reserved.", "all rights reserved"),
]
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|permission is hereby|public domain|spdx|\bCC0\b|\bCC BY\b"
#: Lines without a cue that may stand between two cue lines of a block.
BETWEEN = 2
_WORD = re.compile(r"[^\s,;:()\"']+")


def normal_words(text: str) -> list[str]:
    return [w for w in (m.rstrip(".").lower() for m in _WORD.findall(text)) if w]


def blocks_of(text: str, cue: re.Pattern) -> list[tuple[int, str]]:
    """(number of the first line, text) of each block."""
    lines = text.split("\n")
    hits = [i for i, line in enumerate(lines) if cue.search(line)]
    out: list[tuple[int, int]] = []
    for i in hits:
        if out and i - out[-1][1] <= BETWEEN + 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return [(a, "\n".join(lines[a: b + 1])) for a, b in out]


def differences(template: list[str], block: list[str]) -> tuple[int, list[str], list[str]]:
    """(differing words, missing, added) between the template and the stretch of the block it matches best."""
    matcher = SequenceMatcher(None, template, block, autojunk=False)
    same = [m for m in matcher.get_matching_blocks() if m.size]
    if not same:
        return len(template), template, []
    first, last = same[0], same[-1]
    begin = max(0, first.b - first.a)
    end = min(len(block), last.b + last.size + len(template) - last.a - last.size)
    missing, added = [], []
    for kind, i, j, k, m in SequenceMatcher(None, template, block[begin:end], autojunk=False).get_opcodes():
        if kind != "equal":
            missing += template[i:j]
            added += block[begin + k: begin + m]
    return max(len(missing), len(added)), missing, added


class Scanner:
    """Templates as dictionaries. Blocks repeat, so the results of a task's blocks are kept."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], tolerance: float, cue: re.Pattern):
        import zstandard

        self._plain = zstandard.ZstdCompressor(level=3)
        self._templates = [
            (name, normal_words(body), set(telling.split()), zstandard.ZstdCompressor(
                level=3, dict_data=zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
            for name, body, telling in templates]
        self._counts = [Counter(words) for _, words, _, _ in self._templates]
        self._reach = int((1 + tolerance) * max((len(words) for _, words, _, _ in self._templates), default=0)) + 1
        self._tolerance, self._cue = tolerance, cue
        self._kept: dict[str, list[tuple]] = {}

    def _parts(self, block: str) -> list[str]:
        """The block, and if it is longer than any template around a cue, the words around each cue."""
        spans = [m.span() for m in _WORD.finditer(block)]
        parts = {block: None}
        if len(spans) > 2 * self._reach:
            starts = [a for a, _ in spans]
            for m in self._cue.finditer(block):
                k = bisect_right(starts, m.start()) - 1
                parts[block[spans[max(0, k - self._reach)][0]: spans[min(len(spans) - 1, k + self._reach)][1]]] = None
        return list(parts)

    def __call__(self, block: str) -> list[tuple]:
        """(license, saving, differing words, missing, added) of each confirmed license, best first."""
        if block in self._kept:
            return self._kept[block]
        by_template: dict[int, tuple] = {}
        for part in self._parts(block):
            raw, inside = part.encode(), normal_words(part)
            alone, counted = 0, Counter(inside)
            for i, (name, words, telling, compressor) in enumerate(self._templates):
                most = self._tolerance * len(words)
                # Ruled out for certain: a telling word is not there, or too many words are not.
                if not telling <= counted.keys() or (self._counts[i] - counted).total() > most:
                    continue
                n, missing, added = differences(words, inside)
                if n <= most and not telling & set(missing):
                    alone = alone or len(self._plain.compress(raw))
                    f = (name, 1 - len(compressor.compress(raw)) / alone, n, " ".join(missing), " ".join(added))
                    if i not in by_template or (n, -f[1]) < (by_template[i][2], -by_template[i][1]):
                        by_template[i] = f
        best: dict[str, tuple] = {}
        for f in sorted((by_template[i] for i in sorted(by_template)), key=lambda f: (-round(f[1], 6), f[2])):
            best.setdefault(f[0], f)
        if len(self._kept) > 50_000:
            self._kept.clear()
        self._kept[block] = list(best.values())
        return self._kept[block]


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, tolerance: float = 0.2,
         text: str = "text", cue: str = CUE) -> DataFrame:
    """(doc_id, line, license, saving, n_different, missing_words, added_words), a row per block and confirmed license."""
    kept_templates = list(templates)

    def scanned(batches):
        import pyarrow as pa

        pattern = re.compile(cue)
        scanner = Scanner(kept_templates, tolerance, pattern)
        names = ["doc_id", "line", "license", "saving", "n_different", "missing_words", "added_words"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows = [(doc, line, *result)
                    for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for line, block in blocks_of(body or "", pattern) for result in scanner(block)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    # Texts without a cue stay in the JVM.
    return docs.select("doc_id", F.col(text).alias("_t")).filter(F.col("_t").rlike(cue)).mapInArrow(
        scanned, "doc_id bigint, line int, license string, saving double, n_different int, missing_words string, added_words string")

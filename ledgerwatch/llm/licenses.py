"""Licence scan by conditional compression (operator 1).

Candidate blocks are sentences with a licence cue, joined over small gaps; sentences are cut
at line ends and also, for wrapped notices, over the lines of a paragraph. Each is compressed
by zstandard alone and with every template as raw dictionary. All templates that make it
smaller by ``LEAST_REDUCTION`` are confirmed word by word: an alignment lists the template's
words that the block lacks and the words between that it adds; names and versions (the words
that tell one licence from another) must all be there. A template is refused where the difference
tells another licence or denies it: words such as "lesser" or "affero" between its words, a
negation between or just before them in the clause, or a condition further on that only the other
licence has. Names of other licences in the sentence are left out of the alignment, so a
sentence that lists several licences has all of them.

Defined cases: null and empty texts have no blocks; rows with equal ids or texts are reported
once per row; of overlapping spans of one licence the wording with most words there, then the
fewest added, then the shortest span wins; an empty table gives no rows; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.frames import per_slice

LEAST_REDUCTION = 0.10
LEAST_COVERED = 0.85
MOST_ADDED = 0.25  # words added inside the aligned part, per template word
GAP = 1  # sentences without a cue inside a block

# fixed values: licence names with their words of identity, and public licence wordings
NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "ISC": "ISC License", "Unlicense": "Unlicense", "Zlib": "zlib License",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "MPL-2.0": "Mozilla Public License, version 2.0",
    "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3", "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0", "CC-BY-3.0": "CC BY 3.0", "CC-BY-SA-3.0": "CC BY-SA 3.0",
}
# fixed values: the same licences by other names
OTHER_NAMES = {
    "CC-BY-4.0": "Creative Commons Attribution 4.0 International", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Creative Commons Attribution-NonCommercial 4.0 International", "CC-BY-ND-4.0": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "CC-BY-NC-SA-4.0": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "CC-BY-NC-ND-4.0": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "CC-BY-3.0": "Creative Commons Attribution 3.0 Unported", "CC-BY-SA-3.0": "Creative Commons Attribution-ShareAlike 3.0 Unported",
    "CC0-1.0": "CC0 1.0 Universal", "MPL-2.0": "Mozilla Public License 2.0", "Apache-2.0": "Apache License 2.0",
}
PHRASES = ["Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}"]
WORDINGS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    "either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}
CUES = ["licens", "licenc", "copyright", "rights reserved", "permission", "spdx", "public domain", "warrant", "creative commons", "redistribut", "cc by", "cc0"]

# fixed values: words of a wording that must be there, words that tell another licence where they come between,
# conditions further on that only another licence has, and words that deny
IDENTITY = {"2", "3", "2.0", "2.1", "apache", "lesser", "affero", "mozilla", "neither", "endorse"}
LATER = {"BSD-2-Clause": ["neither the name of", "to endorse or promote"]}
DENYING = {"not", "never", "nor", "cannot", "isn", "aren", "wasn"}
TELLING = {"lesser", "library", "affero", "except"} | DENYING
DENIED_WITHIN = 3  # words before the wording, in one clause

_CUE = re.compile("|".join(map(re.escape, CUES)), re.I)
_SENTENCE = re.compile(r"[^\n]+?(?:(?<!\s[vV])[.!?](?=\s)|(?=\n)|\Z)")
_PARAGRAPH = re.compile(r"[^\n]*[^\W_][^\n]*(?:\n[^\n]*[^\W_][^\n]*)*")
_WRAPPED = re.compile(r".+?(?:(?<!\s[vV])[.!?](?=\s)|\Z)", re.S)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower().replace("licence", "license"))


def clause_starts(text: str) -> list[bool]:
    """For each word whether punctuation stands before it."""
    out, end = [], 0
    low = text.lower()
    for m in _WORD.finditer(low.replace("licence", "license")):
        out.append(any(c in ".,;:!?" for c in low[end : m.start()]))
        end = m.end()
    return out


def denied(block: list[str], starts: list[bool], at: int) -> bool:
    """Whether a negation stands just before word ``at``, in its clause."""
    for i in range(at - 1, max(-1, at - 1 - DENIED_WITHIN), -1):
        if starts[i + 1]:
            return False
        if block[i] in DENYING or block[i] == "longer" and i and block[i - 1] == "no":
            return True
    return False


@cache
def templates() -> list[tuple[str, str, list[str], frozenset[str]]]:
    """(licence, wording, its words, words that must be there)."""
    out = [(name, text, words(text), IDENTITY.intersection(words(text))) for name, text in WORDINGS.items()]
    for name, title in [*NAMES.items(), *OTHER_NAMES.items()]:
        own = frozenset(words(title)) - {"license", "version", "the"}
        out += [(name, p.format(title) + ".", words(p.format(title)), own) for p in PHRASES]
    for name in NAMES:
        out.append((name, f"SPDX-License-Identifier: {name}", words(f"SPDX-License-Identifier: {name}"), frozenset(words(name))))
    return out


@cache
def _titles() -> list[tuple[str, list[str]]]:
    """(licence, words of its name), longest name first."""
    return sorted(((name, words(title)) for name, title in [*NAMES.items(), *OTHER_NAMES.items()]), key=lambda x: -len(x[1]))


def without_other_names(block: list[str], licence: str) -> list[int]:
    """Places of the words of ``block``, without the names of the other licences and the small words that list them."""
    out, i = [], 0
    while i < len(block):
        name, title = next(((n, t) for n, t in _titles() if block[i : i + len(t)] == t), ("", block[i : i + 1]))
        start, i = i, i + len(title)
        if name in ("", licence):
            out += range(start, i)
            continue
        while out and block[out[-1]] in ("the", "and", "or"):
            out.pop()
        while block[i : i + 1] in (["and"], ["or"]):
            i += 1
    return out


@cache
def _compressors() -> list:
    """One for each template, and one without."""
    import zstandard as z

    dictionary = lambda t: z.ZstdCompressionDict(t.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
    options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return [z.ZstdCompressor(dict_data=dictionary(t), **options) for _, t, _, _ in templates()] + [z.ZstdCompressor(**options)]


def _sentences(text: str, wrapped: bool) -> Iterator[tuple[int, int]]:
    """Spans of the sentences: of each line, or of each paragraph of several lines."""
    if not wrapped:
        yield from (m.span() for m in _SENTENCE.finditer(text))
        return
    for p in _PARAGRAPH.finditer(text):
        yield from (m.span() for m in _WRAPPED.finditer(text, *p.span()))


def _joined(text: str, sentences: Iterable[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of the sentences with a cue, and of the blocks they make."""
    cued: list[tuple[int, int]] = []
    out: list[tuple[int, int]] = []
    since = GAP + 1
    for start, end in sentences:
        sentence = text[start:end]
        if _CUE.search(sentence):
            start += len(sentence) - len(sentence.lstrip())
            cued.append((start, end))
            if out and since <= GAP:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
            since = 0
        elif sentence.strip():
            since += 1
    return cued, out


def blocks(text: str) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Spans of the candidate blocks, each with the spans inside that are judged."""
    parts: set[tuple[int, int]] = set()
    for wrapped in (False, True):
        parts.update(*_joined(text, _sentences(text, wrapped)))
    out: list[tuple[tuple[int, int], list[tuple[int, int]]]] = []
    for start, end in sorted(parts, key=lambda x: (x[0], -x[1])):
        if out and start < out[-1][0][1]:
            (first, last), inside = out[-1]
            out[-1] = ((first, max(last, end)), [*inside, (start, end)])
        else:
            out.append(((start, end), [(start, end)]))
    return out


def ranked(block: str) -> list[tuple[float, int]]:
    """(size reduction, template number), largest first."""
    *with_template, alone = _compressors()
    body = block.encode("utf-8", "replace")
    whole = len(alone.compress(body))
    return sorted(((1 - len(c.compress(body)) / whole, i) for i, c in enumerate(with_template)), key=lambda x: (-x[0], x[1]))


def differences(block: list[str], number: int) -> tuple[list[str], list[str], int] | None:
    """(template words the block lacks, words it adds between, where it begins); None if it is another wording."""
    _, _, wanted, identity = templates()[number]
    runs = [m for m in SequenceMatcher(None, wanted, block, autojunk=False).get_matching_blocks() if m.size]
    if not runs or not identity <= {w for m in runs for w in wanted[m.a : m.a + m.size]}:
        return None
    lacks, adds, a, b = [], [], 0, runs[0].b
    for m in runs:
        lacks += wanted[a : m.a]
        adds += block[b : m.b]
        a, b = m.a + m.size, m.b + m.size
    lacks += wanted[a:]
    if len(wanted) - len(lacks) < LEAST_COVERED * len(wanted) or len(adds) > MOST_ADDED * len(wanted) or not TELLING.isdisjoint(adds):
        return None
    return lacks, adds, runs[0].b


def told_later(licence: str, rest: str) -> bool:
    """Whether in ``rest``, which holds a wording, a condition of another licence follows before the wording comes again."""
    if licence not in LATER:
        return False
    _, *behind = " ".join(words(rest)).split(" ".join(words(WORDINGS[licence])[:6]))
    return bool(behind) and any(phrase in behind[0] for phrase in LATER[licence])


def scan(text: str) -> list[tuple[int, int, str, str, float, list[str], list[str]]]:
    """(start, end, licence, wording, reduction, words lacking, words added) of the confirmed blocks."""
    found = []
    for (_, block_end), parts in blocks(text):
        # a long block may hold several notices: sentences are judged singly, then the block whole
        confirmed = []
        for a, b in parts:
            own = words(text[a:b])
            counts, bare, starts = Counter(own), {}, clause_starts(text[a:b])
            for reduction, number in ranked(text[a:b]):
                if reduction < LEAST_REDUCTION:
                    break
                name, wording, wanted, identity = templates()[number]
                # what differences() asks for at least, without an alignment
                if not identity <= counts.keys() or (Counter(wanted) & counts).total() < LEAST_COVERED * len(wanted):
                    continue
                if name not in bare:
                    bare[name] = without_other_names(own, name)
                if (d := differences([own[i] for i in bare[name]], number)) is None:
                    continue
                lacks, adds, first = d
                if denied(own, starts, bare[name][first]) or told_later(name, text[a:block_end]):
                    continue
                rank = (len(lacks) - len(wanted), len(adds), b - a, -reduction, number)
                confirmed.append((rank, (a, b, name, wording, reduction, lacks, adds)))
        taken: dict[str, list[tuple[int, int]]] = {}
        for _, row in sorted(confirmed, key=lambda x: x[0]):
            a, b, name = row[:3]
            if all(b <= c or d <= a for c, d in taken.setdefault(name, [])):
                taken[name].append((a, b))
                found.append(row)
    return sorted(found)


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(CUES[0])
    for cue in CUES[1:]:
        out = out | low.contains(cue)
    return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per confirmed block: key, start_char, end_char, license, wording, reduction, missing, added, exact."""
    names = [key, "start_char", "end_char", "license", "wording", "reduction", "missing", "added", "exact"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(i, *found) for i, t in enumerate(batch.column(1).to_pylist()) for found in scan(t or "")]
        if not rows:
            return None
        of, start, end, name, wording, reduction, lacks, adds = zip(*rows, strict=True)
        columns = [batch.column(0).take(pa.array(of)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(name), pa.array(wording), pa.array(reduction)]
        columns += [pa.array([" ".join(x) for x in lacks]), pa.array([" ".join(x) for x in adds]), pa.array([not x and not y for x, y in zip(lacks, adds, strict=True)])]
        return pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(docs[key], docs[text].cast("string").alias("_text")).where(has_cue(F.col("_text")))
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(
        per_slice(work, "_text"),
        f"`{key}` {kind}, start_char bigint, end_char bigint, license string, wording string, reduction double, missing string, added string, exact boolean",
    )

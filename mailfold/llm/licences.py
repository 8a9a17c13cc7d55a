"""Licence scans by sentences and rules (dealt operator 5).

A text is cut into sentences; every sentence is normalised and looked up among the known
licence sentences, which gives the text a sequence of sentence identifiers.  Rules are
ordered identifier sequences: a rule matches where its identifiers follow each other in that
order, other identifiers between them allowed.  Rules are tried from the longest to the
shortest and use up the identifiers they match, so that a full licence is not reported
again as its own notice.

Sentences end at one ``.``, ``!``, ``?``, ``;`` or ``:`` before white space, at an empty line,
or at a line break; because licence texts are wrapped and hold such signs inside their
sentences ("v. 2.0", an address after an empty line), parts are looked up together with the
next ones as long as they begin a known sentence.  Normalising lowers case and drops
everything but letters and digits; a copyright notice loses its years and holders and ends
with its part.

Defined results: a null text counts as empty; a text without known sentences has an empty
report; repeated rows get a result each; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from mailfold.llm.common import map_rows

# Known sentences of public licences, by identifier, and the rules over them.
SENTENCES = {
    "mit-ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License",
                "This software is released under the MIT License", "SPDX-License-Identifier: MIT"],
    "mit-title": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                  "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                  "permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
                   "the Software."],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
                  "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
                   "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
                   "DEALINGS IN THE SOFTWARE."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
                  "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                  "following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                   "disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                   "disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                  "products derived from this software without specific prior written permission."],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                  "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                  "DISCLAIMED."],
    "bsd-ref": ["Licensed under the BSD License", "Released under the BSD License", "Licensed under the BSD 3-Clause License",
                "SPDX-License-Identifier: BSD-3-Clause"],
    "apache-ref": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License 2.0",
                   "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
                     "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0",
                 "Released under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License v2.0",
                 "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                 "version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-ref": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-ref": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-header": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-ref": ["Released under CC0 1.0", "Licensed under CC0 1.0", "Dedicated to the public domain under CC0 1.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."],
    "reserved": ["All rights reserved"],
    "copyright": ["Copyright"],
}

#: (licence, family, ordered identifiers).
RULES = [
    ("MIT", "permissive", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("MIT", "permissive", ["mit-title", "mit-grant"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("MIT", "permissive", ["mit-ref"]),
    ("ISC", "permissive", ["isc-grant", "isc-as-is"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD", "permissive", ["bsd-ref"]),
    ("Apache-2.0", "permissive", ["apache-header", "apache-comply", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", "permissive", ["apache-header", "apache-comply"]),
    ("Apache-2.0", "permissive", ["apache-ref"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-hope", "gpl-implied"]),
    ("GPL-3.0", "copyleft", ["gpl-free"]),
    ("GPL-3.0", "copyleft", ["gpl3-ref"]),
    ("GPL-2.0", "copyleft", ["gpl2-ref"]),
    ("LGPL-3.0", "copyleft", ["lgpl-ref"]),
    ("AGPL-3.0", "copyleft", ["agpl-ref"]),
    ("MPL-2.0", "copyleft", ["mpl-header", "mpl-copy"]),
    ("MPL-2.0", "copyleft", ["mpl-header"]),
    ("Unlicense", "public domain", ["unlicense"]),
    ("CC0-1.0", "public domain", ["cc0-ref"]),
    ("CC-BY-4.0", "permissive", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", "non-commercial", ["cc-by-nc-ref"]),
    ("Proprietary", "reserved", ["copyright", "reserved"]),
    ("Proprietary", "reserved", ["reserved"]),
]

_END = re.compile(r"(?<![.!?;:])[.!?;:](?=\s|$)|\n[ \t]*\n|\n")
_OTHER = re.compile(r"[\W_]+")
_HOLDER = re.compile(r"^(?:copyright|c)\b.*$")


def words_of(sentence: str) -> str:
    """Lower-case words of a sentence."""
    return _OTHER.sub(" ", sentence.lower()).strip()


def normalised(sentence: str) -> str:
    """Lower-case words of a sentence; a copyright notice without its years and holders."""
    plain = words_of(sentence)
    if plain.startswith("copyright") and re.match(r"copyright (?:c )?(?:\d|by |the )", plain):
        return "copyright"
    return plain


KNOWN = {normalised(s): name for name, variants in SENTENCES.items() for s in variants}
#: Every beginning, in whole words, of a known sentence.
BEGINNINGS = {" ".join(words[:n]) for words in map(str.split, KNOWN) for n in range(1, len(words) + 1)}


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of ``text``."""
    out, start = [], 0
    for m in _END.finditer(text):
        out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def identified(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences of ``text``, in order.

    A sentence may run over several parts, whatever ends them: they are looked up together as
    long as they begin a known sentence.  The longest known one counts.
    """
    parts, out, i = sentences(text), [], 0
    while i < len(parts):
        start, end = parts[i]
        hit, last, j = KNOWN.get(normalised(text[start:end])), i, i
        plain = words_of(text[start:end])
        while plain in BEGINNINGS and j + 1 < len(parts):
            j += 1
            more = words_of(text[slice(*parts[j])])
            if more:  # words end with their part, so parts are joined as words
                plain = f"{plain} {more}"
                if plain in KNOWN:
                    hit, last = KNOWN[plain], j
        if hit:
            out.append((start, parts[last][1], hit))
        i = last + 1
    return out


def recognised(found: list[tuple[int, int, str]]) -> list[tuple[str, str, int]]:
    """(licence, family, place of its first identifier) for the rules that match, by place.

    A match takes the first free place of each identifier after that of the one before, so
    the places of an identifier are walked once a rule.
    """
    free: dict[str, list[int]] = {}
    for place, (_, _, name) in enumerate(found):
        free.setdefault(name, []).append(place)
    out = []
    for licence, family, wanted in sorted(RULES, key=lambda r: -len(r[2])):
        if not all(name in free for name in wanted):
            continue
        at, used = [0] * len(wanted), set()
        while match := _next_match([free[name] for name in wanted], at):
            out.append((licence, family, match[0]))
            used.update(match)
        for name in wanted if used else ():
            free[name] = [place for place in free[name] if place not in used]
    return sorted(out, key=lambda x: x[2])


def _next_match(places: list[list[int]], at: list[int]) -> list[int] | None:
    """Increasing places, one of each list from ``at`` on; ``at`` moves past them."""
    match, last = [], -1
    for k, own in enumerate(places):
        while at[k] < len(own) and own[at[k]] <= last:
            at[k] += 1
        if at[k] == len(own):
            return None
        last = own[at[k]]
        match.append(last)
    for k in range(len(at)):
        at[k] += 1
    return match


SCANNED = "doc_id bigint, n_sentences bigint, identifiers string, spans string, licences string, families string"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known sentences of every document and the licences their order speaks of.

    ``n_sentences`` counts all sentences; ``identifiers`` and ``spans`` (start-end in code
    points) list the known ones; ``licences`` are distinct, in order of place; ``families``
    are distinct and sorted.
    """
    def run(rows):
        out = {k.split()[0]: [] for k in SCANNED.split(", ")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            text = text or ""
            found = identified(text)
            matches = recognised(found)
            row = (
                doc_id, len(sentences(text)), ",".join(n for _, _, n in found), ",".join(f"{a}-{b}" for a, b, _ in found),
                ",".join(dict.fromkeys(m[0] for m in matches)), ",".join(sorted({m[1] for m in matches})),
            )
            for key, value in zip(out, row):
                out[key].append(value)
        yield out

    return map_rows(docs, SCANNED, run, doc_id=id_col, text=text_col)

"""Licence scan by sentence rules.

A text is cut into sentences, each is brought to a normal form and looked up
among known licence sentences; the identifiers found, in text order, are matched
against licence rules, the longer before the shorter. A rule's sentences must
come in its order with at most GAP unknown sentences between neighbours; each
sentence serves one rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import store
from loomstone.llm.kernels import released

GAP = 3

# The sentences of public licence texts and headers, in normal form.
SENTENCES = {
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit.liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc.liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd.redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache.licensed": "licensed under the apache license version 2.0 the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "apache.unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl.free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.free3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.see": "see the gnu general public license for more details",
    "mpl.form": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "unlicense.public": "this is free and unencumbered software released into the public domain",
    "cc0.waive": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}

# Names that notices give to licences, in normal form.
NAMES = {
    "mit": "MIT", "mit license": "MIT", "isc license": "ISC", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "bsd license": "BSD",
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache license": "Apache",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v2": "GPL-2.0", "gnu general public license v3": "GPL-3.0", "gnu general public license": "GPL", "gpl v2": "GPL-2.0", "gpl v3": "GPL-3.0", "gplv2": "GPL-2.0", "gplv3": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license": "LGPL", "gnu affero general public license version 3": "AGPL-3.0", "gnu affero general public license": "AGPL",
    "mozilla public license version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "unlicense": "Unlicense", "cc0 1.0": "CC0-1.0", "cc0": "CC0-1.0",
}
for _part in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _v in ("2.0", "3.0", "4.0"):
        for _head in ("cc", "creative commons"):
            NAMES[f"{_head} {_part} {_v}"] = NAMES[f"{_head} {_part} {_v} license"] = f"CC-{_part.upper().replace(' ', '-')}-{_v}"
for _words, _short in {"attribution": "BY", "attribution sharealike": "BY-SA", "attribution noncommercial": "BY-NC", "attribution noderivatives": "BY-ND"}.items():
    for _v in ("3.0", "4.0"):
        for _tail in ("license", "international license"):
            NAMES[f"creative commons {_words} {_v} {_tail}"] = f"CC-{_short}-{_v}"

#: (licence, kind, sentences); the first rule that matches at a sentence is taken.
RULES = [
    ("MIT", "text", ("mit.grant", "mit.notice", "mit.asis", "mit.liability")),
    ("ISC", "text", ("isc.grant", "isc.asis", "isc.liability")),
    ("BSD-3-Clause", "text", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    ("BSD-2-Clause", "text", ("bsd.redistribute", "bsd.source", "bsd.binary", "bsd.asis")),
    ("Apache-2.0", "header", ("apache.licensed", "apache.comply", "apache.copy", "apache.unless", "apache.see")),
    ("Apache-2.0", "header", ("apache.licensed", "apache.comply")),
    ("GPL-2.0-or-later", "header", ("gpl.free2", "gpl.hope", "gpl.see")),
    ("GPL-3.0-or-later", "header", ("gpl.free3", "gpl.hope", "gpl.see")),
    ("GPL-2.0-or-later", "header", ("gpl.free2",)),
    ("GPL-3.0-or-later", "header", ("gpl.free3",)),
    ("MIT", "part", ("mit.grant", "mit.notice")),
    ("MIT", "part", ("mit.grant",)),
    ("ISC", "part", ("isc.grant",)),
    ("BSD", "part", ("bsd.redistribute",)),
    ("Apache-2.0", "notice", ("apache.licensed",)),
    ("MPL-2.0", "header", ("mpl.form",)),
    ("Unlicense", "notice", ("unlicense.public",)),
    ("CC0-1.0", "notice", ("cc0.waive",)),
]

#: Every sentence of a rule, and every notice and tag, holds one of these; what parts its words may be any that normal() drops.
TRIGGER = "licen[cs]e|permission|redistribut|warrant|copyright|spdx|free[^a-z0-9]+software|unencumbered|in[^a-z0-9]+no[^a-z0-9]+event|(released|distributed|available|published|provided|covered|governed)[^a-z0-9]+(under|by)"
_NOTICE = re.compile(
    r"(?:(?:this|the) (?:work|software|project|file|program|text|document|article|page|content|code|library|package|dataset|data)(?: in this \w+)? (?:is|are) )?(?:dual )?"
    r"(?:licensed|released|distributed|available|published|made available|provided|covered|governed)(?: under| by)(?: the)?(?: terms of(?: the)?)? (.+)"
)
_ID = r"(?:\([ \t]*)*[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?(?:[ \t]*\))*"
#: Small "and", "or" may be prose; they join if a capital or a number is in the word that follows.
_JOIN = r"[ \t]+(?:AND|OR|WITH|(?:and|or|with)(?=[ \t]+\S*[A-Z0-9]))[ \t]+"
_SPDX = re.compile(rf"SPDX-License-Identifier:\s*({_ID}(?:{_JOIN}{_ID})*)")
_COPYRIGHT = re.compile(r"(?:copyright|c)(?: c)? \d{4}\b.*|copyright c .*")
_END = re.compile(r"[.!?;:](?=\s|$)|\n[ \t\r]*\n")
_WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_KNOWN = {v: k for k, v in SENTENCES.items()}
#: What known sentences start with, word by word.
_STARTS = {" ".join(v.split()[:n]) for v in SENTENCES.values() for n in range(1, len(v.split()) + 1)}
_BULLET = re.compile(r"^(?:\d+|[a-z]|[ivx]+) (?=\w)")


def normal(sentence: str) -> str:
    """Lower-case words with single spaces; numbers keep inner dots."""
    return " ".join(_WORDS.findall(sentence.lower().replace("licence", "license")))


def _tag(m: re.Match) -> tuple[int, str]:
    """(end, expression) of a tag: all its identifiers and operators, less brackets that close what is around it."""
    e, end = m[1], m.end()
    while e.endswith(")") and e.count(")") > e.count("("):
        e = e[:-1].rstrip()
        end = m.start(1) + len(e)
    return end, re.sub(r"(?<=\() | (?=\))", "", " ".join(e.split()))


def identify(sentence: str) -> str | None:
    """Identifier of a sentence: a known one's, notice:LICENCE, tag:LICENCE, copyright, or none."""
    n = normal(sentence)
    got = _KNOWN.get(n) or _KNOWN.get(_BULLET.sub("", n))
    if got or not n:
        return got
    m = _SPDX.search(sentence)
    if m:
        return f"tag:{_tag(m)[1]}"
    m = _NOTICE.fullmatch(n)
    if m:
        name = m[1]
        name = NAMES.get(name) or NAMES.get(name.removeprefix("the ")) or NAMES.get(name.removesuffix(" license"))
        if name:
            return f"notice:{name}"
    return "copyright" if _COPYRIGHT.fullmatch(n) else None


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the sentences: between sentence ends or blank lines."""
    at = 0
    for m in _END.finditer(text):
        if m.end() > at:
            yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _run(lines: list[tuple[int, int, str]], at: int) -> tuple[str, int] | None:
    """(identifier, end) of the longest known sentence that the words of lines[at], lines[at + 1] and so on make."""
    got = None
    for n in dict.fromkeys((lines[at][2], _BULLET.sub("", lines[at][2]))):
        j = at
        while n in _STARTS:
            if n in _KNOWN and (got is None or lines[j][1] > got[1]):
                got = _KNOWN[n], lines[j][1]
            j += 1
            if j == len(lines):
                break
            n = f"{n} {lines[j][2]}".rstrip()
    return got


def identified(text: str) -> list[tuple[int, int, int, str | None]]:
    """(number, start, end, identifier) of each sentence; an unknown one is read line by line, as a line may stand alone.

    A known sentence may have a sentence end inside ("free software; you can"),
    so from each line of an unknown one on, following lines are joined as long as
    they go on in a known sentence. A tag has the colon of a sentence end inside,
    so a line that holds one is read whole.
    """
    out, k, done = [], 0, 0
    tags = list(_SPDX.finditer(text))[::-1]  # the next one last
    lines, first, bounds = [], [], list(sentences(text))
    for a, b in bounds:
        first.append(len(lines))
        for line in text[a:b].splitlines(keepends=True):
            lines.append((a, a + len(line), normal(line)))
            a += len(line)
    first.append(len(lines))
    for i, (a, b) in enumerate(bounds):
        joined = done > a  # to the sentence before
        many = first[i + 1] - first[i] > 1
        got = None if joined else identify(text[a:b])
        if got and not (many and got == "copyright"):  # whose lines may go on in a header
            out.append((k, a, b, got))
            k += 1
        else:
            found = 0
            for j in range(first[i], first[i + 1]):
                at, end, words = lines[j]
                if at < done or not words:
                    continue
                name, end = _run(lines, j) or (identify(text[at:end]) if many else None, end)
                if name:
                    out.append((k + found, at, end, name))
                    found, done = found + 1, end
            k += found if joined else max(1, found)
        while tags and tags[-1].start() < b:
            m = tags.pop()
            end, e = _tag(m)
            out.append((k, m.start(), end, f"tag:{e}"))
            k += 1
    return out


def matched(ids: list[tuple[int, int, int, str | None]]) -> list[tuple[str, str, int, int, int]]:
    """(licence, kind, sentences, start, end) of the rules that match."""
    out, used = [], set()
    for i, (_, start, end, name) in enumerate(ids):
        if i in used or not name:
            continue
        head, _, licence = name.partition(":")
        if licence:
            out.append((licence, head, 1, start, end))
            continue
        for licence, kind, rule in RULES:
            if rule[0] != name:
                continue
            took, j = [i], i
            for want in rule[1:]:
                j, at = None, took[-1] + 1
                while j is None and at < len(ids) and ids[at][0] - ids[took[-1]][0] <= GAP + 1:
                    j, at = (at if ids[at][3] == want and at not in used else None), at + 1
                if j is None:
                    break
                took.append(j)
            if j is not None:
                used |= set(took)
                out.append((licence, kind, len(took), start, ids[took[-1]][2]))
                break
    return out


SCAN = "doc_id long, licence string, kind string, sentences int, start long, end long"


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each licence rule that matches in a text, with its stretch of code points.

    Null and empty texts match nothing; rows that repeat give repeated rows. A
    licence that occurs twice in a text is reported twice; of rules that match at
    one sentence the first counts, so there are no ties. The work grows with the
    length of a text, however many sentences it has. An empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pc.fill_null(pc.match_substring_regex(batch.column("text"), TRIGGER, ignore_case=True), False)
            some = batch.filter(hit)
            rows = [(d, *m) for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True) for m in matched(identified(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "licence", "kind", "sentences", "start", "end"]
    return docs.select("doc_id", "text").mapInArrow(released(run), SCAN)


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(store.table(spark, sf_dir, "documents"))

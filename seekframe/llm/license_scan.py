"""Licence scans by a generalised suffix automaton over template tokens.

The automaton holds every run of words of every template. A text is streamed through it
word by word; after each word, (state, length) is its matching statistic: the longest
run ending there that occurs in some template. From it come

* phrases: each state knows which phrases are suffixes of its runs, so a phrase ends at a
  word if it is a suffix of the state's run and no longer than the match;
* spans: maximal matches of at least `min_match` words are chained, per template, at any
  of their places in it, while the places ascend and the gaps in the text stay under
  `max_gap`; a chain that covers `min_cover` of its template's words gives that
  template's label. A short part of a text is a chain's only once for each template.

A word that is in no template resets the stream at the cost of one dictionary lookup.
Memory is the automaton (linear in the templates) and one text.

Cases. Null text counts as empty: no words, no labels, score 0. Rows that repeat each
give a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, words_of

# Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Texts and notices of public licences, lower case, words only; copyright lines are left out.
_DISCLAIMER_MIT = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_DISCLAIMER_BSD = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_CONDITIONS_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": f"{_CONDITIONS_BSD} {_DISCLAIMER_BSD}",
    "bsd-3-clause": f"{_CONDITIONS_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_DISCLAIMER_BSD}",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide this software is distributed without any warranty",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "mit": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_DISCLAIMER_MIT}",
    "mit-short": "released under the mit license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "public-domain": "this work has been released into the public domain by its author",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}
#: A template's label is its name but for these.
LABEL_OF = {"mit-short": "mit"}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 8, 0.6


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: For each state, where its runs end in each template: {template: indexes of the last word, ascending}.
        self.ends: list[dict[int, list[int]]] = [{}]
        self.names = list(templates)
        texts = [t.encode().split() for t in templates.values()]
        self.sizes = [len(t) for t in texts]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        for no, t in enumerate(texts):
            at = 0
            for i, w in enumerate(t):
                at = self._extend(at, w)
                self.ends[at].setdefault(no, []).append(i)
        for p, _ in self.phrases:
            at = 0
            for w in p:
                at = self._extend(at, w)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for no, found in self.ends[s].items():
                self.ends[self.link[s]].setdefault(no, []).extend(found)
        self.ends = [{no: sorted(set(found)) for no, found in e.items()} for e in self.ends]
        #: For each state, the phrases that end its longest run: (words, phrase number).
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.next]
        home = []
        for p, _ in self.phrases:
            s = 0
            for w in p:
                s = self.next[s][w]
            home.append(s)
        for s in sorted(range(len(self.next)), key=lambda s: self.length[s]):
            if s:
                self.found[s] = list(self.found[self.link[s]])
                self.found[s] += [(len(p), k) for k, (p, _) in enumerate(self.phrases) if home[k] == s]

    def _new(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (start, phrase number), and maximal matches (end, length, state) of at least two words."""
        nxt, link, length, found, root = self.next, self.link, self.length, self.found, self.next[0]
        places, matches = [], []
        s = n = 0
        for i, w in enumerate(words):
            if not s:
                s = root.get(w, 0)
                n = 1 if s else 0
            else:
                t = nxt[s].get(w)
                if t is None:
                    if n > 1:
                        matches.append((i, n, s))
                    while s and t is None:
                        s = link[s]
                        t = nxt[s].get(w)
                    n = length[s] + 1 if t is not None else 0
                    s = t or 0
                else:
                    s, n = t, n + 1
            if s and found[s]:
                for size, k in found[s]:
                    if size <= n:
                        places.append((i - size + 1, k))
        if n > 1:
            matches.append((len(words), n, s))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> list[tuple[int, int, int, int]]:
        """(template, first word, end, words covered) of the best chains of long matches; those of a template don't overlap."""
        # For each template the chains that may go on: (end, last place) -> (first word, words covered).
        open_: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        done: dict[int, list[tuple[int, int, int]]] = {}
        for end, n, s in matches:
            if n < min_match:
                continue
            for no, places in self.ends[s].items():
                before = open_.get(no, {})
                near = {k: v for k, v in before.items() if end - n - k[0] <= max_gap}
                new = {}
                for last in places:
                    # What two matches share, in the text or in the template, counts once.
                    best = max(((v[1] + min(n, end - k[0], last - k[1]), -v[0]) for k, v in near.items() if k[1] < last and k[0] < end), default=(0, 0))
                    new[end, last] = (-best[1], best[0]) if best[0] > n else (end - n, n)
                open_[no] = near | new
                done.setdefault(no, []).extend((covered, first, e) for (e, _), (first, covered) in new.items())
        out = []
        for no, ended in done.items():
            taken: list[tuple[int, int]] = []
            for covered, first, e in sorted(ended, key=lambda x: (-x[0], x[1], x[2])):
                if all(e <= a or first >= b for a, b in taken):
                    taken.append((first, e))
                    out.append((no, first, e, covered))
        return sorted(out, key=lambda x: (x[1], x[0]))


@lru_cache(maxsize=2)
def automaton() -> Automaton:
    return Automaton(TEMPLATES, PHRASES)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,first_word:long,end_word:long,cover:double>>"
_ARROW = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))),
]


def scan_text(text: bytes, min_cover: float = MIN_COVER) -> dict:
    a, words = automaton(), words_of(text)
    places, matches = a.scan(words)
    base = {a.phrases[k][1] for _, k in places}
    spans = [{"template": a.names[no], "first_word": s, "end_word": e, "cover": n / a.sizes[no]} for no, s, e, n in a.chains(matches)]
    spans = [x for x in spans if x["cover"] >= min_cover]
    starts = [s for s, _ in places]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {LABEL_OF.get(x["template"], x["template"]) for x in spans})),
        "score": 1.0 if base else max((min(1.0, x["cover"]) for x in spans), default=0.0), "spans": spans,
    }


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id and what SCHEMA names, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t.as_py(), min_cover) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[n] for x in found], kind) for n, kind in _ARROW)], names=["doc_id", *(n for n, _ in _ARROW)])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")

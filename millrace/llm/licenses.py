"""License scans: templates with optional and replaceable regions, compiled into automata over words."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import make_room, map_texts, table

#: Fixed values of the base rule: phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Markup: ``<<opt>> .. <</opt>>`` may be left out; ``<<var:n>>`` stands for up to n words of any kind; ``<<alt:a|b>>`` for one of the wordings.
_GIVEN = "<<alt:licensed|released|distributed|available|provided|shared>> under <<opt>><<alt:the terms of|the conditions of>><</opt>>"


def _gnu(name: str, version: str, thing: str) -> tuple[str, ...]:
    """Statements that something is under a GNU licence of a version."""
    by = f"<<opt>>the<</opt>> gnu {name} <<opt>>({thing})<</opt>> <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> <<opt>><<alt:version|v>><</opt>>"
    return (
        f"{_GIVEN} {by} {version}",
        f"redistribute it and/or modify it under the terms of {by} {version}",
        *(f"{_GIVEN} <<opt>>the<</opt>> {short}" for short in (f"{thing}v{version}", f"{thing} {version}", f"{thing} v{version}", f"{thing} version {version}")),
    )


def _gnu_notice(name: str, version: str) -> str:
    """The notice that the licence asks to be put into each file, up to the end of its disclaimer."""
    return (
        f"is free software<<alt::|;>> you can redistribute it and/or modify it under the terms of the gnu {name} as published by the free software foundation<<alt:,|;>> either "
        f"version {version} of the license, or (at your option) any later version. <<opt>>this<</opt>> <<var:6>> is distributed in the hope that it will be useful, but without any warranty; "
        f"without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {name} for more details"
    )


def _creative_commons() -> dict[str, tuple[str, ...]]:
    """The six licences in versions 2.0 to 4.0, by their long and short names."""
    long = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    out = {}
    for parts in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version, after in (("4.0", "international"), ("3.0", "unported"), ("2.5", "generic"), ("2.0", "generic")):
            full = "attribution " + " ".join(f"<<alt:{long[p]}|{'non commercial' if p == 'nc' else 'no derivatives' if p == 'nd' else 'share alike'}|{'noderivs' if p == 'nd' else long[p]}>>" for p in parts)
            short = "-".join(("by", *parts))
            out[f"cc-{short}-{version}"] = (
                f"<<alt:licensed|released|available|distributed|shared>> under <<opt>><<alt:a|the>><</opt>> <<opt>>terms of the<</opt>> creative commons {full} <<opt>>license<</opt>> <<opt>>version<</opt>> {version} <<opt>>{after}<</opt>> <<opt>>public<</opt>> <<alt:license|licence|(cc {short} {version})>>",
                f"<<alt:licensed|released|available|distributed|shared>> under <<opt>><<alt:a|the>><</opt>> <<opt>>creative commons attribution license<</opt>> cc {short} {version}",
            )
    return out


#: Templates by label: statements, notices of files, and whole texts of short licences (``-text``, fixed values of their authors).
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "apache-2.0": ("<<opt>>this <<alt:work|software|project|file>> is<</opt>> licensed under the apache license<<opt>>,<</opt>> version 2.0", f"{_GIVEN} the apache license <<opt>>version<</opt>> 2.0"),
    "apache-2.0-notice": "licensed under the apache license, version 2.0 (the \"license\"); you may not use <<alt:this file|this work|these files|this software|this project>> except in compliance with the license. you may obtain a copy of the license at <<var:8>> unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license",
    "gpl-3.0": _gnu("general public license", "3", "gpl"),
    "gpl-2.0": _gnu("general public license", "2", "gpl"),
    "lgpl-3.0": _gnu("lesser general public license", "3", "lgpl"),
    "lgpl-2.1": _gnu("lesser general public license", "2.1", "lgpl"),
    "agpl-3.0": _gnu("affero general public license", "3", "agpl"),
    "gpl-3.0-notice": _gnu_notice("general public license", "3"),
    "gpl-2.0-notice": _gnu_notice("general public license", "2"),
    "lgpl-3.0-notice": _gnu_notice("lesser general public license", "3"),
    "lgpl-2.1-notice": _gnu_notice("lesser general public license", "2.1"),
    "agpl-3.0-notice": _gnu_notice("affero general public license", "3"),
    "mpl-2.0": f"{_GIVEN} the mozilla public license<<opt>>,<</opt>> <<alt:version|v.|v>> 2.0",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at <<opt>><<alt:http|https>>://<</opt>>mozilla.org/mpl/2.0/",
    "mit-notice": f"{_GIVEN} the mit license",
    "cc0-1.0": ("to the extent possible under law, <<var:12>> has waived all copyright and related or neighboring rights to", "<<alt:licensed|released|available|dedicated>> <<alt:under|to>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc0 <<opt>>1.0<</opt>>"),
    **_creative_commons(),
    "mit-text": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the <<opt>>\"<</opt>>software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies or substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall <<var:8>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\" and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall <<var:8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    "0bsd-text": "permission to use, copy, modify, and<<opt>>/or<</opt>> distribute this software for any purpose with or without fee is hereby granted. the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<opt>><<alt:1.|a.>><</opt>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<opt>><<alt:2.|b.>><</opt>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<opt>><<opt>><<alt:3.|c.>><</opt>> neither the name of <<var:12>> may be used to endorse or promote products derived from this software without specific prior written permission.<</opt>> this software is provided by <<var:12>> \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall <<var:12>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    "zlib-text": "this software is provided 'as-is', without any express or implied warranty. in no event will <<var:6>> be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<</opt>> the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2.<</opt>> altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3.<</opt>> this notice may not be removed or altered from any source distribution",
    "bsl-1.0-text": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement. in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability, whether in contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
}

#: ASCII bytes other than 0-9 A-Z a-z part words; A-Z become a-z; all other bytes are letters.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(FOLD)


class Automaton:
    """One template as an automaton over words.

    Built as a nondeterministic one with empty moves around optional regions and a counted any-word loop for
    replaceable ones; sets of states become states of the deterministic one when a text first needs them.
    """

    def __init__(self, label: str, markup: str):
        self.label = label
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.mandatory = 0
        tokens = re.findall(r"<<opt>>|<</opt>>|<<var:\d+>>|<<alt:[^>]*>>|[^<]+", markup)
        end, rest = self._sequence(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError(f"{label}: unbalanced markup")
        self.final = end
        first = self._close({0})
        if self.final in first:
            raise ValueError(f"{label}: no mandatory wording")
        self.known: dict[frozenset, dict[bytes, frozenset]] = {}
        self.n_known = 0
        self.first = first
        self.starts = {w for s in first for w, _ in self.edges[s]}
        #: the longest run of mandatory words between markup: any accepted text holds it
        runs = [fold(t.encode()).split() for t in self._mandatory(tokens)]
        self.key = b" " + b" ".join(max(reversed(runs), key=lambda r: (len(r), sum(map(len, r))))) + b" "

    @staticmethod
    def _mandatory(tokens: list[str]) -> list[str]:
        out, depth = [], 0
        for t in tokens:
            depth += (t == "<<opt>>") - (t == "<</opt>>")
            if depth == 0 and not t.startswith("<<"):
                out.append(t)
        return out

    def _node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _words(self, text: str, at: int) -> int:
        for w in fold(text.encode()).split():
            nxt = self._node()
            self.edges[at].append((w, nxt))
            at = nxt
        return at

    def _sequence(self, tokens: list[str], i: int, at: int) -> tuple[int, int]:
        while i < len(tokens):
            t = tokens[i]
            if t == "<</opt>>":
                return at, i
            if t == "<<opt>>":
                inner, i = self._sequence(tokens, i + 1, at)
                if i == len(tokens):
                    raise ValueError(f"{self.label}: unbalanced markup")
                out = self._node()
                self.empty[inner].append(out)
                self.empty[at].append(out)
                at = out
            elif t.startswith("<<var:"):
                out = self._node()
                self.empty[at].append(out)
                for _ in range(int(t[6:-2])):
                    nxt = self._node()
                    self.edges[at].append((None, nxt))
                    self.empty[nxt].append(out)
                    at = nxt
                at = out
            elif t.startswith("<<alt:"):
                out = self._node()
                for way in t[6:-2].split("|"):
                    self.empty[self._words(way, at)].append(out)
                at = out
            else:
                at = self._words(t, at)
            i += 1
        return at, i

    def _close(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _next(self, states: frozenset, word: bytes) -> frozenset:
        known = self.known.setdefault(states, {})
        got = known.get(word)
        if got is None:
            got = self._close({t for s in states for w, t in self.edges[s] if w is None or w == word})
            if self.n_known < 50_000:
                known[word] = got
                self.n_known += 1
        return got

    def ends(self, words: list[bytes], at: int) -> int:
        """The end of the shortest text accepted from word ``at`` on, or -1."""
        states = self.first
        while states:
            if self.final in states:
                return at
            if at == len(words):
                return -1
            states = self._next(states, words[at])
            at += 1
        return -1

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """All (start, end) of accepted texts, one for each start."""
        out = []
        for i, w in enumerate(words):
            if w in self.starts and (end := self.ends(words, i)) >= 0:
                out.append((i, end))
        return out


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> dict[bytes, list[Automaton]]:
    """The automata by the run of words that a text must hold."""
    out: dict[bytes, list[Automaton]] = {}
    for label, markup in templates:
        a = Automaton(label, markup)
        out.setdefault(a.key, []).append(a)
    return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers where the phrase's words start; ``joined`` has a blank on either side of each word."""
    out, at, word, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: bytes, phrases: tuple[tuple[bytes, str], ...], automata: dict[bytes, list[Automaton]]) -> tuple:
    words = fold(text).split()
    joined = b" " + b" ".join(words) + b" "
    base = [(p, label) for phrase, label in phrases for p in places(joined, phrase)] if words else []
    matches = [(a.label, s, e) for key, some in automata.items() if key in joined for a in some for s, e in a.find(words)] if words else []
    own = sorted({label for _, label in base})
    starts = [p for p, _ in base]
    longest = max((e - s for _, s, e in matches), default=0)
    score = 0.5 + 0.5 * longest / (longest + 8) if matches else 0.5 if base else 0.0
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted({*own, *(m[0] for m in matches)})), score, ",".join(dict.fromkeys(f"{label}:{s}-{e}" for label, s, e in matches))


def all_templates(templates: dict[str, str | tuple[str, ...]]) -> tuple[tuple[str, str], ...]:
    """Each label with each of its templates."""
    return tuple((label, m) for label, some in templates.items() for m in ((some,) if isinstance(some, str) else some))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str | tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A template's label is given when its automaton accepts some run of the text's words; a label may have several
    templates. ``score`` is 0 without a place or match, one half with base phrases only, and nears 1 with the words w
    of the longest match: 1 - 4 / (w + 8). ``matches`` lists label:start-end in words. Null and empty texts have no
    words, no labels and score 0; repeated rows are scanned each on their own; an empty table gives no rows.
    """
    chosen = all_templates(templates or TEMPLATES)
    phrases = tuple((b" " + p.encode() + b" ", label) for p, label in PHRASES)

    def make():
        make_room()
        automata = compiled(chosen)
        return lambda texts: [scan(t or b"", phrases, automata) for t in texts]

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("matches", "string")]
    return map_texts(docs, id_col, text_col, make, fields)


def op6(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))

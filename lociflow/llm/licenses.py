"""Licence wording in text by templates compiled to token automata."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import Words, chunks, slices

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Markup: [optional words]  {from-to} any words, {from-to:a|b} those words only. The rest is mandatory.
# <!word|word> in front: not behind one of these. The wording is that of the licences' own notices and texts.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0 [the license]",
                   "licensed under the apache 2 0 license"],
    "mit": ["[released|licensed|distributed|available] under the [terms of the] mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "bsd": ["[released|licensed] under the [terms of the] [2|3 clause] [new|modified|simplified] bsd [2|3 clause] license",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl-2.0": ["<!lesser|library|affero> [gnu] general public license [as published by the free software foundation] [either] version 2"],
    "gpl-3.0": ["<!lesser|library|affero> [gnu] general public license [as published by the free software foundation] [either] version 3"],
    "agpl-3.0": ["[gnu] affero general public license [as published by the free software foundation] [either] version 3"],
    "lgpl": ["gnu lesser general public license [version] {0-1:2|3}", "gnu library general public license"],
    "mpl-2.0": ["[subject to the terms of|licensed under] the mozilla public license [v|version] 2 0"],
    "cc0-1.0": ["[licensed under|released under|dedicated under] [creative commons] cc0 [1 0]"],
    "cc-by-sa": ["[licensed under] cc by sa {0-2}", "creative commons attribution share alike {0-2:1|2|3|4|0|5|international|license}"],
    "cc-by-nc": ["licensed under [a|the] cc by nc {0-2:1|2|3|4|0|5}", "creative commons attribution non commercial {0-2:1|2|3|4|0|5|international|license}"],
    "cc-by-4.0": ["licensed under [a|the] cc by 4 0", "creative commons attribution 4 0 international"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall {1-8} be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software"],
    "isc-text": [
        "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and {1-8} disclaims all warranties with regard to "
        "this software including all implied warranties of merchantability and fitness in no event shall {1-8} be liable for any special direct indirect "
        "or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in "
        "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution [[3] neither the name of {1-12} nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission] this software is provided by {1-12} as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event "
        "shall {1-12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
        "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
        "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the "
        "possibility of such damage"],
    "all-rights-reserved": ["[copyright [c] {0-6}] all rights reserved"],
}
_BEHIND = re.compile(r"<!([^>]*)>\s*")
_MARK = re.compile(r"\[|\]|\||\{(\d+)-(\d+)(?::([^}]*))?\}|[^\s\[\]|{}]+")


@dataclass
class Automaton:
    """States in order; ``step[s]`` are (word, next), with None for any word; ``free[s]`` are moves without a word."""
    label: str
    step: list[list[tuple[bytes | None, int]]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    needed: list[int] = field(default_factory=lambda: [0])        # mandatory words passed when in the state
    last: int = 0
    not_behind: frozenset = frozenset()

    def _state(self, needed: int) -> int:
        self.step.append([])
        self.free.append([])
        self.needed.append(needed)
        return len(self.step) - 1

    @classmethod
    def compiled(cls, label: str, template: str) -> Automaton:
        a, refused = cls(label), _BEHIND.match(template)
        a.not_behind = frozenset(w.encode() for w in refused[1].split("|")) if refused else frozenset()
        parts = _MARK.finditer(template, refused.end() if refused else 0)

        def sequence(at: int, optional: bool) -> list[int]:
            """Compiles up to the closing bracket; the states at the ends of the alternatives."""
            begin, ends = at, []
            for m in parts:
                token = m[0]
                if token == "[":
                    inner = sequence(at, True)
                    after = a._state(a.needed[at])
                    for s in (at, *inner):
                        a.free[s].append(after)
                    at = after
                elif token == "]":
                    break
                elif token == "|":
                    ends.append(at)
                    at = begin
                elif m[1] is not None:
                    words = [w.encode() for w in m[3].split("|")] if m[3] else [None]
                    spots = [at]
                    for _ in range(int(m[2])):
                        nxt = a._state(a.needed[at])
                        a.step[spots[-1]] += [(w, nxt) for w in words]
                        spots.append(nxt)
                    after = a._state(a.needed[at])
                    for s in spots[int(m[1]):]:
                        a.free[s].append(after)
                    at = after
                else:
                    nxt = a._state(a.needed[at] + (not optional))
                    a.step[at].append((token.encode(), nxt))
                    at = nxt
            return [*ends, at]
        a.last = sequence(0, False)[-1]
        return a

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w, _ in self.step[s] if w is not None}

    def match(self, word, n: int, at: int) -> tuple[bool, int]:
        """Whether the words from ``at`` reach the end, and the most mandatory words passed."""
        if at and self.not_behind and word(at - 1) in self.not_behind:
            return False, 0
        states, most = self.closure({0}), 0
        for i in range(at, n):
            if self.last in states:
                break
            w = word(i)
            states = self.closure({t for s in states for x, t in self.step[s] if x is None or x == w})
            if not states:
                break
            most = max(most, max(self.needed[s] for s in states))
        return self.last in states, most


class Matcher:
    def __init__(self, templates=None):
        self.automata = [Automaton.compiled(label, t) for label, ts in (templates or TEMPLATES).items() for t in ts]
        self.phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
        self.by_word: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first_words():
                self.by_word.setdefault(w, []).append(a)
        words = sorted({*self.by_word, *(p[0] for p, _ in self.phrases)})
        self.hashes = np.sort(np.array([Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hash[0] for w in words], np.uint64))

    def scan(self, column: pa.Array):
        """(words, places, first, last, base labels, labels, score) of each text."""
        for _, data, at in chunks(column):
            w = Words(data, at)
            bits = np.zeros(1 << 16, bool)
            bits[self.hashes >> np.uint64(48)] = True
            maybe = np.flatnonzero(bits[w.hash >> np.uint64(48)])
            maybe = maybe[np.isin(w.hash[maybe], self.hashes)]
            cut = np.searchsorted(maybe, w.of)
            for d in range(len(at) - 1):
                n, base, begin = int(w.of[d + 1] - w.of[d]), [], int(w.of[d])
                labels, best = set(), 0.0

                def word(i):
                    return w.word(begin + i)
                for i in (maybe[cut[d]:cut[d + 1]] - begin).tolist():
                    here = word(i)
                    for phrase, label in self.phrases:
                        if phrase[0] == here and i + len(phrase) <= n and all(word(i + j) == p for j, p in enumerate(phrase)):
                            base.append((i, label))
                    for a in self.by_word.get(here, ()):
                        ok, passed = a.match(word, n, i)
                        if ok:
                            labels.add(a.label)
                        best = max(best, 1.0 if ok else passed / a.needed[a.last])
                found = {label for _, label in base}
                yield (n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                       ",".join(sorted(found)), ",".join(sorted(found | labels)), best)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    Words are runs of A-Z (lower-cased), digits and characters beyond ASCII. Base phrases are places where their words stand
    consecutively. Each template becomes an automaton over words: optional regions are moves without a word, replaceable ones
    take any or given words. It is started wherever one of its first words stands, and accepts a text
    whose mandatory wording follows exactly; its label is then added. The score is 1 if one accepts, else the
    largest share of mandatory words that one passed.

    Null and empty texts have no words, null places, empty labels and score 0; repeated rows each get
    a row, null identifiers stay; very long texts are scanned whole; an empty table gives none. One pass, without a shuffle.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    types = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
             ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]

    def run(batches):
        matcher = Matcher(templates)
        for b in slices(batches):
            found = list(matcher.scan(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(types))],
                                             ["doc_id", *(n for n, _ in types)])
    schema = named.select("doc_id").schema
    for name, t in types:
        schema = schema.add(name, {"int64": "long", "string": "string", "double": "double"}[str(t)])
    return named.mapInArrow(run, schema)

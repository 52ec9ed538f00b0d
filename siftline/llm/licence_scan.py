"""Licence scans: matching statistics against a generalized suffix automaton of licence words.

All templates go into one suffix automaton over word ids. A text is streamed through it: at each word
the automaton gives the longest stretch that ends there and occurs in some template. Stretches of
``LEAST_MATCH`` words or more that can't be extended are located in the templates that hold them, and
chained per template in the order of text and template, with at most ``MOST_GAP`` words between; a
chain that covers ``LEAST_COVER`` of its template is a find. Notices that name a version or a Creative
Commons licence must be there whole, since one word decides which licence it is; whole published texts
(``-text``) to ``LEAST_TEXT``, since the texts of one family share much.

Templates: short notices and headers (here) and the published texts in ``licences/``, verbatim.

A long match consists of template words only, so only runs of ``LEAST_MATCH`` such words are streamed;
the runs are found for a whole batch at once. This drops nothing.

Words are runs of letters and digits, in lower case. Defined cases: null and empty texts give no
finds; a null doc_id is carried along; repeated rows give their finds again; of overlapping finds of one
licence, or of rivals (``rivals``: notices, headers or texts of one family), the one that covers most
stays, then the one of the shorter template, then the earlier; a licence said twice in a text is found twice;
other columns are never read. A text of any length and any repetition takes time in proportion to its length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, span_hashes, utf8, words

LEAST_MATCH = 4
MOST_GAP = 12
LEAST_COVER = 0.7
LEAST_TEXT = 0.85
GNU = {"gpl": "GNU general public license", "lgpl": "GNU lesser general public license", "agpl": "GNU affero general public license"}
VERSIONS = {"gpl": ("1 0", "2 0", "3 0"), "lgpl": ("2 0", "2 1", "3 0"), "agpl": ("1 0", "3 0")}
CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


def _notices() -> Iterator[tuple[str, tuple[str, ...]]]:
    """The short forms of the versioned licences, each as people write it."""
    for kind, name in GNU.items():
        yield f"{kind}-notice", (f"licensed under the {name}",)
        for lead in (f"licensed under the {name}", name, f"licensed under the {kind}", f"under the {kind}", f"licensed under {kind}", f"GNU {kind}"):
            for version in VERSIONS[kind]:
                whole = [version.removesuffix(" 0"), version] if version.endswith(" 0") else [version]
                for v in (f"{word}{n}" for n in whole for word in ("version ", "v", "")):
                    yield f"{kind}-{version.replace(' ', '.')}-notice", (f"{lead} {v}",)
        for version in VERSIONS[kind]:
            for n in sorted({version, version.removesuffix(" 0")}):
                yield f"{kind}-{version.replace(' ', '.')}-notice", (f"license {kind} {n} only" if n != version else f"license {kind} {n}",)
                yield f"{kind}-{version.replace(' ', '.')}-notice", (f"{kind} {n} or later",)
    for version in ("1 1", "2 0"):
        for lead in ("licensed under the apache license", "the apache license", "apache license", "licensed under apache", "licensed under the apache"):
            for v in ("version ", "v", ""):
                yield f"apache-{version.replace(' ', '.')}-notice", (f"{lead} {v}{version}",)
        for tail in ("license", "licence"):
            yield f"apache-{version.replace(' ', '.')}-notice", (f"apache {version} {tail}",)
        yield f"mpl-{version.replace(' ', '.')}-notice", (f"licensed under mpl {version}",)
        for lead in ("mozilla public license", "licensed under the mozilla public license"):
            for v in ("version ", "v ", "v", ""):
                yield f"mpl-{version.replace(' ', '.')}-notice", (f"{lead} {v}{version}",)
    yield "apache-2.0-notice", ("licensed under the apache license version 2",)
    yield "apache-notice", ("licensed under the apache license",)
    yield "mpl-notice", ("licensed under the mozilla public license",)
    for name, said in (("bsd", "bsd license"), ("bsd-2-clause", "bsd 2 clause license"), ("bsd-2-clause", "2 clause bsd license"), ("bsd-3-clause", "bsd 3 clause license"), ("bsd-3-clause", "3 clause bsd license"), ("isc", "isc license"), ("mit", "mit license"), ("mit", "mit licence"), ("zlib", "zlib license"), ("unlicense", "unlicense")):
        for lead in ("licensed under the", "released under the", "under the"):
            yield f"{name}-notice", (f"{lead} {said}",)
    for kind, name in CC.items():
        short, names = f"cc {kind.replace('-', ' ')}", {name}
        for one, two in (("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noderivatives", "no derivatives"), ("noderivatives", "noderivs")):
            names |= {n.replace(one, two) for n in names}
        leads = [short, f"licensed under {short}", f"licensed under a {short}", f"licensed under the {short}", f"licensed under creative commons {kind.replace('-', ' ')}", f"creative commons {kind.replace('-', ' ')}"]
        leads += [f"{lead}creative commons {n}" for n in sorted(names) for lead in ("", "licensed under a ", "licensed under the ", "licensed under ")]
        for lead in leads:
            yield f"cc-{kind}-notice", (lead,)
            for version in CC_VERSIONS:
                for v in (version, f"v{version}", f"version {version}"):
                    yield f"cc-{kind}-{version.replace(' ', '.')}-notice", (f"{lead} {v}",)
                for place in ("international", "unported", "generic"):
                    yield f"cc-{kind}-{version.replace(' ', '.')}-notice", (f"{lead} {version} {place} license",)
        for version in CC_VERSIONS:
            yield f"cc-{kind}-{version.replace(' ', '.')}-notice", (f"creativecommons org licenses {kind.replace('-', ' ')} {version}",)
    for said in ("cc0 1 0", "cc 0 1 0", "cc0 1 0 universal", "creative commons zero", "creative commons cc0", "licensed under cc0", "released under cc0", "creativecommons org publicdomain zero 1 0"):
        yield "cc0-1.0-notice", (said,)


def _headers() -> Iterator[tuple[str, tuple[str, ...]]]:
    """The header that the GNU licences have put on each file; that of gpl-3.0 is below."""
    for kind, name in (*GNU.items(), ("lgpl", "GNU library general public license")):
        for version in VERSIONS[kind]:
            if (kind, version) != ("gpl", "3 0"):
                for v in sorted({version, version.removesuffix(" 0")}):
                    for what in ("program", "library"):
                        yield f"{kind}-{version.replace(' ', '.')}", (f"this {what} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {v} of the license or at your option any later version", f"this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose")


def _texts() -> Iterator[tuple[str, tuple[str, ...]]]:
    """The published texts; also MIT's without its disclaimer."""
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        yield path.stem, (text,)
        if path.stem == "mit":
            yield "mit", (text.split("THE SOFTWARE IS PROVIDED")[0],)


#: (licence, its clauses). Short notices are templates of their own.
TEMPLATES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("mit-notice", ("released under the MIT license",)),
    ("mit-notice", ("licensed under the MIT license",)),
    ("mit", ("permission is hereby granted free of charge to any person", "obtaining a copy of this software and associated documentation files", "the software to deal in the software without restriction", "including without limitation the rights to use copy modify merge", "publish distribute sublicense and or sell copies of the software", "the above copyright notice and this permission notice", "shall be included in all copies or substantial portions", "the software is provided as is without warranty of any kind")),
    ("apache-2.0-notice", ("licensed under the apache license version 2 0",)),
    ("apache-2.0", ("licensed under the apache license version 2 0 the license", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing", "software distributed under the license is distributed on an as is basis", "without warranties or conditions of any kind either express or implied", "see the license for the specific language governing permissions and", "limitations under the license")),
    ("gpl-3.0-notice", ("this work is licensed under the GNU general public license version 3",)),
    ("gpl-3.0-notice", ("licensed under the GNU general public license version 3",)),
    ("gpl-3.0", ("this program is free software you can redistribute it and or modify", "it under the terms of the GNU general public license as published by", "the free software foundation either version 3 of the license or", "at your option any later version", "this program is distributed in the hope that it will be useful", "but without any warranty without even the implied warranty of", "merchantability or fitness for a particular purpose")),
    ("lgpl-notice", ("licensed under the GNU lesser general public license",)),
    ("mpl-2.0", ("this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the MPL was not distributed with this file", "you can obtain one at")),
    ("bsd", ("redistribution and use in source and binary forms with or without", "modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice", "this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice")),
    ("isc", ("permission to use copy modify and or distribute this software", "for any purpose with or without fee is hereby granted", "provided that the above copyright notice and this permission notice appear in all copies")),
    ("cc-by-4.0-notice", ("licensed under a creative commons attribution 4 0 international license",)),
    ("unlicense", ("this is free and unencumbered software released into the public domain",)),
    ("reserved-notice", ("all rights reserved",)),
    *_notices(),
    *_headers(),
    *_texts(),
)


@cache
def rivals(name: str) -> str:
    """What only one of several overlapping finds may be: notices, headers or texts of one family."""
    family = name.split("-")[0]
    kind = next((k for k in ("notice", "text") if name.endswith(f"-{k}")), "body")
    return f"{ {'gpl': 'gnu', 'lgpl': 'gnu', 'agpl': 'gnu', 'cc0': 'cc', '0bsd': 'isc'}.get(family, family)} {kind}"


def _least(name: str, length: int) -> float:
    """How many words of a template must be covered."""
    return length * (LEAST_TEXT if name.endswith("-text") else LEAST_COVER)


class Automaton:
    """A generalized suffix automaton of sequences of word ids."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for which, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((which, at + 1))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(length of the longest stretch that ends at each word and occurs in a template, its state)."""
        out, state, length = [], 0, 0
        for word in sequence:
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.step[state]:
                state, length = self.step[state][word], length + 1
            else:
                length = 0
            out.append((length, state))
        return out

    def long_matches(self, sequence: list[int], least: int) -> list[tuple[int, int, int, int]]:
        """(start, length, template, start in it): every match of ``least`` words or more that can't be extended within its template."""
        out: list[tuple[int, int, int, int]] = []
        before: dict[tuple[int, int], int] = {}
        for at, (length, state) in enumerate([*self.statistics(sequence), (0, 0)]):
            now: dict[tuple[int, int], int] = {}
            while length >= least:
                for place in self.ends[state]:
                    now.setdefault(place, length)
                state = self.link[state]
                length = self.length[state]
            out += [(at - n, n, which, end - n) for (which, end), n in sorted(before.items()) if (which, end + 1) not in now]
            before = now
        return out


class Compiled(NamedTuple):
    hashes: np.ndarray  # of the templates' words, sorted
    vocabulary: dict[int, int]
    automaton: Automaton
    names: list[str]
    lengths: list[int]
    least: list[float]  # words of each template that must be covered


@cache
def _compiled() -> Compiled:
    sequences, names, least, vocabulary = [], [], [], {}
    for name, clauses in dict.fromkeys(TEMPLATES):
        data, offsets = utf8(pa.array([" ".join(clauses)]), lower=True)
        starts, ends, _ = words(data, offsets)
        sequences.append([vocabulary.setdefault(h, len(vocabulary)) for h in span_hashes(data, starts, ends).tolist()])
        names.append(name)
        exact = name.endswith("-notice") and (name.startswith("cc") or any(c.isdigit() for c in " ".join(clauses)))
        least.append(len(sequences[-1]) if exact else _least(name, len(sequences[-1])))
    return Compiled(np.array(sorted(vocabulary), np.uint64), vocabulary, Automaton(sequences), names, [len(s) for s in sequences], least)


class Apart:
    """Spans that don't overlap."""

    def __init__(self) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, begin: int, end: int) -> bool:
        """Takes the span, unless it overlaps one that is there."""
        k = bisect_left(self.begins, begin)
        if (k and self.ends[k - 1] > begin) or (k < len(self.begins) and self.begins[k] < end):
            return False
        self.begins.insert(k, begin)
        self.ends.insert(k, end)
        return True


def chains(matches: list[tuple[int, int, int, int]], least: list[float]) -> list[tuple[int, int, int, int]]:
    """(template, start, end, covered words) of the chains that cover enough of their template."""
    found = []
    by: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, which, place in matches:
        by.setdefault(which, []).append((start, length, place))
    for which, own in sorted(by.items()):
        own.sort()
        best: list[tuple[int, int]] = []  # covered words, start of the chain
        by_end: dict[int, list[int]] = {}
        for i, (start, length, place) in enumerate(own):
            covered, begin = length, start
            for j in sorted((j for end in range(start - MOST_GAP, start + 1) for j in by_end.get(end, ())), reverse=True):
                _, n, p = own[j]
                if place >= p + n and best[j][0] + length > covered:
                    covered, begin = best[j][0] + length, best[j][1]
            best.append((covered, begin))
            by_end.setdefault(start + length, []).append(i)
        taken = Apart()
        for covered, begin, end in sorted(((c, b, s + n) for (c, b), (s, n, _) in zip(best, own) if c >= least[which]), key=lambda x: (-x[0], x[1], x[2])):
            if taken.add(begin, end):
                found.append((which, begin, end, covered))
    return sorted(found, key=lambda f: (f[1], f[0]))


def finds_of_words(known: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(licence, first word, end, covered words, template's words) of one text's word ids, -1 where no template has the word."""
    _, _, automaton, names, lengths, least = _compiled()
    matches, inside = [], known >= 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= min(LEAST_MATCH, 3):
            matches += [(a + s, n, w, p) for s, n, w, p in automaton.long_matches(known[a:b].tolist(), LEAST_MATCH) + _whole_short(automaton, known[a:b].tolist(), lengths)]
    out: list[tuple[str, int, int, int, int]] = []
    taken: dict[str, Apart] = {}
    for w, a, b, c in sorted(chains(sorted(set(matches)), least), key=lambda f: (-f[3], lengths[f[0]], f[1])):
        if taken.setdefault(rivals(names[w]), Apart()).add(int(a), int(b)):
            out.append((names[w], int(a), int(b), int(c), lengths[w]))
    return sorted(out, key=lambda f: (f[1], f[0]))


def _whole_short(automaton: Automaton, sequence: list[int], lengths: list[int]) -> list[tuple[int, int, int, int]]:
    """Whole occurrences of templates shorter than LEAST_MATCH."""
    return [m for m in automaton.long_matches(sequence, 3) if m[1] < LEAST_MATCH and m[1] == lengths[m[2]]]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sorted_hashes, vocabulary = _compiled()[:2]
    as_id = np.array([vocabulary[h] for h in sorted_hashes.tolist()])
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = utf8(piece.column("text"), lower=True)
            starts, ends, row = words(data, offsets)
            hashes = span_hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
            known = np.where(sorted_hashes[at] == hashes, as_id[at], -1)
            hit, bounds = known >= 0, np.searchsorted(row, np.arange(piece.num_rows + 1))
            run = hit[:-2] & hit[1:-1] & hit[2:] & (row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, bool)
            out = []
            for r in np.unique(row[:-2][run]) if len(row) > 2 else ():
                out += [(int(r), *f) for f in finds_of_words(known[bounds[r] : bounds[r + 1]])]
            columns = [pa.array([f[i] for f in out], kind) for i, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array([f[0] for f in out], pa.int64())), *columns], ["doc_id", "licence", "first_word", "end_word", "covered", "template_words"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, first_word, end_word, covered, template_words): a row for each find."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_scan_batches, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licence string, first_word long, end_word long, covered int, template_words int")

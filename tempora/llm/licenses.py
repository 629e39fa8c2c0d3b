"""License scans: winnowed template fingerprints, then banded alignment.

Every template is cut into word K-grams; of each ``WINDOW`` consecutive K-grams the
one of least hash is kept (winnowing), so any stretch of K + WINDOW - 1 template words
holds an indexed gram.  The inverted index maps a gram to its templates and places.
All K-grams of a document are looked up; every template and distance (place in the
document less place in the template) that is hit is a candidate, and a sequence
alignment of the template with the words within ``BAND`` of that distance gives the
matched words, so that inserted, dropped or
changed words are allowed for.  A match of ``COVER`` of the template's words is
reported with its span, if every identifying word is matched: those marked ``MARK`` in
the template (name, variant, version; ``a|b`` allows either).  Between identifying
words that follow one another no other word may stand, so "GNU Lesser General" is not
"GNU General".  Templates are whole licence texts (files of ``licence_texts``), whole
file headers and one-line notices; coverage is the share of the whole template.  Before a long template is aligned, its
words that occur near the distance at all are counted: an upper bound of the match, so
what cannot reach ``COVER`` is passed over and nothing else.

Scale: a single pass over whole texts without a shuffle; the templates are a fixed
parameter and travel with the task.

Edge cases: letter case and outer punctuation don't matter; null and empty texts have
no match; a document that holds a template several times has a row for each place;
of matches that overlap, the one with most matched words stays (ties: the first);
templates shorter than K words are one gram, and short ones keep all their grams; rows that repeat an id repeat its matches; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontam import PUNCTUATION
from .text import slices, window_hashes

K, WINDOW, BAND, COVER = 3, 4, 6, 0.8
LONG, PART = 40, 20_000  # words of a template that is bounded first; of a text that is compared at once

MARK = "^"
_V2, _V3, _V21 = "^2|2.0|v2|v2.0|2.0-only|2-only", "^3|3.0|v3|v3.0|3.0-only|3-only", "^2.1|v2.1|2.1-only"

# Whole texts by file name, with the phrases that tell near neighbours apart.
TEXTS = {
    "apache-2.0": [], "artistic-1.0": [], "bsd-2-clause": [], "bsd-3-clause": ["Neither the name"],
    "bsd-4-clause": ["All advertising materials"], "cc0-1.0": [], "gfdl-1.2": ["1.2,"], "gfdl-1.3": ["1.3,"],
    "gpl-1": ["GNU GENERAL PUBLIC", "1,"], "gpl-2": ["GNU GENERAL PUBLIC", "2,"], "gpl-3": ["GNU GENERAL PUBLIC", "3,"],
    "isc": ["provided that"], "lgpl-2": ["GNU LIBRARY GENERAL PUBLIC", "2,"],
    "lgpl-2.1": ["GNU LESSER GENERAL PUBLIC", "2.1,"], "lgpl-3": ["GNU LESSER GENERAL PUBLIC", "3,"],
    "mit": ["subject to the following conditions:"], "mpl-1.1": [], "mpl-2.0": [],
}


def _text(name: str) -> str:
    text = " ".join(files(f"{__package__}.licence_texts").joinpath(f"{name}.txt").read_text().split())
    for phrase in TEXTS[name]:
        text = text.replace(phrase, " ".join(MARK + w for w in phrase.split()), 1)
    return text


def _gnu(kind: str, version: str) -> str:
    """The header that the GNU licences ask for."""
    name = "^GNU " + " ".join(f"^{w}" for w in f"{kind} General Public".split())
    plain = name.replace(MARK, "")
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} "
            f"License as published by the Free Software Foundation, either version {version} of the License, or (at your "
            "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
            "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
            f"{plain} License for more details. You should have received a copy of the {plain} License along with this "
            "program. If not, see <https://www.gnu.org/licenses/>.")


_LICENSE_URL = 'you may not use this file except in compliance with the License. You may obtain a copy of the License at'

# Public licence texts, headers and notices.
TEMPLATES = {
    "apache-2.0/notice": "Licensed under the ^Apache ^License, Version ^2.0|2|v2|v2.0",
    "apache-2.0/header": "Licensed under the ^Apache ^License, Version ^2.0|2|v2|v2.0 (the License); "
                         f"{_LICENSE_URL} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
                         "or agreed to in writing, software distributed under the License is distributed on an AS IS "
                         "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
                         "License for the specific language governing permissions and limitations under the License.",
    "apache-1.1/notice": "Licensed under the ^Apache ^Software|License ^License|Version Version ^1.1|v1.1",
    "mit/notice": "Released under the ^MIT License",
    "bsd/notice": "Released under the ^BSD License",
    "isc/notice": "Released under the ^ISC License",
    "gpl-2.0/notice": f"This work is licensed under the ^GNU ^General ^Public License, version {_V2}",
    "gpl-3.0/notice": f"This work is licensed under the ^GNU ^General ^Public License, version {_V3}",
    "lgpl-2.1/notice": f"This work is licensed under the ^GNU ^Lesser ^General ^Public License, version {_V21}",
    "lgpl-3.0/notice": f"This work is licensed under the ^GNU ^Lesser ^General ^Public License, version {_V3}",
    "agpl-3.0/notice": f"This work is licensed under the ^GNU ^Affero ^General ^Public License, version {_V3}",
    "gpl-2.0/header": _gnu("", _V2),
    "gpl-3.0/header": _gnu("", _V3),
    "lgpl-2.0/header": _gnu("Library", _V2),
    "lgpl-2.1/header": _gnu("Lesser", _V21),
    "lgpl-3.0/header": _gnu("Lesser", _V3),
    "agpl-3.0/header": _gnu("Affero", _V3),
    **{f"cc-{kind}-{v}/notice": f"Licensed under ^CC ^{kind.upper()} ^{v}"
       for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("2.0", "2.5", "3.0", "4.0")},
    **{f"cc-{kind}-{v}/long-notice": f"This work is licensed under a ^Creative ^Commons ^{name} ^{v}"
       for kind, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives|Attribution-NoDerivs"),
                          ("by-nc", "Attribution-NonCommercial"),
                          ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
                          ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives|Attribution-NonCommercial-NoDerivs"))
       for v in ("2.0", "2.5", "3.0", "4.0")},
    "mpl-1.1/notice": "Licensed under the ^Mozilla ^Public|License License, Version ^1.1|v1.1",
    "mpl-2.0/notice": "Licensed under the ^Mozilla ^Public|License License, Version ^2.0|2|v2|v2.0",
    "mpl-1.1/header": "The contents of this file are subject to the ^Mozilla ^Public License Version ^1.1 (the License); "
                      f"{_LICENSE_URL} http://www.mozilla.org/MPL/ Software distributed under the License is distributed "
                      "on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for "
                      "the specific language governing rights and limitations under the License.",
    "mpl-2.0/header": "This Source Code Form is subject to the terms of the ^Mozilla ^Public License, v. ^2.0. If a copy of "
                      "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "proprietary/notice": "All rights reserved",
    **{f"{name}/text": _text(name) for name in TEXTS},
}


def bare_words(column):
    """Per slice: word hashes without case and outer punctuation, and word offsets
    (words that are punctuation only are left out)."""
    for t in slices(column):
        start, end, woff = t.words()
        last = max(len(t.buf) - 1, 0)
        for _ in range(3):
            start = start + ((start < end) & PUNCTUATION[t.buf[np.minimum(start, last)]])
            end = end - ((start < end) & PUNCTUATION[t.buf[end - 1]])
        keep = end > start
        doc = np.repeat(np.arange(t.n), np.diff(woff))[keep]
        yield t, t.span_hashes(start[keep], end[keep], lower=True), np.searchsorted(doc, np.arange(t.n + 1))


def _marked(template: str) -> tuple[str, dict[int, frozenset[int]]]:
    """The text without marks (of alternatives the first), and by place of an
    identifying word the hashes that match it."""
    raw = template.split()
    plain = [w[len(MARK):].split("|")[0] if w.startswith(MARK) else w for w in raw]
    _, _, woff = next(bare_words(pa.array(plain)))
    places = woff.tolist()  # a word that is punctuation only has no place
    keys = {}
    for at, w in enumerate(raw):
        if w.startswith(MARK):
            _, own, _ = next(bare_words(pa.array([w[len(MARK):].replace("|", " ")])))
            keys[places[at]] = frozenset(own.tolist())
    return " ".join(plain), keys


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.words, self.arrays, self.keys = list(templates), [], [], []
        grams: dict[int, list[tuple[int, int]]] = {}
        for number, text in enumerate(templates.values()):
            text, keys = _marked(text)
            _, words, woff = next(bare_words(pa.array([text])))
            self.words.append(words.tolist())
            self.arrays.append(words)
            self.keys.append(keys)
            k = min(K, len(words))
            hashes, _ = window_hashes(words, woff, k)
            window = WINDOW if len(words) > 2 * (K + WINDOW) else 1  # short ones keep every gram
            kept = {int(a + np.argmin(hashes[a: a + window])) for a in range(max(1, len(hashes) - window + 1))}
            for at in kept:
                grams.setdefault(int(hashes[at]), []).append((number, at))
        self.grams = grams
        self.sizes = sorted({min(K, len(w)) for w in self.words})
        self.hashes = np.array(sorted(grams), np.uint64)


def align(template: list[int], words: list[int], diagonal: int, band: int = BAND,
          keys: dict[int, frozenset[int]] | None = None) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment of the whole template with
    the words near ``diagonal``; a match scores 2, a skipped or changed word -1.
    ``keys``: words by place of which one must be matched; without such an alignment
    nothing is."""
    lowest, keys, never = diagonal - band, keys or {}, -1 << 40
    # state by offset in the band: score, matched, first and last matched place
    row = [(0, 0, -1, -1)] * (2 * band + 1)
    for i, want in enumerate(template):
        new, key, close = [], keys.get(i), i in keys and i - 1 in keys
        for o in range(2 * band + 1):
            at = lowest + o + i
            score, matched, first, last = row[o]
            inside = 0 <= at < len(words)
            if inside and (words[at] in key if key else words[at] == want) and (not close or last == at - 1):
                best = (score + 2, matched + 1, first if first >= 0 else at, at)
            else:
                best = (never if key else score - 1, matched, first, last)
            if not key and o + 1 < len(row) and row[o + 1][0] - 1 > best[0]:  # template word skipped
                best = (row[o + 1][0] - 1, *row[o + 1][1:])
            if new and new[-1][0] - 1 > best[0] and new[-1][1] and not (key and i + 1 in keys):  # document word skipped
                best = (new[-1][0] - 1, *new[-1][1:])
            new.append(best)
        row = new
    # ties: the path that ends nearest the diagonal
    o = max(range(len(row)), key=lambda o: (row[o][0], row[o][1], -abs(o - band)))
    return row[o][1:] if row[o][0] > never // 2 else (0, -1, -1)


def _reachable(template: np.ndarray, keys: int, words: np.ndarray, diagonals: list[int]) -> list[int]:
    """The diagonals on which ``COVER`` of the template can match at all: equal words
    are counted by diagonal, and those of a band summed."""
    size = len(template)
    least = COVER * size - keys  # an identifying word may match by an alternative
    if len(words) < COVER * size or np.isin(template, words).sum() < least:
        return []
    order = np.argsort(template, kind="stable")
    ranked = template[order]
    count = np.zeros(len(words) + size, np.int64)  # by place in the text - place in the template + size - 1
    for at in range(0, len(words), PART):
        part = words[at: at + PART]
        low, high = np.searchsorted(ranked, part, "left"), np.searchsorted(ranked, part, "right")
        n = high - low
        first = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        count += np.bincount(np.repeat(np.arange(at, at + len(part)), n) - order[first] + size - 1, minlength=len(count))
    total = np.concatenate([[0], np.cumsum(count)])
    d = np.array(diagonals) + size - 1
    near = total[np.clip(d + BAND + 1, 0, len(count))] - total[np.clip(d - BAND, 0, len(count))]
    out = []
    for x in np.array(diagonals)[near >= least].tolist():
        hit = np.zeros(size, bool)
        for o in range(x - BAND, x + BAND + 1):
            a, z = max(0, -o), min(size, len(words) - o)
            if a < z:
                hit[a:z] |= template[a:z] == words[a + o: z + o]
        if hit.sum() >= least:
            out.append(x)
    return out


def _matches(index: Index, words: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple]:
    """``hits``: (place of a gram in the document, gram hash)."""
    near: dict[int, set[int]] = {}
    for at, gram in hits:
        for number, place in index.grams[gram]:
            near.setdefault(number, set()).add(at - place)
    own, found = None, []
    for number, diagonals in near.items():
        size, keys = len(index.words[number]), index.keys[number]
        tried = sorted(diagonals)
        if size > LONG:
            tried = _reachable(index.arrays[number], len(keys), words, tried)
        if tried and own is None:
            own = words.tolist()
        for d in tried:
            matched, first, last = align(index.words[number], own, d, keys=keys)
            if matched and matched >= COVER * size:
                found.append((index.names[number], matched / size, first, last, matched))
    held: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0])):
        if all(m[3] < h[2] or m[2] > h[3] for h in held):
            held.append(m)
    return [m[:4] for m in sorted(held, key=lambda m: m[2])]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per match: ``doc_id, template, coverage, first_word, last_word``."""
    def run(batches):
        index = Index(templates)
        for b in batches:
            ids, out = [], []
            for t, words, woff in bare_words(b.column(1)):
                hits: dict[int, list[tuple[int, int]]] = {}
                for k in index.sizes:
                    hashes, offsets = window_hashes(words, woff, k)
                    at = np.flatnonzero(np.isin(hashes, index.hashes))
                    doc = np.searchsorted(offsets, at, "right") - 1
                    for d, place, gram in zip(doc.tolist(), (at - offsets[doc]).tolist(), hashes[at].tolist()):
                        hits.setdefault(d, []).append((place, gram))
                for d, own in sorted(hits.items()):
                    got = _matches(index, words[woff[d]: woff[d + 1]], own)
                    ids += [t.first + d] * len(got)
                    out += got
            if out:
                names, cover, first, last = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(ids)), pa.array(names), pa.array(cover, pa.float64()),
                     pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    names=["id", "template", "coverage", "first_word", "last_word"])

    own = docs.select(F.col(id_col), F.col(text_col))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, template string, coverage double, first_word long, last_word long") \
        .withColumnRenamed("id", "doc_id")

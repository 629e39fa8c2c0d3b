"""Ids of whole texts from a public byte-level BPE file, through a cache of words.

The file's pre-tokeniser never lets a token cross a space that stands between two
characters that are not white space: the space opens the next token.  So a text is
cut at its spaces, and each word has, after its space, the ids that it has within
the text.  Words not seen before are cut by the pre-tokeniser's own pattern and
encoded by the ``tokenizers`` library's model; their ids are kept, up to ``CACHE``
words a worker, then the cache starts anew.  A text with a space beside other white
space, or with the string of a special token, is given to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

CACHE = 1_000_000
#: a space beside white space (looked for at spaces only)
_BLANKS = re.compile(r" (?:(?=\s)|(?<=\s ))")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """``path``: a tokenizer file whose pre-tokeniser is byte-level with the usual
    pattern and no prefix space."""

    def __init__(self, path: str):
        import json

        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        plain = form["normalizer"] is None and form["post_processor"] is None and form["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.plain = plain  # other files: every text is given to the library whole
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in form["added_tokens"]]
        self.tokens = regex.compile(PATTERN).findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.as_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Ids of new words.  A space opens each word, so the tokens of all of them in
        one string fall apart again at the spaces.  A token after a space is a word of its
        own, and may be known from texts before."""
        tokens = self.tokens(" " + " ".join(words))
        known, after = {}, self.after_space
        for t in set(tokens):
            ids = after.get(t[1:]) if t[0] == " " else None
            if ids is None:
                chars = t.encode().decode("latin-1").translate(self.as_chars)
                ids = array("I", [x.id for x in self.model.tokenize(chars)]).tobytes()
                if t[0] == " ":
                    after[t[1:]] = ids
            known[t] = ids
        i = 0
        for w in words:
            ids, size = known[tokens[i]], len(tokens[i])
            i += 1
            while size <= len(w):
                ids += known[tokens[i]]
                size += len(tokens[i])
                i += 1
            after[w] = ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        after, start = self.after_space, self.at_start
        if len(after) + len(start) > CACHE:
            after.clear()
            start.clear()
        cut: list[list[str] | None] = []
        new: dict[str, None] = {}
        for text in texts:
            whole = not self.plain or _BLANKS.search(text) or any(s in text for s in self.special)
            words = None if whole else text.split(" ")
            cut.append(words)
            if words and words[0] not in start:
                start[words[0]] = self._whole(words[0])
            if words:
                new.update(dict.fromkeys(set(words[1:]).difference(after)))
        new.pop("", None)  # after the last space of a text
        after.setdefault("", self._whole(" "))
        if new:
            self._learn(list(new))
        return [self._whole(t) if w is None else start[w[0]] + b"".join(map(after.__getitem__, w[1:]))
                for t, w in zip(texts, cut)]


def as_texts(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]

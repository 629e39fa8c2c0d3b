"""Token ids of whole Arrow text columns, word by word and without a Python step a word.

Where single spaces part the words of a text, both kinds of tokenizer file open a token
at every space and let none go across: a word's ids, after its space, do not depend on
its neighbours.  So a column is split at its spaces, its distinct words are looked up (or
learnt, all new ones in one call of the library), and the ids of all occurrences are
gathered by numpy.  Texts that are not so plain (white space beside a space, at either
end for pieces) are given to the library whole.

Columns are walked in slices of about ``SLICE`` bytes; a longer text is a slice of its
own.  A worker keeps the ids of ``CACHE`` words, then starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import Encoder

SLICE, CACHE = 1 << 20, 400_000
#: all white space of Unicode and what Python adds to it (RE2's \s has ASCII only)
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``flat[offsets[r]:offsets[r + 1]]`` one after the other, and the
    offsets of the result."""
    sizes = np.diff(offsets)[rows]
    ends = np.cumsum(sizes)
    out = np.zeros(len(rows) + 1, np.int64)
    out[1:] = ends
    at = np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], sizes)
    return flat[at], out


def text_slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The rows of a string column in runs of about ``SLICE`` bytes, with their place;
    nulls as empty texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield at, column.slice(at, to - at)
        at = to


class _Words:
    """Shared by both kinds: ids of a column of texts.  ``opened``: each text counts as if
    a space stood before it."""

    opened = True
    width = np.dtype("<u4")

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        """Ids of a text that is not cut into words."""
        raise NotImplementedError

    def first(self, word: str) -> bytes:
        """Ids of a text's first word."""
        return self.known[word]

    def not_plain(self, texts: pa.Array) -> np.ndarray:
        blank = rf" {_WHITE}|{_WHITE} " + (rf"|^{_WHITE}" if self.opened else "")
        return pc.match_substring_regex(texts, blank).to_numpy(zero_copy_only=False)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, one after the other, and the texts' n + 1 offsets.
        An empty text has no ids."""
        n = len(texts)
        some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        odd = self.not_plain(texts) & some
        split = pc.split_pattern(texts, " ")
        parts = split.flatten().dictionary_encode()
        codes, words = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
        bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        doc = np.repeat(np.arange(n), np.diff(bounds))
        plain = (some & ~odd)[doc]
        starts = bounds[:-1]
        after = plain.copy()  # occurrences after a space
        if not self.opened:
            after[starts[some]] = False
        needed = np.zeros(len(words), bool)
        needed[codes[after]] = True
        if len(self.known) > CACHE:
            self.known.clear()
        used = np.flatnonzero(needed)
        new = [w for w in map(words.__getitem__, used) if w not in self.known]
        if new:
            self.learn(new)
        table = [b""] * len(words)
        for k in used.tolist():
            table[k] = self.known[words[k]]
        # one row of the table an occurrence; odd texts, and first words without a space, have their own
        rows = codes.astype(np.int64)
        keep = plain.copy()
        for d in np.flatnonzero(odd).tolist():
            rows[starts[d]], keep[starts[d]] = len(table), True
            table.append(self.whole(texts[d].as_py()))
        if not self.opened:
            for d in np.flatnonzero(some & ~odd).tolist():
                at = starts[d]
                word = words[rows[at]]
                rows[at] = len(table)
                table.append(self.first(word))
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(table), self.width)
        ids, ends = gather(flat, offsets, rows[keep])
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n))])
        return ids, ends[per_doc]


class ByteLevel(_Words):
    """A byte-level BPE file.  ``specials``: strings of special tokens get their ids,
    else they are plain text."""

    def __init__(self, path: str, opened: bool, specials: bool):
        super().__init__()
        self.inner, self.opened = Encoder(path), opened
        self.inner.tokenizer.encode_special_tokens = not specials
        self.special = self.inner.special if specials else []
        self.inner.after_space = self.known
        self.starts: dict[str, bytes] = {}

    def not_plain(self, texts):
        odd = super().not_plain(texts)
        for s in self.special:
            odd = odd | pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return odd if self.inner.plain else np.ones(len(texts), bool)

    def learn(self, words):
        if "" in words:  # after the last space of a text
            self.known[""] = self.inner._whole(" ")
        if words := [w for w in words if w]:
            self.inner._learn(words)

    def whole(self, text):
        return self.inner._whole(" " + text if self.opened else text)

    def first(self, word):
        if len(self.starts) > CACHE:
            self.starts.clear()
        if (ids := self.starts.get(word)) is None:
            ids = self.starts[word] = self.inner._whole(word)
        return ids

    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in self.inner.as_chars.items()}
        tokenizer = self.inner.tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        out = []
        for i in range(size):
            token = tokenizer.id_to_token(i) or ""
            known = all(c in back for c in token)
            out.append(bytes(back[c] for c in token) if known else token.encode())
        return out


class Pieces(_Words):
    """A piece file of the sentencepiece library that puts a space before each text and
    has no piece with a space after other characters."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.plain = not any("▁" in p.lstrip("▁") for p in pieces)

    def not_plain(self, texts):
        return super().not_plain(texts) if self.plain else np.ones(len(texts), bool)

    def learn(self, words):
        if "" in words:
            self.known[""] = np.array(self.model.encode("a ")[len(self.model.encode("a")):], "<u4").tobytes()
        words = [w for w in words if w]
        for w, ids in zip(words, self.model.encode(words, num_threads=1)):
            self.known[w] = np.array(ids, "<u4").tobytes()

    def whole(self, text):
        return np.array(self.model.encode(text), "<u4").tobytes()

    def token_bytes(self) -> list[bytes]:
        out = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        return out


@lru_cache(maxsize=2)
def byte_level(path: str, opened: bool = False, specials: bool = True) -> ByteLevel:
    return ByteLevel(path, opened, specials)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)

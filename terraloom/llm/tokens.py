"""Byte-level BPE ids of whole Arrow text columns, through the tokenizers library.

The library splits a text into pieces and encodes each piece alone, so equal pieces have equal ids. Here
a slice of texts is split in bulk: each code point has one of four classes, asked of the library's own
pre-tokenizer, and piece borders follow from neighbouring classes. The library's model then encodes each
distinct piece once, and a bounded cache keeps the ids between slices (by 64-bit hashes: among N distinct pieces about N^2 / 2^65
pairs collide). A text with code points whose class is not known goes through the library whole.

A text may hold the name of a special token literally. With `specials` it becomes that token's id, as the library does by
default; without, it is text like any other, so no document can place a control token in a training sequence.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

from terraloom.llm.common import pieces

_SLICE = 1 << 20
#: Code points of the longest slice that is split in bulk.
_LONGEST = 4 << 20
_LETTER, _DIGIT, _SPACE, _OTHER, _UNKNOWN = range(5)
_SUFFIX = regex.compile("'(?:s|t|re|ve|m|ll|d)")
_BASE = 0x9E3779B97F4A7C15
_made: dict[tuple[str, bool], "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, specials: bool = False) -> "Encoder":
    """One encoder for each vocabulary file and Python worker."""
    if (path, specials) not in _made:
        _made[path, specials] = Encoder(path, specials=specials)
    return _made[path, specials]


def _byte_symbols() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 as it is, the rest from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in keep else next(spare)) for b in range(256)}


class Encoder:
    def __init__(self, path: str, most_cached: int = 400_000, specials: bool = False) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not specials
        added = self.whole.get_added_tokens_decoder().values()
        self.names = [t.content for t in added if specials or not t.special]
        self.model, self.symbols, self.most = self.whole.model, _byte_symbols(), most_cached
        self.classes = self._classes()
        self.up = self.down = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _powers(self, n: int) -> None:
        """The powers of the base and of its inverse, for as many code points as a slice had so far."""
        if n > len(self.up):
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(min(_LONGEST, n + n // 4), base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = made

    def _classes(self) -> np.ndarray:
        """The class of each assigned code point of the basic plane and of pictographs, from whether the pre-tokenizer joins it to a letter, a digit or a mark."""
        out = np.full(0x110000, _UNKNOWN, np.uint8)
        points = np.array([c for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FB00)) if unicodedata.category(chr(c)) not in ("Cn", "Co")])
        out[points] = _SPACE
        for lead, kind in (("a", _LETTER), ("1", _DIGIT), ("!", _OTHER)):
            starts = np.zeros(3 * len(points) + 1, bool)
            text = "".join(f"{lead}{chr(c)}\n" for c in points)
            starts[[span[0] for _, span in self.whole.pre_tokenizer.pre_tokenize_str(text)]] = True
            out[points[~starts[1::3][: len(points)]]] = kind
        return out

    def _symbols(self, piece: str) -> str:
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalnum():
            return self.symbols[32] + word if len(word) < len(piece) else word
        return "".join([self.symbols[b] for b in piece.encode()])

    def _learn(self, keys: list[int], found: list[str]) -> None:
        ids: list[int] = []
        lengths: list[int] = []
        tokenize, symbols = self.model.tokenize, self._symbols
        for piece in found:
            made = tokenize(symbols(piece))
            ids += [t.id for t in made]
            lengths.append(len(made))
        at = len(self.known)
        self.known.update(zip(keys, range(at, at + len(keys)), strict=True))
        while at + len(keys) > len(self.first):
            self.first, self.length = np.concatenate([self.first, self.first]), np.concatenate([self.length, self.length])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[at : at + len(keys)] = lengths
        self.first[at : at + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For UTF-8 texts laid end to end: slices (first text, ids, offsets of its texts in the ids)."""
        for i, j in pieces(at, _SLICE):
            texts = [bytes(data[at[r] : at[r + 1]]).decode("utf-8", "replace") for r in range(i, j)]
            yield (i, *self._slice(texts))

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        ends = np.cumsum([len(t) for t in texts])
        named = any(name in joined for name in self.names)
        if len(points) > _LONGEST or named or (kinds == _UNKNOWN).any():
            strange = np.array([named and any(name in t for name in self.names) for t in texts])
            strange[np.searchsorted(ends, np.flatnonzero(kinds == _UNKNOWN), "right")] = True
            strange |= np.array([len(t) > _LONGEST for t in texts])
            parts: list[np.ndarray] = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if s else np.zeros(0) for t, s in zip(texts, strange, strict=True)]
            if named and not strange.any():  # a name that runs over a border of texts
                return self._bulk(texts, joined, points, kinds, ends)
            for r in np.flatnonzero(~strange):
                parts[r] = self._slice([texts[r]])[0]
            return np.concatenate(parts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._bulk(texts, joined, points, kinds, ends)

    def _bulk(self, texts: list[str], joined: str, points: np.ndarray, kinds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], ends[:-1]])
        begins = begins[begins < len(points)]
        cuts = self._cuts(joined, points, kinds, begins, ends)
        stops = np.append(cuts[1:], len(points))
        n = len(points)
        self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        x = points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        np.cumsum((x ^ (x >> np.uint64(32))) * self.up[:n], out=sums[1:])
        h = (sums[stops] - sums[cuts]) * self.down[cuts] + (stops - cuts).astype(np.uint64)
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(keys) > self.most:
            self._clear()
        known, listed = self.known, keys.tolist()
        new = [r for r, k in enumerate(listed) if k not in known]
        if new:
            starts, ends_ = cuts[where].tolist(), stops[where].tolist()
            self._learn([listed[r] for r in new], [joined[starts[r] : ends_[r]] for r in new])
        slot = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))[inverse]
        counts = self.length[slot]
        after = np.cumsum(counts)
        take = np.repeat(self.first[slot] - (after - counts), counts) + np.arange(after[-1])
        return self.flat[take], np.concatenate([[0], after])[np.searchsorted(cuts, np.concatenate([[0], ends]))]

    @staticmethod
    def _cuts(joined: str, points: np.ndarray, kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start: at a change of class, with a blank before a word joined to it and other space kept apart."""
        n = len(points)
        start = np.ones(n + 1, bool)
        start[1:n] = kinds[1:] != kinds[:-1]
        start[begins] = True
        space = kinds == _SPACE
        final = np.zeros(n, bool)  # the last space character before a word
        final[:-1] = space[:-1] & ~space[1:]
        final[ends[ends > 0] - 1] = False
        last = np.flatnonzero(final)
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        if "'" in joined:
            stop = np.zeros(n + 1, bool)
            stop[ends] = True
            for m in _SUFFIX.finditer(joined):
                a, b = m.span()
                if start[a] and not stop[a + 1 : b].any():
                    start[a + 1] = False
                    start[b] = True
        return np.flatnonzero(start[:n])

"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

A byte-level BPE cuts a text into pieces by a fixed pattern and encodes each piece alone, so equal pieces have equal ids.
Pieces are found for a chunk of texts at once, each is looked up by its hash among those met before, and only pieces that are
new to the worker are merged, with the tokenizer's own vocabulary (its ids are the ranks of its merges). Texts on which the cut isn't plain (characters beyond Latin, odd
blanks, contractions) go to the tokenizer whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from . import textkit as tk

SLOT_BITS = 20  #: of the table of known pieces
MOST_IDS = 8 << 20  #: ids kept for known pieces; beyond that the table starts anew
_PLAIN = 0x250
_KIND = np.zeros(_PLAIN, np.uint8)  # 0 blank, 1 letter, 2 number, 3 other, 4 sends the text to the tokenizer
for _i in range(_PLAIN):
    _c = unicodedata.category(chr(_i))[0]
    _KIND[_i] = 0 if _i == 32 or 9 <= _i <= 13 else 4 if _i in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0) else 1 if _c == "L" else 2 if _c == "N" else 3
_AFTER_QUOTE = np.zeros(_PLAIN, bool)
_AFTER_QUOTE[[ord(c) for c in "strvmld"]] = True


# The vocabulary writes each byte as a character: printable ones as themselves, the rest from U+0100 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """ids(chunk): all ids of the chunk's texts end to end, and where each text's begin.

    A special token that a text writes out gets its own id, as the tokenizer has it, or where ``spelt`` is true the ids of its characters.
    """

    _of: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spelt: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelt
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ranks = {bytes(map(_BYTE.__getitem__, x)): i for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(ch in _BYTE for ch in x)}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._clear()

    @classmethod
    def of(cls, path: str, spelt: bool = False) -> Encoder:
        """The worker's own encoder for a file; it stays while the worker lives."""
        if (path, spelt) not in cls._of:
            cls._of[path, spelt] = cls(path, spelt)
        return cls._of[path, spelt]

    def _clear(self) -> None:
        self.slot_hash, self.slot = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, in order."""
        got = [self.merge(x) for x in pieces]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(got) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        new = np.arange(self.n, self.n + len(got))
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.used, self.n = self.used + len(flat), self.n + len(got)
        return new

    def ids(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        if self.used > MOST_IDS:
            self._clear()
        n = len(c)
        lead = (c.buf & 0xC0) != 0x80
        place = np.flatnonzero(lead)  # the first byte of each character
        chars = np.frombuffer(c.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        offs = np.searchsorted(place, c.offs)
        kind = np.where(chars < _PLAIN, _KIND[np.minimum(chars, _PLAIN - 1)], 4)
        odd = kind == 4
        quote = np.flatnonzero(chars[:-1] == 39) if len(chars) else np.zeros(0, np.int64)
        odd[quote[(chars[quote + 1] < _PLAIN) & _AFTER_QUOTE[np.minimum(chars[quote + 1], _PLAIN - 1)]]] = True
        special = np.flatnonzero((chars[:-1] == 60) & (chars[1:] == 124)) if len(chars) else quote  # a special token may be written out
        odd[special] = True
        seen = np.concatenate([[0], np.cumsum(odd)])
        odd_text = seen[offs[1:]] > seen[offs[:-1]]
        # Pieces begin where the kind changes; a run of blanks gives its last one up, and a space joins what follows.
        cut = np.zeros(len(chars) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        cut[offs] = True
        ends = np.flatnonzero(cut)
        ends = ends[ends > 0]
        inner = np.ones(len(chars) + 1, bool)
        inner[offs] = False
        ends = ends[inner[ends] & (kind[ends - 1] == 0)] if len(ends) else ends  # of blank runs that a text goes on after
        cut[ends - 1] = True
        cut[ends[chars[ends - 1] == 32]] = False
        cut[offs] = True
        bounds = np.concatenate([place, [len(c.buf)]])[np.flatnonzero(cut)]
        w = tk.words(c, np.ones(256, bool), lower=False)
        start, end = bounds[:-1], bounds[1:]
        text = np.searchsorted(c.offs, start, "right") - 1
        fine = ~odd_text[text] if len(text) else np.zeros(0, bool)
        start, end, text = start[fine], end[fine], text[fine]
        h = w.part(start, end)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        number = np.where(self.slot_hash[slot] == h, self.slot[slot], -1)
        missed = np.flatnonzero(number < 0)
        if len(missed):
            _, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            raw = c.buf.tobytes()
            at = missed[first]
            new = self._learn([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            number[missed] = new[back]
            self.slot_hash[slot[at]], self.slot[slot[at]] = h[at], new
        size = self.size[number].astype(np.int64)
        before = np.cumsum(size) - size
        total = int(size.sum())
        flat = self.flat[np.repeat(self.at[number] - before, size) + np.arange(total)]
        counts = np.bincount(text, size, n).astype(np.int64)
        if not odd_text.any():
            return flat, np.concatenate([[0], np.cumsum(counts)])
        whole = {int(d): np.array(self.tokenizer.encode(c.text(d), add_special_tokens=False).ids, np.uint32) for d in np.flatnonzero(odd_text)}
        own = np.split(flat, np.cumsum(counts)[:-1])
        parts = [whole.get(d, own[d]) for d in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

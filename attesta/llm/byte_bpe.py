"""Byte-level BPE ids of whole texts, as ``tokenizers`` gives them, at several times its speed.

A single space between two characters that are no white space always starts a new piece of the byte-level
pattern, and nothing before it matters to what follows. So a text is cut there, and a piece that comes again
is remembered; most distinct pieces never do and are soon forgotten. ``tiktoken`` with the same vocabulary encodes pieces.
A piece that is not remembered costs several times what it does within its text, so where too many are new, texts go to
``tiktoken`` whole, and after some thousands it is tried by pieces again. Texts that contain a special token's string go to
``tokenizers`` whole. The tests hold the ids against ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLANK = re.compile(r"[\s\x00-\x1f]")
#: Pieces remembered, those of them that came once only, and characters of the longest.
REMEMBERED, ONCE, LONGEST = 120_000, 40_000, 48
#: Texts tried by pieces, those encoded whole if over one piece in ``NEW`` was new to a trial, and characters of a long text.
TRIAL, WHOLE, NEW, LONG = 200, 8_000, 16, 1 << 20


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others as characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe(dict):
    """Maps a piece that follows a space to its ids (little-endian unsigned 32-bit); None: not to be cut here."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        table = _bytes_of_characters()
        ranks = {bytes(table[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.full = path, None
        self.once: dict[str, bytes] = {}
        self.once_before: dict[str, bytes] = {}
        self.whole_left, self.tried, self.met, self.new = 0, 0, 0, 0

    def _raw(self, text: str) -> bytes:
        if len(text) > LONG:
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        self.new += 1
        again = self.once.pop(piece, None) or self.once_before.get(piece)
        if again is not None:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = again
            return again
        if not piece or _BLANK.match(piece[0]) or _BLANK.match(piece[-1]):
            return None
        ids = self._raw(" " + piece)
        if len(piece) <= LONGEST:
            if len(self.once) >= ONCE:
                self.once_before, self.once = self.once, {}
            self.once[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """All ids of a text, little-endian unsigned 32-bit."""
        if any(s in text for s in self.special):
            if self.full is None:
                self.full = Tokenizer.from_file(self.path)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.whole_left:
            self.whole_left -= 1
            return self._raw(text)
        if self.tried >= TRIAL:
            self.whole_left, self.tried, self.met, self.new = WHOLE * (self.new * NEW > self.met), 0, 0, 0
        first, *rest = text.split(" ")
        self.tried, self.met = self.tried + 1, self.met + len(rest)
        if rest and (not first or _BLANK.match(first[-1])):
            return self._raw(text)
        try:
            return self._raw(first) + b"".join(map(self.__getitem__, rest))
        except TypeError:  # a piece that begins or ends with white space
            return self._raw(text)


@cache
def load(path: str) -> ByteBpe:
    """One encoder for each Python worker and path."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

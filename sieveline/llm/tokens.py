"""Tokenizing whole texts inside Arrow batches.

A tokenizer's pre-tokenizer splits a text into pieces that it encodes one by
one. Where it is known to split at a space, the text is cut there first and
every distinct piece goes through the ``tokenizers`` library once per worker;
its ids are then looked up. The ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

#: How a tokenizer treats a space between two visible characters.
#: ``prefix``: the space starts the next piece (byte-level BPE).
#: ``drop``: white space only separates and upper-case ASCII equals lower case.
#: ``none``: nothing is known; every text is encoded in one go.
BOUNDARIES = ("prefix", "drop", "none")

_SAFE_SPACE = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
_SAFE_CHAR = re.compile(r"[\w!-~]")
#: Words that are one pre-token and that no normalizer changes (after lower-casing, for "drop").
_LATIN_WORD = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one visible character: itself if it has one, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _NotAPiece(Exception):
    """The space beside this piece may be no boundary."""


class _Pieces(dict):
    """Piece -> ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, tokenizer, lead: str = "", limit: int = 800_000):
        super().__init__()
        self._whole, self._word, self._limit = tokenizer.encode, tokenizer.model.tokenize, limit
        self._lead, self._characters = lead, _byte_characters()

    def whole(self, text: str) -> bytes:
        return array("I", self._whole(self._lead + text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """The ids of one pre-token, straight from the library's model."""
        written = (self._lead + text).encode().decode("latin-1").translate(self._characters)
        return array("I", [x.id for x in self._word(written)]).tobytes()

    def ids(self, piece) -> bytes:
        return self.whole(piece)

    def __missing__(self, piece) -> bytes:
        ids = self.ids(piece)
        if len(piece) <= 40:
            if len(self) >= self._limit:
                self.clear()
            self[piece] = ids
        return ids


class _SpacedPieces(_Pieces):
    """Pieces that follow a space: that space is part of their first pre-token."""

    def __init__(self, tokenizer, plain: _Pieces):
        super().__init__(tokenizer, " ")
        self._plain = plain

    def ids(self, piece: str) -> bytes:
        if _LATIN_WORD.fullmatch(piece):
            return self.word(piece)
        if not piece or not _SAFE_CHAR.match(piece[0]) or not _SAFE_CHAR.match(piece[-1]):
            raise _NotAPiece
        if piece[-1] in ".,!" and _LATIN_WORD.fullmatch(piece, 0, len(piece) - 1):
            return self[piece[:-1]] + self._plain[piece[-1]]
        head, line, tail = piece.partition("\n")
        if line and head and tail and head.isascii() and tail.isascii() and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self._plain[line] + self._plain[tail]
        return self.whole(piece)


class _LowerPieces(_Pieces):
    """Pieces between white space, as UTF-8 with A-Z in lower case."""

    def ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        if _LATIN_WORD.fullmatch(text):
            return self.word(text.lower())
        if text[-1] in ".,!" and _LATIN_WORD.fullmatch(text, 0, len(text) - 1):
            return self[piece[:-1]] + self[piece[-1:]]
        return self.whole(text)


class Encoder:
    """``encode(text)`` gives the ids of a whole text as little-endian unsigned 32-bit bytes.

    ``special`` says what the strings of special tokens inside a text are:
    their ids, as the library gives them by default, or ordinary text. A text
    that holds one of them is encoded in one go.
    """

    def __init__(self, path: str, boundary: str = "none", special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if boundary not in BOUNDARIES:
            raise ValueError(f"boundary must be one of {BOUNDARIES}")
        tokenizer, self._given = Tokenizer.from_file(path), Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self._special = {x.content.lower() for x in tokenizer.get_added_tokens_decoder().values()} if special else set()
        self._plain, self._lower = _Pieces(tokenizer), _LowerPieces(tokenizer)
        self._spaced = _SpacedPieces(tokenizer, self._plain)
        self._encode = {"prefix": self._prefix, "drop": self._drop, "none": self._plain.whole}[boundary]

    def encode(self, text: str) -> bytes:
        low = text.lower() if self._special else ""
        if any(x in low for x in self._special):
            return array("I", self._given.encode(text, add_special_tokens=False).ids).tobytes()
        return self._encode(text)

    def _prefix(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest:
            return self._plain[first]
        try:
            if not first or not _SAFE_CHAR.match(first[-1]):
                raise _NotAPiece
            return self._plain[first] + b"".join(map(self._spaced.__getitem__, rest))
        except _NotAPiece:
            first, *rest = _SAFE_SPACE.split(text)
            return self._plain.whole(first) + b"".join(map(self._spaced.whole, rest))

    def _drop(self, text: str) -> bytes:
        return b"".join(map(self._lower.__getitem__, text.encode().lower().split()))


_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, boundary: str, special: bool = True) -> Encoder:
    """The worker's encoder; Python workers are reused, so its pieces are too."""
    key = (path, boundary, special)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]

"""Token ids of a public tokenizer file, by whitespace chunks that are remembered.

The vocabulary's normaliser and splitter never join text across white space, so a text's
ids are the ids of its chunks, one after the other.  Chunks made of ordinary characters
are split further into pieces by the vocabulary's own pattern and each new piece goes to
the BPE model once; anything else goes through the whole tokenizer as it is.  Both
memories are emptied when full, so their size is bounded whatever the corpus.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Entries of a memory before it is emptied.
REMEMBER = 600_000

# The vocabulary's pattern over lower-cased text, written for the characters of PLAIN.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: ASCII and Latin letters and signs that normalisation leaves as they are (superscripts and fractions aside).
PLAIN = re.compile(r"[!-~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ňŊ-ž]+")
SIGNS = frozenset(".,;:!?)")
#: Separators that str.split() takes for white space and the tokenizer does not.
ODD_BLANKS = re.compile(r"[\x1c-\x1f]")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name_or_path: str) -> str:
    import public_tokenizers

    return name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        rest = [b for b in range(256) if b not in shown]
        self.bytes = {chr(b): chr(b) for b in shown} | {chr(b): chr(256 + i) for i, b in enumerate(rest)}
        self.bytes = str.maketrans(self.bytes)
        self.pieces: dict[str, bytes] = {}
        self.chunks = _Memory(self._chunk)

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.bytes)
            got = _little([t.id for t in self.model.tokenize(mapped)])
            if len(self.pieces) >= REMEMBER:
                self.pieces.clear()
            if len(piece) <= 40:
                self.pieces[piece] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        last = chunk[-1]
        if last in SIGNS and chunk.isascii() and chunk[:-1].isalpha():  # a word and a sign: two pieces
            return self._piece(chunk[:-1].lower()) + self._piece(last)
        if chunk.isascii() and chunk.isalpha():
            return self._piece(chunk.lower())
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self._piece, PIECE.findall(chunk.lower())))
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Drops what was remembered of pieces and chunks."""
        self.pieces.clear()
        self.chunks.clear()

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit."""
        if ODD_BLANKS.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) >= REMEMBER:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, text.split()))


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        got = self.make(chunk)
        if len(chunk) <= 40:
            self[chunk] = got
        return got

    def __reduce__(self):
        raise TypeError("made anew in each worker")

"""Token ids of whole texts by a public tokenizer.

The library does the encoding. Splitting at ASCII white space changes no id of this tokenizer: it drops white space, and neither
its normalizer nor its pre-tokenizer joins across it. So each distinct word is encoded once for each worker and kept in a bounded
cache.
"""

from __future__ import annotations

import re
from array import array
from sys import byteorder

import regex
from tokenizers import Tokenizer

from ._common import sole

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker's cache holds at most.
CACHE_WORDS = 500_000

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0da-z0-9]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_TAIL = ".,;:!?*&%$#|)"
_PLAIN = re.compile("[\x21-\x7e\xa1-įĲ-ɏ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Recent(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what is asked for again moves up."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.old = most // 2, {}

    def turn(self) -> None:
        self.old = dict(self)
        super().clear()

    def clear(self) -> None:
        super().clear()
        self.old = {}


class _Pieces(_Recent):
    """piece (lower case) -> its ids."""

    def __init__(self, model, width: int):
        super().__init__(CACHE_WORDS // 2)
        self.model, self.code, self.letters = model, {2: "H", 4: "I"}[width], _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if (found := self.old.get(piece)) is None:
            spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array(self.code, [t.id for t in self.model.tokenize(spelled)])
            if byteorder == "big":
                found.byteswap()
            found = found.tobytes()
        if len(self) >= self.half:
            self.turn()
        self[piece] = found
        return found


class WordEncoder(_Recent):
    """word (bytes without ASCII white space) -> its ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        super().__init__(CACHE_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.dtype[-1])
        self.pieces = _Pieces(self.tokenizer.model, self.width)

    def _by_library(self, text: str) -> bytes:
        return b"".join(i.to_bytes(self.width, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        if (found := self.old.get(word)) is None:
            text = word.decode()
            low = text.lower()
            core = low.rstrip(_TAIL)
            if core.isalpha() and (low.isascii() or max(text) <= "ɏ" and "İ" not in text and "ı" not in text):
                found = self.pieces[core] if len(core) == len(low) else self.pieces[core] + self.pieces[low[len(core) :]]
            elif b"<|" in word or not _PLAIN.fullmatch(text):
                return self._by_library(text)
            else:
                found = b"".join([self.pieces[p] for p in (_ASCII if low.isascii() else _LATIN).findall(low)])
            if len(word) > 64:
                return found
        if len(self) >= self.half:
            self.turn()
        self[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, words: int = CACHE_WORDS) -> WordEncoder:
    """This worker's encoder for a vocabulary file, with a cache of so many words."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].half, _encoders[path].pieces.half = words // 2, words // 4
    sole(_encoders[path], _encoders[path].pieces)
    return _encoders[path]

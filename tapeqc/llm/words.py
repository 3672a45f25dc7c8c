"""Ids of tokenizers' word-BPE vocabularies, a word at a time."""

from __future__ import annotations

import codecs
import json
import re
from array import array
from functools import cache

import numpy as np
import regex

#: Words whose ids a Python worker remembers, twice over: the latest, and those before. About 170 bytes a word; results don't depend on it.
REMEMBERED = 300_000
#: An ASCII capital before a character that Unicode may compose with it: there lower-casing and composing do not commute.
_COMPOSES = re.compile("[A-Z][̀-\U0010ffff]")

# The steps of a tokenizer file whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


#: What texts of Latin-1 letters and ASCII do not hold; and the pieces of such texts, in bytes.
_OTHER = re.compile("[^\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_SPLIT = re.compile(rb"[a-z\x80-\xff]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\s0-9a-z\x80-\xff]+")
_LATIN = re.compile("[!-~\xa1-\xff]+")
_PIECES = regex.compile(PRE_TOKENIZER["pretokenizers"][0]["pattern"]["Regex"])


def _byte_chars() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = "".join(c for _, c in sorted(_byte_chars().items()))


class WordEncoder(dict):
    """Encodes whole texts with a tokenizer of the tokenizers library; `ids` gives exactly what `encode(text, add_special_tokens=False)` does.

    Where the file's normalizer and pre-tokenizer are the ones above, which lower-case and drop white space, a text's ids are its words' ids in
    turn, so that each word is encoded once and remembered: this is the dict of those words' ids. Words of a-z go to the tokenizer's
    model at once, since its normalizers leave them alone. Texts that may hold a special token's string, and all texts of any other
    kind of tokenizer, go to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        super().__init__()
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.special = tuple(t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values())
        steps = json.loads(self.tokenizer.to_str())
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 and max(self.tokenizer.get_vocab().values(), default=0) < 1 << 16 else "I"
        self.by_word = steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER and steps["post_processor"] is None and steps["truncation"] is None and not steps["model"].get("dropout")

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._piece(word.decode()) if word.isalpha() else self._other(word.decode())  # of bytes: ASCII letters only
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece.lower())]).tobytes()

    def _other(self, word: str) -> bytes:
        # Of printing Latin-1: composed already, and lower-cased alike everywhere. Its pieces are encoded one by one.
        if not _LATIN.fullmatch(word):
            return self._whole(word)
        word = word.lower()
        pieces = [word] if word.isalpha() else _PIECES.findall(word)
        if len(pieces) > 1:
            return b"".join([self[p.encode()] for p in pieces])
        return array(self.kind, [t.id for t in self.model.tokenize(codecs.charmap_decode(pieces[0].encode(), "strict", _BYTE_CHARS)[0])]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as unsigned numbers, of two bytes where `kind` is H, else of four; null is the empty text."""
        text = text or ""
        if not self.by_word or any(s in text for s in self.special):
            return self._whole(text)
        raw = text.encode()
        # Lower-cased beforehand, a word is remembered once in all its cases.
        if text.isascii() or not _OTHER.search(text):
            words = _SPLIT.findall(raw.lower())
        else:
            words = raw.split() if _COMPOSES.search(text) else raw.lower().split()
        return b"".join(map(self.__getitem__, words))

    def ids(self, text: str | None) -> np.ndarray:
        """The same as an array."""
        return np.frombuffer(self.packed(text), dtype=np.uint16 if self.kind == "H" else np.uint32)


@cache
def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """One for each Python worker, file and number of words remembered."""
    return WordEncoder(path, remembered)

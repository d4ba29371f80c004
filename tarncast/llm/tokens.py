"""Token ids of whole texts by a public ``tokenizers`` file, each distinct piece encoded once."""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
from array import array
from collections.abc import Iterable
from unicodedata import category

import numpy as np
import regex
from tokenizers import Tokenizer

#: Words and pieces that a process remembers: a worker stays between tasks and holds them beside the executor's heap.
CACHE_WORDS, CACHE_PIECES = 400_000, 50_000
#: A full stop or comma that ends a word is a piece of its own: apart from it, the word is met more often.
END_MARK = re.compile(r"([a-z])([.,])(?=[ \n]|$)")
#: The pattern that the vocabulary file itself states for its pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: The normaliser and the pre-tokenizer that the vocabulary file states and that ``WordIds`` follows word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECES.pattern}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(byte) if byte in printable else chr(next(rest)) for byte in range(256)]


#: Letters below this one never compose with each other, and each has one lower-case form.
COMPOSED = "\u0100"


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class WordIds(dict):
    """Ids of a word (a run without ASCII white space) as little-endian unsigned 32-bit integers, remembered; words not met for long are forgotten.

    The vocabulary's normaliser and pre-tokenizer never join across white space, so the ids of a text
    are those of its words in order. A word is cut into pieces by the file's pattern and each piece
    goes to the library's model once. Of a file that states another normaliser or pre-tokenizer, every
    text goes to the library whole.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        stated = json.loads(self.whole.to_str())
        self.by_word = stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == PRE_TOKENIZER
        self.model, self.normalizer = self.whole.model, self.whole.normalizer
        self.special = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            text = piece if piece.isascii() and piece.isprintable() else "".join(self.letters[byte] for byte in piece.encode())
            found = self.pieces[piece] = packed(token.id for token in self.model.tokenize(text))
        return found

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS // 2:  # words met since the last time stay for one more turn
            self.older = dict(self)
            self.clear()
        known = self.older.get(word)
        if known is not None:
            self[word] = known
            return known
        if word.isascii():
            plain = word
        elif max(word) < COMPOSED:  # such letters are known and composed: normalising is lower case
            plain = word.lower()
        else:
            plain = self.normalizer.normalize_str(word)
        if not plain.isascii() and max(plain) >= COMPOSED and any(category(letter) == "Cn" for letter in plain):
            # A character that this Python does not know may be a letter to the library.
            value = self[word] = np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return value
        if plain.isalpha():  # letters only: one piece
            text = plain if plain.isascii() else "".join([self.letters[byte] for byte in plain.encode()])
            value = packed([token.id for token in self.model.tokenize(text)])
        else:
            value = b"".join(map(self.piece, PIECES.findall(plain)))
        self[word] = value
        return value

    def encode(self, text: str) -> np.ndarray:
        """What the library's ``encode(text, add_special_tokens=False).ids`` gives, as unsigned 32-bit integers."""
        if not self.by_word or any(token in text for token in self.special) or not usual_space(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        plain = text.encode().lower().decode()  # A-Z only, as the normaliser does too
        words = END_MARK.sub(r"\1 \2", plain).split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u4")


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """The ids of a file, with the words that this process has met in earlier tasks."""
    return WordIds(path)


#: Characters at which Python's split cuts although the pattern's white space leaves them in a piece.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def usual_space(text: str) -> bool:
    return ODD_SPACE.search(text) is None

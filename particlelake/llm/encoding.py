"""Token ids of whole texts, with words encoded once per worker."""

from __future__ import annotations

import string
import struct

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Words of a generation. A worker remembers two generations: words that come again move
#: to the new one, and the rest is forgotten with the old one, so memory is bounded.
CACHE_WORDS = 300_000
MARKS = string.punctuation.encode()

_ENCODERS: dict[str, "WordEncoder"] = {}


def as_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Encodes texts with a tokenizer that drops white space and never joins words over it.

    Such a tokenizer gives a text the ids of its words one after the other, so the
    encoder is a dictionary from words to ids that fills itself. Ids are little-endian
    unsigned 32-bit integers in ``bytes``.

    A word of Latin-1 letters, with or without ASCII punctuation behind it, is encoded
    as the vocabulary's model sees it: its lower-case letters by the model alone, and the
    punctuation as a word of its own. Every other word takes the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(c) for c in range(256) if chr(c).isalpha()]
        self.as_bytes = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in latin}
        samples = ["a b\nc", "Straße ÉTÉ", "words!", "Más..."]
        split = ["a", "b", "c", "straße", "été", "words", "!", "más", "..."]
        if [i for s in samples for i in self._whole(s)] != [i for s in split for i in self._whole(s)]:
            raise ValueError("this tokenizer keeps white space, case, or letters and marks together")
        if any(self._letters(s) != self._whole(s) for s in ("straße", "été", "words", "zzqxj")):
            raise ValueError("this tokenizer's model does not see words byte by byte")

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, lower: str) -> list[int]:
        return [t.id for t in self.model.tokenize(lower.translate(self.as_bytes))]

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._encode(word)
        self[word] = ids
        return ids

    def _encode(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha():
            lower = core.lower()
            text = None
        else:
            text = core.decode("utf-8")
            if not text.isalpha() or max(text) > "\xff":
                return as_ids(self._whole(word.decode("utf-8")))
            text = text.lower()
            lower = text.encode("utf-8")
        if len(core) < len(word):
            return self[lower] + self[word[len(core):]]
        if lower != word:
            return self[lower]
        return as_ids(self._letters(text or lower.decode()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; memory grows with the texts of one call."""
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        return [b"".join(map(self.__getitem__, text.split())) for text in texts]


def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, kept across its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]

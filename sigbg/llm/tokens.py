"""Token ids of whole texts with a public tokenizer file, a word at a time.

The tokenizer never joins across white space (its pre-tokenizer matches no
white space), so the ids of a text are the ids of its words one after another;
``tests/llm`` holds that against whole-text encoding.  Words are encoded once a
worker and kept; the store is emptied when it grows past a bound.
"""

from __future__ import annotations

import os
import sys
from array import array

END_ID = 1
CACHE_WORDS = 500_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; the default of every operator's ``path`` parameter."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by word; an unknown word is encoded when it is first asked for."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    """``ids(texts)``: little-endian uint16 bytes of each text's ids, without the end id."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        if sys.byteorder != "little":
            raise RuntimeError("ids are stored little-endian")
        self.words = _Words(self._learn)
        self.cores = _Words(self._run)
        self.tokenize = self.tok.model.tokenize
        self.marks = bytes(i for i in range(33, 127) if not chr(i).isalnum())
        self.letters = _byte_letters()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a worker process and tokenizer file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, word: bytes) -> bytes:
        return array("H", self.tok.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _run(self, letters: bytes) -> bytes:
        """Ids of a lower-case run of letters, or of marks as they stand at a word's end."""
        if letters.isalpha():
            text = letters.decode()
        elif letters.isascii():
            return self._whole(letters)
        else:
            text = "".join([self.letters[c] for c in letters])
        return array("H", [x.id for x in self.tokenize(text)]).tobytes()

    def _learn(self, word: bytes) -> bytes:
        # A run of letters below U+0250 needs no normalisation but lower-casing; marks after it are a word of their own.
        core = word.rstrip(self.marks)
        if core.isalpha():                           # ASCII letters only
            ids = self.cores[core.lower()]
        else:
            t = core.decode()
            if not t.isalpha() or max(t) >= "\u0250" or "\u0130" in t:
                return self._whole(word)
            ids = self.cores[t.lower().encode()]
        return ids + self.cores[word[len(core):]] if len(core) < len(word) else ids

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """UTF-8 texts in, ids out; split at ASCII white space only."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            self.cores.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]

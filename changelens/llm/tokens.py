"""Token ids in tasks, by public vocabularies."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Code points from here on, and those below that END_OF_FAST marks, go through the tokenizer library itself.
FAST = 0x250
SPACE, LETTER, DIGIT, OTHER, END_OF_FAST = range(5)
CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)", re.IGNORECASE)


def _classes() -> np.ndarray:
    """The kind of each code point below FAST, as the vocabulary's pattern splits text."""
    out = np.full(FAST, OTHER, dtype=np.uint8)
    for code in range(FAST):
        kind = unicodedata.category(chr(code))[0]
        if chr(code) in " \t\n\r\v\f":
            out[code] = SPACE
        elif code < 0x20 or 0x7F <= code <= 0xA0 or code == 0x130:
            out[code] = END_OF_FAST
        elif kind in "LN":
            out[code] = LETTER if kind == "L" else DIGIT
    return out


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes for bytes: printable Latin-1 ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a lower-casing word-level BPE vocabulary whose last symbol of a word carries an end mark.

    The end mark becomes a byte of its own, so that a rank-based encoder can merge whole runs of words. Texts with
    other characters than Latin ones, with contractions or with controls are encoded by the tokenizer library. Both
    ways give the same ids.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, vocabulary = _byte_letters(), model["vocab"]

        def as_bytes(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(letters[c] for c in word) + (b"\0" if word != token else b"")

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [*(c + "</w>" for c in letters), *(a + b for a, b in merges), *letters]
        self.encoder = tiktoken.Encoding(
            "words", pat_str=r"[^\x00]+\x00", mergeable_ranks={as_bytes(t): i for i, t in enumerate(tokens)}, special_tokens={}
        )
        self.ids = np.array([vocabulary[t] for t in tokens], dtype="<u4")
        self.classes = _classes()

    def _marked(self, text: str) -> str | None:
        """The text's words, each with a mark behind it; None where the library has to do it."""
        text = text.lower()
        wide = "" if text.isascii() else max(text)
        coding, unit = ("latin-1", "u1") if wide < "\u0100" else ("utf-32-le", "<u4")
        if wide >= chr(FAST) or "'" in text and CONTRACTION.search(text):
            return None
        code = np.frombuffer(text.encode(coding), dtype=unit)
        kind = self.classes[code]
        if (kind == END_OF_FAST).any():
            return None
        pair = np.zeros((len(code), 2), dtype=unit)
        pair[:, 0] = code
        keep = np.ones((len(code), 2), dtype=bool)
        keep[:, 0] = kind != SPACE
        np.not_equal(kind[1:], kind[:-1], out=keep[:-1, 1])
        keep[:, 1] |= kind == DIGIT
        keep[:, 1] &= keep[:, 0]
        return pair[keep].tobytes().decode(coding)

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        marked = self._marked(text)
        if marked is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ids[np.array(self.encoder.encode_ordinary(marked), dtype=np.int64)].tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer a worker; by default over the 49k word vocabulary."""
    return WordTokenizer(path or public_tokenizers.path("word_bpe_49k.json"))

"""Token ids by the tokenizers library, with a cache of words.

Both vocabularies cut a text at white space before anything else, so the ids
of a text are those of its words in turn. A word is encoded by the library
once and then looked up; the cache is dropped when full, which changes no
result. Texts that the word rules do not fit are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np

_END = ".,!?;:|"
_COMBINING = re.compile("[\u0300-\u036f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache:
    """ids(texts): the ids of each text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, most_words: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        norm = told.get("normalizer") or {}
        pre = told.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in norm.get("normalizers", [])]
        self.kind = "whole"
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "spaced"
        elif kinds == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed":
            self.kind = "words"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.most = most_words
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _word(self, unit: str) -> bytes | None:
        """Ids of a single word of letters by the library's model alone; None if it is something else."""
        word = unit[1:] if unit[:1] == " " else unit
        if not word.isalpha():
            return None
        if self.kind == "words":
            if not word.isascii() and ("\u03a3" in word or "\u0130" in word or not unicodedata.is_normalized("NFC", word)):
                return None
            unit = word.lower()
        mapped = unit.encode("utf-8").decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _encode(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _learn(self, units: set[str]) -> None:
        """Closing marks are split from a word: they always start a token of their own."""
        known = self.known
        missing = units.difference(known)
        if not missing:
            return
        split = []
        need = set()
        for u in missing:
            core = u.rstrip(_END)
            if core != u and core and core[-1].isalpha():
                tail = u[len(core) :]
                split.append((u, core, tail))
                need.update(x for x in (core, tail) if x not in known)
            else:
                need.add(u)
        other = []
        for u in need:
            ids = self._word(u)
            if ids is None:
                other.append(u)
            else:
                known[u] = ids
        known.update(zip(other, self._encode(other), strict=True))
        for u, core, tail in split:
            known[u] = known[core] + known[tail]

    def _units(self, text: str) -> list[str] | None:
        """The text cut into units whose ids are simply put together; None if the rules do not fit."""
        if self.kind == "words":
            words = text.split()
            if any(c in text for c in "\x1c\x1d\x1e\x1f") or (not text.isascii() and _COMBINING.search(text)):
                return None
            return words
        words = text.split()
        lines = text.split("\n")
        if len(words) != text.count(" ") + len(lines) or not words:
            return None
        units = []
        for line in lines:
            first, *rest = line.split(" ")
            units.append(first)
            units += [" " + w for w in rest]
            units.append("\n")
        units.pop()
        return units

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        out: list[bytes | None] = [None] * len(texts)
        if self.kind == "whole":
            return self._encode(texts)
        if self.kind == "words":  # the lower case of A-Z merges words before the library sees them
            lowered = [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
        else:
            lowered = texts
        cut = [self._units(t) for t in lowered]
        self._learn(set().union(*(u for u in cut if u)))
        known = self.known.__getitem__
        whole = []
        for i, units in enumerate(cut):
            if units is None:
                whole.append(i)
            else:
                out[i] = b"".join(map(known, units))
        if whole:
            for i, got in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
                out[i] = got
        return out


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str, most_words: int = 1_200_000) -> WordCache:
    """One cache for each Python worker and vocabulary; a word takes about 250 bytes."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    _CACHES[path].most = most_words
    return _CACHES[path]


def forget_words() -> bool:
    """Drop the caches of this worker; whether there were any."""
    known = bool(_CACHES)
    _CACHES.clear()
    return known

"""Exact, cached encoding with a public tokenizer file.

A text is cut at spaces and line feeds, which no pre-token of the supported
file crosses, so the ids of a text are those of its chunks in order. Chunks and
the words in them are cached in the Python worker; only new words meet the BPE
model. Chunks with characters above U+024F, with combining marks or special
tokens take the tokenizer's own path.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import regex
from tokenizers import Tokenizer

#: The pre-token pattern of the word BPE file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(plain))
    return letters


class CachedEncoder:
    """ids(text) equals ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, most: int = 200_000):
        """most: entries in each of the cache's two generations; what is in use survives when the older one goes."""
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = next((p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), {})
        #: The fast path holds for this file's normaliser and pattern only; others are encoded by the tokenizer, text by text.
        self.fast = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == WORD_PATTERN
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words_of = regex.compile(WORD_PATTERN).findall
        self.latin = regex.compile("[\x00-\u024f]*").fullmatch
        self.letters = _byte_letters()
        #: Lower-case words are chunks themselves, so one cache serves both.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def _keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= 48:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        got = self.young.get(word)
        if got is None:
            if (got := self.old.get(word)) is None:
                mapped = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
                got = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            self._keep(word, got)
        return got

    def _chunk(self, chunk: str) -> bytes:
        if (got := self.old.get(chunk)) is None:
            if (chunk.isascii() or self.latin(chunk)) and not ("<|" in chunk and any(s in chunk for s in self.special)):
                low = chunk.lower()
                if low.isascii() and low.isalpha():
                    got = self._word(low)
                else:
                    got = b"".join(map(self._word, self.words_of(low)))
            else:
                got = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return self._keep(chunk, got)

    def raw(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.fast:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunk, out = self._chunk, []
        for c in text.replace("\n", " ").split(" "):
            if c:
                got = self.young.get(c)
                out.append(chunk(c) if got is None else got)
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None) -> CachedEncoder:
    """One for each Python worker; workers serve many tasks."""
    return CachedEncoder(path or tokenizer_path())

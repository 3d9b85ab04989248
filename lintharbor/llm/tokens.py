"""Token ids of whole texts by the tokenizers library, kept as packed little-endian bytes.

A byte-level BPE file splits a text into pieces by a fixed pattern and encodes each piece by itself.
Pieces repeat, so every Python worker keeps the ids of those it has met; the library encodes only
new ones. Files of another kind, and texts that hold an added token of the file, are encoded text by text.
"""

from __future__ import annotations

import array
import json
import re
import sys
import types
import unicodedata
from itertools import islice

import numpy as np

#: Most pieces a worker keeps, about 220 bytes each.
KEPT_PIECES = 500_000
#: Pieces of one text handled at a time, so that very long texts need no list of all of them.
_STRIDE = 200_000
#: The pattern of byte-level BPE for Python's own expressions, which are faster. Their letters, numbers
#: and spaces are the same but for the characters of `_differing`; texts with one of those take the other.
_QUICK = r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def _differing() -> re.Pattern:
    """Word characters that are neither letters nor decimal digits, control characters Python takes for spaces,
    and all characters beyond 16 bits, which would make the search slow."""
    odd = "".join(
        c for c in map(chr, range(0x10000))
        if (c.isalnum() and unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd"))
    return re.compile(f"[{re.escape(odd)}\x1c-\x1f\x85\U00010000-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE (given as Latin-1)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts, 2 bytes each where the vocabulary fits, else 4."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        split = parts.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        # A text that holds one of these goes to the library whole.
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._full = None
        if plain and not parts.get("normalizer") and parts["model"]["type"] == "BPE":
            import public_tokenizers
            import regex

            self._full, self._quick, self._odd = regex.compile(public_tokenizers.PATTERN), re.compile(_QUICK), _differing()
            self._letters, self._model = _byte_letters(), self._library.model
        self._pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the library's model, which takes bytes as letters."""
        letters = piece.encode().decode("latin-1").translate(self._letters)
        return array.array(self.dtype.char, [t.id for t in self._model.tokenize(letters)]).tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        kept = self._pieces
        found = list(map(kept.get, pieces))
        if None in found:
            if len(kept) > KEPT_PIECES:
                kept.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = kept.get(pieces[i]) or kept.setdefault(pieces[i], self._piece(pieces[i]))
        return b"".join(found)

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of one text; none for NULL or an empty one."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if self._full is None or any(t in text for t in self._added):
            return np.asarray(self._library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        pattern = self._full if self._odd.search(text) else self._quick
        if len(text) < 4 * _STRIDE:
            return np.frombuffer(self._joined(pattern.findall(text)), dtype=self.dtype)
        found = (m[0] for m in pattern.finditer(text))
        parts = []
        while pieces := list(islice(found, _STRIDE)):
            parts.append(self._joined(pieces))
        return np.frombuffer(b"".join(parts), dtype=self.dtype)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file. It outlives the task, as functions are sent anew with each."""
    held = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders")).__dict__
    if path not in held:
        os_threads()
        held[path] = Encoder(path)
    return held[path]


def os_threads() -> None:
    """One thread a task; Spark runs the tasks side by side."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))

"""Byte-level BPE token ids of whole texts.

The ids are those of tokenizers' file `byte_bpe_50k.json`; texts without its special token are
encoded from the same vocabulary's rank file, which gives the same ids several times faster
(tests/llm/test_operators.py holds the two against each other).
"""

from __future__ import annotations

import base64

import numpy as np

SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """encode(text) gives the ids as an array of unsigned 32-bit numbers."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as lines:
            self._ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=self._ranks, special_tokens={})
        self._json_path = json_path
        self._whole = None

    def encode(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            return self.encode_plain(text)
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._json_path)
        return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_plain(self, text: str) -> np.ndarray:
        """encode(), with the special token's string as plain text."""
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        lengths = np.zeros(max(self._ranks.values()) + 2, dtype=np.int64)
        for token, rank in self._ranks.items():
            lengths[rank] = len(token)
        lengths[-1] = len(SPECIAL)
        return lengths


_loaded: dict[tuple, ByteBpe] = {}


def load(json_path: str | None = None, rank_path: str | None = None) -> ByteBpe:
    """One encoder per Python worker and vocabulary."""
    from public_tokenizers import PATTERN

    key = (json_path or vocabulary_path("byte_bpe_50k.json"), rank_path or vocabulary_path("byte_bpe_50k.tiktoken"))
    if key not in _loaded:
        _loaded[key] = ByteBpe(*key, PATTERN)
    return _loaded[key]

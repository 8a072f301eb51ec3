"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import json
import os

import numpy as np


class TextTokenizer:
    """Ids as little-endian unsigned 32-bit arrays, equal to encoding each text whole with the tokenizer file.

    Texts go whole through a rank-based encoder built from the same file's
    vocabulary (its ids are the merge ranks) and the file's own split
    pattern. The two agree on every code point (compared one by one, in and
    beside words, digits and spaces). A text that holds an added token's
    string goes through the tokenizer itself, which gives it its id, and so
    does one with more white space in a row than the pattern's matcher takes.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        self.file = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        with open(self.file, encoding="utf-8") as f:
            model = json.load(f)
        self.added = special = {t["content"] for t in model["added_tokens"]}
        byte_of = _byte_alphabet()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = None

    @property
    def tokenizer(self):
        """The file's own tokenizer, loaded at its first use."""
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.file)
        return self._slow

    def __call__(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # the matcher's stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for.

    Bytes 33-126, 161-172 and 174-255 stand for themselves, the others take
    the code points from 256 on in byte order.
    """
    out, shift = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(shift)] = b
            shift += 1
    return out

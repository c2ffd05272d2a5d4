"""Token ids of whole texts, as the public tokenizer files give them. Runs inside tasks."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

# The fast encoder has the same vocabulary and word pattern. It is used where both libraries
# cannot differ: Latin text without unusual white space, special strings or very long words.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
_LONG_WORD = re.compile(r"\S{1000}")
# GPT-2's public word pattern, a fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file(name: str) -> str:
    """A path as given, or the place of a public tokenizer file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Byte-level BPE: ids of a text without added special tokens."""

    def __init__(self, name: str, ranks: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_file(name))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(tokenizer_file(ranks), "rb") as lines:
                table = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("bytes", pat_str=_WORDS, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if (
            self.fast is not None
            and _PLAIN.fullmatch(text)
            and not any(s in text for s in self.special)
            and not _LONG_WORD.search(text)
        ):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def byte_encoder(name: str, ranks: str | None) -> ByteEncoder:
    return ByteEncoder(name, ranks)

"""Token ids of whole texts by a public tokenizer, quickly.

Ids are those of the ``tokenizers`` library for its file.  Where a ``.tiktoken`` file with the same ranks
lies beside it, whole texts are encoded by these, in a half of the time that a cache of words takes where words
are many; texts that hold the string of a special token go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k.json"


@functools.cache
def special_tokens(vocabulary: str) -> tuple[int, tuple[str, ...]]:
    """The number of ids, and the strings of special tokens; the file's text is not kept."""
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        described = json.load(file)
    added = described.get("added_tokens", [])
    return max([*described["model"]["vocab"].values(), *(t["id"] for t in added)]) + 1, tuple(t["content"] for t in added)


def id_type(vocabulary: str) -> str:
    """The narrowest unsigned type, little-endian, that holds every id."""
    return "<u2" if special_tokens(vocabulary)[0] <= 1 << 16 else "<u4"


class Encoder:
    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.path = public_tokenizers.path(vocabulary)
        self.special = special_tokens(vocabulary)[1]
        ranks = self.path.removesuffix(".json") + ".tiktoken"
        self.whole = None
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.whole = fast.encode_ordinary

    @functools.cached_property
    def slow(self):
        """The tokenizer itself, loaded only for texts that need it."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers, without special tokens added."""
        if self.whole is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.whole(text), "<u4")


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each worker process."""
    return Encoder(vocabulary)

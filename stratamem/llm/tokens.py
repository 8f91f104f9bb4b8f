"""Token ids and counts of texts by a public tokenizer, for operators that only need the ids.

The ids are those of ``bpe``, but from the installed ``tiktoken`` library, a text at a time.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import tiktoken

from .bpe import PATTERN, VOCABULARY, load


@lru_cache(maxsize=2)
def library(path: str = VOCABULARY) -> Whole:
    return Whole(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load(path), special_tokens={}))


class Whole:
    """A text's ids as int32 bytes."""

    def __init__(self, coder: tiktoken.Encoding) -> None:
        self.coder = coder

    def ids(self, text: str) -> bytes:
        return array("i", self.coder.encode_ordinary(text)).tobytes()

"""Byte-pair encoding of whole texts with a public tokenizer file.

Ids of this kind of file rise in the order of the merges, so its vocabulary is also a table of ranks, and the faster library
for such tables gives the same ids.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself if it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str = TOKENIZER) -> None:
        path = public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            model = json.load(handle)["model"]
        vocabulary, byte_of = model["vocab"], {c: b for b, c in byte_alphabet().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        made = [vocabulary["".join(rule) if isinstance(rule, list) else rule.replace(" ", "")] for rule in model["merges"]]
        if made != sorted(made):
            raise ValueError(f"{file}: the ids are not in the order of the merges")
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if token not in special}
        self.ranks = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        # separators that the two pattern engines may class differently, and special tokens, go the whole way
        self.odd = re.compile("[\x1c-\x1f\u180e]")
        self.whole = re.compile("|".join([*map(re.escape, special), self.odd.pattern]))

    @functools.cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each id (none for special tokens), and how many they are."""
        table = [self.bytes.get(i, b"") for i in range(self.tokenizer.get_vocab_size())]
        return np.array(table, object), np.array([len(b) for b in table], np.int64)

    def plain(self, text: str) -> list[int]:
        """Ids of a text in which strings of special tokens are ordinary text."""
        if not self.odd.search(text):
            return self.ranks.encode_ordinary(text)
        self.tokenizer.encode_special_tokens = True
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = False
        return ids

    def encode_one(self, text: str | None) -> bytes:
        text = text or ""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.whole.search(text) else self.ranks.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


@functools.cache
def encoder(file: str = TOKENIZER) -> TextEncoder:
    """One encoder for each worker process."""
    return TextEncoder(file)

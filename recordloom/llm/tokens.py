"""Token ids of whole texts, by the byte-level BPE of a vocabulary file.

The ids are those of the vocabulary's tokenizer, which adds no special tokens but knows the vocabulary's added tokens
where a text spells them. A text is cut at these, and then at single spaces between other characters, where the
vocabulary's splitting pattern always cuts. The parts' ids are kept in a bounded cache, since most words come again.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

from recordloom.llm.worker import held

CACHED_PARTS = 200_000
CACHED_LENGTH = 48
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path() -> str:
    """The default vocabulary file; every user of this module takes another path as well."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """The ids of the tokens that the vocabulary's tokenizer file adds to its ranks; none without such a file beside it."""
    described = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(described):
        return {}
    with open(described, encoding="utf-8") as lines:
        return {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}


class _Loose(Exception):
    """A part begins or ends with white space, so cutting at each space was wrong."""


class Encoder(dict):
    """Ids as bytes (unsigned, 32 bits, little-endian) of a part that follows a space; the parts are the keys."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._added = {t: np.array([i], "<u4").tobytes() for t, i in added_tokens(path).items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self._added else None

    def _ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Loose
        ids = self._ids(" " + part)
        if len(part) <= CACHED_LENGTH:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        parts = self._cuts.split(text) if self._cuts else [text]
        if len(parts) == 1:
            return self._plain(text)
        # every second part is an added token
        return b"".join([self._added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts)])

    def encode_as_text(self, text: str) -> bytes:
        """The ids of a whole text in which the strings of added tokens are text like any other."""
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Loose
            return b"".join([self._ids(first), *map(self.__getitem__, rest)])
        except _Loose:
            first, *rest = SINGLE_SPACE.split(text)
            return b"".join([self._ids(first), *[self._ids(" " + p) if p[-1].isspace() else self[p] for p in rest]])


def encoder(path: str) -> Encoder:
    """The encoder that this Python worker holds, of the file at ``path``."""
    return held((Encoder, path), lambda: Encoder(path))

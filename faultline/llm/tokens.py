"""Token ids of whole texts by a byte-level BPE tokenizer file."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: Ids of one text piece are kept so long as a worker holds no more than this many pieces.
MOST_PIECES = 500_000
#: Where this alphabet covers a text, the pattern below cuts it as the tokenizer's own rule does.
_SAFE = re.compile("[\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]*")
_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r" [^\W\d_]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes batches of texts; pieces between which no merge can happen are encoded once and remembered.

    Texts with characters outside the safe alphabet, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # a character of a byte-level token stands for a byte
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if _PLAIN.fullmatch(p)]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in part])) + 1
            raw, before = ids.tobytes(), 0
            for p, cut in zip(part, (4 * cuts).tolist()):
                self.known[p] = raw[before:cut]
                before = cut
        for p in pieces:
            if p not in self.known:
                self.known[p] = self._whole(p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > MOST_PIECES:
            self.known.clear()
        cut = [None if any(s in t for s in self.special) or not _SAFE.fullmatch(t) else _PIECE.findall(t) for t in texts]
        new: set[str] = set()
        for pieces in cut:
            if pieces:
                new.update(pieces)
        self._learn(list(new.difference(self.known)))
        get = self.known.__getitem__
        return [self._whole(t) if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def runs(texts: list[str | None], most: int = 1 << 20):
    """Slices of a list with about ``most`` characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))

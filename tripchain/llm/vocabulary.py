"""A byte-level BPE vocabulary file, as tasks read it: byte strings of tokens, merges in rank order, splitting of texts into words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

# Fixed value: the splitting pattern of the vocabulary's pre-tokeniser.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Below this code point the same pattern runs on the standard library, with its classes written out.
NARROW = 0x250


def _narrow_pattern() -> re.Pattern[str]:
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(NARROW) if regex.match(kind, chr(c)))
    letter, number, space = (members(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_NARROW_PATTERN, _WIDE = _narrow_pattern(), re.compile(f"[^\0-{chr(NARROW - 1)}]")


def split_words(text: str) -> list[str]:
    return (PATTERN if _WIDE.search(text) else _NARROW_PATTERN).findall(text)


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in the file: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shown = spec["model"], _shown_bytes()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or any(
                t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.size = max([*ids.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(shown[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.byte_ids = np.array([ids[c] for c in sorted(shown, key=shown.get)], np.int64)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = np.full(self.size, -1, np.int64)  # the rank at which a token is made; -1 for bytes
        self.rank_of[self.made] = np.arange(len(pairs))
        if (np.maximum(self.rank_of[self.left], self.rank_of[self.right]) >= np.arange(len(pairs))).any() or len(np.unique(self.made)) < len(pairs):
            raise ValueError(f"{path}: merges are not in the order in which their parts are made")
        order = np.argsort(self.left * self.size + self.right)
        self.pair_keys = (self.left * self.size + self.right)[order]
        self.pair_ranks = order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_keys))

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings: (piece, whether it is one)."""
        if self.special_pattern is None or not any(t in text for t in self.special):
            yield text, False
            return
        for i, piece in enumerate(self.special_pattern.split(text)):
            if piece:
                yield piece, bool(i % 2)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


class WordCache:
    """What a worker has found for words so far. Emptied when it holds ``most`` words; that costs time, never results."""

    def __init__(self, make, most: int = 200_000):
        self.make, self.most, self.found = make, most, {}

    def fill(self, texts: list[list[str]]) -> dict[str, bytes]:
        """The results of all words of the lists."""
        new = [w for w in set().union(*texts) if w not in self.found]
        if len(self.found) + len(new) > self.most:
            self.found.clear()
            new = list(set().union(*texts))
        if new:
            self.found.update(zip(new, self.make([w.encode() for w in new])))
        return self.found

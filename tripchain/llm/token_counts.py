"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a word, the last token of its encoding is found from shorter prefixes: a token that ends there, after the
prefix it leaves, is the last one exactly when it stays apart from that prefix's own last token. Of the tokens that end at a place just one
passes. So one sweep over a word stores the exact count of each of its prefixes, and a text's counts add up over its words: truncation and
budget questions need no second encoding. All words of a slice take each step together, in arrays; whether two
tokens stay apart is worked out from the merges once and kept in a table of fixed size.

Defined cases: a null text is an empty one, with no bytes and no tokens; whole texts of any length are counted; a special token's string counts
as one token; rows are independent of each other; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.llm.common import mix64, slices, tidy
from tripchain.llm.vocabulary import Vocabulary, WordCache, split_words, vocabulary


class Neighbours:
    """Whether one token may follow another: no merge crosses the border between them while each is put together."""

    def __init__(self, v: Vocabulary, memory_bits: int = 21):
        self.v, self.none = v, len(v.left)
        self.right_edge, self.left_edge = self._edges(v.right), self._edges(v.left)
        self.known = np.full(1 << memory_bits, -1, np.int64)
        self.apart = np.zeros(1 << memory_bits, bool)

    def _edges(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the symbols that stand at one end of it while it is made, each with the rank at which it is merged away."""
        token, until = np.arange(self.v.size), np.full(self.v.size, self.none)
        symbols, ends = [token], [until]
        while (rank := np.where(token >= 0, self.v.rank_of[token], -1)).max() >= 0:
            token, until = np.where(rank >= 0, part[rank], -1), rank
            symbols.append(token)
            ends.append(until)
        return np.array(symbols), np.array(ends)

    def stay_apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first * self.v.size + second
        slot = (mix64(key.astype(np.uint64)) & np.uint64(len(self.known) - 1)).astype(np.int64)
        missing = np.flatnonzero(self.known[slot] != key)
        out = self.apart[slot]
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            found = self._work_out(new // self.v.size, new % self.v.size)
            out[missing] = found[back]
            where = (mix64(new.astype(np.uint64)) & np.uint64(len(self.known) - 1)).astype(np.int64)
            _, last = np.unique(where[::-1], return_index=True)
            one = len(where) - 1 - last
            self.known[where[one]], self.apart[where[one]] = new[one], found[one]
        return out

    def _work_out(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        apart = np.ones(len(first), bool)
        for a_row, a_until in zip(*self.right_edge):
            for b_row, b_until in zip(*self.left_edge):
                live = np.flatnonzero(apart & (a_row[first] >= 0) & (b_row[second] >= 0))
                if not len(live):
                    continue
                a, b = first[live], second[live]
                rank = self.v.ranks(a_row[a], b_row[b])
                # Equal pairs merge from the left: the border's pair loses to one on its left and wins over one on its right.
                apart[live[(rank < self.none) & (rank < a_until[a]) & (rank <= b_until[b])]] = False
        return apart


class PrefixCounts:
    def __init__(self, v: Vocabulary):
        self.v, self.neighbours = v, Neighbours(v)
        # All tokens as a trie: a node's children by binary search over node * 256 + byte.
        nodes: dict[int, int] = {}
        ends = {0: -1}
        for token in np.flatnonzero(self._reachable()).tolist():
            node = 0
            for byte in v.token_bytes[token]:
                node = nodes.setdefault(node * 256 + byte, len(nodes) + 1)
            ends[node] = token
        self.edges = np.array(sorted(nodes), np.int64)
        self.child = np.array([nodes[e] for e in self.edges.tolist()], np.int64)
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())

    def _reachable(self) -> np.ndarray:
        """Tokens that merges make: bytes, and tokens whose two parts stay apart until they are merged."""
        kept = np.zeros(self.v.size, bool)
        kept[self.v.byte_ids] = True
        kept[self.v.made] = True
        return kept

    def of(self, words: list[bytes]) -> list[bytes]:
        """For each word the token counts of its prefixes of 1, 2, ... bytes, as the bytes of 32-bit integers."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        home = np.repeat(start, size)
        stop = home + np.repeat(size, size)
        # Every token at every place: (end place, first place, token).
        at, node, length, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0, []
        while len(at):
            key = node * 256 + flat[at + length]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[edge] == key
            at, node = at[on], self.child[edge[on]]
            token = self.token[node]
            is_token = token >= 0
            found.append((at[is_token] + length, at[is_token], token[is_token]))
            length += 1
            more = at + length < stop[at]
            at, node = at[more], node[more]
        end, first, token = (np.concatenate(x) for x in zip(*found))
        step = end - home[end]
        order = np.argsort(step, kind="stable")
        end, first, token, step = end[order], first[order], token[order], step[order]
        cuts = np.searchsorted(step, np.arange(int(step[-1]) + 2))
        last, count = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            e, f, t = end[a:b], first[a:b], token[a:b]
            whole = f == home[e]
            good = whole.copy()
            inner = np.flatnonzero(~whole)
            good[inner] = self.neighbours.stay_apart(last[f[inner] - 1], t[inner])
            # A token over the whole prefix is its encoding: it is made by merges, and no other candidate passes beside it.
            for chosen in (np.flatnonzero(good & ~whole), np.flatnonzero(whole)):
                last[e[chosen]] = t[chosen]
                count[e[chosen]] = np.where(whole[chosen], 1, count[f[chosen] - 1] + 1)
        raw = count.astype("<i4").tobytes()
        return [raw[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), size.tolist())]


@lru_cache(maxsize=4)
def _cache(path: str) -> WordCache:
    counts = PrefixCounts(vocabulary(path))
    return WordCache(counts.of)


class Prefixes:
    """The counts of a text's prefixes, from those of its words."""

    def __init__(self, v: Vocabulary, found: dict[str, bytes], pieces: list[tuple[str, list[str] | None]], lookup):
        """``pieces``: (piece, its words), words None for a special string; ``lookup`` fills in words that the text itself lacks."""
        self.words = [w for piece, words in pieces for w in ([piece] if words is None else words)]
        self.special = [words is None for piece, words in pieces for _ in ([piece] if words is None else words)]
        self.found, self.lookup = found, lookup
        ones = [1 if s else int.from_bytes(found[w][-4:], "little") for w, s in zip(self.words, self.special)]
        self.chars = [0, *accumulate(map(len, self.words))]
        self.tokens = [0, *accumulate(ones)]

    def _word(self, word: str) -> int:
        if not word:
            return 0
        if word not in self.found:
            return sum(int.from_bytes(x[-4:], "little") for x in self.lookup(word))
        return int.from_bytes(self.found[word][-4:], "little")

    def count(self, n: int) -> int:
        """Tokens of the first n characters, as if the text ended there."""
        k = int(np.searchsorted(self.chars, n, side="right")) - 1
        inside = n - self.chars[k]
        if not inside:
            # White space at the end is one run, however the longer text splits it.
            if k >= 2 and not self.special[k - 1] and not self.special[k - 2] and self.words[k - 1].isspace() and self.words[k - 2].isspace():
                return self.tokens[k - 2] + self._word(self.words[k - 2] + self.words[k - 1])
            return self.tokens[k]
        word, part = self.words[k], self.words[k][:inside]
        if self.special[k]:
            back = k
            while back and not self.special[back - 1] and (self.words[back - 1] + part).strip() == (self.words[back - 1] + part):
                back -= 1
            return self.tokens[back] + self._word("".join(self.words[back:k]) + part)
        if part.isspace() and k and not self.special[k - 1] and self.words[k - 1].isspace():
            return self.tokens[k - 1] + self._word(self.words[k - 1] + part)
        if part[0] == "'" and word[1:2].isalpha() and inside > 1 and inside < len(word):
            return self.tokens[k] + self._word("'") + self._word(part[1:])
        return self.tokens[k] + int.from_bytes(self.found[word][4 * len(part.encode()) - 4 : 4 * len(part.encode())], "little")

    def longest(self, budget: int) -> int:
        """The most characters whose tokens are within the budget."""
        k = int(np.searchsorted(self.tokens, budget, side="right")) - 1
        high = self.chars[min(k + 2, len(self.words))]
        return next((n for n in range(high, self.chars[k], -1) if self.count(n) <= budget), self.chars[k])


def prefixes(path: str, texts: list[str]) -> list[Prefixes]:
    v, cache = vocabulary(path), _cache(path)
    pieces = [[(s, None if special else split_words(s)) for s, special in v.segments(t)] for t in texts]
    found = cache.fill([w for p in pieces for _, w in p if w is not None])
    return [Prefixes(v, found, p, lambda text: (cache.make([w.encode()])[0] for w in split_words(text))) for p in pieces]


def count_tokens(docs: DataFrame, path: str, budget: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, kept_chars): kept_chars is the most characters whose tokens are within the budget."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            said = [t.decode() for t in texts]
            counted = prefixes(path, said)
            total = [p.tokens[-1] for p in counted]
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(total, pa.int64()),
                "kept_chars": pa.array([len(t) if n <= budget else p.longest(budget) for t, n, p in zip(said, total, counted)], pa.int64())})

    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, kept_chars long"
    return rows.mapInArrow(tidy(run), schema).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "kept_chars")

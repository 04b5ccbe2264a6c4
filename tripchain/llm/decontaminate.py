"""Benchmark decontamination with an FM-index per training shard.

Words are ids here: those of the benchmark come first, every other word of the shard has its own too, ends of texts are 1, and a single 0 ends the string. A shard is a run
of documents of bounded size inside one task. Its whole word string is indexed (suffix order, Burrows-Wheeler transform, wavelet matrix of packed bits with
a count for every 64 of them, every 16th text place sampled), all windows of the benchmark are searched backwards at once, occurrences
are located by stepping to the next sampled place, and the spans of a document are merged.

The benchmark's items are dealt to blocks of a bounded number of bytes (an item is never cut), written as a table, and searched one block after the other:
only one block is read, sent to the tasks and held by them at a time. Between two blocks the texts with the spans found so far are written to the shared folder.

Defined cases: null and empty texts have no words; a text is one row of the result however often its id occurs; items without words have no
windows; an item with a null id is left out; items that share an id count once; an empty benchmark marks nothing; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.llm.common import Run, Scratch, slices, tidy

#: Benchmark text sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Text of a shard: one index is built over about this much.
SHARD_BYTES = 2 << 20
SAMPLE = 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Wavelet:
    """Wavelet matrix: rank of a symbol before a place, for many (symbol, place) pairs at once."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.before, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            # One word more than the bits need, so that the place after the last one has a word.
            packed = np.zeros(8 * (len(bit) // 64 + 1), np.uint8)
            packed[: -(-len(bit) // 8)] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before[:-1])
            self.zeros.append(len(bit) - int(before[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        at = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][at] + np.bitwise_count(self.words[level][at] & below)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for k, zeros in enumerate(self.zeros):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self._ones(k, low), self._ones(k, high)
            low = np.where(bit, zeros + ones[0], low - ones[0])
            high = np.where(bit, zeros + ones[1], high - ones[1])
        return high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still alike are sorted again. ``symbols`` ends in its only 0."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key, places = symbols[order], np.arange(n)
    suffix, rank, step = order, np.empty(n, np.int64), 1
    while True:
        # A rank is the first place of those that are alike.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(new, places, 0))
        places = places[~(new & np.concatenate([new[1:], [True]]))]
        if not len(places):
            return order
        suffix = order[places]
        # Suffixes that are alike are longer than the step, as the 0 stands once.
        key = rank[suffix] * n + rank[suffix + step]
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[places] = suffix
        step *= 2


class FmIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """``symbols`` must end in its only 0."""
        order = suffix_order(symbols)
        last = symbols[order - 1]
        self.n, self.last = len(symbols), last
        self.wavelet = Wavelet(last, max(1, int(alphabet - 1).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffix order that start with each pattern (one per line, filled with -1 on the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in patterns.T[::-1]:
            live = np.flatnonzero((column >= 0) & (low < high))
            if not len(live):
                continue
            c = column[live]
            low[live] = self.smaller[c] + self.wavelet.rank(c, low[live])
            high[live] = self.smaller[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows: step back to a sampled place."""
        place, rows, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows[open_]]
            place[open_[known >= 0]] = known[known >= 0] + steps
            open_ = open_[known < 0]
            c = self.last[rows[open_]]
            rows[open_] = self.smaller[c] + self.wavelet.rank(c, rows[open_])
            steps += 1
        return place


class Phrases:
    """Windows of the benchmark as word ids, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 2) for w in words_of(text)]
            for i in range(max(1, len(words) - n + 1) if words else 0):
                windows.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.items = sorted({item for found in windows.values() for item in found})
        number = {item: i for i, item in enumerate(self.items)}
        self.length = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.full((len(windows), n), -1, np.int64)
        for i, w in enumerate(windows):
            self.patterns[i, n - len(w) :] = w
        self.holders = [np.array(sorted(number[item] for item in found)) for found in windows.values()]

    def spans(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence in the documents of a shard."""
        none = np.empty(0, np.int64)
        if not len(self.length):
            return none, none, none
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.ones(int(sizes.sum()) + len(docs) + 1, np.int64)
        flat[-1] = 0
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = dict(self.ids)
        number = ids.setdefault
        for i, words in enumerate(docs):
            flat[starts[i] : starts[i] + len(words)] = [number(w, len(ids) + 2) for w in words]
        index = FmIndex(flat, len(ids) + 2)
        low, high = index.search(self.patterns)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        rows = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        place = index.locate(rows)
        doc = np.searchsorted(starts, place, side="right") - 1
        return doc, place - starts[doc], window


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return list(zip(first[new].tolist(), end[np.concatenate([new[1:], [True]])].tolist()))


class _Search:
    """A search for all blocks of the benchmark. ``rows`` are the documents, with the extra columns by number, as all blocks but the last have left them;
    ``last`` is the search for the last one. Without a further block nothing is written."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, n: int, extra: list[str], text: str, item_id: str, item_text: str):
        self.scratch = Scratch(docs.sparkSession)
        said = F.coalesce(F.col(item_text), F.lit("")).cast("binary")
        items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), said.alias("said"))
        size = items.agg(F.sum(F.length("said"))).first()[0] or 0
        # Half of what a block may hold on average; an item id is in one block.
        blocks = max(1, -(-2 * size // BLOCK_BYTES))
        if blocks > 1:
            items = self.scratch.keep(items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "benchmark-blocks")
        self.rows = docs.select(
            *[F.col(c).alias(f"_{i}") for i, c in enumerate(extra)], F.col(text).alias("_text"),
            F.lit(None).cast("array<struct<first:long,end:long>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
            F.lit(0).cast("long").alias("n_words"))
        for block in range(blocks):
            own = items.where(F.col("block") == block) if blocks > 1 else items
            sent = docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["said"])) for r in own.toLocalIterator()])  # one block
            self.last = _searcher(sent, n)
            if block < blocks - 1:
                self.rows = self.scratch.keep(self.rows.mapInArrow(tidy(self.last), self.rows.schema), "searched")
                sent.unpersist()

    def finish(self, found: DataFrame) -> DataFrame:
        """The result; where it rests on written tables it is written too, and those go."""
        if not self.scratch.paths:
            return found
        kept = Scratch(found.sparkSession).keep(found, "decontaminated")
        self.scratch.drop()
        return kept


def find_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, extra: tuple[str, ...] = (), text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``extra`` columns of every document with n_words, spans (array of [first, end) word numbers, merged) and items (sorted ids).

    A benchmark of more than one block adds a search of the same texts for each further block.
    """
    search = _Search(docs, benchmark, n, list(extra), text, item_id, item_text)
    found = search.rows.mapInArrow(tidy(search.last), search.rows.schema)
    return search.finish(found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(extra)], F.col("_text").alias(text), "n_words", "spans", "items"))


def _searcher(sent, n: int) -> Run:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, n)
        names = np.array(phrases.items, dtype=object)
        for part, texts in slices(batches, "_text", SHARD_BYTES):
            words = [words_of(t) for t in texts]
            doc, first, window = phrases.spans(words)
            order = np.argsort(doc, kind="stable")
            doc, first, window = doc[order], first[order], window[order]
            cut = np.searchsorted(doc, np.arange(len(words) + 1))
            spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
            for i in range(len(words)):
                a, b = cut[i], cut[i + 1]
                old = [(s["first"], s["end"]) for s in spans[i] or ()]
                if a == b:
                    spans[i], items[i] = spans[i] or [], items[i] or []
                    continue
                both = np.array(old + list(zip(first[a:b], first[a:b] + phrases.length[window[a:b]])), np.int64)
                spans[i] = [{"first": x, "end": y} for x, y in merged(both[:, 0], both[:, 1])]
                held = np.unique(np.concatenate([phrases.holders[w] for w in np.unique(window[a:b])]))
                items[i] = sorted({*(items[i] or ()), *names[held]})
            columns = {name: part.column(i) for i, name in enumerate(part.schema.names)} | {
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)
    return search


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents with the merged spans cut out of their texts; other texts stay as they are."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    search = _Search(docs, benchmark, n, others, "text", "item_id", "text")
    kept, run = [f"_{i}" for i in range(len(others))] + ["_text"], search.last

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            texts, spans = batch.column("_text").to_pylist(), batch.column("spans").to_pylist()
            said = [cut_spans(t.encode(), [(s["first"], s["end"]) for s in x]).decode() if x else t for t, x in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(said, pa.string())], names=kept)

    out = search.rows.mapInArrow(tidy(cut), search.rows.select(kept).schema).toDF(*others, "text")
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return search.finish(out.select(columns))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return find_spans(docs, benchmark, n, extra=("doc_id",)).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))

"""BPE encoding and decoding in batched NumPy merge rounds.

The distinct words of a slice of texts stand as symbols in one flat array. In a round, all adjacent pairs are looked up by binary search over
the sorted pair keys, every word's lowest rank is found, and all its pairs of that rank merge at once (from the left where they
overlap). That equals one merge at a time, as a new symbol's merges rank after its own. Words without a merge leave the array.

Defined cases: a null text is an empty one, with no tokens; whole texts of any length are encoded; strings of special tokens become those
tokens; ids that the vocabulary lacks are left out in decoding; bytes that are no UTF-8 decode to U+FFFD; rows are
independent of each other, so repeated rows and clashing names need no rule; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripchain.llm.common import Run, slices, tidy
from tripchain.llm.vocabulary import Vocabulary, WordCache, split_words, vocabulary


def merge_rounds(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Token ids of each word, as the bytes of 32-bit integers."""
    if not words:
        return []
    none, n = len(v.left), len(words)
    symbols = v.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(n), [len(w) for w in words])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank = np.full(len(symbols), none)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = v.ranks(symbols[same], symbols[same + 1])
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        lowest = np.repeat(np.minimum.reduceat(rank, first), size)
        over = lowest == none
        if over.any():
            done.append((word[over], symbols[over]))
            going = ~over
            symbols, word, rank, lowest = symbols[going], word[going], rank[going], lowest[going]
        merge = rank == lowest
        if (merge[1:] & merge[:-1]).any():
            # A run of equal symbols: its pairs overlap, and every second one merges.
            at = np.flatnonzero(merge)
            start = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])])
            run = np.repeat(at[start], np.diff(np.append(np.flatnonzero(start), len(at))))
            merge[at[(at - run) % 2 == 1]] = False
        at = np.flatnonzero(merge)
        symbols[at] = v.made[rank[at]]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        symbols, word = symbols[kept], word[kept]
    word = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
    symbols = np.concatenate([s for _, s in done]) if done else word
    order = np.argsort(word, kind="stable")
    raw, ends = symbols[order].astype("<i4").tobytes(), 4 * np.cumsum(np.bincount(word, minlength=n))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=4)
def _cache(path: str) -> WordCache:
    v = vocabulary(path)
    return WordCache(lambda words: merge_rounds(v, words))


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    v, cache = vocabulary(path), _cache(path)
    pieces = [list(v.segments(t)) for t in texts]
    words = [[split_words(s) for s, special in p if not special] for p in pieces]
    found = cache.fill([w for p in words for w in p])
    out = []
    for text, split in zip(pieces, words):
        plain = iter(split)
        raw = b"".join(v.special[s].to_bytes(4, "little") if special else b"".join(map(found.__getitem__, next(plain))) for s, special in text)
        out.append(np.frombuffer(raw, "<i4"))
    return out


def _encoder(path: str, text: str, ids: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            found = encode_texts(path, [t.decode() for t in texts])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            kept = {name: part.column(i) for i, name in enumerate(part.schema.names) if name != ids}
            yield pa.RecordBatch.from_pydict(kept | {ids: column})
    return run


def _decoder(path: str, ids: str, text: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        pieces = v.token_bytes
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            said = []
            for i in range(len(column)):
                row = np.asarray(column[i].values) if column[i].is_valid else np.empty(0, np.int32)
                if row.dtype != np.int32 or (len(row) and (row.min() < 0 or row.max() >= v.size)):
                    row = np.array([x for x in column[i].as_py() if x is not None and 0 <= x < v.size], np.int32)
                said.append(b"".join(map(pieces.__getitem__, row.tolist())).decode("utf-8", "replace"))
            kept = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if name != text}
            yield pa.RecordBatch.from_pydict(kept | {text: pa.array(said, pa.string())})
    return run


def _with(docs: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in docs.schema if f.name not in new), *(T.StructField(name, kind, True) for name, kind in new.items())])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with their token ids as an array column."""
    return docs.mapInArrow(tidy(_encoder(path, text, ids)), _with(docs, **{ids: T.ArrayType(T.IntegerType())}))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The documents with the text of their token ids; null ids give an empty text."""
    return docs.mapInArrow(tidy(_decoder(path, ids, text)), _with(docs, **{text: T.StringType()}))


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both in one pass: a task has one Python worker, which holds a slice of texts at a time."""
    there, back = _encoder(path, text, ids), _decoder(path, ids, decoded)
    schema = _with(docs, **{ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()})
    return docs.mapInArrow(tidy(lambda batches: back(there(batches))), schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return encode_and_decode(docs.select("doc_id", "text"), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

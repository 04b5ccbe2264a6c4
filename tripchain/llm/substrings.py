"""Substring dedup with prefix-partitioned suffix trees.

The suffixes of interest start where a window of 35 words starts. A suffix's prefix reaches up to and including the 14-word gram with the smallest
hash in its first 35 words, so prefixes differ in length, and suffixes that share 35 words share that gram. Suffixes are
grouped by it; those of one document whose prefix ends in the same gram are neighbours, so a group gets them as one span of text.

1. Every task lists the (gram, text) pairs of its texts; grams that it sees twice are shared, the others meet those of other tasks, one
   record a task. A gram that occurs once in the corpus cannot lie in a repeat, and its suffixes go no further.
2. Spans of shared grams are cut from the texts; a gram with more than ``HOT`` spans is extended to the full 35 words, a group for each window.
   Equal spans are counted before they are shuffled, so copies do not gather in one task.
3. A task takes its groups together up to a memory-sized batch, orders their suffixes by prefix doubling and joins neighbours
   with a common prefix of at least 35 words: these runs are the tree's internal nodes of that depth, and their windows are the repeats.
4. The covered words are gathered per text, as many ranges as it has spans at most, and cut out.

Texts are known by their MD5 digest; equal texts are worked on once, and every window of a text that occurs twice is a repeat.

Defined cases: null and empty texts have no words; texts of fewer words than a window are left alone; a text's repeats inside itself count; rows stay,
also repeated ones; an empty table stays empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch, by_part, free_name, mix64, odd_powers, parts_of, runs_of_parts, slices, text_key, tidy

#: Words of a gram. Longer ones are rarer, shorter ones make fewer and longer spans.
GRAM = 14
#: Spans of a gram that one group holds.
HOT = 4096
#: Words that a task orders at once.
BATCH_WORDS = 250_000
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = odd_powers(11, 256)
_BASE = int(odd_powers(12, 1)[0]) | 5
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            np.multiply.accumulate(np.full(size - 1, base, np.uint64), out=out[1:])
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """The words of several texts: places in one buffer, a 64-bit hash each, and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        flat = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[flat], [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(flat))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[flat] * up)])
        self.hash = mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.start, place)
        self.joined = joined

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; the last n - 1 have none."""
        if len(self.hash) < n:
            return np.empty(0, np.uint64)
        times = odd_powers(100 + n, n)
        total = np.zeros(len(self.hash) - n + 1, np.uint64)
        for j in range(n):
            total += self.hash[j : len(self.hash) - n + 1 + j] * times[j]
        return mix64(total)


def span_table(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, first word, last word + 1) of every span, words counted over all texts."""
    none = np.empty(0, np.int64)
    grams, width = words.grams(GRAM), window - GRAM + 1
    if len(words.hash) < window:
        return none, none.astype(np.uint64), none, none
    least, where = grams, np.arange(len(grams))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        right = least[step:] < least[: len(least) - step]
        where = np.where(right, where[step:], where[: len(where) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        reach += step
    size = np.diff(words.first)
    text = np.repeat(np.arange(len(size)), size)
    whole = np.flatnonzero(np.arange(len(where)) + window <= words.first[1:][text[: len(where)]])
    if not len(whole):
        return none, none.astype(np.uint64), none, none
    anchor, home = where[whole], text[whole]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (home[1:] != home[:-1])]))
    last = np.append(new[1:], len(whole)) - 1
    return home[new], grams[anchor[new]], whole[new], whole[last] + window


def shared_grams(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(tk, gram, hot) of every gram that lies in another text too or twice in this one."""
    partitions, parts = parts_of(docs)
    kind = np.dtype([("gram", "<u8"), ("tk", "V16"), ("alone", "u1")])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, names, seen = [], [], [], set()
        for part, texts in slices(batches, most=SLICE):
            tks = part.column(0).to_pylist()
            new = [i for i, tk in enumerate(tks) if tk not in seen and not seen.add(tk)]
            home, gram, _, _ = span_table(Words([texts[i] for i in new]), window)
            keys.append(gram)
            owners.append(home + len(names))
            names += [tks[i] for i in new]
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        size = np.bincount(run) if len(key) else np.zeros(0, int)
        tk = np.array(names, dtype="S16").view("V16") if names else np.empty(0, "V16")
        record = np.zeros(int(first.sum()), kind)
        record["gram"], record["tk"], record["alone"] = key[first], tk[owner[first]], size == 1
        for part, blob in by_part(record, record["gram"], parts):
            yield pa.RecordBatch.from_pydict({"part": part, "blob": blob, "found": pa.array([b""] * len(part), pa.binary())})
        twice = np.repeat(size > 1, size)
        here = np.zeros(int(twice.sum()), [("gram", "<u8"), ("tk", "V16")])
        here["gram"], here["tk"] = key[twice], tk[owner[twice]]
        for i in range(0, len(here), 1 << 16):
            yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "blob": pa.array([b""], pa.binary()),
                                              "found": pa.array([np.unique(here[i : i + (1 << 16)].view("V24")).tobytes()], pa.binary())})

    def meet(record: np.ndarray) -> Iterator[pa.RecordBatch]:
        record = record[np.argsort(record["gram"], kind="stable")]
        gram, tk = record["gram"], np.ascontiguousarray(record["tk"]).view("<u8").reshape(-1, 2)
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        run = np.cumsum(first) - 1
        # Records of one text from several tasks do not make a gram shared; equal texts are one.
        other = (tk != tk[np.flatnonzero(first)[run]]).any(1)
        shared = np.bincount(run, weights=other)[run] > 0
        told = record[shared & (record["alone"] == 1)]
        out = np.zeros(len(told), [("gram", "<u8"), ("tk", "V16")])
        out["gram"], out["tk"] = told["gram"], told["tk"]
        yield from _pairs(np.unique(out.view("V24")).view(out.dtype))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, record in runs_of_parts(batches, kind):
            yield from meet(record)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                yield from _pairs(np.frombuffer(blob, [("gram", "<u8"), ("tk", "V16")]))

    listed = scratch.keep(docs.select(text_key(F.col("text")).alias("tk"), "text").mapInArrow(tidy(local), "part int, blob binary, found binary"), "grams")
    # Spark sorts the parts, on disk where it must; Python holds one.
    met = listed.where("part >= 0").select("part", "blob").repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(tidy(run), "tk binary, gram long")
    here = listed.where("part < 0").select("found").mapInArrow(tidy(spread), "tk binary, gram long")
    pairs = scratch.keep(met.unionByName(here), "shared")
    hot = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    return pairs.join(hot, "gram", "left").select("tk", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))


def _pairs(out: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(out), 1 << 16):
        part = out[i : i + (1 << 16)]
        tk = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(part), [None, pa.py_buffer(np.ascontiguousarray(part["tk"]).tobytes())])
        yield pa.RecordBatch.from_pydict({"tk": tk.cast(pa.binary()), "gram": pa.array(part["gram"].view("<i8") if part["gram"].flags.c_contiguous else part["gram"].astype("<i8"))})


def cut_spans(texts: DataFrame, window: int) -> DataFrame:
    """Rows (tk, text, n, grams, hots) to spans (tk, start, gram, span); of hot grams one span for each window, under a hash of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, said in slices(batches, most=SLICE):
            words = Words(said)
            home, gram, first, end = span_table(words, window)
            grams, hots = part.column(3).to_pylist(), part.column(4).to_pylist()
            kept, hot = np.zeros(len(home), bool), np.zeros(len(home), bool)
            cut = np.searchsorted(home, np.arange(len(said) + 1))
            for i in range(len(said)):
                if grams[i]:
                    known = np.array(grams[i], np.int64).view(np.uint64)
                    order = np.argsort(known, kind="stable")
                    known = known[order]
                    mine = gram[cut[i] : cut[i + 1]]
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    kept[cut[i] : cut[i + 1]] = known[at] == mine
                    hot[cut[i] : cut[i + 1]] = np.array(hots[i], bool)[order][at]
            rows = [(home[cool := kept & ~hot], gram[cool], first[cool], end[cool])]
            if (kept & hot).any():
                h, f, e = home[kept & hot], first[kept & hot], end[kept & hot]
                n = e - f - window + 1
                start = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((np.repeat(h, n), words.grams(window)[start], start, start + window))
            home, gram, first, end = (np.concatenate(x) for x in zip(*rows))
            tks, joined = part.column(0).to_pylist(), words.joined
            spans = [b" ".join(joined[a:b].split()) for a, b in zip(words.start[first].tolist(), words.end[end - 1].tolist())]
            yield pa.RecordBatch.from_pydict({
                "tk": pa.array([tks[i] for i in home.tolist()], pa.binary()), "start": pa.array(first - words.first[home], pa.int32()),
                "gram": pa.array(gram.view(np.int64)), "span": pa.array(spans, pa.binary()).cast(pa.string())})

    return texts.mapInArrow(tidy(run), "tk binary, start int, gram long, span string")


def repeated_windows(spans: list[list[bytes]], times: np.ndarray, window: int) -> np.ndarray:
    """For every window of the spans, in order, whether its words start anywhere else too.

    The suffixes at window starts in suffix order, by prefix doubling; runs of neighbours that share ``window`` words are the suffix
    tree's internal nodes of that depth, and what lies below one with two leaves is repeated.
    """
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for s in spans for w in s], np.int64)
    size = np.array([len(s) for s in spans], np.int64)
    n = size - window + 1
    begin = np.cumsum(size) - size
    start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rank, reach = flat, 1
    while reach < window:
        step = min(reach, window - reach)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        reach += step
    order = np.argsort(rank[start], kind="stable")
    deep = np.concatenate([[False], rank[start[order[1:]]] == rank[start[order[:-1]]]])
    node = np.cumsum(~deep) - 1
    leaves = np.bincount(node, weights=np.repeat(times, n)[order])
    out = np.zeros(len(start), bool)
    out[order] = leaves[node] > 1
    return out


def find_repeats(counted: DataFrame, window: int) -> DataFrame:
    """Rows (gram, span, sid, n), all of a gram in one task, to (gram, sid, ranges): repeated words of a span, as [first, end) pairs."""
    def solve(rows: list[tuple[int, bytes, bytes, int]]) -> pa.RecordBatch:
        spans = [span.split() for _, span, _, _ in rows]
        found = repeated_windows(spans, np.array([n for *_, n in rows]), window)
        sizes = np.array([len(s) - window + 1 for s in spans])
        cut = np.concatenate([[0], np.cumsum(sizes)])
        keep, ranges = [], []
        for i in range(len(rows)):
            at = np.flatnonzero(found[cut[i] : cut[i + 1]])
            if len(at):
                new = np.concatenate([[True], at[1:] > at[:-1] + window])
                keep.append(i)
                ranges.append(np.stack([at[new], at[np.append(new[1:], True)] + window], 1).ravel().tolist())
        return pa.RecordBatch.from_pydict({"gram": pa.array([rows[i][0] for i in keep], pa.int64()), "sid": pa.array([rows[i][2] for i in keep], pa.binary()),
                                           "ranges": pa.array(ranges, pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if words > BATCH_WORDS and row[0] != last:
                    yield solve(held)
                    held, words = [], 0
                held.append(row)
                words += row[1].count(b" ") + 1
                last = row[0]
        if held:
            yield solve(held)

    return counted.mapInArrow(tidy(run), "gram long, sid binary, ranges array<int>")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(tk, text, n): every text once, with its number of rows."""
    return docs.groupBy(text_key(F.col("text")).alias("tk")).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))


def remove_repeats(docs: DataFrame, window: int = 35, scratch: Scratch | None = None) -> DataFrame:
    """(tk, n_words, n_removed, kept): every distinct text without the words in repeated windows; kept words joined by one space."""
    scratch = scratch or Scratch(docs.sparkSession)
    shared = shared_grams(docs, window, scratch).groupBy("tk").agg(F.collect_list(F.struct("gram", "hot")).alias("told"))
    texts = distinct_texts(docs)
    spans = cut_spans(texts.join(shared, "tk").select("tk", "text", "n", F.col("told.gram").alias("grams"), F.col("told.hot").alias("hots")), window)
    spans = scratch.keep(spans.withColumn("sid", F.unhex(F.md5("span"))), "spans")
    counted = (spans.groupBy("gram", "sid").agg(F.min("span").alias("span"), F.count(F.lit(1)).alias("n"))
               .repartition("gram").sortWithinPartitions("gram").select("gram", "span", "sid", "n"))
    repeats = find_repeats(counted, window)
    told = (spans.select("gram", "sid", "tk", "start").join(repeats, ["gram", "sid"])
            .groupBy("tk").agg(F.flatten(F.collect_list(F.transform("ranges", lambda x: x + F.col("start")))).alias("ranges")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, said in slices(batches):
            times, ranges = part.column(2).to_pylist(), part.column(3).to_pylist()
            total, removed, kept = [], [], []
            for text, n, found in zip(said, times, ranges):
                words = text.split()
                total.append(len(words))
                if n > 1 and len(words) >= window:
                    words = []
                elif found:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, found[::2], 1)
                    np.add.at(gone, found[1::2], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict({"tk": part.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                                              "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return texts.join(told, "tk", "left").select("tk", "text", "n", "ranges").mapInArrow(tidy(cut), "tk binary, n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with the words in repeated windows cut out; texts without any stay as they are."""
    key, kept = free_name(docs, "_tk"), free_name(docs, "_kept")
    with Scratch(docs.sparkSession) as scratch:
        found = remove_repeats(docs, window, scratch).where("n_removed > 0").select(F.col("tk").alias(key), F.col("kept").alias(kept))
        changed = Scratch(docs.sparkSession).keep(found, "changed")
    joined = docs.withColumn(key, text_key(F.col("text"))).join(changed, key, "left")
    text = F.coalesce(kept, "text")
    return joined.withColumns({"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})).select(docs.columns)


def report(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    with Scratch(docs.sparkSession) as scratch:
        found = remove_repeats(docs, window, scratch).select("tk", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
        rows = docs.select("doc_id", text_key(F.col("text")).alias("tk"))
        return Scratch(docs.sparkSession).keep(rows.join(found, "tk").select("doc_id", "n_words", "n_removed", "kept_sha256"), "kept")

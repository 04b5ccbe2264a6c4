"""SimHash near duplicates: fingerprints of 64 bits, linked at ``NEAR`` or fewer differing bits, by an index in Gray order.

Distinct fingerprints are numbered in the order of their rank in the Gray code, where neighbours share most bits, and cut into blocks. A block's index is a
tree over runs of ``FAN`` neighbours: an upper node holds, as mask and value, the bits that all below it share and that no
node above holds already. A search adds up differences on the way down and leaves a node, with all below it, as soon as they
exceed ``NEAR``. The blocks' roots are the leaves of one more such tree, which every task holds (at most ``MOST_BLOCKS`` roots): through it a
fingerprint is sent to the later blocks that can hold something near it, so a pair is met once. A fingerprint goes to about
(l * l + l) / 4 of 2^l blocks, so blocks are as large as a task may well hold, and what a block is asked for, by its own fingerprints and others, is dealt out in turns of
bounded size, each with a copy of the block. A turn gives the links that join its fingerprints to components, fewer than there are fingerprints in it, and never its pairs.

Memory of a task: a block (``BLOCK`` fingerprints, or all / MOST_BLOCKS if that is more, 16 bytes each and half as much for the tree)
and one turn.

Defined cases: a null text, an empty one and one without words have the fingerprint zero, which links like any other; of fewer than
three words the whole sequence is the one shingle; repeated rows count each; a row with a null id is linked but names no component unless
nothing else is in it (then null); an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch, slices, tidy
from tripchain.llm.components import components
from tripchain.llm.sharding import in_order, numbered

#: Fixed values of the fingerprint: words to a shingle and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Differing bits up to which fingerprints link.
NEAR = 2
#: Children of a node; fingerprints to a block, unless there would be more blocks than the second number.
FAN, BLOCK, MOST_BLOCKS = 8, 1 << 20, 4096
#: Least fingerprints to a turn, the share of a block that a turn has otherwise, and those that walk the tree together.
TURN, SHARE, WALK = 1 << 15, 8, 1 << 10
#: Fingerprints that are packed into one row of a block.
CHUNK = 1 << 15
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
#: Parts of a class in the join that gives rows their component.
SALTS = 8

_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes) -> np.ndarray:
    """The hash of each shingle of a text, repeats included."""
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())),
                       np.uint64, len(words) - last)


def _bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from bit 0 on."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: bytes) -> np.uint64:
    hashes = shingle_hashes(text)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        counts += _bits_set(hashes[i : i + COUNTED])
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed integer of the same bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint among all Gray codes, shifted so that it sorts as a signed integer."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """A tree over patterns (mask, value) in Gray order; the leaves are patterns themselves, whole fingerprints having a full mask."""

    def __init__(self, masks: np.ndarray, values: np.ndarray):
        full = [(masks, values & masks)]
        while len(full[-1][0]) > 1:
            mask, value = full[-1]
            starts = np.arange(0, len(mask), FAN)
            first = np.repeat(value[starts], np.diff(np.append(starts, len(mask))))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ first), starts)
            full.append((shared, value[starts] & shared))
        # From the root down; a node keeps the bits that its parent does not hold.
        self.levels = []
        for depth, (mask, value) in enumerate(reversed(full)):
            above = full[len(full) - depth][0] if depth else np.zeros(1, np.uint64)
            own = mask & ~np.repeat(above, FAN)[: len(mask)] if depth else mask
            self.levels.append((own, value & own))

    def near(self, queries: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of all leaves within reach that stand behind the place ``after`` of the query."""
        at = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        gone = np.zeros(len(queries), np.int64)
        width = FAN ** (len(self.levels) - 1)
        for depth, (mask, value) in enumerate(self.levels):
            if depth:
                at, gone = np.repeat(at, FAN), np.repeat(gone, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = np.flatnonzero((node < len(mask)) & ((node + 1) * width - 1 > after[at]))
            at, node, gone = at[there], node[there], gone[there]
            gone = gone + np.bitwise_count((queries[at] ^ value[node]) & mask[node])
            held = np.flatnonzero(gone <= NEAR)
            at, node, gone = at[held], node[held], gone[held]
            width //= FAN
        return at, node


def joined_up(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``top`` (of each node the smallest known of its component) after the links (a, b)."""
    while True:
        high, low = np.maximum(top[a], top[b]), np.minimum(top[a], top[b])
        apart = high != low
        if not apart.any():
            return top
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        np.minimum.at(top, high, low)
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up


def links_in(block: np.ndarray, asked: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up ``asked`` and what is near to them in the block: fewer than there are fingerprints. ``places`` are those of
    the block's own, which look behind themselves only, and -1 for others."""
    tree = GrayTree(np.full(len(block), ~np.uint64(0)), block)
    own = np.where(places >= 0, places, len(block) + np.arange(len(asked)))
    top = np.arange(len(block) + len(asked))
    for i in range(0, len(asked), WALK):
        at, leaf = tree.near(asked[i : i + WALK], places[i : i + WALK])
        top = joined_up(top, own[i + at], leaf)
    names = np.concatenate([block, asked])
    moved = np.flatnonzero(top != np.arange(len(top)))
    return names[moved], names[top[moved]]


def _visits(rows: DataFrame, roots: GrayTree) -> DataFrame:
    """(block, fp): each fingerprint at the later blocks that may hold something near it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, own = (batch.column(i).to_numpy() for i in range(2))
            for i in range(0, len(fps), WALK):
                at, found = roots.near(fps[i : i + WALK].view(np.uint64), own[i : i + WALK])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[i : i + WALK][at])], ["block", "fp"])

    return rows.select("fp", "block").mapInArrow(tidy(run), "block long, fp long")


def _packed(placed: DataFrame) -> DataFrame:
    """(block, chunk, fps): runs of a block's fingerprints in their order, a row each."""
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "chunk": [key[1]], "fps": [part.sort_values("place")["fp"].to_numpy(np.int64).tobytes()]})

    return placed.groupBy("block", F.expr(f"place div {CHUNK}").alias("chunk")).applyInPandas(run, "block long, chunk long, fps binary")


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fp``) that join up all near ones."""
    spark = distinct.sparkSession
    n = distinct.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    size = max(BLOCK, -(-n // MOST_BLOCKS))
    ranked = in_order(distinct.select("fp", F.lit(0).alias("all")), scratch, "simhash-order", gray_rank(F.col("fp")))
    placed = scratch.keep(numbered(ranked, "all").select(
        "fp", F.expr(f"number div {size}").alias("block"), (F.col("number") % size).alias("place")), "simhash-places")
    asked = placed
    if n > size:
        found = placed.groupBy("block").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("block").toPandas()  # a row for each block
        every, some = (found[c].to_numpy(np.int64).view(np.uint64) for c in ("all", "any"))
        visits = _visits(placed, GrayTree(~(every ^ some), every)).withColumn("place", F.lit(-1).cast("long"))
        asked = scratch.keep(placed.unionByName(visits), "simhash-asked")
    turn = max(TURN, min(size, n) // SHARE)
    turns = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / turn).alias("turns"))
    turns = F.broadcast(spark.createDataFrame(turns.collect(), turns.schema))  # a row for each block
    dealt = asked.join(turns, "block").select("block", F.pmod(F.xxhash64("fp"), "turns").alias("turn"), "fp", "place")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")
    copies = _packed(placed).join(turns, "block").select("block", each, "chunk", "fps")

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        held = np.frombuffer(b"".join(block.sort_values("chunk")["fps"]), np.uint64)
        a, b = links_in(held, queries["fp"].to_numpy(np.int64).view(np.uint64), queries["place"].to_numpy(np.int64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    keys = ["block", "turn"]
    return copies.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, "a long, b long")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that a document reaches by links, its own included."""
    spark = docs.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    rows = scratch.keep(fingerprints(docs, doc_id, text), "simhash-rows")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = scratch.keep(components(links(distinct, scratch), scratch).withColumnRenamed("node", "fp"), "simhash-labels")
    named = distinct.join(labels, "fp", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"))
    # Fingerprints of one row that link with nothing need no name.
    classes = named.where("n > 1 OR label IS NOT NULL").join(least, "label", "left").select(
        "fp", F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # One fingerprint may have a third of all rows.
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(
        salted.withColumn("known", F.lit(True)), ["fp", "salt"], "left")
    result = kept.keep(found.select(
        "doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "simhash")
    scratch.drop()
    return result


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 hex digits."""
    return join_documents(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

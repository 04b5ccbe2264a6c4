"""Centroid clustering (Lloyd's rounds on integer vectors) with heap-ordered bounds.

A vector that was scanned last when its nearest centroid was u away and the next one l keeps that centroid while l - u is more than what
the centroids have moved since: its own towards the outside, the fastest other one towards the inside. Each cluster keeps a heap of these gaps,
offset by the drift that the cluster had accumulated when the vector was scanned, so a round adds one number per cluster and looks at the
top of each heap: only vectors whose gap has expired are popped, scanned exactly against all centroids, and pushed onto their cluster's heap.

Vectors stand in blocks of ``BLOCK_ROWS``, a row of the vectors' table each, written once. The state of a block is one row of a small table
in buckets of the same key, written anew each round: its heaps, and sums and counts of its clusters, which change with the vectors
that moved. A block is read without an exchange, and what the driver gets is one sum per cluster and component.

Everything is exact: components are integers, distances are squared in 64 bits, and a gap counts as expired ``SLACK`` before it is, more than
all rounding of its square roots.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; components are held to
±2^21 (±2^27 as integers), so that distances fit, and inertias to 2^63 - 1; rows with one id stand each for itself, rows with a null id too, as last seeds; seeds of one id go by
their components; fewer vectors than centroids make fewer centroids; of equal seeds the later ones stay empty; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch

#: Fixed values of the query's contract.
CLUSTERS, ROUNDS, LENGTH, SCALE = 16, 3, 64, 64
BLOCK_ROWS = 4096
#: Rows that are compared with all centroids at once.
SCANNED = 512
SLACK = 1e-4
#: Bound of the integer components.
MOST = 1 << 27


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gap = vectors[:, None, :] - centroids[None]
    return (gap * gap).sum(2)


class Block:
    """The state of one block: a heap of (gap + drift when scanned, row) for each cluster, and the clusters' sums and counts."""

    def __init__(self, vectors: np.ndarray, k: int, state: dict[str, bytes] | None = None):
        self.vectors, self.k = vectors, k
        if state is None:
            # Nothing is known yet: every gap of the first cluster has expired.
            self.heaps = [[(-np.inf, i) for i in range(len(vectors))], *([] for _ in range(k - 1))]
            self.sums, self.counts = np.zeros((k, vectors.shape[1]), np.int64), np.zeros(k, np.int64)
            self.fresh = True
        else:
            keys, rows, ends = (np.frombuffer(state[c], t) for c, t in (("gaps", np.float64), ("rows", np.int32), ("ends", np.int64)))
            starts = np.concatenate([[0], ends[:-1]])
            self.heaps = [list(zip(keys[a:b].tolist(), rows[a:b].tolist())) for a, b in zip(starts, ends)]
            self.sums = np.frombuffer(state["sums"], np.int64).reshape(k, -1).copy()
            self.counts = np.frombuffer(state["counts"], np.int64).copy()
            self.fresh = False

    def rescan(self, centroids: np.ndarray, drift: np.ndarray) -> int:
        """Pop all expired gaps, scan their vectors, push them again; how many there were."""
        popped, came_from = [], []
        for cluster, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[cluster] + SLACK:
                popped.append(heapq.heappop(heap)[1])
                came_from.append(cluster)
        for i in range(0, len(popped), SCANNED):
            rows = np.array(popped[i : i + SCANNED])
            vectors = self.vectors[rows].astype(np.int64)
            far = squared(vectors, centroids)
            nearest = far.argmin(1)
            two = np.sqrt(np.sort(far, axis=1)[:, :2].astype(np.float64))
            gaps = two[:, 1] - two[:, 0] if self.k > 1 else np.full(len(rows), np.inf)
            for row, cluster, gap in zip(rows.tolist(), nearest.tolist(), (gaps + drift[nearest]).tolist()):
                heapq.heappush(self.heaps[cluster], (gap, row))
            if not self.fresh:
                before = np.array(came_from[i : i + SCANNED])
                moved = np.flatnonzero(before != nearest)
                np.subtract.at(self.sums, before[moved], vectors[moved])
                np.subtract.at(self.counts, before[moved], 1)
                vectors, nearest = vectors[moved], nearest[moved]
            np.add.at(self.sums, nearest, vectors)
            np.add.at(self.counts, nearest, 1)
        return len(popped)

    def assigned(self) -> np.ndarray:
        out = np.empty(len(self.vectors), np.int64)
        for cluster, heap in enumerate(self.heaps):
            out[[row for _, row in heap]] = cluster
        return out

    def state(self) -> dict[str, bytes]:
        entries = [e for heap in self.heaps for e in heap]
        return {"gaps": np.array([g for g, _ in entries], np.float64).tobytes(), "rows": np.array([r for _, r in entries], np.int32).tobytes(),
                "ends": np.cumsum([len(h) for h in self.heaps]).astype(np.int64).tobytes(),
                "sums": self.sums.tobytes(), "counts": self.counts.tobytes()}


_STATE = ("gaps", "rows", "ends", "sums", "counts")


def _blocks_of(batch: pa.RecordBatch, k: int, length: int) -> Iterator[tuple[int, Block]]:
    columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        vectors = np.frombuffer(columns["vectors"][i].as_buffer(), np.int32).reshape(-1, length)
        state = {c: columns[c][i].as_buffer() for c in _STATE} if _STATE[0] in columns else None
        yield columns["block"][i].as_py(), Block(vectors, k, state)


def _round(blocks: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks' states after one assignment; ``popped`` counts the vectors that were scanned."""
    k, length = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block in _blocks_of(batch, k, length):
                popped = block.rescan(centroids, drift)
                state = block.state()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([popped], pa.int64()), *(pa.array([state[c]], pa.binary()) for c in _STATE)],
                    ["block", "popped", *_STATE])

    return blocks.mapInArrow(run, "block long, popped long, " + ", ".join(f"{c} binary" for c in _STATE))


def _totals(state: DataFrame, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the clusters over all blocks: a row for each partition, then one for each sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (length + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.concatenate([np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in range(2)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    found = state.select("sums", "counts").mapInArrow(run, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at")
    values = found.toPandas()["value"].to_numpy(np.int64)
    return values[: k * length].reshape(k, length), values[k * length :]


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, length: int, scale: int) -> DataFrame:
    """(vec_id, x): the usable vectors with integer components."""
    x = F.col(embedding)
    usable = x.isNotNull() & (F.size(x) == length) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    integer = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), integer.alias("x"))


def _in_blocks(rows: DataFrame, length: int) -> DataFrame:
    """(block, ids, known, vectors): the vectors of each part of a table in packed blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(ids: list[pa.Array], xs: list[np.ndarray]) -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            # The place of a block's first row names it: partitions count from their own multiple of 2^33.
            return pa.RecordBatch.from_arrays([
                pa.array([first], pa.int64()), pa.array([own.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                pa.array([np.asarray(own.is_valid()).astype(np.uint8).tobytes()], pa.binary()), pa.array([np.concatenate(xs).tobytes()], pa.binary())],
                ["block", "ids", "known", "vectors"])
        ids, xs, held, first = [], [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - held)
                if not held:
                    first = part.column(2)[0].as_py()
                ids.append(part.column(0))
                xs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, length))
                held, at = held + part.num_rows, at + part.num_rows
                if held == BLOCK_ROWS:
                    yield packed(ids, xs)
                    ids, xs, held = [], [], 0
        if held:
            yield packed(ids, xs)

    return rows.select("vec_id", "x", F.monotonically_increasing_id().alias("first")).mapInArrow(
        pack, "block long, ids binary, known binary, vectors binary")


def _result(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, length = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, known = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "known"))
            for i, (_, block) in enumerate(_blocks_of(batch, k, length)):
                cluster = block.assigned()
                gap = block.vectors.astype(np.int64) - centroids[cluster]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(ids[i].as_buffer(), np.int64), mask=np.frombuffer(known[i].as_buffer(), np.uint8) == 0),
                    pa.array(cluster.astype(np.int32)), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE,
            vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance), the final centroids, and how many vectors each assignment scanned."""
    spark = vectors.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    rows = scratch.keep(whole_vectors(vectors, vec_id, embedding, length, scale), "cluster-rows")
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(seed.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, length)
    if not len(centroids):
        scratch.drop()
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, []
    # Dealt as the buckets are, so that each is one file.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.keep_by(_in_blocks(rows, length).repartition(buckets, "block"), "cluster-blocks", "block")
    drift, scanned, state = np.zeros(len(centroids)), [], None
    for turn in range(rounds + 1):
        known = blocks.select("block", "vectors") if state is None else blocks.select("block", "vectors").join(state.drop("popped"), "block")
        state = scratch.keep_by(_round(known, centroids, drift), "cluster-state", "block")
        scanned.append(state.agg(F.sum("popped")).first()[0])
        if turn == rounds:
            break
        sums, counts = _totals(state, *centroids.shape)
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        by = np.sqrt(((moved - centroids) ** 2).sum(1).astype(np.float64))
        fastest = np.array([np.delete(by, c).max(initial=0) for c in range(len(by))])
        centroids, drift = moved, drift + by + fastest
    result = kept.keep(_result(blocks.join(state.drop("popped"), "block"), centroids), "clusters")
    scratch.drop()
    return result, centroids, scanned


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    found, centroids, _ = cluster(vectors)
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(exact).collect()}  # a row for each cluster
    most = (1 << 63) - 1
    told = found.sparkSession.createDataFrame(
        [(c, min(sums[c], most), min(sum(sums.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(sums)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

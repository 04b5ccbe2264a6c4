"""Approximate nearest neighbours by balanced posting lists (Euclidean distance, double precision).

Centroids are fitted by balanced halving on a bounded sample (``SAMPLE`` rows). Their number grows with the rows, at first one for ``LIST_ROWS`` rows,
then with the root of the rows, up to ``MAX_LISTS``, so that what every task holds has a bound. Every vector is indexed: it goes to its nearest list
and, near a border, to up to ``REPLICAS`` lists in all. At every size a query walks a graph over the centroids, held in memory, best first with a beam,
and opens those of the nearest lists whose centroid is within a ratio of the nearest one's distance (or of a list's own width, if that is more).
Both bounds are measured on every input: ``TRIED`` query vectors are compared with all rows and dealt to up to ``GROUPS`` groups by their distance to the
nearest centroid, so that queries of thin regions, whose neighbours are spread over many lists, are no small part of a good mean. In each group the lists are
doubled from ``PROBES`` on until ``RECALL`` of what it should find lies in opened lists, and then the smallest ratio is taken that keeps this share. Lists are
read in blocks of bounded size, so a heavy list is many tasks. Distances are computed on the original vectors.

Of vectors that are equal in all components only the k+1 smallest ids can ever be in an answer, as ties go to the smaller id; only those
are listed. Equal query vectors are searched once. A query whose lists hold too few vectors is searched in all lists.

Defined cases: vectors that are null, zero or hold null or non-finite components, rows with a null id, and vectors of another length than the
most frequent one (of several, the longest) take no part; of rows with one id the smallest vector stands for it; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripchain.llm.common import Scratch

#: Bounds of the fitted part: they hold at every size of the input.
MAX_LISTS, SAMPLE = 65_536, 262_144
#: Sampled rows for a list, rows for a list, and lists for the root of the rows.
SAMPLE_PER_LIST, LIST_ROWS, ROOT_LISTS = 16, 64, 4
REPLICAS, REPLICA_RATIO = 6, 1.25
#: Lists that a query opens at first, and the steps by which the distance ratio goes up from 1 (each twice the one before).
PROBES, RATIO_STEP, RATIO_STEPS = 64, 0.0625, 40
#: Query vectors whose answers are counted, and the share of their neighbours to be found: over the wanted 0.9 by more than the count's error.
TRIED, RECALL = 1024, 0.98
#: Groups of queries with bounds of their own, and tried queries that a group has at least.
GROUPS, GROUP_TRIED = 8, 64
BLOCK_ROWS = 8192
#: Links of a centroid to near ones and to far ones, and centroids of the beam that a step of the walk follows.
DEGREE, FAR, FOLLOWED = 16, 4, 8
#: Distances held at once by one piece of work.
CELLS = 1 << 22


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def pieces(rows: int, width: int) -> range:
    """Starts of runs of rows for which ``width`` numbers each may be held."""
    return range(0, rows, run_of(width))


def run_of(width: int) -> int:
    return max(1, min(1024, CELLS // width))


def lists_for(rows: int) -> int:
    return max(1, min(MAX_LISTS, -(-rows // LIST_ROWS), int(ROOT_LISTS * rows**0.5) + 1))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Split into halves of equal size, largest part first, then move each centroid to the mean of what is nearest to it."""
    rng = np.random.default_rng(seed)
    parts = deque([np.unique(sample, axis=0)])
    while len(parts) < lists:
        # Halves go to the end, so the first part is a largest one (but for one row).
        part = parts.popleft()
        if len(part) < 2:
            parts.appendleft(part)
            break
        centre = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(rounds):
            lean = squares(part, centre) @ np.array([1.0, -1.0])
            order = np.argsort(lean, kind="stable")
            halves = part[order[: len(part) // 2]], part[order[len(part) // 2 :]]
            centre = np.array([h.mean(0) for h in halves])
        parts.extend(sorted(halves, key=len, reverse=True))
    centroids = np.array([p.mean(0) for p in parts])
    for _ in range(2):
        run = run_of(len(centroids))
        nearest = np.concatenate([squares(sample[i : i + run], centroids).argmin(1) for i in pieces(len(sample), len(centroids))])
        size = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, sample)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


class CentroidGraph:
    """Each centroid's nearest others and a few far ones; searched for many queries at once, best first."""

    def __init__(self, centroids: np.ndarray, seed: int = 7):
        self.centroids = centroids
        n = len(centroids)
        near = min(DEGREE, n - 1)
        rng = np.random.default_rng(seed)
        self.links = np.empty((n, near + FAR), np.int32)
        run = run_of(n)
        for i in pieces(n, n):
            d = squares(centroids[i : i + run], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            self.links[i : i + run, :near] = np.argpartition(d, near - 1, axis=1)[:, :near] if near else 0
        self.links[:, near:] = rng.integers(0, n, (n, FAR))
        # One far link follows a ring through all centroids, so that each can be reached from each.
        ring = rng.permutation(n)
        self.links[ring, near] = np.roll(ring, -1)
        self.entries = rng.choice(n, min(n, FOLLOWED), replace=False)

    def nearest(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances), nearest first, up to ``wanted`` of them each (missing: -1 and infinity)."""
        run = run_of(len(self.centroids))
        found = [self._walk(queries[i : i + run], wanted) for i in pieces(len(queries), len(self.centroids))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """A beam half as wide again as what is wanted; each step follows the links of its best centroids not followed yet."""
        n, q = len(self.centroids), len(queries)
        width = min(n, wanted + max(wanted // 2, 2 * FOLLOWED))
        seen = np.zeros((q, n), bool)
        seen[:, self.entries] = True
        first = np.empty((q, n), np.int16)
        beam, far = np.full((q, width), -1, np.int32), np.full((q, width), np.inf)
        beam[:, : len(self.entries)] = self.entries
        far[:, : len(self.entries)] = squares(queries, self.centroids[self.entries])
        waiting = far.copy()
        live = np.arange(q)
        while len(live):
            ahead = min(FOLLOWED, width)
            best = np.argpartition(waiting[live], ahead - 1, axis=1)[:, :ahead]
            open_ = np.isfinite(waiting[live[:, None], best])
            live, best, open_ = live[open_.any(1)], best[open_.any(1)], open_[open_.any(1)]
            if not len(live):
                break
            row = live[:, None]
            node = np.where(open_, beam[row, best], self.entries[0])
            waiting[row, best] = np.inf
            next_ = self.links[node].reshape(len(live), -1)
            # Of equal links of one step the one that was written last is taken.
            at = np.arange(next_.shape[1], dtype=np.int16)
            first[row, next_] = at
            new = ~seen[row, next_] & (first[row, next_] == at)
            seen[row, next_] = True
            which, column = np.nonzero(new)
            gap = queries[live[which]] - self.centroids[next_[which, column]]
            d = np.full(next_.shape, np.inf)
            d[which, column] = np.einsum("ij,ij->i", gap, gap)
            both = np.hstack([far[live], d])
            keep = np.argpartition(both, width - 1, axis=1)[:, :width]
            far[live] = np.take_along_axis(both, keep, 1)
            beam[live] = np.take_along_axis(np.hstack([beam[live], np.where(new, next_, -1)]), keep, 1)
            waiting[live] = np.take_along_axis(np.hstack([waiting[live], d]), keep, 1)
        order = np.argsort(far, axis=1, kind="stable")[:, :wanted]
        return np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)


class Index:
    """The fitted part that every task gets: centroids and their graph, bounded by MAX_LISTS, and how far a query goes."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.graph = centroids, CentroidGraph(centroids)
        self.opened, self.ratio = min(PROBES, len(centroids)), 1.0
        #: Bounds of the groups of queries once they are measured; ``opened`` and ``ratio`` are then the largest of them.
        self.edges, self.bounds = np.empty(0), None
        # A list's width: the usual distance from its centroid to the next one. A query may sit on a centroid.
        self.width = float(np.sqrt(np.median(self.graph.nearest(centroids, 2)[1][:, 1]))) if len(centroids) > 1 else 0.0

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, list) pairs: the nearest list, and further ones near a border that no nearer chosen list covers."""
        run = run_of(len(self.centroids))
        found = [self._lists_of(vectors[i : i + run], i) for i in pieces(len(vectors), len(self.centroids))]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _lists_of(self, vectors: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        d = squares(vectors, self.centroids)
        m = min(REPLICAS, d.shape[1])
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        far = np.sqrt(np.take_along_axis(d, near, 1))
        order = np.argsort(far, axis=1, kind="stable")
        near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
        taken = far <= REPLICA_RATIO * far[:, :1]
        for j in range(1, m):
            for i in range(j):
                between = ((self.centroids[near[:, j]] - self.centroids[near[:, i]]) ** 2).sum(1)
                taken[:, j] &= ~(taken[:, i] & (np.sqrt(between) < 0.5 * far[:, j]))
        row, at = np.nonzero(taken)
        return row + start, near[row, at]

    def walked(self, vectors: np.ndarray, opened: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distance ratios) of the nearest lists that the graph leads to; a missing one has an infinite ratio."""
        near, far = self.graph.nearest(vectors, opened)
        far = np.sqrt(far)
        least = np.maximum(np.maximum(far[:, :1], self.width), 1e-12)
        return near, np.where(near >= 0, far / least, np.inf)

    def gap(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distance to the nearest centroid, as a short walk gives it."""
        return self.graph.nearest(vectors, min(PROBES, len(self.centroids)))[1][:, 0]

    def groups_of(self, vectors: np.ndarray) -> list[tuple[np.ndarray, int, float]]:
        """(vectors, lists, ratio): how far the queries of each group go; before anything is measured, all are one group."""
        if self.bounds is None:
            return [(np.arange(len(vectors)), self.opened, self.ratio)]
        group = np.searchsorted(self.edges, self.gap(vectors))
        return [(np.flatnonzero(group == g), *self.bounds[g]) for g in np.unique(group)]

    def probes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, lists = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for own, opened, most in self.groups_of(vectors):
            near, ratio = self.walked(vectors[own], opened)
            row, at = np.nonzero(ratio <= most)
            rows.append(own[row])
            lists.append(near[row, at])
        return np.concatenate(rows), np.concatenate(lists)

    def needed(self, queries: np.ndarray, row: np.ndarray, neighbours: np.ndarray, opened: int) -> np.ndarray:
        """The smallest ratio with which each of ``neighbours``, one of query ``row``, lies in an opened list (infinite: in none that the walk gives)."""
        near, ratio = self.walked(queries, opened)
        reach = np.full((len(queries), len(self.centroids)), np.inf)
        query, place = np.nonzero(near >= 0)
        reach[query, near[query, place]] = ratio[query, place]
        least = np.full(len(neighbours), np.inf)
        if len(neighbours):
            at, lists = self.lists_of(neighbours)
            np.minimum.at(least, at, reach[row[at], lists])
        return least

    def recall(self, queries: np.ndarray, row: np.ndarray, neighbours: np.ndarray) -> float:
        """The share of ``neighbours`` that lie in a list which their query opens."""
        found = 0
        for own, opened, most in self.groups_of(queries):
            of = np.isin(row, own)
            found += (self.needed(queries[own], np.searchsorted(own, row[of]), neighbours[of], opened) <= most).sum()
        return float(found / len(row)) if len(row) else 1.0

    def widen(self, queries: np.ndarray, row: np.ndarray, neighbours: np.ndarray) -> None:
        """In each group of queries open twice as many lists until enough of the known neighbours lie in them, then take the smallest ratio that keeps enough."""
        gap, start = self.gap(queries), self.opened
        parts = max(1, min(GROUPS, len(queries) // GROUP_TRIED))
        self.edges, self.bounds = np.quantile(gap, np.arange(1, parts) / parts), []
        group = np.searchsorted(self.edges, gap)
        for g in range(parts):
            own = np.flatnonzero(group == g)
            of = np.isin(row, own)
            known = queries[own], np.searchsorted(own, row[of]), neighbours[of]
            opened = start
            while True:
                least = self.needed(*known, opened)
                if opened >= len(self.centroids) or np.isfinite(least).sum() >= RECALL * len(least):
                    break
                opened = min(2 * opened, len(self.centroids))
            for step in range(RATIO_STEPS):
                ratio = 1 + RATIO_STEP * 2**step
                if len(least) and (least <= ratio).sum() >= RECALL * len(least):
                    break
            self.bounds.append((opened, ratio))
        self.opened, self.ratio = (max(b) for b in zip(*self.bounds))


def _spread(index: Index, rows: DataFrame, which: str) -> DataFrame:
    """(list, vec_id, embedding): a row for each list that a vector is in, or that a query opens."""
    sent = rows.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_LISTS

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                row, found = getattr(sent.value, which)(np.array(part["embedding"].tolist(), np.float64))
                yield part.iloc[row].assign(list=found.astype(np.int32))
    return rows.mapInPandas(run, f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, list int").select("list", "vec_id", "embedding")


def nearest_in(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of each query's k nearest, ties to the smaller id; distances from component differences."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    out = []
    for i in range(0, len(queries), 256):
        block = queries[i : i + 256]
        rough = squares(block, vectors)
        m = min(k, len(ids))
        bound = np.partition(rough, m - 1, axis=1)[:, m - 1]
        slack = 1e-9 * ((block * block).sum(1) + (vectors * vectors).sum(1).max())
        q, c = np.nonzero(rough <= (bound + slack)[:, None])
        gap = block[q] - vectors[c]
        exact = np.sqrt((gap * gap).sum(1))
        by = np.lexsort((ids[c], exact, q))
        q, c, exact = q[by], c[by], exact[by]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        out.append((q[kept] + i, ids[c[kept]], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _search(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): each (list, block) gives its k nearest for the queries that open the list."""
    spark = queries.sparkSession
    sizes = postings.groupBy("list").count().withColumnRenamed("count", "rows").join(queries.groupBy("list").count().withColumnRenamed("count", "asked"), "list")
    cut = spark.createDataFrame([(r["list"], -(-r["rows"] // BLOCK_ROWS), -(-r["asked"] // BLOCK_ROWS)) for r in sizes.collect()],
                                "list int, blocks int, turns int")  # a row for each list, so bounded by MAX_LISTS

    def each(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)

    hashed = F.xxhash64("vec_id")
    lists = postings.join(F.broadcast(cut), "list").select("list", F.pmod(hashed, "blocks").cast("int").alias("block"), each("turns", "turn"), "vec_id", "embedding")
    asked = queries.join(F.broadcast(cut), "list").select("list", each("blocks", "block"), F.pmod(hashed, "turns").cast("int").alias("turn"), "vec_id", "embedding")

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row, found, score = nearest_in(np.array(q["embedding"].tolist(), np.float64), np.array(v["embedding"].tolist(), np.float64), v["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy()[row], "vec_id": found, "score": score})

    keys = ["list", "block", "turn"]
    return asked.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", place).where(F.col("rank") <= k)


def neighbours_of(tried: pd.DataFrame, rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, query, neighbour): the vectors of the k nearest of all rows for a few queries, without the query's own row."""
    queries, own = np.array(tried["embedding"].tolist(), np.float64), tried["vec_id"].to_numpy()

    def run(batches):
        ids, vectors = np.empty(0, np.int64), np.empty((0, queries.shape[1]))
        for pdf in batches:
            if pdf.empty:
                continue
            ids = np.concatenate([ids, pdf["vec_id"].to_numpy()])
            vectors = np.concatenate([vectors, np.array(pdf["embedding"].tolist(), np.float64)])
            kept = np.isin(ids, nearest_in(queries, vectors, ids, k + 1)[1])
            ids, vectors = ids[kept], vectors[kept]
        if len(ids):
            row, found, score = nearest_in(queries, vectors, ids, k + 1)
            at = np.argsort(ids)
            yield pd.DataFrame({"query_id": row, "vec_id": found, "score": score, "embedding": vectors[at[np.searchsorted(ids[at], found)]].tolist()})

    found = rows.mapInPandas(run, "query_id long, vec_id long, score double, embedding array<double>")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k + 1).select("query_id", "vec_id", "embedding").toPandas()
    row = best["query_id"].to_numpy()
    other = best["vec_id"].to_numpy() != own[row]
    return queries, row[other], np.array(best["embedding"].tolist(), np.float64).reshape(-1, queries.shape[1])[other]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    common = whole.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return whole.where(F.size("embedding") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` (of ``vec_id``) picks, its own left out."""
    spark = vectors.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    rows = scratch.keep(usable(vectors, vec_id, embedding), "ann-rows")
    n = rows.count()
    same = Window.partitionBy("embedding").orderBy("vec_id")
    if not n:
        scratch.drop()
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = lists_for(n)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, lists * SAMPLE_PER_LIST)).select("embedding").toPandas()
    index = Index(balanced_centroids(np.array(sample["embedding"].tolist(), np.float64), lists))
    listed = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    postings = scratch.keep(_spread(index, listed, "lists_of"), "ann-lists")
    twins = scratch.keep(rows.where(is_query).groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "ann-queries")
    tried = twins.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).toPandas()
    if len(tried):
        index.widen(*neighbours_of(tried, listed, k))
    found = scratch.keep(_top(_search(scratch.keep(_spread(index, twins, "probes"), "ann-probes"), postings, k + 1), k + 1), "ann-found")
    short = twins.join(found.groupBy("query_id").count(), F.col("query_id") == F.col("vec_id"), "left").where(
        F.coalesce("count", F.lit(0)) < min(k + 1, n)).select("vec_id", "embedding")
    short = scratch.keep(short, "ann-short")
    if short.count():
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).select("list", "vec_id", "embedding")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(
            _top(_search(everywhere, postings, k + 1), k + 1))
    found = found.select(F.col("query_id").alias("twin"), "vec_id", "score")
    asked = rows.where(is_query).join(twins.select(F.col("vec_id").alias("twin"), "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "twin")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    answers = asked.join(found, "twin").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", place).where(F.col("rank") <= k)
    result = kept.keep(answers.select("query_id", "rank", "vec_id", "score"), "ann-answers")
    scratch.drop()
    return result

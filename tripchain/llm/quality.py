"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of two families, hashed into columns of their own: lower-cased words and pairs of adjacent words, and word shapes (runs of letters become one
letter, marks stay), their pairs, and a word right after itself. Weights are log counts times inverse document frequency; each family has length one, so that a
text's words count as much as its marks and capitals. A truncated singular value decomposition of the labelled documents' matrix gives the
latent space. Labelled vectors are sent to every task; each document is compared with all of them by exact cosine products in blocks,
and its nearest vote for their labels, weighted by similarity.

Fitting uses a bounded sample: at most ``PER_LABEL`` labelled rows of each label, those with the smallest hash of the id. Every document is
scored on its whole text. The label table, language, source and id are never part of a score.

Defined cases: null and empty texts have no terms and get the share of label 1 in the sample; without labelled rows every score is 1; of several
labels of one id the smallest counts, and null labels do not; rows are scored one by one, so repeated rows stay; an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripchain.llm.common import mix64, slices, tidy

#: Bounds of the fitted part.
PER_LABEL, LATENT = 2048, 64
#: Columns of the word shapes and of the words.
SHAPES, WORDS = 4096, 4096
COLUMNS = SHAPES + WORDS
#: The words' share of a vector's squared length, where it has both families.
WORD_SHARE = 0.5
NEIGHBOURS, POWER = 25, 8

_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"([Aa0])\1+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _shape_counts(text: bytes) -> Counter[int]:
    shapes = _RUN.sub(rb"\1", text.translate(_SHAPE)).split()
    found: Counter[int] = Counter()
    for term, n in Counter(shapes).items():
        found[zlib.crc32(term[:64]) % SHAPES] += n
    for (a, b), n in Counter(zip(shapes, shapes[1:])).items():
        found[zlib.crc32(a[:64] + b" " + b[:64]) % SHAPES] += n
    words = text.split()
    if again := sum(map(bytes.__eq__, words, words[1:])):
        found[zlib.crc32(b"again") % SHAPES] += again
    return found


def _word_counts(text: bytes) -> np.ndarray:
    """Counts by column of the lower-cased words and their pairs."""
    hashes = np.fromiter(map(zlib.crc32, _WORD.findall(text.lower())), np.uint64)
    pairs = mix64(hashes[:-1] * np.uint64(0x1_0000_0001) + (hashes[1:] << np.uint64(17)))
    return np.bincount((np.concatenate([mix64(hashes), pairs]) % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(columns, log counts) of a text's terms: shapes from column 0 on, words from column SHAPES on."""
    shapes, words = _shape_counts(text), _word_counts(text)
    used = np.flatnonzero(words)
    columns = np.concatenate([np.fromiter(shapes.keys(), np.int64, len(shapes)), used + SHAPES])
    return columns, np.log1p(np.concatenate([np.fromiter(shapes.values(), np.float64, len(shapes)), words[used]]))


def balance(columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights with each family at its share of length one."""
    word = columns >= SHAPES
    out = np.array(weights, np.float64)
    for family, share in ((word, WORD_SHARE), (~word, 1 - WORD_SHARE)):
        out[family] *= np.sqrt(share) / max(float(np.linalg.norm(out[family])), 1e-12)
    return out


class Model:
    def __init__(self, rows: list[tuple[list[int], list[float], int]], seed: int = 7):
        self.share = float(np.mean([y for *_, y in rows])) if rows else 1.0
        seen = np.zeros(COLUMNS)
        for columns, *_ in rows:
            seen[columns] += 1
        self.weight = np.log((1 + len(rows)) / (1 + seen)) + 1
        # Single precision: the matrix is the largest thing that the driver holds.
        matrix = np.zeros((len(rows), COLUMNS), np.float32)
        for i, (columns, counts, _) in enumerate(rows):
            matrix[i, columns] = self._vector(np.asarray(columns, np.int64), np.asarray(counts))
        self.space = self._directions(matrix, seed)
        self.vectors = self._unit(matrix @ self.space)
        self.labels = np.array([y for *_, y in rows], np.float64)

    def _vector(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return balance(columns, counts * self.weight[columns])

    @staticmethod
    def _directions(matrix: np.ndarray, seed: int) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration."""
        if not len(matrix):
            return np.zeros((COLUMNS, 1))
        basis = np.random.default_rng(seed).standard_normal((COLUMNS, min(LATENT + 16, len(matrix)))).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        right = np.linalg.svd(matrix @ basis, full_matrices=False)[2]
        return basis @ right[:LATENT].T

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(vectors, axis=1)
        return np.where(size[:, None] > 1e-9, vectors / np.maximum(size, 1e-9)[:, None], 0.0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        latent = np.zeros((len(texts), self.space.shape[1]))
        for i, text in enumerate(texts):
            columns, counts = terms(text)
            latent[i] = self._vector(columns, counts) @ self.space[columns]
        near = self._unit(latent) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        # The k nearest; what lies as near as the k-th votes too, so that ties do not hang on an order.
        bound = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
        weight = np.where(near >= bound - 1e-12, np.maximum(near, 0) ** POWER, 0.0)
        total = weight.sum(1)
        return np.clip(np.where(total > 1e-12, weight @ self.labels / np.maximum(total, 1e-12), self.share), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of the rows that are not held out."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
             .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).cast("int").alias("y")))
    # The smallest hashes of each label: every task keeps that many at most.
    chosen = known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(PER_LABEL).unionByName(
        known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(PER_LABEL))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [terms(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c for c, _ in found], pa.list_(pa.int64())),
                                              pa.array([n for _, n in found], pa.list_(pa.float64()))], names=["id", "y", "columns", "counts"])

    # Broadcast: at most two times PER_LABEL ids.
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "y", "text")
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(tidy(count), f"id {kind}, y int, columns array<long>, counts array<double>").collect()
    return Model([(r["columns"], r["counts"], r["y"]) for r in sorted(found, key=lambda r: str(r["id"]))])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_LABEL, COLUMNS and LATENT
    schema = T.StructType([*(f for f in docs.schema if f.name != name), T.StructField(name, T.DoubleType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            found = np.concatenate([sent.value.scores(texts[i : i + 256]) for i in range(0, len(texts), 256)])
            kept = {c: part.column(i) for i, c in enumerate(part.schema.names) if c != name}
            yield pa.RecordBatch.from_pydict(kept | {name: pa.array(found, pa.float64())})

    return docs.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""What the operators share: table access, scratch tables in the shared folder, Arrow slices, byte helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripchain.session import scratch_path

#: Texts of about this many bytes are worked on at once inside a task.
SLICE_BYTES = 4 << 20
#: Records that a task compares with each other come from about this many bytes of text; those that one shuffled partition holds, from this many.
PART_BYTES, PARTITION_BYTES = 16 << 20, 128 << 20
#: Parts of a shuffled partition, at least: with few, some partitions hold several and others none.
PARTS = 8

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one with more underlines before it, that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Scratch:
    """Tables written to the shared folder while an operator works; ``drop`` removes them again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table in buckets of ``key``, which joins on it read without an exchange."""
        path, kept = scratch_path(self.spark, name), f"scratch_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(kept)
        self.paths.append(path)
        self.tables.append(kept)
        return self.spark.table(kept)

    def drop(self) -> None:
        for kept in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {kept}")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths, self.tables = [], []


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into runs of rows of about ``most`` bytes of text, with the texts as bytes (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        cut, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                part = batch.slice(cut, i - cut)
                yield part, _as_bytes(part.column(batch.schema.get_field_index(column)))
                cut, held = i, 0
            held += int(size)
        part = batch.slice(cut)
        yield part, _as_bytes(part.column(batch.schema.get_field_index(column)))
        del batch, texts, part
        pa.default_memory_pool().release_unused()


def tidy(run: Run) -> Run:
    """The same work, after which the worker, which waits for another task, gives back the memory that Arrow keeps for reuse."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
    return tidied


def parts_of(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Shuffle partitions and parts for records made from the texts, by their counted bytes, so that neither grows in size with the input."""
    size = docs.agg(F.sum(F.octet_length(column)).alias("size")).first()["size"] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    return partitions, max(PARTS * partitions, -(-size // PART_BYTES))


def by_part(record: np.ndarray, key: np.ndarray, parts: int, most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Columns (part, blob) of records dealt by key: a blob holds records of one part, a pair of columns about ``most`` bytes."""
    part = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    record, part, step = record[order], part[order], max(1, most // record.itemsize)
    for i in range(0, len(record), step):
        some = part[i : i + step]
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        places = (np.append(first, len(some)) * record.itemsize).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(record[i : i + step].tobytes())])
        yield pa.array(some[first]), blobs


def runs_of_parts(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(part, records) from rows (part, blob) sorted by part; only one part is held at once. Rows of a negative part come one by one."""
    part, held = None, []
    for batch in batches:
        for here, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (here != part or here < 0):
                yield part, np.frombuffer(b"".join(held), kind)
                held = []
            part = here
            held.append(blob)
    if held:
        yield part, np.frombuffer(b"".join(held), kind)


def _as_bytes(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def arrow_type(ddl_type: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
            "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32())}[ddl_type]


#: Mixing constants of a public 64-bit finaliser (fixed values).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def odd_powers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)

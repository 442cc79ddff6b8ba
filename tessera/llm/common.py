"""What the operators share: shared scratch tables, Arrow text batches, byte hashes, components.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``; a default is
set only where that is unset (tests, a laptop).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of the numpy kernels takes at a time (a longer text goes alone).
STEP_BYTES = 1 << 21


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables; a folder of this machine only where Spark runs on it alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(scratch_dir, "own", None):
        scratch_dir.own = tempfile.mkdtemp(prefix="tessera-")
    return "file://" + scratch_dir.own


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if _PASSING:
        _PASSING[-1].append((name, path))
    return spark.read.schema(df.schema).parquet(path)


#: Lists of the tables that are written within each ``passing`` block, innermost last.
_PASSING: list[list[tuple[str, str]]] = []


@contextmanager
def passing(spark: SparkSession, *outer: str) -> Iterator[None]:
    """Tables that are ``written`` inside are deleted at the end: nothing that outlives the block may read them.

    Tables whose name is in ``outer`` stay.
    """
    _PASSING.append(mine := [])
    try:
        yield
    finally:
        _PASSING.pop()
        for name, path in mine:
            if name in outer:
                if _PASSING:
                    _PASSING[-1].append((name, path))
                continue
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def shuffles_go(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more.

    It does so when the driver collects its garbage, which between the rounds of a loop may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def plain_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in columns])


# ---------------------------------------------------------------- Arrow text batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts (n + 1 offsets). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``step`` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        cuts = np.searchsorted(off, np.arange(step, off[-1] + step, step)) if off[-1] > step else np.array([batch.num_rows])
        begin = 0
        for end in [*np.unique(np.minimum(cuts, batch.num_rows)).tolist(), batch.num_rows]:
            if end > begin:
                yield batch.slice(begin, end - begin)
                begin = end
    hand_back()


def hand_back() -> None:
    """Gives back what a worker holds beyond its task: it stays for later stages, whose workers need the memory."""
    _POW[:] = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


# ---------------------------------------------------------------- byte and word hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = n + n // 8
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[k] = np.multiply.accumulate(steps)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in a fresh array."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Prefixes:
    """Polynomial prefix sums of a byte array; hash(start, end) of any spans at once."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, size: int) -> np.ndarray:
        """The hash of the ``size`` bytes from each place that has so many."""
        found = self.sums[size:] - self.sums[:-size]
        found *= self.inverse[: len(found)]
        return mix(found)


def runs_of(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that cross no row border."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id): for every id on an edge (a long, b long), the smallest id that links reach.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Neighbours are never gathered
    in lists: a star is its centre's minimum, counted with partial minima in each task and joined back,
    so a centre with very many neighbours is split like any skewed join key. A round's edges are a
    written table; nothing but a checksum comes to the driver. Self-loops and nulls are ignored.
    """

    def star(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = written(
        edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct(), "edges"
    )
    seen = mark(now)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        # Large star: a neighbour above the centre moves to the centre's minimum.
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        large = written(both.where("v > u").join(star(both), F.col("u") == F.col("c")).selectExpr("v as u", "m as v").distinct(), "large")
        # Small star: all smaller neighbours, and the centre itself, move to the minimum.
        low = star(large)
        moved = large.join(low, F.col("u") == F.col("c")).selectExpr("v as u", "m as v").where("u <> v")
        now = written(moved.unionByName(low.selectExpr("c as u", "m as v")).distinct(), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    both = now.selectExpr("u as id", "v as component_id").unionByName(now.selectExpr("v as id", "v as component_id"))
    return both.groupBy("id").agg(F.min("component_id").alias("component_id"))


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that span the same components as the given ones."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(names))
    return names[keep], names[root[keep]]

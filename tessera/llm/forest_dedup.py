"""Embedding near-dedup: a forest of random-projection trees with spill, compared within leaves.

Equal vectors of a label are one class with a size. Each tree splits recursively: a level projects
on a random direction and splits at a threshold (the median over a bounded sample of all vectors of
its length, so the nodes of a level share their split); a vector within
``SPILL`` of the threshold goes to both sides. Trees are as deep as brings the label's leaves to
about ``LEAF_ROWS``. Within a leaf all vectors are compared exactly; a larger leaf is compared in pairs
of blocks, so none is cut. A pair is counted in the first leaf of the first tree that holds both, which
both can tell from their sides. Links are summed by vector and united into components.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of different lengths never meet. An empty table gives no rows; extra columns
are ignored; rows that share a vec_id are counted as one vector where their vectors are equal.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, local_stars, plain_rows, written
from tessera.llm.graph_index import usable, vector_type

COSINE = 0.98
TREES = 4
#: Half the width of the overlap, in standard deviations of a random unit vector's projection. At
#: cosine 0.98 a level parts a pair in about 3 of 1,000 cases, so all trees part it in far fewer.
SPILL = 0.16
LEAF_ROWS = 512
BLOCK_ROWS = 2048
#: The bound of the sample that the thresholds come from.
SAMPLE_ROWS = 4096
SEED = 5


def _directions(dim: int, levels: int) -> np.ndarray:
    found = np.random.default_rng((SEED, dim)).normal(size=(TREES, 30, dim))[:, :levels]
    return found / np.linalg.norm(found, axis=2, keepdims=True)


def _unit(vectors: list) -> np.ndarray:
    out = np.stack(vectors).astype(np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def thresholds(sample: list, dim: int) -> np.ndarray:
    """Medians of the sample's projections, tree by level."""
    return np.median(np.einsum("tld,nd->tln", _directions(dim, 30), _unit(sample)), axis=2)


def sides_of(vectors: np.ndarray, cuts: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the levels where each vector may go left, and right, by tree."""
    dim = vectors.shape[1]
    gap = np.einsum("tld,nd->ntl", _directions(dim, levels), vectors) - cuts[None, :, :levels]
    margin = SPILL / math.sqrt(dim)
    bit = (1 << np.arange(levels)).astype(np.int64)
    return ((gap <= margin) * bit).sum(2), ((gap >= -margin) * bit).sum(2)


def _leaves(left: int, right: int, levels: int) -> list[int]:
    """All leaves (bits: right) that the sides allow."""
    out = [0]
    for k in range(levels):
        bit = 1 << k
        out = [x | b for x in out for b, may in ((0, left & bit), (bit, right & bit)) if may]
    return out


def _cuts(sample: pd.DataFrame) -> pd.DataFrame:
    """The thresholds of one vector length, of its sampled rows."""
    dim = int(sample["dim"].iloc[0])
    sample = sample.sort_values(["turn", "rep"])
    return pd.DataFrame({"dim": [dim], "cuts": [thresholds(sample["vector"].to_list(), dim).tobytes()]})


def _assign():
    def run(batches):
        for batch in batches:
            out = []
            for (dim, levels), part in batch.groupby(["dim", "levels"]):
                cuts = np.frombuffer(part["cuts"].iloc[0], np.float64).reshape(TREES, -1)
                left, right = sides_of(_unit(part["vector"].to_list()), cuts, int(levels))
                for i, row in enumerate(part.itertuples()):
                    sides = np.stack([left[i], right[i]]).tobytes()
                    for t in range(TREES):
                        out += [(row.label, dim, t, leaf, int(levels), row.rep, row.size, row.vector, sides) for leaf in _leaves(int(left[i, t]), int(right[i, t]), int(levels))]
            yield pd.DataFrame(out, columns=["label", "dim", "tree", "leaf", "levels", "rep", "size", "vector", "sides"])

    return run


def _compare(cosine: float):
    """One group of rows: a leaf, or blocks i and j of a large one. Rows (rep, links) and (rep, to) of local stars."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["own", "rep"])
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        tree, leaf, levels = int(rows["tree"].iloc[0]), int(rows["leaf"].iloc[0]), int(rows["levels"].iloc[0])
        unit, rep, size, own = _unit(rows["vector"].to_list()), rows["rep"].to_numpy(), rows["size"].to_numpy(), rows["own"].to_numpy()
        sides = np.frombuffer(b"".join(rows["sides"]), np.int64).reshape(-1, 2, TREES)
        every = (1 << levels) - 1
        links = np.zeros(len(rows), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        a_rows, b_rows = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for begin in range(0, len(a_rows), 1024):
            part = a_rows[begin : begin + 1024]
            r, c = np.nonzero(unit[part] @ unit[b_rows].T >= cosine)
            a, b = part[r], b_rows[c]
            keep = a < b if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            both_left, both_right = sides[a, 0] & sides[b, 0], sides[a, 1] & sides[b, 1]
            met = (both_left | both_right) == every
            # The first common leaf goes left wherever both may.
            first = ~met[:, :tree].any(1) & ((every & ~both_left[:, tree]) == leaf)
            a, b = a[first], b[first]
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            if len(a):
                ends.append(local_stars(rep[a], rep[b]))
        told = np.flatnonzero(links)
        frames = [pd.DataFrame({"rep": rep[told], "links": links[told], "other": np.full(len(told), -1), "edge": False})]
        frames += [pd.DataFrame({"rep": x, "links": np.zeros(len(x), np.int64), "other": y, "edge": True}) for x, y in ends]
        return pd.concat(frames)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows = plain_rows(vectors, "vec_id", "embedding", "label").where("vec_id is not null")
    kind = vector_type(rows)
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select("vec_id", "label", F.col("embedding").cast(kind).alias("vector"))
    classes = written(good.distinct().groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")).withColumn("dim", F.size("vector")), "classes")
    levels = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("levels", F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.col("n") / leaf_rows)).cast("int")))).drop("n")
    turned = classes.withColumn("turn", F.xxhash64("rep"))
    first = Window.partitionBy("dim").orderBy("turn", "rep")
    # Tasks keep no more than a sample of each length before these are dealt.
    sample = turned.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SAMPLE_ROWS).select("dim", "turn", "rep", "vector")
    cuts = written(sample.groupBy("dim").applyInPandas(_cuts, "dim int, cuts binary"), "cuts")
    dealt = classes.join(levels, ["label", "dim"]).join(cuts, "dim").select("label", "dim", "levels", "rep", "size", "vector", "cuts")
    label_type = dict(rows.dtypes)["label"]
    schema = f"label {label_type}, dim int, tree int, leaf long, levels int, rep long, size long, vector {kind}, sides binary"
    placed = written(dealt.mapInPandas(_assign(), schema), "placed")
    key = ["label", "dim", "tree", "leaf"]
    blocks = written(placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("b")), "leaf-sizes")
    own = placed.join(blocks, key).withColumn("own", F.expr("pmod(xxhash64(rep), b)").cast("int")).withColumn("with", F.explode(F.expr("sequence(0, b - 1)")))
    met = own.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("b", "with")
    found = written(met.groupBy(*key, "i", "j").applyInPandas(_compare(cosine), "rep long, links long, other long, edge boolean"), "found")
    joined = written(components(found.where("edge").selectExpr("rep as a", "other as b")), "components")
    links = found.where("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.join(links, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")
    )
    told = written(told, "told")
    mine = rows.withColumn("v", F.when(usable(F.col("embedding")), F.col("embedding").cast(kind)))
    out = mine.join(told, (mine["label"] == told["l"]) & (mine["v"] == told["v"]), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id")
    )


def op5_forest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

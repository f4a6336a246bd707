"""Nearest vectors through an index of cells.

Centroids come from spherical k-means on a bounded sample (the SAMPLE rows with the least hash of their id, a documented limit
of what is learned from); every vector is in the index, in the cell of its nearest centroid. A query looks into its ``probes``
nearest cells and compares its vector with all of theirs, so distances are exact and only a neighbour in another cell can be missed.
How many cells a target recall needs is measured on the sample: where, in the order of a query's cells, its true neighbours lie.
Cells that hold many vectors are dealt into chunks, and queries of a cell into blocks; a chunk and a block meet in one task, so
no task grows with a cell. Probing all cells gives the exact result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage

#: Rows that centroids are learned from, most cells, sampled rows for each cell at least, vectors of a cell and queries of a cell that meet in one task,
#: sampled rows that the probes are measured with, and their neighbours; the recall aimed at.
SAMPLE, CELLS, PER_CELL, CHUNK, BLOCK, TRIED, NEAR, RECALL = 16_384, 1024, 16, 8192, 1024, 512, 5, 0.97


def centroids(vectors: DataFrame, cells: int | None = None, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of (vec_id, embedding), by default about the square root of the rows, as far as the sample carries; and for every neighbour of the rows tried, how many cells are nearer to the row than the neighbour's."""
    held = vectors.where(F.col("embedding").isNotNull())
    rows = held.count() if cells is None else 0
    sample = held.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample["embedding"].combine_chunks())
    if not len(x):
        return np.zeros((0, 0)), np.zeros(0, int)
    n = max(1, min(cells or round(rows**0.5), CELLS, len(x) if cells else -(-len(x) // PER_CELL)))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    found = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        of = np.argmax(x @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), found)  # an empty cell keeps its centroid
    tried = np.arange(min(TRIED, len(x)))  # the sample is in order of a hash
    like = x[tried] @ x.T
    like[tried, tried] = -np.inf
    near = np.argsort(-like, axis=1)[:, :NEAR]
    rank = np.argsort(np.argsort(-(x[tried] @ found.T), axis=1, kind="stable"), axis=1)
    return found, np.sort(rank[tried[:, None], np.argmax(x @ found.T, axis=1)[near]].reshape(-1))


def _matrix(lists: pa.Array) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _placed(rows: DataFrame, found: np.ndarray, probes: int) -> DataFrame:
    """(vec_id, embedding, cell) for the ``probes`` nearest cells of every vector."""
    most = min(probes, len(found))

    def run(batches):
        for b in batches:
            near = np.argsort(-(_matrix(b.column("embedding")) @ found.T), axis=1, kind="stable")[:, :most] if b.num_rows else np.zeros((0, most), int)
            places = pa.array(np.repeat(np.arange(b.num_rows), most))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(places), b.column("embedding").take(places), pa.array(near.reshape(-1).astype(np.int32))], ["vec_id", "embedding", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select(F.col("vec_id").cast("long"), "embedding").where(F.col("embedding").isNotNull()).mapInArrow(run, f"vec_id long, embedding {kind}, cell int")


def _nearest(key, asked: pa.Table, held: pa.Table, k: int, most: float) -> pa.Table:
    """The k nearest of the held vectors for each query of one block."""
    none = pa.table({"vec_id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
    if not asked.num_rows or not held.num_rows:
        return none
    ids, others = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy()
    order = np.argsort(others, kind="stable")  # ties go to the lesser id
    others = others[order]
    distance = np.round(1 - _matrix(asked["embedding"]) @ _matrix(held["embedding"])[order].T, 4)
    distance[ids[:, None] == others[None, :]] = np.inf
    near = np.argsort(distance, axis=1, kind="stable")[:, :k]
    rows = np.repeat(np.arange(len(ids)), near.shape[1])
    near, found = near.reshape(-1), np.take_along_axis(distance, near, axis=1).reshape(-1)
    keep = found <= most
    return pa.table({"vec_id": ids[rows[keep]], "other": others[near[keep]], "distance": found[keep]})


def _rounded(x: np.ndarray) -> np.ndarray:
    """To four places, halves of the decimal form away from zero, as Spark rounds."""
    out = np.round(x, 4)
    for i in np.flatnonzero(np.abs(np.abs(x) * 1e4 % 1 - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return out


def nearest_exact(size: int, asked: pa.Table, held: pa.Table, k: int, most: float, rows: int = 128) -> pa.Table:
    """The k nearest of the held vectors (all of ``size`` numbers) for each query. Products of matrices leave what may be among the k; sums term by term settle it."""
    q, v = (_matrix(t["embedding"]).reshape(t.num_rows, size) for t in (asked, held))
    ids, others = asked["vec_id"].to_numpy(), held["vec_id"].to_numpy()
    order = np.argsort(others, kind="stable")  # ties go to the lesser id
    others, v, found = others[order], v[order], []
    for start in range(0, len(ids) if len(others) else 0, rows):
        some = ids[start : start + rows]
        about = 1 - q[start : start + rows] @ v.T
        about[some[:, None] == others[None, :]] = np.inf
        bound = np.full(len(some), most) if len(others) <= k else np.fmin(np.partition(about, k - 1, axis=1)[:, k - 1], most)
        i, j = np.nonzero(about <= bound[:, None] + 2e-4)
        dot = np.zeros(len(i))
        for n in range(size):
            dot += q[start + i, n] * v[j, n]
        distance = _rounded(1 - dot)
        keep = distance <= most
        i, j, distance = i[keep], j[keep], distance[keep]
        place = np.lexsort((others[j], distance, i))
        i, j, distance = i[place], j[place], distance[place]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((some[i[best]], others[j[best]], distance[best]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(["vec_id", "other", "distance"], columns, strict=True)))


@dataclass
class Index:
    """Centroids, places of neighbours' cells in the sample, the vectors with their cells (vec_id, embedding, cell), and the number of vectors of each cell."""

    centroids: np.ndarray
    places: np.ndarray
    rows: DataFrame
    sizes: DataFrame

    def probes_for(self, recall: float) -> int:
        """Cells that hold such a share of the neighbours in the sample."""
        return 1 + int(self.places[min(len(self.places) - 1, int(recall * len(self.places)))]) if len(self.places) else 1

    def search(self, queries: DataFrame, k: int, most: float, probes: int | None = None) -> DataFrame:
        """(vec_id, other, distance, rank): the k nearest vectors of each query by cosine distance of unit vectors, itself excluded; null vectors are left out. Without ``probes`` as many cells as RECALL needs."""
        asked = cut_lineage(_placed(queries, self.centroids, probes or self.probes_for(RECALL)))
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        grid = F.broadcast(self.sizes.join(blocks, "cell").select("cell", "blocks", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks")))  # a row for each cell
        dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias(n[:-1])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(n[:-1])
        left = asked.join(grid, "cell").select("cell", "vec_id", "embedding", dealt("blocks"), every("chunks"))
        right = self.rows.join(grid, "cell").select("cell", "vec_id", "embedding", dealt("chunks"), every("blocks"))
        place = ["cell", "block", "chunk"]
        near = left.groupBy(place).cogroup(right.groupBy(place)).applyInArrow(lambda key, a, b: _nearest(key, a, b, k, most), "vec_id long, other long, distance double")
        order = Window.partitionBy("vec_id").orderBy("distance", "other")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_index(vectors: DataFrame, cells: int | None = None) -> Index:
    """An index over all vectors (vec_id, embedding)."""
    found, places = centroids(vectors, cells)
    rows = cut_lineage(_placed(vectors, found, 1))
    return Index(found, places, rows, cut_lineage(rows.groupBy("cell").agg(F.count("*").alias("n"))))


def nearest_by_index(queries: DataFrame, vectors: DataFrame, k: int, most: float, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """The same columns as the exact form, ``texts.nearest``."""
    return build_index(vectors, cells).search(queries, k, most, probes)

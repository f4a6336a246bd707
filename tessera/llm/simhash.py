"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds 64 majority bits over the hashes of a text's word shingles. Fingerprints within the radius are found
through masks: every bit position gets a non-zero vector of radius + 1 bits, and the mask of a non-zero vector v keeps the
positions whose vector has an odd product with v. At most ``radius`` differing positions span fewer dimensions than
radius + 1, so some v is orthogonal to them all and its mask keeps none of them: every pair within the radius collides in
some of the 2^(radius+1) - 1 tables. With radius 2 each of the seven masks keeps 36 or 37 bits.

Only distinct fingerprints meet. A bucket of up to BLOCK of them is compared in one task, which returns its local components
(a row for each member, never pairs). The members of a larger bucket are linked exactly and without comparing them to each other:
two fingerprints within ``radius`` share a fingerprint that lies within half of it (rounded up) of both, so each
member names all those midpoints in range; a midpoint ties its members if they are within the radius of each other by the triangle
inequality. Components follow from these links.

Defined cases: null texts and texts without words have fingerprint zero and are linked like others; a text with fewer words
than a shingle is one shingle; repeated shingles count each time; a tie of a bit is 0. Rows with null or repeated ids are
kept; ``component_id`` is the least id that is not null (null if the component has none). Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage, table
from tessera.llm.components import components

WORDS, RADIUS, SEED, BITS = 3, 2, 42, 64
#: Most fingerprints of a bucket that are compared in one task; words that are hashed at a time.
BLOCK, SLICE = 256, 1 << 15


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit masks such that every pair within the radius agrees on all bits of some mask."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """Majority bits over XXH64 of the shingles of the ASCII-lower-cased text; words end at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), max(1, len(words) - n + 1)
    for at in range(0, total, SLICE):
        part = words[at : at + SLICE + n - 1]
        line = b" ".join(part)
        ends = list(itertools.accumulate(len(w) + 1 for w in part))
        starts = [0, *ends[:-1]]
        hashes = [xxhash.xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, ends[n - 1 :] or ends[-1:], strict=False)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = WORDS) -> DataFrame:
    """(id_, mark) of every row: the id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = np.array([fingerprint(t.as_py(), n) for t in b.column("text_")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id_"), pa.array(marks.view(np.int64))], ["id_", "mark"])

    return df.select(F.col(id_col).cast("long").alias("id_"), F.col(text).alias("text_")).mapInArrow(run, "id_ long, mark long")


def _local_roots(marks: np.ndarray, radius: int) -> np.ndarray:
    """Least fingerprint of the component that each has within one bucket."""
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    signed = marks.view(np.int64)
    order = np.argsort(signed)
    near = near[np.ix_(order, order)]
    root = np.arange(len(marks))
    while True:
        best = np.minimum(root, np.where(near, root[None, :], len(marks)).min(axis=1))
        best = np.minimum(best, best[best])
        if (best == root).all():
            break
        root = best
    out = np.empty(len(marks), np.int64)
    out[order] = signed[order][root]
    return out


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) inside buckets given as arrays of marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for marks in b.column("marks"):
                own = np.array(marks.as_py(), np.int64)
                root = _local_roots(own.view(np.uint64), radius)
                left.append(own[own != root])
                right.append(root[own != root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return buckets.select("marks").mapInArrow(run, "a long, b long")


def _through_midpoints(marks: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of all marks within the radius, without pairs.

    An even radius 2k: a midpoint's members are within k of it, so all of them are linked, to the least of them. An odd radius
    2k + 1 joins the members at distance up to k (all linked) with each member at k + 1 (linked to those, not to each other).
    """
    half = radius // 2
    flips = [sum(1 << i for i in c) for k in range(half + radius % 2 + 1) for c in itertools.combinations(range(BITS), k)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    reach = F.array(*[F.struct(F.col("mark").bitwiseXOR(F.lit(f)).alias("middle"), F.lit(g.bit_count() > half).alias("outer")) for f, g in zip(signed, flips, strict=True)])
    near = marks.select("mark", F.explode(reach).alias("m")).select("mark", "m.middle", "m.outer")
    heads = near.where("not outer").groupBy("middle").agg(F.min("mark").alias("head"))
    return near.join(heads, "middle").where("mark <> head").select(F.col("mark").alias("a"), F.col("head").alias("b"))


def links(marks: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct marks within the radius."""
    kept = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    placed = marks.select("mark", F.posexplode(F.array(*[F.col("mark").bitwiseAND(F.lit(m)) for m in kept])).alias("mask", "value"))
    sizes = placed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    crowded = cut_lineage(placed.join(sizes, ["mask", "value"]))
    small = crowded.where(F.col("n") <= block).groupBy("mask", "value").agg(F.collect_list("mark").alias("marks"))
    large = crowded.where(F.col("n") > block).select("mark").distinct()
    return _compared(small, radius).unionAll(_through_midpoints(large, radius)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    signed = cut_lineage(fingerprints(df, id_col, text, n))
    marks = cut_lineage(signed.groupBy("mark").agg(F.min("id_").alias("least")))
    tied = components(links(marks.select("mark"), radius, block)).select(F.col("node").alias("mark"), "root")
    named = marks.join(tied, "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(heads, "root").select("mark", "component_id")
    return signed.join(found, "mark").select(F.col("id_").alias(id_col), F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

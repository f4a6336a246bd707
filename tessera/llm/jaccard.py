"""N-gram Jaccard join by MinHash banding.

Texts are compared as sets of five-word shingles (lower case, split at white space; a text with fewer words is
one shingle). Bands and rows are chosen for the target recall at the similarity threshold. Documents with the
same word sequence are one text; the texts meet on band hashes, and only those that share a band with another
text are read again with their full shingle sets.

No pairs are written out. Texts that share bands form groups (components of the stars text - least text of
the band). A group of up to BLOCK texts is verified at once, all pairs of it, by counting shared shingles. A larger
group may be glued together by false candidates, so it is verified bucket by bucket of its bands, a pair only in
the first band that it shares; buckets with the same members are verified once. A unit (group or bucket) above BLOCK
texts or VOLUME shingles is dealt into chunks, and every two chunks meet in one task, so that no task grows with the
unit and no link is lost. A task returns a row for each text: its links and the least text it is tied to. Classes are
the components of these verified links. The work inside a bucket of n mutually similar texts grows with n squared,
because n_links counts them all.

Result: one row for each document: class_id, the least id of all documents tied to it by links or equal
words; n_links, the number of other texts with similarity >= the threshold; n_copies, the documents with the
same words.

Defined cases: null and empty texts have no shingles, are copies of each other, and link to nothing; rows with
null ids are kept, in a class of their own and without links; repeated rows count as copies; two texts under one
id are told apart; other columns are not read; an empty table gives no rows. Ids are whole numbers. Joins on a group
or bucket are ordinary joins, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage
from tessera.llm.components import components, thinned

WORDS, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 128
#: Texts and shingles of a unit that one side of a task holds, and columns of shared shingles that are multiplied at a time.
BLOCK, VOLUME, SLAB = 1024, 1 << 21, 2048


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, so the fewest false candidates, that reach the recall within the hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()
_POWERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D]


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    return np.unique(_sequence(text, n))


def _sequence(text: str | None, n: int) -> np.ndarray:
    words = text.lower().split() if text else []
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not words:
        return h
    k = min(n, len(words))
    x = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        x += (h[i : len(h) - k + 1 + i] ^ np.uint64(i + 1)) * np.uint64(_POWERS[i % len(_POWERS)] + 2 * i)
    x ^= x >> np.uint64(31)
    return x * np.uint64(_POWERS[1])


def signatures(df: DataFrame, id_col: str, text: str, bands: int, rows: int, n: int = WORDS) -> DataFrame:
    """(id_, text_hash, digest_hi, digest_lo, size, b0 ...): hashes of the plain text and of the word sequence, and one hash for each band (null without words)."""
    seeds = np.random.default_rng(11).integers(1, 1 << 63, size=(2, bands * rows), dtype=np.uint64)
    names = [f"b{i}" for i in range(bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            digest = [xxhash.xxh3_128_digest(" ".join(t.lower().split()) if t else "") for t in texts]
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2) if texts else np.zeros((0, 2), np.int64)
            out = np.zeros((bands, len(texts)), np.uint64)
            size = np.zeros(len(texts), np.int64)
            start = 0
            while start < len(texts):  # some documents at a time, so that their shingles stay in cache
                parts, stop, held = [], start, 0
                while stop < len(texts) and (held < 50_000 or stop == start):
                    parts.append(_sequence(texts[stop], n))
                    held += len(parts[-1])
                    stop += 1
                lengths = np.array([len(p) for p in parts])
                size[start:stop] = lengths
                live = np.flatnonzero(lengths)
                if len(live):
                    flat = np.concatenate(parts)
                    at = np.concatenate(([0], np.cumsum(lengths[live])))[:-1]
                    for band in range(bands):
                        mix = np.zeros(len(live), np.uint64)
                        for k in range(band * rows, band * rows + rows):
                            mix = (mix ^ np.minimum.reduceat(flat * (seeds[0, k] | np.uint64(1)) + seeds[1, k], at)) * np.uint64(_POWERS[0])
                        out[band, start + live] = mix ^ (mix >> np.uint64(32))
                start = stop
            arrays = [b.column(0), b.column(2), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(size), *[pa.array(o.view(np.int64), mask=size == 0) for o in out]]
            yield pa.RecordBatch.from_arrays(arrays, ["id_", "text_hash", "digest_hi", "digest_lo", "size", *names])

    schema = "id_ long, text_hash long, digest_hi long, digest_lo long, size long, " + ", ".join(f"{c} long" for c in names)
    return df.select(F.col(id_col).cast("long").alias("id_"), F.col(text).alias("text_"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of shared shingles of every two sets.

    Shingles that occur in exactly the same sets are one weighted column; those of a single set are left out.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    many = np.diff(np.append(first, len(flat)))
    mark = np.random.default_rng(5).integers(1, 1 << 63, size=n, dtype=np.uint64)
    pattern = np.add.reduceat(mark[row], first)
    _, example, weight = np.unique(pattern[many > 1], return_index=True, return_counts=True)
    starts, many = first[many > 1][example], many[many > 1][example]
    out = np.zeros((n, n), np.float32)  # exact below 2**24 shingles
    for at in range(0, len(starts), SLAB):
        s, m = starts[at : at + SLAB], many[at : at + SLAB]
        places = np.repeat(s - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
        grid = np.zeros((n, len(s)), np.float32)
        grid[row[places], np.repeat(np.arange(len(s)), m)] = 1
        out += (grid * weight[at : at + SLAB]).astype(np.float32) @ grid.T
    return out


def _verify(part: pa.Table, threshold: float) -> pa.Table:
    """Links and least tied text of every text of one pair of chunks."""
    left, right, band = (part[c][0].as_py() for c in ("left", "right", "band"))
    chunk, ids = part["chunk"].to_numpy(), part["rep"].to_numpy()
    ids, order = np.unique(ids, return_index=True)  # a repeated row comes twice
    chunk = chunk[order]
    lists = part["shingles"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    sets = [values[offsets[i] : offsets[i + 1]] for i in order]
    sizes = np.array([len(s) for s in sets], float)
    both = _shared(sets)
    tied = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    if left != right:
        tied &= chunk[:, None] != chunk[None, :]
    if band > 0:  # pairs that share an earlier band belong to its bucket
        signed = np.array([part["bands"][i].as_py()[:band] for i in order.tolist()])
        for k in range(band):
            tied &= signed[:, k][:, None] != signed[:, k][None, :]
    np.fill_diagonal(tied, False)
    root = np.arange(len(ids))
    while True:  # least label of the neighbours, then the label's own label
        best = np.minimum(root, np.where(tied, root[None, :], len(ids)).min(axis=1))
        best = np.minimum(best, best[best])
        if (best == root).all():
            break
        root = best
    return pa.table({"rep": ids, "root": ids[root], "links": tied.sum(axis=1).astype(np.int64)})


def _units(grouped: DataFrame, sizes: DataFrame, banded: DataFrame, block: int) -> DataFrame:
    """(rep, units): what each text is verified in, an array of (band, unit, chunks, chunk).

    A small group is one unit with band -1. Of a large group, every bucket of two texts or more is a unit; of buckets
    with the same members (by count, least member and sum of hashes) only the first band's.
    """
    grouped = cut_lineage(grouped.join(sizes, "rep"))
    groups = grouped.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    chunks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("volume") / F.lit(VOLUME))).cast("int")
    small = grouped.join(groups.where(F.col("n") <= block), "cluster").select("rep", F.lit(-1).alias("band"), F.col("cluster").alias("unit"), chunks.alias("chunks"))
    large = grouped.join(groups.where(F.col("n") > block).select("cluster"), "cluster").select("rep", "cluster")
    spread = banded.join(large, "rep")
    buckets = spread.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.sum("size").alias("volume"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("members")
    ).where("n > 1")
    first = buckets.groupBy("n", "least", "members").agg(F.min(F.struct("band", "hash")).alias("s"), F.first("volume").alias("volume"))
    of_bucket = spread.join(first.select("s.*", chunks.alias("chunks")), ["band", "hash"]).select("rep", "band", F.col("hash").alias("unit"), "chunks")
    every = small.unionByName(of_bucket).withColumn("chunk", F.pmod(F.xxhash64("rep", "band"), F.col("chunks")).cast("int"))
    return every.groupBy("rep").agg(F.collect_list(F.struct("band", "unit", "chunks", "chunk")).alias("units"))  # one for each band at most


def classes(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, class_id, class_hash, n_links, n_copies) of every row.

    ``class_id`` and ``class_hash`` are the least (id, xxhash64 of the text) of the class. Texts are told apart by
    their digest, so ids may repeat; a row with a null id is a class of its own.
    """
    bands, rows = bands_for(threshold, recall)
    signed = cut_lineage(signatures(df, id_col, text, bands, rows, n))
    texts = cut_lineage(
        signed.where("id_ is not null").groupBy("digest_hi", "digest_lo")
        .agg(F.min(F.struct("id_", "text_hash")).alias("least"), F.count("*").alias("n_copies"), F.min("size").alias("size"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(bands)])
        .withColumn("rep", F.monotonically_increasing_id())
    )
    banded = texts.where("b0 is not null").select("rep", "size", F.posexplode(F.array(*[f"b{i}" for i in range(bands)])).alias("band", "hash"))
    leaders = banded.groupBy("band", "hash").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = banded.join(leaders, ["band", "hash"]).where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    grouped = components(thinned(stars)).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    placed = cut_lineage(_units(grouped, texts.select("rep", "size"), banded, block).join(texts.select("rep", "least.id_", "least.text_hash", F.array(*[f"b{i}" for i in range(bands)]).alias("bands")), "rep"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in b.column("text_").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("units"), b.column("bands"), lists], ["rep", "units", "bands", "shingles"])

    texts_again = df.select(F.col(id_col).cast("long").alias("id_"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text_"))
    unit = "array<struct<band:int,unit:long,chunks:int,chunk:int>>"
    sets = texts_again.join(placed, ["id_", "text_hash"]).select("rep", "units", "bands", "text_").mapInArrow(read, f"rep long, units {unit}, bands array<long>, shingles array<long>")
    dealt = sets.select("rep", F.explode("units").alias("u"), "bands", "shingles").select("rep", "u.*", F.when(F.col("u.band") > 0, F.col("bands")).alias("bands"), "shingles")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least("chunk", other).alias("left"), F.greatest("chunk", other).alias("right")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("band", "unit", "pair.left", "pair.right", "chunk", "rep", "bands", "shingles")
    checked = dealt.groupBy("band", "unit", "left", "right").applyInArrow(lambda part: _verify(part, threshold), "rep long, root long, links long")
    checked = cut_lineage(checked)
    tied = components(thinned(checked.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    roots = tied.select(F.col("node").alias("rep"), "root")
    heads = texts.select("rep", "least").join(roots, "rep").groupBy("root").agg(F.min("least").alias("head"))
    found = (
        texts.select("digest_hi", "digest_lo", "rep", "least", "n_copies")
        .join(roots.join(heads, "root").select("rep", "head"), "rep", "left")
        .join(checked.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .select("digest_hi", "digest_lo", F.coalesce("head", "least").alias("head"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    )
    named = signed.where("id_ is not null").select("id_", "text_hash", "digest_hi", "digest_lo").join(found, ["digest_hi", "digest_lo"])
    out = named.select(F.col("id_").alias(id_col), "text_hash", F.col("head.id_").alias("class_id"), F.col("head.text_hash").alias("class_hash"), "n_links", "n_copies")
    lost = signed.where("id_ is null").select(F.col("id_").alias(id_col), "text_hash", F.col("id_").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionAll(lost)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, n_copies) of every row."""
    return classes(df, id_col, text, threshold, recall, n, block).select(id_col, "class_id", "n_links", "n_copies")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    from tessera.io import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

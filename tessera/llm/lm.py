"""LM scoring: stupid-backoff scores from n-gram count tables, joined to the exploded n-grams of the documents.

A word is a run without ASCII white space; a document with words starts with order - 1 begin marks. The score of
a word is count(n-gram) / count(its context) for the longest n-gram, up to the order, that the corpus holds; every
order that must be given up costs a factor of ALPHA, and a word is at last scored by count(word) / all words (a
word never seen counts as half an occurrence). A document's score is the mean natural log over its words.

``score_self`` scores a corpus by its own counts with the document's own n-grams taken out (count - own count), so a
text is measured by the rest of the corpus: copies stand out and new text backs off. ``score`` takes the counts of
another corpus. Both run one plan. N-grams travel as 64-bit hashes.

Documents are dealt into slices of about SLICE bytes of text. A slice asks once for each of its distinct n-grams: they
are shuffled in arrays by bucket (the leading bits of the hash), exploded there, counted, and joined to the count
table, of which rows known to one slice only are left out. The counts go back as arrays in the order of the asking.
Words and pairs go first; a longer n-gram is asked for only if both its parts are known outside the slice, as it is
unknown there otherwise. Counts inside the slice and the document are taken from the slice itself. An n-gram has one
row a slice at most, however frequent it is.

Defined cases: a null or empty text has 0 words and a null score; every row is a document of its own, so null and
repeated ids, of any type, keep their rows, and repeated rows count as copies of each other; other columns are
not read; an empty table gives no rows; an empty corpus leaves half an occurrence for each word. The tables are read
once for each order after the first, so they must give the same ids and texts each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.io import shared_folder

ALPHA, BEGIN, ORDER = 0.4, b"\x02", 3
#: Bytes of text in a slice, about, and least buckets of n-grams (a power of two).
SLICE, BUCKETS = 8 << 20, 1024
#: Orders are parts of a place, slice * PARTS + order; slices of another corpus have places below 0.
PARTS = 64
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NONE = np.zeros(0, np.int64)
ASKED = "bucket int, place long, grams array<long>, times array<int>"


class _Slice:
    """Words of a slice: hashes with begin marks, the row of each and its place in the text."""

    def __init__(self, texts: pa.Array, order: int):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, rows = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        word = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        coded = flat.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        self.order, self.size = order, np.bincount(rows[word], minlength=len(lists))
        sizes = self.size + (order - 1) * (self.size > 0)
        self.row = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.h = np.full(len(self.row), xxhash.xxh64_intdigest(BEGIN), np.uint64)
        self.h[self.place >= order - 1] = hashes[coded.indices.to_numpy(zero_copy_only=False)[word]]

    def parts(self, known: dict[int, np.ndarray], asks: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: distinct n-grams, how often the slice holds each, which of them are asked for, and the one of each position that ends an n-gram.

        A count outside the slice that is among ``known`` is sent in for the next order; ``asks`` is False for a corpus, which tells all.
        """
        outside = x = None
        for n in range(1, self.order + 1):
            if n == 1:
                x = self.h
            else:
                before = np.zeros_like(self.h)
                before[n - 1 :] = self.h[: len(self.h) - n + 1]
                x = (before ^ (before >> np.uint64(29))) * _K1 + x * _K2 + np.uint64(n)
                x = (x ^ (x >> np.uint64(32))) * _K1
            at = np.flatnonzero(self.place >= n - 1)
            grams, inverse, times = np.unique(x[at], return_inverse=True, return_counts=True)
            asked = np.ones(len(grams), bool)
            if n > 2 and asks:
                asked[inverse] = (outside[at] > 0) & (outside[at - 1] > 0)  # alike wherever the n-gram stands
            yield n, grams, times, asked, (at, inverse)
            if 1 < n < self.order and known:
                outside = self.spread(known.get(n, NONE), asked, at, inverse)

    def spread(self, counts: np.ndarray, asked: np.ndarray, at: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """Counts of the n-grams asked for, at every position; the rest have none."""
        if len(counts) != np.count_nonzero(asked):
            raise ValueError(f"{len(counts)} counts for {np.count_nonzero(asked)} n-grams: the tables changed while they were scored")
        each, out = np.zeros(len(asked), np.int64), np.zeros(len(self.h), np.int64)
        each[asked] = counts
        out[at] = each[inverse]
        return out

    def own(self, times: np.ndarray, at: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """For each position of ``at`` how often the rest of the slice holds its n-gram."""
        out = times[inverse] - 1
        more = np.flatnonzero(out)  # others have one occurrence, which is the document's
        _, of, mine = np.unique(inverse[more] * np.int64(len(self.size)) + self.row[at[more]], return_inverse=True, return_counts=True)
        out[more] += 1 - mine[of]
        return out

    def scores(self, known: dict[int, np.ndarray], own: bool) -> np.ndarray:
        """The sum of logs of each row."""
        counts = {}
        for n, _, times, asked, (at, inverse) in self.parts(known, True):
            counts[n] = self.spread(known.get(n, NONE), asked, at, inverse)
            if own:
                counts[n][at] += self.own(times, at, inverse)
        word = np.flatnonzero(self.place >= self.order - 1)
        value, left = np.zeros(len(word)), np.ones(len(word), bool)
        for n in range(self.order, 1, -1):
            here, before = counts[n][word], counts[n - 1][word - 1]
            hit = left & (here > 0)
            value[hit] += np.log(here[hit]) - np.log(before[hit])
            left &= ~hit
            value[left] += np.log(ALPHA)
        rest = known[0].sum() + (self.size.sum() - self.size if own else np.zeros_like(self.size))  # of all words
        single = np.log(np.maximum(counts[1][word], 0.5)) - np.log(np.maximum(rest, 1))[self.row[word]]
        return np.bincount(self.row[word], value + np.where(left, single, 0.0), len(self.size))


def _dealt(df: DataFrame, id_col: str | None, text: str, slices: int) -> DataFrame:
    """(id_, text_, slice), dealt by what the rows hold, so that they fall alike whenever the table is read."""
    rows = df.select(F.col(id_col).alias("id_") if id_col else F.monotonically_increasing_id().alias("id_"), F.col(text).cast("string").alias("text_"))
    return rows.withColumn("slice", F.pmod(F.xxhash64("id_", "text_"), F.lit(slices)).cast("int"))


def _slices(df: DataFrame, text: str) -> int:
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(-(-size // SLICE), df.sparkSession.sparkContext.defaultParallelism)


def _asking(orders: range, order: int, bits: int, own: bool, asks: bool) -> tuple[Callable, Callable]:
    """Functions of a slice, and of a slice and its counts, that give its n-grams of the given orders by bucket; 0 is the empty n-gram, whose count is that of all words."""

    def run(docs: pa.Table, known: dict[int, np.ndarray]) -> pa.Table:
        s, place = _Slice(docs["text_"].combine_chunks(), order), docs["slice"][0].as_py() * PARTS
        tells = own or not asks
        found = [(0, np.zeros(1, np.uint64), np.array([s.size.sum()]))] if 0 in orders else []
        for n, grams, times, asked, _ in s.parts(known, asks):
            if n in orders:
                found.append((n, grams[asked], times[asked]))
            if n == orders[-1]:
                break
        out = []
        for n, grams, times in found:
            bucket = (grams >> np.uint64(64 - bits)).astype(np.int32)
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = pa.array(np.append(first, len(grams)), pa.int32())
            grams, times = pa.array(grams.view(np.int64)), pa.array((times if tells else np.zeros_like(times)).astype(np.int32))
            places = np.full(len(first), place + n if asks else ~(place + n), np.int64)
            out.append(pa.table([pa.array(bucket[first]), pa.array(places), pa.ListArray.from_arrays(ends, grams), pa.ListArray.from_arrays(ends, times)], ["bucket", "place", "grams", "times"]))
        return pa.concat_tables(out)

    return (lambda docs: run(docs, {})), (lambda docs, back: run(docs, _known(back)))


def _known(back: pa.Table) -> dict[int, np.ndarray]:
    """Counts by order, in the order of the n-grams, from rows (slice, part, bucket, counts)."""
    back = back.sort_by([("part", "ascending"), ("bucket", "ascending")])
    part, lists = back["part"].to_numpy(), back["counts"].combine_chunks()
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return {int(n): flat[ends[np.searchsorted(part, n)] : ends[np.searchsorted(part, n, "right")]] for n in np.unique(part)}


def _counted(asked: DataFrame, tasks: int) -> DataFrame:
    """(slice, part, bucket, counts): how often others hold the n-grams that a slice asks for, in their order (of slices below 0 too)."""
    rows = asked.where("bucket is not null").repartition(tasks, "bucket").select("bucket", "place", F.posexplode(F.arrays_zip("grams", "times")).alias("pos", "g")).select("bucket", "place", "pos", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))  # the same rows on both sides of the join, so one shuffle
    seen = rows.groupBy("bucket", "gram").agg(F.sum("times").alias("total"), (F.min("place") < F.max("place")).alias("shared")).where("shared").drop("shared")
    joined = rows.join(seen.hint("shuffle_hash"), ["bucket", "gram"], "left")
    n = F.coalesce(F.col("total") - F.col("times"), F.lit(0))
    told = F.shiftleft(F.col("pos").cast("long"), 40).bitwiseOR(n)  # a plain number is lighter than a struct
    lists = joined.groupBy("bucket", "place").agg(F.sort_array(F.collect_list(told)).alias("found"))
    return lists.select(F.floor(F.col("place") / PARTS).cast("int").alias("slice"), (F.col("place") % PARTS).cast("int").alias("part"), "bucket", F.transform("found", lambda x: x.bitwiseAND(F.lit((1 << 40) - 1))).alias("counts"))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows dealt by bucket meet by bucket and n-gram without another shuffle, lists are gathered without a sort (a task has those of about one slice), and the files of a shuffle go with the step that wrote them.
STEP = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1000000", "spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def _scored(df: DataFrame, corpus: DataFrame | None, order: int, id_col: str, text: str, corpus_text: str) -> DataFrame:
    spark, own, slices = df.sparkSession, corpus is None, _slices(df, text)
    docs, tasks = _dealt(df, id_col, text, slices), slices
    others = None
    if not own:
        tasks += (more := _slices(corpus, corpus_text))
        others = _dealt(corpus, None, corpus_text, more)
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = (max(BUCKETS, 16 * tasks) - 1).bit_length()
    known = None
    for orders in (range(min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))):
        alone, beside = _asking(orders, order, bits, own, True)
        asked = docs.groupBy("slice").applyInArrow(alone, ASKED) if known is None else docs.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(beside, ASKED)
        if others is not None:
            asked = asked.unionByName(others.groupBy("slice").applyInArrow(_asking(orders, order, bits, own, False)[0], ASKED))
        folder = shared_folder(spark)
        with _settings(spark, STEP):
            _counted(asked, tasks).write.parquet(folder)
        back = spark.read.parquet(folder).where("slice >= 0")
        known = back if known is None else known.unionByName(back)
    kind = df.schema[id_col].dataType.simpleString()

    def scores(t: pa.Table, b: pa.Table) -> pa.Table:
        s = _Slice(t["text_"].combine_chunks(), order)
        logs = s.scores(_known(b), own)
        mean = pa.array(logs / np.maximum(s.size, 1), mask=s.size == 0)
        return pa.table([t["id_"], pa.array(s.size), mean], ["id_", "n_words", "score"])

    found = docs.groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(scores, f"id_ {kind}, n_words long, score double")
    return found.select(F.col("id_").alias(id_col), "n_words", "score")


def score_self(df: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, score) of every row under the counts of all other rows."""
    return _scored(df, None, order, id_col, text, text)


def score(df: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text: str = "text", corpus_text: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, score) of every row of df under the counts of another corpus."""
    return _scored(df, corpus, order, id_col, text, corpus_text)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The mean log score of every document under the counts of all other documents."""
    from tessera.io import table

    found = score_self(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP10_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents
), places AS (
  SELECT r, len(w) AS n_words, [chr(2), chr(2)] || w AS w, unnest(generate_series(1, len(w) + 2)) AS i FROM texts WHERE len(w) > 0
), grams AS (
  SELECT r, n_words, i, hash(w[i]) AS w, hash(w[i - 1], w[i]) AS vw, hash(w[i - 2], w[i - 1], w[i]) AS uvw FROM places
), counts AS (  -- of each n-gram outside the document; n-grams with places before the text are not asked for
  SELECT r, n_words, i,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS w,
    count(*) OVER (PARTITION BY vw) - count(*) OVER (PARTITION BY r, vw) AS vw,
    count(*) OVER (PARTITION BY uvw) - count(*) OVER (PARTITION BY r, uvw) AS uvw
  FROM grams
), asked AS (
  SELECT *, lag(w) OVER before AS v, lag(vw) OVER before AS uv FROM counts WINDOW before AS (PARTITION BY r ORDER BY i)
), everything AS (
  SELECT sum(len(w)) AS n FROM texts
), sums AS (
  SELECT r, sum(CASE WHEN uvw > 0 THEN ln(uvw) - ln(uv) WHEN vw > 0 THEN ln(0.4) + ln(vw) - ln(v)
    ELSE 2 * ln(0.4) + ln(greatest(w, 0.5)) - ln(greatest(1, n - n_words)) END) AS logs
  FROM asked, everything WHERE i > 2 GROUP BY r
)
SELECT doc_id, len(w) AS n_words, round(logs / len(w), 6) AS score FROM texts LEFT JOIN sums USING (r)
"""

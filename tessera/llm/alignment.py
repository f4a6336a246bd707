"""Cross-tokenizer alignment by interval coalescing, and how often token pairs meet in the corpus.

Each text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), and every token becomes a
byte range. All ranges are sorted by start (``lexsort``), the running maximum of their ends is taken, and a group breaks where a
start reaches it; inside a group each A token is expanded to the B tokens that it overlaps.

Both tokenizers cut at a blank between two characters that are not white space: the pre-tokenizer of A starts a word there and
no piece of B continues over it (checked when the vocabulary is read). So a text is a sequence of segments (a blank and what
follows it) and its groups are those of its segments, one after another. A worker aligns all segments of SLICE that it has not seen of
late together and keeps the results in a bounded cache; texts of any length are taken piece by piece.

A link's count is over the whole corpus, so each document's distinct id pairs are written once as packed arrays. They are read to
count, for each pair, the documents that link it (each task sums before the shuffle), and again to look the counts up: the most frequent
pairs, HOT at most, go to the workers as a sorted table (they are most occurrences and the skewed keys, and their number is
bounded); pairs beyond it leave as rows, meet the full count table in an ordinary join and are summed by document.

Defined cases: a null or empty text, and one whose joined token bytes differ from blank + text, has no tokens: zeros and ''. Special
tokens inside a text are plain text. Null and repeated ids keep their rows; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage, shared_folder, table

#: Segments taken at a time, segments that a worker keeps, pairs held before they are summed, pairs sent to the workers.
SLICE, CACHE, HELD, HOT = 1 << 15, 600_000, 1 << 20, 1 << 19
_CUT = re.compile(r"(?<=[^\s᠎]) (?=[^\s᠎])")
_RARE = re.compile(r"[^\S \n]|᠎")


def segments(text: str) -> list[str]:
    """The text cut at each blank between two characters that are not white space, without those blanks."""
    odd = "  " in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or _RARE.search(text)
    return _CUT.split(text) if odd else text.split(" ")


class _Side:
    """One tokenizer: the bytes of each of its tokens, and a function from a text to ids that puts a blank before the text."""

    def __init__(self, surface: list[bytes], encode):
        self.surface, self.encode = surface, encode
        self.lengths = np.array([len(s) for s in surface], np.int64)

    def tokens(self, parts: list[str], plain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each segment, True where its joined token bytes are those of the segment).

        The first ``plain`` segments have no white space at their ends and are encoded as one text, whose tokens never
        cross a segment's first blank.
        """
        whole = " ".join(parts[:plain])
        ids = np.array(self.encode(whole) if plain else [], np.int64)
        if b"".join(map(self.surface.__getitem__, ids.tolist())) == (f" {whole}".encode() if plain else b""):
            ends = np.cumsum(np.array([len(p.encode()) + 1 for p in parts[:plain]], np.int64))
            counts = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1, prepend=0)
        else:
            ids, counts, plain = ids[:0], np.zeros(0, np.int64), 0
        found = [self.encode(p) for p in parts[plain:]]
        same = [b"".join(map(self.surface.__getitem__, x)) == f" {p}".encode() for x, p in zip(found, parts[plain:], strict=True)]
        good = np.concatenate([np.ones(plain, bool), np.array(same, bool)])
        return np.concatenate([ids, *[np.array(x, np.int64) for x in found]]), np.concatenate([counts, np.array([len(x) for x in found], np.int64)]), good


def coalesce(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, places of the A and of the B token of every link) of two lists of token lengths over the same bytes."""
    ends = np.cumsum(lengths_a), np.cumsum(lengths_b)
    starts = ends[0] - lengths_a, ends[1] - lengths_b
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((np.arange(len(start)) >= len(lengths_a), start))
    top = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= top[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(ends[1], starts[0], "right")
    many = np.searchsorted(starts[1], ends[0], "left") - first
    left = np.repeat(np.arange(len(lengths_a)), many)
    right = np.arange(len(left)) + (first - (np.cumsum(many) - many))[left]
    return group[: len(lengths_a)], group[len(lengths_a) :], left, right


class _Column:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1 << 16, kind), 0

    def extend(self, values) -> None:
        while self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


class Aligner:
    """Both tokenizers and the alignment of the segments seen of late.

    Of each segment: whether its token bytes are its own, numbers of A tokens, B tokens, groups and links (``counts``), where its id
    pairs lie in ``pairs``, and its groups as text, each with a semicolon before it.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size(with_added_tokens=True))]
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces of B continue over blanks")
        self.a = _Side([bytes(byte.get(c, 0) for c in t) for t in names], lambda part: a.encode(f" {part}", add_special_tokens=False).ids)
        self.b = _Side([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces], b.encode)
        # a token in a listing of groups: after another of its side, or the first of its side in a group
        self.shown = [f",{i}" for i in range(len(names))] + [f";{i}" for i in range(len(names))] + [f",{i}" for i in range(len(pieces))] + [f"|{i}" for i in range(len(pieces))]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good, self.start, self.pairs, self.listing = _Column(bool), _Column(np.int64), _Column(np.int64), []
        self.counts = [_Column(np.int32) for _ in range(4)]

    def add(self, parts: list[str], plain: int) -> None:
        """Aligns new segments, the first ``plain`` of which have no white space at their ends."""
        a, n_a, good_a = self.a.tokens(parts, plain)
        b, n_b, good_b = self.b.tokens(parts, plain)
        good = good_a & good_b
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        of_a, size = np.repeat(np.arange(len(parts)), n_a), len(parts)
        group_a, group_b, left, right = coalesce(self.a.lengths[a], self.b.lengths[b])
        opens = np.diff(group_a, prepend=-1)
        links = np.bincount(of_a[left], minlength=size)
        self.start.extend(self.pairs.size + np.cumsum(links) - links)
        self.pairs.extend(a[left] * len(self.b.surface) + b[right])
        for column, values in zip(self.counts, (n_a, n_b, np.bincount(of_a, opens, size), links), strict=True):
            column.extend(values)
        self.good.extend(good)
        # places in the listing: groups in order, A before B
        total = int(opens.sum())
        in_a, in_b = np.bincount(group_a, minlength=total), np.bincount(group_b, minlength=total)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + len(self.a.surface) * opens
        codes[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.a.surface) + b + len(self.b.surface) * np.diff(group_b, prepend=-1)
        told, cuts = list(map(self.shown.__getitem__, codes.tolist())), np.cumsum(n_a + n_b).tolist()
        self.listing += ["".join(told[i:j]) for i, j in zip([0, *cuts], cuts, strict=False)]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of segments; those not known are aligned. Numbers hold until the cache is cleared."""
        found = list(map(self.known.get, parts))
        if None in found:
            new = dict.fromkeys(p for p, i in zip(parts, found, strict=True) if i is None)
            bare = [p for p in new if p and p == p.strip() and "᠎" not in (p[0], p[-1])]
            every = bare + sorted(set(new).difference(bare))
            self.known.update(zip(every, range(self.good.size, self.good.size + len(every)), strict=True))
            self.add(every, len(bare))
            found = list(map(self.known.__getitem__, parts))
        return np.array(found, np.int64)

    def slices(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, segment number) arrays, up to SLICE segments at a time; documents without tokens are left out."""
        held, size = [], 0
        for doc, text in enumerate(texts):
            if text:
                held.append((doc, segments(text)))
                size += len(held[-1][1])
            if held and (size >= SLICE or doc == len(texts) - 1):
                parts = [p for _, own in held for p in own]
                docs = np.repeat([d for d, _ in held], [len(own) for _, own in held])
                numbers = np.concatenate([self.numbers(parts[at : at + SLICE]) for at in range(0, size, SLICE)])
                whole = ~np.isin(docs, docs[~self.good.data[numbers]])
                docs, numbers = docs[whole], numbers[whole]
                for at in range(0, len(docs), SLICE):
                    yield docs[at : at + SLICE], numbers[at : at + SLICE]
                held, size = [], 0
                if len(self.known) > CACHE:
                    self.clear()

    def links(self, docs: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, id pair, links) of every distinct pair of a document, in this order."""
        n = self.counts[3].data[numbers]
        of = np.repeat(np.arange(len(numbers)), n)
        pair = self.pairs.data[np.arange(len(of)) + (self.start.data[numbers] - (np.cumsum(n) - n))[of]]
        every = len(self.a.surface) * len(self.b.surface)
        key, times = np.unique(docs[of] * every + pair, return_counts=True)
        return *np.divmod(key, every), times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def linked(df: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id_, the four SUMS, groups_sha256, and its distinct id pairs (A id times size of B, plus B id) with their links as packed 64- and 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        for batch in batches:
            size = batch.num_rows
            sums, hashes = np.zeros((4, size), np.int64), {}
            pairs: list[list[np.ndarray]] = [[] for _ in range(size)]
            times: list[list[np.ndarray]] = [[] for _ in range(size)]
            for docs, numbers in aligner.slices(batch.column("text_").to_pylist()):
                sums += [np.bincount(docs, c.data[numbers], size).astype(np.int64) for c in aligner.counts]
                told = list(map(aligner.listing.__getitem__, numbers.tolist()))
                for d, i, j in _runs(docs):
                    shown = "".join(told[i:j])
                    if d in hashes:
                        hashes[d].update(shown.encode())
                    else:
                        hashes[d] = hashlib.sha256(shown[1:].encode())
                doc, pair, n = aligner.links(docs, numbers)
                for d, i, j in _runs(doc):
                    pairs[d].append(pair[i:j])
                    times[d].append(n[i:j])
            for d in range(size):
                if len(pairs[d]) > 1:  # a document of several slices
                    own, at = np.unique(np.concatenate(pairs[d]), return_inverse=True)
                    pairs[d], times[d] = [own], [np.bincount(at, np.concatenate(times[d]))]
            packed = [pa.array([x[0].astype(kind).tobytes() if x else b"" for x in found], pa.binary()) for found, kind in ((pairs, "<i8"), (times, "<i4"))]
            digests = pa.array([hashes[d].hexdigest() if d in hashes else "" for d in range(size)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id_"), *[pa.array(s) for s in sums], digests, *packed], ["id_", *SUMS, "groups_sha256", "pairs", "times"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id_"), F.col(text).alias("text_")).mapInArrow(run, f"id_ {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first place, place after the last) of each run of equal values."""
    first = np.flatnonzero(np.diff(sorted_values, prepend=-1)).tolist()
    return zip(sorted_values[first].tolist(), first, [*first[1:], len(sorted_values)], strict=True)


def pair_counts(documents: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that link an id pair, and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([sums, *held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([counts, np.ones(size, np.int64)]), len(pairs)).astype(np.int64)

        for batch in batches:
            for packed in batch.column("pairs"):
                held.append(np.frombuffer(packed.as_buffer(), "<i8"))
                size += len(held[-1])
                if size > HELD:
                    sums, counts = merged()
                    held, size = [], 0
                    if len(sums) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array(counts)], ["pair", "n"])
                        sums, counts = sums[:0], counts[:0]
        sums, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(sums), pa.array(counts)], ["pair", "n"])

    summed = documents.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # at most one row for each token of B
    return summed.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, counts and marks of at most ``most`` pairs: all those above a count, told by a histogram in eighths of a doubling."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    rows = counts.where(F.lit(False) if least is None else step >= least).toArrow().sort_by("pair")
    return tuple(rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))


def align(df: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    linked(df, paths, id_col, text).withColumn("row_", F.monotonically_increasing_id()).write.parquet(folder)
    documents = spark.read.parquet(folder)
    counts = cut_lineage(pair_counts(documents, len(_aligner(paths).b.surface)))
    spread = spark.sparkContext.broadcast(_most_frequent(counts, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = spread.value
        for batch in batches:
            sums, rest, rest_times = np.zeros((2, batch.num_rows), np.int64), [], []
            for d, (packed, weights) in enumerate(zip(batch.column("pairs"), batch.column("times"), strict=True)):
                pair, times = np.frombuffer(packed.as_buffer(), "<i8"), np.frombuffer(weights.as_buffer(), "<i4")
                at = np.searchsorted(pairs, pair)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == pair[hit]
                at, seen = at[hit], times[hit]
                sums[:, d] = (seen * best[at]).sum(), (seen * n[at]).sum()
                rest.append(pair[~hit])
                rest_times.append(times[~hit].astype(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (rest, rest_times)]
            yield pa.RecordBatch.from_arrays([batch.column("row_"), *[pa.array(s) for s in sums], *lists], ["row_", "n_best", "count_sum", "pairs", "times"])

    found = cut_lineage(documents.select("row_", "pairs", "times").mapInArrow(run, "row_ long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rare = found.select("row_", F.explode(F.arrays_zip("pairs", "times")).alias("p")).join(counts, F.col("p.pairs") == F.col("pair"))
    more = rare.select("row_", F.when(F.col("best"), F.col("p.times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("p.times")).alias("count_sum"))
    sums = found.select("row_", "n_best", "count_sum").unionByName(more).groupBy("row_").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return documents.drop("pairs", "times").join(sums, "row_").select(F.col("id_").alias(id_col), *SUMS, "n_best", "count_sum", "groups_sha256")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark, sf_dir: str, paths: tuple[str, str] | None = None) -> DataFrame:
    """Every document aligned between the byte-level and the piece tokenizer."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), paths or default_paths())

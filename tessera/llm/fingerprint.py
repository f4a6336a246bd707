"""Document fingerprints: canonical exact digest, with DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space become one space, ends trimmed.
The digest is two differently seeded 64-bit xxhashes. Equal buckets of it are compared byte by byte;
where a bucket holds different canonical texts, the SHA-256 of the canonical text is appended, so that
equal fingerprints always mean equal canonical texts.

Defined cases: a null text counts as empty; a null or repeated id keeps its row; ties in the order of
documents are broken by text; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage

#: Bits of the filter that finds repeated buckets: 2**22 bits are 128 rows of 4 KB, whatever the input.
FILTER_BITS = 22


def _icu(text: Column) -> Column:
    nfkc = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))


def canonical(text: Column) -> Column:
    """Normalised, case-folded text with single spaces; ASCII texts need no normaliser."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), _icu(text)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def _wide(text: Column, bits: int) -> tuple[Column, Column]:
    first, second = F.xxhash64(text), F.xxhash64(F.lit("wide"), text)
    if bits >= 128:
        return first, second
    return F.pmod(first, F.lit(1 << max(bits, 1))).cast("long"), F.lit(0).cast("long")


def digests(df: DataFrame, text: str, prefix: str = "", bits: int = 128) -> DataFrame:
    """Adds <prefix>h1, <prefix>h2 (the wide hash) and <prefix>sha of the canonical text."""
    canon = f"{prefix}canon"
    df = df.withColumn(canon, canonical(F.col(text)))
    first, second = _wide(F.col(canon), bits)
    return df.withColumns({f"{prefix}h1": first, f"{prefix}h2": second, f"{prefix}sha": F.sha2(canon, 256)})


def _repeated_filter(buckets: DataFrame) -> DataFrame:
    """Bitmap rows (at most 2**FILTER_BITS bits in all) over the buckets with more than one text."""
    place = F.pmod("h1", F.lit(1 << FILTER_BITS))
    repeated = buckets.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select(place.alias("place"))
    return repeated.groupBy(F.bitmap_bucket_number("place").alias("bm_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bm_bits")
    )


def _may_repeat(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    place = F.pmod("h1", F.lit(1 << FILTER_BITS))
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bm_bits"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(bm_byte, cast(bm_pos % 8 as int)) & 1") == 1
    return (
        df.withColumn("bm_bucket", F.bitmap_bucket_number(place))
        .join(F.broadcast(bitmaps), "bm_bucket")  # at most 512 KB, by FILTER_BITS
        .withColumns({"bm_byte": byte, "bm_pos": position})
        .where(hit)
        .drop("bm_bucket", "bm_bits", "bm_byte", "bm_pos")
    )


def collided(hashed: DataFrame, texts: DataFrame, prefixes: tuple[str, ...], bits: int) -> DataFrame:
    """Buckets (h1, h2) that hold different canonical texts.

    hashed: the narrow digests; texts: (h1, h2, canon) of the documents, read again only for buckets
    that repeat. Bytes are compared by their least and greatest value, which a partial aggregation
    finds, so that a hot bucket never meets in one task.
    """
    pick = lambda p: hashed.select(F.col(f"{p}h1").alias("h1"), F.col(f"{p}h2").alias("h2"), F.col(f"{p}sha").alias("sha"))
    by_digest = (
        reduce(DataFrame.unionAll, [pick(p) for p in prefixes])
        .groupBy("h1", "h2").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
        .where("lo <> hi").select("h1", "h2")
    )
    bitmaps = _repeated_filter(hashed.select("h1", "h2"))
    by_bytes = (
        _may_repeat(texts, bitmaps)
        .groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
        .where("lo <> hi").select("h1", "h2")
    )
    return by_digest.unionAll(by_bytes).distinct()


def _text_of(first: str, second: str, sha: str, odd: Column) -> Column:
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(first), half(second), F.when(odd, F.concat(F.lit("-"), F.col(sha))).otherwise(F.lit("")))


def with_fingerprints(hashed: DataFrame, clashes: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Adds <prefix>fingerprint for each prefix; clashes is nearly always empty, then nothing is joined."""
    empty = clashes.isEmpty()
    for p in prefixes:
        odd = F.lit(False)
        if not empty:
            marks = clashes.select(F.col("h1").alias(f"{p}h1"), F.col("h2").alias(f"{p}h2"), F.lit(True).alias("odd"))
            hashed, odd = hashed.join(marks, [f"{p}h1", f"{p}h2"], "left"), F.coalesce("odd", F.lit(False))
        hashed = hashed.withColumn(f"{p}fingerprint", _text_of(f"{p}h1", f"{p}h2", f"{p}sha", odd)).drop("odd")
    return hashed


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = 128) -> DataFrame:
    """(id, fingerprint) of every row; bits below 128 exist to test equal buckets."""
    rows = digests(df.select(F.col(id_col), F.col(text).alias("text_")), "text_", bits=bits)
    hashed = cut_lineage(rows.select(id_col, "h1", "h2", "sha"))
    clashes = cut_lineage(collided(hashed, rows.select("h1", "h2", "canon"), ("",), bits))
    return with_fingerprints(hashed, clashes, ("",)).select(id_col, "fingerprint")


def with_next(df: DataFrame, id_col: str, carry: list[str], slices: int | None = None) -> DataFrame:
    """Adds next_<c> of the row with the next greater id (after the last: the first), without one global sort.

    Ids are cut at their approximate quantiles, so clustered ids give even ranges; each range also gets a copy of the row
    that follows it, and a window inside the range does the rest. Only the quantiles and one id per range (numbers fixed
    by ``slices``) leave the executors. Null ids come first.
    """
    spark = df.sparkSession
    slices = slices or max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(id_col, [i / slices for i in range(1, slices)], 10 * slices)).first()[0]
    bounds = F.array(*[F.lit(b) for b in sorted(set(cuts or []))]).cast("array<long>")
    slot = F.when(F.col(id_col).isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b < F.col(id_col)))).cast("long")
    df = df.withColumn("slot_", slot)
    firsts = [(r[0], r[1]) for r in df.groupBy("slot_").agg(F.min(F.struct(F.col(id_col).isNotNull(), F.col(id_col)))[id_col]).collect()]
    firsts.sort()
    follows = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]  # the first follows the last
    guests = df.join(F.broadcast(spark.createDataFrame(follows or [(None, None)], "first_ long, slot_after_ long")), F.col(id_col).eqNullSafe(F.col("first_")))
    both = df.withColumn("guest_", F.lit(0)).unionByName(
        guests.where("slot_after_ is not null").withColumn("slot_", F.col("slot_after_")).drop("first_", "slot_after_").withColumn("guest_", F.lit(1))
    )
    order = Window.partitionBy("slot_").orderBy("guest_", F.col(id_col).asc_nulls_first(), *[F.col(c) for c in carry])
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carry}).where("guest_ = 0").drop("guest_", "slot_")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))


def op1_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness (an exact digest: 1 or 0)."""
    from tessera.io import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = digests(docs, "text")
    pairs = with_next(own.drop("canon"), "doc_id", ["text", "h1", "h2", "sha"])
    pairs = pairs.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    hashed = digests(pairs, "edited", "edited_").select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        *[f"{p}{c}" for p in ("", "edited_", "next_") for c in ("h1", "h2", "sha")],
    )
    hashed = cut_lineage(hashed)
    clashes = cut_lineage(collided(hashed, own.select("h1", "h2", "canon"), ("", "edited_"), 128))
    out = with_fingerprints(hashed, clashes, ("", "edited_", "next_"))
    like = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"),
    )

"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by leading bits of a 60-bit hash of the id. A bucket splits on its next bit only
while it holds more bytes than the limit, so the shard of a row is its shortest hash prefix whose rows fit.
Byte totals of fine hash bins are added up to all their prefixes, which finds that prefix without reading
rows again; bins that are still too large go through another round with more bits.

Defined cases: a null text has 0 bytes; a null id hashes as the empty text; rows with equal ids share a
hash and cannot be split, so a bucket with one hash value is final even above the limit (``over_limit``);
an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.io import cut_lineage

KEY_BITS, MORE_BITS = 60, 8


def hash_key(id_col: Column) -> Column:
    """Leading 60 bits of MD5 of the id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col("key_"), F.lit(KEY_BITS) - bits)


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """One DataFrame (bin_bits, bin, depth, prefix, shard_bytes, shard_docs, over_limit) for each round of splitting.

    rows: (key_, n_bytes). A round covers the bins that no earlier round could settle.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, bits = 0, min(20, math.ceil(math.log2(max(1.0, total / limit))) + 4)
    rounds, pending = [], rows
    while True:
        bins = cut_lineage(
            pending.groupBy(_prefix(F.lit(bits)).alias("bin"))
            .agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("key_").alias("lo"), F.max("key_").alias("hi"))
        )
        up = bins.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits))))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("bin"), F.lit(bits) - F.col("depth")))
        sums = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).drop("lo", "hi")
        found = up.select("bin", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("bin").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        found = cut_lineage(found.select(F.lit(bits).alias("bin_bits"), "bin", "s.*").withColumn("over_limit", F.col("shard_bytes") > limit))
        rounds.append(found)
        left = cut_lineage(bins.join(found, "bin", "left_anti").select("bin"))
        if left.isEmpty():
            return rounds
        pending = pending.withColumn("bin", _prefix(F.lit(bits))).join(left, "bin", "left_semi").drop("bin")
        base, bits = bits + 1, min(KEY_BITS, bits + MORE_BITS)


def shards(df: DataFrame, limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_docs, over_limit): shard is the prefix as a bit string."""
    rows = df.select(F.col(id_col), hash_key(F.col(id_col)).alias("key_"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    rows = cut_lineage(rows)
    parts = []
    for found in directory(rows, limit):
        bits = found.select("bin_bits", "bin", "depth", "prefix", "shard_bytes", "shard_docs", "over_limit")
        n = found.select("bin_bits").head()
        if n is None:
            continue
        parts.append(rows.withColumn("bin", _prefix(F.lit(n[0]))).join(bits.drop("bin_bits"), "bin"))
    if not parts:
        parts = [rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("depth", "int"), ("prefix", "long"), ("shard_bytes", "long"), ("shard_docs", "long"), ("over_limit", "boolean"))])]
    out = reduce(DataFrame.unionByName, [p.drop("bin") for p in parts])
    name = F.call_function("lpad", F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))
    return out.select(id_col, "n_bytes", name.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_docs", "over_limit")


def write_shards(df: DataFrame, limit: int, path: str, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the rows of df as Parquet, one folder for each shard.

    A row finds its shard by its own hash and the directory, so null and repeated ids keep their rows and no row meets
    another one. The directory of the first round has at most 2**20 bins and is broadcast; later rounds, of crowded bins,
    are ordinary joins.
    """
    sizes = cut_lineage(df.select(hash_key(F.col(id_col)).alias("key_"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")))
    parts = []
    for i, found in enumerate(directory(sizes, limit)):
        n = found.select("bin_bits").head()
        if n is None:
            continue
        name = F.call_function("lpad", F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0"))
        bins = found.select(F.col("bin").alias("bin_"), F.concat(F.lit("b"), name).alias("shard"))
        place = F.call_function("shiftrightunsigned", hash_key(F.col(id_col)), F.lit(KEY_BITS - n[0]))
        parts.append(df.withColumn("bin_", place).join(F.broadcast(bins) if i == 0 else bins, "bin_").drop("bin_"))
    rows = reduce(DataFrame.unionByName, parts) if parts else df.withColumn("shard", F.lit("b"))
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


#: Bytes of text in one shard.
LIMIT = 1 << 20


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document under the byte limit."""
    from tessera.io import table

    return shards(table(spark, sf_dir, "documents").select("doc_id", "text"), LIMIT)


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key_
  FROM documents
), up AS (
  SELECT key_, n_bytes, depth, key_ >> CAST(60 - depth AS INTEGER) AS prefix FROM d, (SELECT unnest(generate_series(0, 60)) AS depth)
), fits AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM up
  GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR min(key_) = max(key_)
), best AS (
  SELECT up.key_, min(up.depth) AS depth FROM up JOIN fits USING (depth, prefix) GROUP BY up.key_
)
SELECT d.doc_id, d.n_bytes, CASE WHEN best.depth = 0 THEN '' ELSE lpad(bin(d.key_ >> CAST(60 - best.depth AS INTEGER)), CAST(best.depth AS INTEGER), '0') END AS shard,
  CAST(best.depth AS INTEGER) AS depth, fits.shard_bytes, fits.shard_docs, fits.shard_bytes > {LIMIT} AS over_limit
FROM d JOIN best USING (key_) JOIN fits ON fits.depth = best.depth AND fits.prefix = d.key_ >> CAST(60 - best.depth AS INTEGER)
"""

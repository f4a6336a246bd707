"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

Weights are token shares raised to an exponent and normalised. The exponent is bisected until the
entropy of the weights reaches a target, or no source is repeated more often than a limit. The token budget is a
parameter; without one it keeps the largest source exactly once, so every document stays and small sources are
repeated. A smaller budget takes part of the blocks of a source, a larger one repeats all sources more often.
Each source is cut into hash blocks; every epoch of a source is one pseudo-random permutation of its
blocks, and the last, partial epoch takes blocks in that order up to the token budget (to the nearest block).

Defined cases: null texts and texts without words have 0 tokens and are kept with their block; a null
source is a source of its own; a source with 0 tokens is kept once; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.io import cut_lineage

BLOCKS, GRID, PASSES = 1024, 63, 5


def n_tokens(text: Column) -> Column:
    """Words: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def block_of(source: Column, doc_id: Column, blocks: int = BLOCKS) -> Column:
    """The hash block of a document within its source."""
    return F.pmod(_hash(source, doc_id), F.lit(blocks)).cast("int")


def find_exponent(totals: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in 0..1: the least that keeps repetitions within the limit, or the greatest that keeps the entropy.

    totals: (tokens), one row for each source. Every pass evaluates a grid of exponents in one job, which
    equals six halvings of the interval; only the figures of the grid come to the driver.
    """
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    used = totals.where("tokens > 0").withColumn("ln_t", F.log("tokens"))
    top = used.agg(F.max("ln_t")).first()[0]
    if top is None:
        return 1.0
    used = used.withColumn("ln_t", F.col("ln_t") - F.lit(top))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / (GRID + 1)
        grid = F.array(*[F.lit(low + step * i) for i in range(GRID + 2)])
        each = used.select("ln_t", F.posexplode(grid).alias("i", "a"))
        power = F.exp(F.col("a") * F.col("ln_t"))
        found = each.groupBy("i").agg(
            F.max(F.exp((F.col("a") - 1) * F.col("ln_t"))).alias("repeats"),
            (F.log(F.sum(power)) - F.sum(power * F.col("a") * F.col("ln_t")) / F.sum(power)).alias("entropy"),
        )
        rows = sorted(found.collect())
        if repetition_limit is not None:
            ok = [r.i for r in rows if r.repeats <= repetition_limit * (1 + 1e-12)]
            at = min(ok, default=GRID + 1)
            low, high = low + step * max(0, at - 1), low + step * at
        else:
            at = max((r.i for r in rows if r.entropy >= target_entropy * (1 - 1e-12)), default=0)
            low, high = low + step * at, low + step * min(GRID + 1, at + 1)
        if low == high:
            break
    return high if repetition_limit is not None else low


def mix(df: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text", blocks: int = BLOCKS, budget: int | None = None) -> DataFrame:
    """(id, source, tokens, epoch, block, block_rank): one row for each copy of a document in the mixture.

    The budget of a source is met to half a block, which is 1 / blocks of the source on average; give more blocks for a
    finer cut or larger sources.
    """
    docs = df.select(
        F.col(id_col), F.col(source).alias("source"), n_tokens(F.col(text)).alias("tokens"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("key_"),
        block_of(F.col(source), F.col(id_col), blocks).alias("block"),
    )
    docs = cut_lineage(docs)
    dealt = cut_lineage(docs.groupBy("key_", "block").agg(F.sum("tokens").alias("block_tokens")))
    totals = cut_lineage(dealt.groupBy("key_").agg(F.sum("block_tokens").alias("tokens")))
    exponent = find_exponent(totals, repetition_limit, target_entropy)
    most = totals.agg(F.max("tokens")).first()[0] or 0
    times = F.when(F.col("tokens") > 0, F.exp(F.lit(1 - exponent) * (F.lit(math.log(most or 1)) - F.log("tokens")))).otherwise(F.lit(1.0))
    plan = totals.select("key_", times.alias("times"), F.col("tokens").alias("source_tokens"))
    if budget is not None:
        implied = plan.agg(F.sum(F.col("times") * F.col("source_tokens"))).first()[0] or 1.0
        plan = plan.withColumn("times", F.when(F.col("source_tokens") > 0, F.col("times") * F.lit(budget / implied)).otherwise(F.col("times")))
    plan = plan.withColumns({"full": F.floor("times").cast("int"), "rest": (F.col("times") - F.floor("times")) * F.col("source_tokens")})
    order = Window.partitionBy("key_", "epoch").orderBy("mark", "block")
    turns = (
        dealt.join(plan, "key_")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
        .withColumn("mark", _hash(F.col("key_"), F.col("epoch"), F.col("block")))
        .withColumns({"block_rank": F.row_number().over(order), "upto": F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        .where((F.col("epoch") < F.col("full")) | ((F.col("rest") > 0) & (F.col("upto") - F.col("block_tokens") / 2 <= F.col("rest"))))
        .select("key_", "block", "epoch", "block_rank")
    )
    return docs.join(turns, ["key_", "block"]).select(id_col, "source", "tokens", "epoch", "block", "block_rank")


#: No source is repeated more often than this.
REPEATS = 2.0


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mixture of all sources."""
    from tessera.io import table

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetition_limit=REPEATS)


def mixing_sql(documents: str = "documents", columns: str = "doc_id, source, tokens, epoch, block, block_rank") -> str:
    """DuckDB SQL of the mixture; the exponent for a repetition limit has a closed form."""
    number = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return rf"""
WITH d AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS tokens, coalesce('s' || source, 'n') AS key_,
    CAST({number.format("coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')")} % {BLOCKS} AS INTEGER) AS block
  FROM {documents}
), dealt AS (
  SELECT key_, block, sum(tokens) AS block_tokens FROM d GROUP BY ALL
), totals AS (
  SELECT key_, sum(block_tokens) AS tokens FROM dealt GROUP BY ALL
), e AS (
  SELECT greatest(0.0, coalesce(1 - ln({REPEATS}) / nullif(ln(max(tokens)) - ln(min(tokens)), 0), 0.0)) AS a, max(tokens) AS most FROM totals WHERE tokens > 0
), plan AS (
  SELECT key_, tokens AS source_tokens, CASE WHEN tokens > 0 THEN exp((1 - a) * (ln(most) - ln(tokens))) ELSE 1.0 END AS times FROM totals, e
), turns AS (
  SELECT key_, block, epoch, times, source_tokens, block_tokens,
    row_number() OVER w AS block_rank, sum(block_tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, {number.format("key_ || '|' || epoch || '|' || block")} AS mark FROM (
    SELECT *, unnest(generate_series(0, CAST(floor(times + 1e-9) AS INTEGER))) AS epoch FROM dealt JOIN plan USING (key_)))
  WINDOW w AS (PARTITION BY key_, epoch ORDER BY mark, block)
)
SELECT {columns} FROM (
  SELECT d.*, CAST(epoch AS INTEGER) AS epoch, CAST(block_rank AS INTEGER) AS block_rank FROM d JOIN turns USING (key_, block)
  WHERE epoch < floor(times + 1e-9) OR (times - floor(times + 1e-9) > 1e-9 AND upto - block_tokens / 2 <= (times - floor(times + 1e-9)) * source_tokens)
)
"""

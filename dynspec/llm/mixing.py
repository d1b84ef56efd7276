"""Mixing sources to target weights by systematic sampling.

Each source gets a share of the mix by weight, up to a cap of ``max_repeat`` times its size; what a capped source cannot take
goes to the others by weight. Within a source each document expects ``target / source size`` copies; expected copies are summed along an order of the
documents, one random offset is added, and a document is emitted once for each integer that its interval crosses.
The order is by size, then by a hash of the id, so any stretch of it is a fair sample of sizes and the words taken stay near the target
whatever the spread of sizes.

All documents of a source expect the same number of copies, so the running sum is a position in the source times that number.
Positions come from counts of small groups (size and hash of the id), added up in two levels, so no task holds a source. A group is
one size's documents in one of 16 ** ``BUCKET_DIGITS`` hash buckets; the first level has a row per size of a source,
the second a row per bucket.

Defined results: a null text has size 0; the null source is a source of its own, last in order; documents without words
take part as others do, with 0 words; a source without words has target 0 and none of its documents is emitted; of repeated
rows each is a document of its own; an empty table gives an empty mix. Extra columns are kept as they are; names that start
with ``_mix_`` are reserved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 7
#: Hex digits of a row's hash that make its bucket, and of a source's that make its offset: multiples of 1 / 16**5, so that
#: sums with a whole number of copies are exact.
BUCKET_DIGITS, OFFSET_DIGITS = 3, 5


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source, with ``target``.

    Sources by code point, null last, have ``weights`` in turn. In the order of cap over weight, the capped sources come first: the
    level at which the others share what is left is found with running sums. One row per source is what a mix is
    configured by, so this table is small beside the documents.
    """
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("cap_level", F.col("source").asc_nulls_last())
    every, before = W.partitionBy(F.lit(0)), by_level.rowsBetween(W.unboundedPreceding, -1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("cap_level", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("sharing", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source whose cap is above the level shared by it and all after it; none: every source is at its cap.
    rows = rows.withColumn("level", F.min(F.when(F.col("left") / F.col("sharing") <= F.col("cap_level"), F.struct("cap_level", "source", (F.col("left") / F.col("sharing")).alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``_mix_size``, ``_mix_source_size``, ``_mix_target`` and ``_mix_copies``: how often the mix takes each row."""
    kept = keep if keep is not None else docs.columns
    # Null sorts last and joins as any other key.
    key = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    rank = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(doc_id).cast("string")))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], key.alias("_mix_key"), words_in(text).alias("_mix_size"), rank.alias("_mix_rank"), F.col(doc_id).alias("_mix_id"))
    rows = rows.withColumn("_mix_bucket", F.left("_mix_rank", F.lit(BUCKET_DIGITS)))
    groups = stored(rows.groupBy("_mix_key", "_mix_size", "_mix_bucket").agg(F.count("*").alias("n")), "mix-groups")
    by_size = groups.groupBy("_mix_key", "_mix_size").agg(F.sum("n").alias("n"))
    earlier = W.unboundedPreceding, -1
    sized = by_size.withColumn("first", F.sum("n").over(W.partitionBy("_mix_key").orderBy("_mix_size").rowsBetween(*earlier)))
    total = by_size.groupBy(F.col("_mix_key").alias("source")).agg(F.sum(F.col("n") * F.col("_mix_size")).alias("source_size"))
    goal = targets(total, weights=weights, share=share, max_repeat=max_repeat).select(F.col("source").alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    inside = groups.withColumn("inner", F.sum("n").over(W.partitionBy("_mix_key", "_mix_size").orderBy("_mix_bucket").rowsBetween(*earlier)))
    placed = inside.join(sized.join(goal, "_mix_key").drop("n"), ["_mix_key", "_mix_size"])
    placed = placed.withColumn("_mix_base", F.coalesce("first", F.lit(0)) + F.coalesce("inner", F.lit(0))).drop("first", "inner", "n")
    group = ["_mix_key", "_mix_size", "_mix_bucket"]
    met = rows.join(placed, group).withColumn("_mix_at", F.col("_mix_base") + F.row_number().over(W.partitionBy(*group).orderBy("_mix_rank", "_mix_id")))
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "_mix_key"))
    offset = F.conv(F.left(digest, F.lit(OFFSET_DIGITS)), 16, 10).cast("double") / float(16**OFFSET_DIGITS)
    each = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("_mix_at") * each + offset) - F.floor((F.col("_mix_at") - 1) * each + offset)
    most = math.ceil(max_repeat)
    return met.select(*[F.col(f"`{c}`") for c in kept], "_mix_size", "_mix_source_size", "_mix_target", F.least(copies, F.lit(most)).cast("int").alias("_mix_copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as often as it takes them, without its own columns."""
    return mixed.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*[F.col(f"`{c}`") for c in mixed.columns if not c.startswith("_mix_")])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS cap_level FROM w),
l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap_level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap_level, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sharing FROM c),
v AS (SELECT arg_min(rest / sharing, cap_level) AS level FROM l WHERE rest / sharing <= cap_level),
t AS (SELECT k, source_size, least(cap, coalesce(level * weight, cap))::DOUBLE AS target FROM l, v),
p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
  ('0x' || left(md5('7|' || k), 5))::BIGINT / 1048576.0::DOUBLE AS off,
  row_number() OVER (PARTITION BY k ORDER BY size, md5('7|' || doc_id::VARCHAR), doc_id) AS pos FROM d JOIN t USING (k))
SELECT doc_id, size, source_size, target, (least(floor(pos * each + off) - floor((pos - 1) * each + off), 2) * size)::BIGINT AS taken FROM p
"""

"""A corpus pipeline of five of the training-data operators; each stage works on all that the one before it kept.

Defined results: every stage keeps the columns it gets, whatever others are there, and helper columns take names that are not among them; names that start with ``_line_`` or ``_mix_`` are
reserved, as in those operators. An empty table stays empty. Null texts are empty ones, and null ids are kept apart: such rows leave only by their text (quality, lines, contamination).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dynspec.llm import decontaminate, linededup, mixing, quality, similar
from dynspec.llm.common import shuffles_freed, stored, table, text_key

KEEP_FROM = 0.5
#: Bits in which fingerprints of near-duplicates may differ, as in op3_simhash.
DISTANCE = 2


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many more underscores as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _free(docs, "_score")
    return quality.with_score(docs, model, score=score).where(F.col(score) >= KEEP_FROM).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; those of which nothing is left go."""
    removed = _free(docs, "n_removed")
    cleaned = linededup.remove_boilerplate(docs, removed=removed)
    cleaned = cleaned.where((F.col(removed) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document with the smallest id, once; rows without an id stay as they are. Where an id has several texts, each group of them keeps one.

    Texts link whose SimHash fingerprints differ in ``DISTANCE`` bits or fewer, found by the index of ``simhash``, and so do looser copies with a Jaccard similarity of 0.8, which no index of fingerprints finds.
    """
    key = ["doc_id", _free(docs, "_a"), _free(docs, "_b")]
    with shuffles_freed(spark):
        found = similar.similar_documents(docs, distance=DISTANCE).where(F.col("doc_id") == F.col("component_id"))
        kept = found.groupBy("doc_id", "root").agg(F.min(F.struct("a", "b")).alias("k"))
        kept = stored(kept.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "k.a", "k.b"), key)]), "kept")
    of = text_key(F.col("text"))
    keyed = docs.withColumns({key[1]: of["a"], key[2]: of["b"]})
    once = keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)  # one exchange of texts serves both
    return once.unionAll(docs.where(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    name = _free(docs, "_id")
    gone = stored(hits.where("n_hit > 0").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(mixing.mix(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs

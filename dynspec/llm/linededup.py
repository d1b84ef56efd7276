"""Cross-site line deduplication by distinct-site spread.

Every line is known by a 128-bit hash. A HyperLogLog sketch of the sites that carry it is built per line hash and merged by the
aggregation, so a line on millions of pages costs each task one sketch. Lines whose estimate is clearly above ``min_sites`` are boilerplate,
lines clearly below are not, and those within ``MARGIN`` standard errors get an exact distinct count. Boilerplate goes
from every document but the one with the smallest id that has it, so no text is lost to the corpus.

Defined results: lines are parted by \\n and compared without surrounding spaces; lines of fewer than ``min_chars`` code points are never
removed, blank ones included; the null site is a site; a null id is never the smallest unless all are null, and then the line goes everywhere; a null
text stays null; a text that loses all its lines becomes empty; repeated rows are treated alike; an empty table stays empty.
All input columns are kept; names that start with ``_line_`` are reserved, and ``n_removed`` (or the name given) is added or replaced; lines and texts of any length are taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_key

MIN_SITES = 5
MIN_CHARS = 20
LOG2_REGISTERS = 12
MARGIN = 4


def _lines(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    """``(id, site, ta, tb, at, a, b)``: each line that is long enough, by its place in its text and its key."""
    site_key = F.when(F.col(site).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(site).cast("string")))
    rows = docs.select(F.col(doc_id).alias("id"), site_key.alias("site"), text_key(F.col(text)).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return rows.select("id", "site", F.col("t.a").alias("ta"), F.col("t.b").alias("tb"), "at", text_key(F.col("line")).alias("l")).select("id", "site", "ta", "tb", "at", "l.a", "l.b")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(a, b, first)`` of each line on ``min_sites`` sites or more; first is the smallest id that has it."""
    error = 1.04 / math.sqrt(1 << LOG2_REGISTERS)
    low, high = math.floor(min_sites * (1 - MARGIN * error)), math.ceil(min_sites * (1 + MARGIN * error))
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG2_REGISTERS)).alias("sites"), F.min("id").alias("first"))
    wide = stored(spread.where(F.col("sites") >= low), "wide-lines")
    near = wide.where(F.col("sites") <= high).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = wide.where(F.col("sites") > high).select("a", "b", "first")
    return sure.unionAll(wide.join(exact.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "first"))


def remove_boilerplate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, removed: str = "n_removed") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and how many in a column ``removed``."""
    lines = _lines(docs, doc_id, text, site, min_chars)
    found = stored(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(found, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("_line_id"), F.col("ta").alias("_line_a"), F.col("tb").alias("_line_b")).agg(F.collect_set("at").alias("_line_at"))
    gone = stored(gone, "lines-gone")  # so that both sides of the join with the texts are plain exchanges
    rows = docs.drop(removed).withColumn("_line_key", text_key(F.col(text)))
    same = F.col(doc_id).eqNullSafe(F.col("_line_id")) & (F.col("_line_key.a") == F.col("_line_a")) & (F.col("_line_key.b") == F.col("_line_b"))
    met = rows.join(gone, same, "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_line_at", i)), "\n")
    met = met.withColumn(text, F.when(F.col("_line_at").isNull(), F.col(text)).otherwise(left))
    return met.withColumn(removed, F.when(F.col("_line_at").isNull(), F.lit(0)).otherwise(F.size("_line_at")).cast("long")).drop("_line_key", "_line_id", "_line_a", "_line_b", "_line_at")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce('0' || source, '1') AS site, string_split(text, chr(10)) AS w FROM documents),
l AS (SELECT r, doc_id, site, i, trim(w[i]) AS line FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE length(trim(w[i])) >= {MIN_CHARS}),
b AS (SELECT line, min(doc_id) AS first FROM l GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
g AS (SELECT r, list(i) AS gone FROM l JOIN b USING (line) WHERE doc_id IS DISTINCT FROM first GROUP BY r)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), chr(10)) END AS text,
  coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN g USING (r)
"""

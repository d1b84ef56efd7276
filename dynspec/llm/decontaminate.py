"""Benchmark decontamination: an exact, prefix-filtered set join in built-in functions.

Each benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). The
tokens of a window are its 5-word shingles (the whole window if it has fewer words). A document holds a window only if it
holds all the window's shingles, so one necessary shingle is enough to propose it: the rarest in the documents, which
makes the fewest candidates. The steps:

1. one pass over the texts finds every place of any benchmark shingle: its number in the text and its hash, no words;
2. places give each shingle's frequency, and that order gives each window its prefix shingle;
3. places meet windows on the prefix shingle; the shingle's offset fixes where the window would start, and windows
   that would leave the document go (length and positional bounds);
4. the words of proposed texts alone are fetched and compared, so the result does not rest on hashes. Item ids come in after that, by a join.

The first pass meets a broadcast table: all benchmark shingles while these take less than ``BROADCAST_BYTES``, else a bitmap of ``BITMAP_BITS`` bits
of their hashes, whose size does not depend on theirs; what passes it is joined with the shingles exactly. Either way the places of texts of any length cross no exchange with
their words.

Defined results: null texts and items have no words; an item with a null id marks words as hit but is not counted or
listed; repeated rows come back as often as they went in, repeated items count once; empty tables give no hits, or
no rows; texts of any length are taken whole, a row a place; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, text_key

SHINGLE = 5
WINDOW = 10
#: Most bytes of a table that is broadcast; a row of one or two longs takes about ROW_BYTES.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64
#: 64 to a row of the broadcast bitmap.
BITMAP_BITS = 1 << 24
#: Marks the row that each text has whatever its shingles; ``at`` is -1 there.
EVERY = 0
#: What separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAKS), "")


def _shingle(size: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(size), *words[:size])


def _zipped(w: str, longest: int) -> Column:
    """From an array of words, for each place the words ``w0``, ``w1`` ... from there on, null beyond the end."""
    return F.arrays_zip(*[F.expr(f"slice({w}, {j + 1}, size({w}))").alias(f"w{j}") for j in range(longest)])


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``(win, item_id, k, ww)``: distinct windows of each item; ww their k words, win a 128-bit key of these."""
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    cut = f"transform(sequence(0, greatest(0, size(w) - {window})), i -> slice(w, i + 1, {window}))"
    key = F.struct(F.xxhash64("ww").alias("a"), F.xxhash64(F.lit(1), "ww").alias("b"))
    return rows.select("item_id", F.expr(f"explode({cut})").alias("ww")).distinct().select(key.alias("win"), "item_id", F.size("ww").alias("k"), "ww")


def _shingles(windows: DataFrame) -> DataFrame:
    """``(win, k, o, s, h)``: hash h of each shingle of s words at offset o of a distinct window."""
    size = F.least("k", F.lit(SHINGLE)).alias("s")
    spots = windows.select("win", "k", size, F.posexplode(_zipped("ww", SHINGLE)).alias("o", "x")).where("o + s <= k")
    hashes = [_shingle(n, [F.col(f"x.w{j}") for j in range(n)]) for n in range(1, SHINGLE + 1)]
    return spots.select("win", "k", "o", "s", F.element_at(F.array(*hashes), F.col("s")).alias("h"))


def _bitmap(wanted: DataFrame) -> DataFrame:
    """``(cell, bits)``: which of ``BITMAP_BITS`` places the hashes take; BITMAP_BITS / 64 rows at most."""
    return wanted.select(F.shiftright(F.pmod("h", F.lit(BITMAP_BITS)), 6).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP_BITS}) % 64 AS int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))


def _places(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``(doc_id, a, b, n, at, h)``: of each text a row with ``at`` -1, and one for each place where a wanted shingle stands (or may, if they are many)."""
    few = wanted.count() * ROW_BYTES <= BROADCAST_BYTES
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w")).select("doc_id", "key.a", "key.b", F.size("w").alias("n"), "w")
    longest = max(sizes)
    # The first element is no place: it brings the row of the text itself through the same pass.
    zipped = F.concat(F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{j}") for j in range(longest)])), _zipped("w", longest))
    spots = rows.select("doc_id", "a", "b", "n", F.posexplode(zipped).alias("at", "x")).withColumn("at", F.col("at") - 1)
    hashes = [F.when(F.col(f"x.w{n - 1}").isNotNull(), _shingle(n, [F.col(f"x.w{j}") for j in range(n)])) for n in sizes]
    of_text = F.when(F.col("at") < 0, F.lit(EVERY).cast("long"))
    if len(hashes) == 1:
        spots = spots.withColumn("h", F.coalesce(of_text, hashes[0]))
    else:
        spots = spots.withColumn("h", F.explode(F.array(F.coalesce(of_text, hashes[0]), *hashes[1:])))
    spots = spots.select("doc_id", "a", "b", "n", "at", "h").where("h IS NOT NULL")
    marked = wanted.select("h").unionAll(wanted.sparkSession.range(1).select(F.lit(EVERY).cast("long").alias("h"))).distinct()
    if few:
        return spots.join(F.broadcast(marked), "h").select("doc_id", "a", "b", "n", "at", "h")
    met = spots.withColumn("cell", F.shiftright(F.pmod("h", F.lit(BITMAP_BITS)), 6)).join(F.broadcast(_bitmap(marked)), "cell")
    return met.where(f"getbit(bits, cast(pmod(h, {BITMAP_BITS}) % 64 AS int)) = 1").select("doc_id", "a", "b", "n", "at", "h")


def find_hits(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` of every row: words, words inside an occurring window, and the ids (as strings, sorted) of items with one."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held_by = stored(windows_of(items, item_id, item_text, window), "windows")
    windows = stored(held_by.groupBy("win").agg(F.first("k").alias("k"), F.first("ww").alias("ww")), "distinct-windows")
    shingles = stored(_shingles(windows), "shingles")
    wanted = shingles.select("h").distinct()
    rows = shingles.count()
    sizes = sorted(r[0] for r in shingles.select("s").distinct().collect())  # 5 values at most
    if not sizes:
        none = F.array().cast("array<string>")
        return docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    places = stored(_places(docs, wanted, sizes), "places")
    base = places.where("at < 0").select("doc_id", "a", "b", F.col("n").cast("long").alias("n_words"))
    spots = stored(places.where("at >= 0").select("a", "b", "n", "at", "h").join(shingles.select("h"), "h", "left_semi").distinct(), "spots")
    counts = spots.groupBy("h").count()
    # The prefix: of each window's shingles the rarest; windows with a shingle that never occurs cannot occur.
    ranked = shingles.join(counts, "h", "left")
    prefix = ranked.groupBy("win", "k").agg(F.min(F.struct("count", "h", "o")).alias("p"), F.min(F.col("count").isNotNull()).alias("all")).where("all")
    asked = stored(prefix.select("win", "k", "p.h", "p.o"), "prefixes", rows)
    likely = spots.join(asked, "h").withColumn("start", F.col("at") - F.col("o")).where("start >= 0 AND start + k <= n")
    likely = stored(likely.select("a", "b", "start", "k", "win").distinct(), "likely")
    asking = stored(likely.select("a", "b").distinct(), "proposed")
    rows = likely.count()
    few = rows * ROW_BYTES <= BROADCAST_BYTES
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text").select("key.a", "key.b", "text")
    fetched = keyed.join(F.broadcast(asking) if few else asking, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("text").alias("text"))
    fetched = stored(fetched.select("a", "b", words_of(F.col("text")).alias("w")), "proposed-texts")
    met = likely.join(windows.select("win", "ww"), "win").join(fetched, ["a", "b"])
    held = stored(met.where(F.slice("w", F.col("start") + 1, F.col("k")) == F.col("ww")).select("a", "b", "start", "k", "win"), "held")
    spans = held.select("a", "b", "start", "k").distinct()
    hit = spans.select("a", "b", F.explode(F.sequence("start", F.expr("start + k - 1"))).alias("at")).distinct().groupBy("a", "b").agg(F.count("*").alias("n_hit"))
    named = held.select("a", "b", "win").distinct().join(held_by.where("item_id IS NOT NULL").select("win", "item_id"), "win").select("a", "b", "item_id").distinct()
    named = named.groupBy("a", "b").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    # Stored, so that both sides of the join with the rows are plain exchanges and a text with many copies can be split.
    per_text = stored(hit.join(named, ["a", "b"], "left"), "per-text", rows)
    out = base.join(per_text, ["a", "b"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i+9] AS ww FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(ww) AS k FROM win),
spots AS (SELECT doc_id, k, i, w[i:i+k-1] AS ww FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
held AS (SELECT doc_id, i, k, item_id FROM spots JOIN win USING (ww)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM held)) GROUP BY 1),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM held GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

"""Near-duplicates by SimHash.

A document's 64-bit fingerprint is the bitwise majority of its shingles' XXH64. Two fingerprints link when few bits
differ. Candidates come from an inverted index over byte positions: fingerprints that differ in at most ``d`` bits
share at least ``8 - d`` of their 8 positional bytes, whichever those are. Postings of single bytes would hold a 256th of all
rows each, so a posting's key is a set of positions with their bytes: the positions fall into ``d + 2`` blocks, and any two of them
make a key; of linked fingerprints at least two blocks agree. In each posting list the shared positional bytes of every pair are
tallied, pairs under the guaranteed minimum go, and the rest are verified bit by bit. (A pair that passes the bit check has that minimum in any case: the tally is the
cheaper test before it, and the keys of several bytes take the place of counting over lists of single ones.)

Equal fingerprints are one entry of the index, so copies make no pairs. Lists above ``LIST_LIMIT`` entries are not
enumerated: their fingerprints are indexed by themselves and their 64 one-bit neighbours instead, which is exact for distances up to 2,
because two fingerprints within 2 bits have a common neighbour; such a list has 65 entries at most.

Defined results: a null text is the empty one; texts without words have fingerprint zero, which links as any other;
a component's id is its smallest id that is not null (null if there is none); repeated rows come back as often as they
went in; an empty table gives an empty one; of the input only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table
from .components import components

LIST_LIMIT = 64
SEED = 42
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    # bytes.split() splits at exactly \x20 and \x09-\x0D, and bytes.lower() changes A-Z alone.
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    line, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> bytes:
    """8 bytes, the highest first: a bit is set if more than half of the hashes have it."""
    tally = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK].astype(">u8")
        tally += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * tally > len(hashes)).tobytes()


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint of one text; zero without words."""
    return int.from_bytes(majority(shingle_hashes(text, words)), "big", signed=True)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _keys(fp: Column, distance: int) -> list[Column]:
    """A key of each pair of blocks of byte positions."""
    blocks = [x.tolist() for x in np.array_split(np.arange(8), distance + 2)]
    masks = [sum(0xFF << (8 * p) for p in block) for block in blocks]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.struct(F.lit(n).alias("n"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("bytes")) for n, (i, j) in enumerate(combinations(range(len(blocks)), 2))]


def shared_bytes(a: Column, b: Column) -> Column:
    """At how many of the 8 byte positions both fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(255) == 0).cast("int") for i in range(8))


def links(fps: DataFrame, distance: int = 2, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints of ``fps(fp)`` within ``distance`` (at most 2) differing bits."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    postings = fps.select("fp", F.explode(F.array(*_keys(F.col("fp"), distance))).alias("k")).select("fp", "k.n", "k.bytes")
    lists = stored(postings.groupBy("n", "bytes").count().where("count > 1"), "postings")
    short = postings.join(lists.where(F.col("count") <= list_limit), ["n", "bytes"]).groupBy("n", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    pair = "explode(flatten(transform(sequence(1, size(l) - 1), i -> transform(slice(l, i + 1, size(l)), y -> struct(l[i - 1] AS a, y AS b)))))"
    pairs = short.select(F.expr(pair).alias("p")).select("p.a", "p.b")
    near = pairs.where(shared_bytes(F.col("a"), F.col("b")) >= 8 - distance).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    long = lists.where(F.col("count") > list_limit).select("n", "bytes")
    if not long.isEmpty():
        crowded = postings.join(long, ["n", "bytes"], "left_semi").select("fp").distinct()
        flips = [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)]
        around = crowded.select("fp", F.explode(F.array("fp", *flips)).alias("mid")).groupBy("mid").agg(F.array_sort(F.collect_list("fp")).alias("l")).where("size(l) > 1")
        star = around.select(F.col("l")[0].alias("a"), F.expr("explode(slice(l, 2, size(l)))").alias("b"))
        near = near.unionAll(star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``."""
    marked = stored(fingerprints(docs, doc_id=doc_id, text=text, words=words), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")

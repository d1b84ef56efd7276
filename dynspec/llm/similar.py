"""Near-duplicates by similarity: a prefix-filtered join of shingle sets, exact.

Texts link whose sets of ``words``-word shingles (as 64-bit hashes) have a Jaccard similarity of ``similarity`` or more; no link is lost, whatever the edit:

1. a text's shingles are put into one order for all texts, rare ones first. Two sets that are similar enough have a common shingle among the
   first ``n - ceil(similarity * n) + 1`` of each, so these are the posting keys. Any order is exact; that of a sample's counts keeps lists short,
   because what many texts share (a passage, a licence) stands last and makes no key;
2. the sizes of both texts and the places of the common key bound their overlap, and pairs that cannot reach the similarity go;
3. lists of up to ``LIST_LIMIT`` entries give all their pairs. Longer ones first pair every entry with the one in which the common key comes first, so which has least of its own
   before what they share: of a group of edited copies the one nearest to the original. That settles such groups in a time linear in the list. Then entries that do not yet belong together meet, dealt out over many tasks
   and only where their sizes allow it: a set of ``n`` shingles with the key at place ``i`` can only be similar to sets of ``similarity * n`` to ``(n - i) * (1 + similarity) / similarity - n``, so of two sets the smaller has the key
   near its start (at ``front``). Lists without such an entry have no pairs;
4. of each set the parity of its shingles in buckets (a bit each, about one a shingle) is compared first: buckets of unlike parity are no more than the shingles that only one set has, so pairs
   with too many go, and no similar pair does;
5. pairs that are left are verified on their whole shingle sets.

With a ``distance`` texts also link whose SimHash fingerprints (``simhash.near_duplicates``) differ in so many bits or fewer: that index finds them first, and components are of the links of both kinds.

Defined results: equal texts are one entry and always together; texts without words link only to equal ones (with a ``distance`` all such texts link, as their fingerprint is zero); rows with a null id are kept apart from others
unless their text has another id; repeated rows come back as often as they went in; an empty table gives an empty one; only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import drop_stored, small_batches, stored, text_key
from .components import components

LIST_LIMIT = 32
#: Sizes of sets in long lists are told apart by this factor.
BAND = 1.05
#: Texts whose shingles are counted, about; least count of a common shingle there; how many common ones are broadcast at most.
SAMPLED = 1 << 15
COMMON = 4
MAX_COMMON = 1 << 18
#: Against rounding; only ever lets more pairs through to be verified.
EPSILON = 1e-6
#: Bytes of text hashed at a time.
CHUNK = 1 << 20

#: A byte in lower case if it belongs to a word, 0 if it separates words. UTF-8 has no byte 255, so it can stand for the byte 0.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[0] = 255
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_BASE = 0xD6E8FEB86659FD93
#: Powers of the base and of its inverse, modulo 2 ** 64, for each place of a chunk.
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of ``data`` (UTF-8 bytes) and where it starts; a word also ends at each of ``breaks`` (sorted).

    A word's hash is a polynomial of its bytes, read off running sums over the chunk; what a word has in later chunks is added to it.
    """
    sums, places, last, inside = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, False
    for at in range(0, len(data), CHUNK):
        b = _BYTES[data[at : at + CHUNK]]
        word = b > 0
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[0] &= not inside
        cut = breaks[np.searchsorted(breaks, at) : np.searchsorted(breaks, at + len(b))] - at
        first[cut] = word[cut]
        inside = bool(word[-1])
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _UP[: len(b)])])
        starts = np.flatnonzero(first)
        edge = running[np.concatenate([starts, [len(b)]])]
        if edge[0]:
            sums[-1][-1:] += edge[:1] * np.uint64(pow(_BASE, at - last, 1 << 64))
        if len(starts):
            sums.append(np.diff(edge) * _DOWN[starts])
            places.append(at + starts)
            last = at + int(starts[-1])
    return _mixed(np.concatenate(sums)), np.concatenate(places)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; words are parted by ASCII white space and A-Z are lower-cased. A text of fewer words is one
    shingle, one without words has none."""
    edges = np.zeros(len(texts) + 1, np.int64)
    raw = [x.as_buffer() if x.is_valid else b"" for x in texts.cast(pa.large_binary())]
    np.cumsum([len(x) for x in raw], out=edges[1:])
    h, starts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), edges[:-1])
    at = np.searchsorted(starts, edges).tolist()
    factors = [np.uint64(pow(_BASE, 2 * j + 1, 1 << 64)) for j in range(words)]
    n = max(0, len(h) - words + 1)
    every = _mixed(sum((h[j : j + n] * f for j, f in enumerate(factors)), np.zeros(n, np.uint64)))
    found = []
    for a, b in zip(at, at[1:]):
        few = _mixed(sum((h[a + j : a + j + 1] * f for j, f in enumerate(factors[: b - a])), np.full(1, b - a, np.uint64))) if a < b < a + words else every[a : max(a, b - words + 1)]
        found.append(np.unique(few))
    return found


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's shingles (sorted): as many as two similar sets must share one of. ``common`` has the frequent ones, sorted in its first row, and their ranks."""
    n = len(shingles)
    take = n - ceil(similarity * n - EPSILON) + 1
    if not common.shape[1]:
        return shingles[:take]
    at = np.minimum(np.searchsorted(common[0], shingles), common.shape[1] - 1)
    rank = np.where(common[0][at] == shingles, common[1][at].astype(np.int64) + 1, 0)
    return shingles[np.argsort(rank, kind="stable")[:take]]


def parities(shingles: np.ndarray) -> bytes:
    """The size of a set, then a bit for each of as many buckets (the next power of two): whether an odd number of shingles falls into it."""
    buckets = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.int64(len(shingles)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets can be similar enough by their ``parities``, as 64-bit words. Halves of the one with more buckets are laid on each other."""
    n, (p, q) = int(p[0]) + int(q[0]), sorted((p[1:], q[1:]), key=len)
    while len(p) < len(q):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum()) <= n * (1 - similarity) / (1 + similarity) + EPSILON


def are_similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sets are similar enough."""
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common >= similarity * (len(p) + len(q) - common)


def can_reach(similarity: float, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles whose first common one is at places i and j can be similar enough."""
    return F.least(n - i, m - j) >= (n + m) * (similarity / (1 + similarity)) - EPSILON


def most(similarity: float, n: Column, i: Column) -> Column:
    """The size of the largest set that can be similar to one of n shingles whose first common one is at place i."""
    return F.floor((n - i) * ((1 + similarity) / similarity) - n + EPSILON)


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The frequent shingles of a sample of ``texts(a, text)``, sorted, and their ranks by count."""

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

    step = max(1, ceil(texts.count() / SAMPLED))
    counts = texts.where(F.pmod("a", F.lit(step)) == 0).select("text").mapInArrow(shingles, "key long").groupBy("key").agg(F.count("*").alias("n"))
    counts = stored(counts.where(F.col("n") >= COMMON), "common")
    least, total = 1 << 62, 0
    for n, some in sorted(counts.groupBy("n").count().collect(), reverse=True):
        total += some
        if total > MAX_COMMON:
            break
        least = n
    found = counts.where(F.col("n") >= least).toArrow()  # MAX_COMMON rows at most
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    ranks = np.empty(len(keys), np.uint64)
    ranks[np.lexsort((keys, n))] = np.arange(len(keys), dtype=np.uint64)
    order = np.argsort(keys)
    return np.stack([keys[order], ranks[order]])


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, distance: int | None = None) -> DataFrame:
    """``(doc_id, a, b, root, component_id)`` of every row; a and b are the text's key, root is a number of the component in this run (null for a text that only null ids have)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("k"), F.col(text).cast("string").alias("text")).select("doc_id", "k.a", "k.b", "text")
    once = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.first("text").alias("text")).where(F.col("first").isNotNull())
    texts = stored(once.withColumn("node", F.monotonically_increasing_id()), "texts")
    alike = None
    if distance is not None:
        marked = simhash.near_duplicates(texts, doc_id="node", distance=distance)
        alike = stored(marked.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "simhash-links")
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, words))  # bounded by MAX_COMMON

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = shingle_sets(batch.column("text"), words)
            keys = [prefix(x, shared.value, similarity) if len(x) else x for x in whole]
            n = np.array([len(x) for x in keys], np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            nodes, sizes = batch.column("node").to_numpy(), np.array([len(x) for x in whole], np.int32)
            columns = [np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64), np.repeat(nodes, n), np.repeat(sizes, n), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "at"])

    def judged(pairs: DataFrame, form: Callable[[np.ndarray], bytes], judge: Callable[[np.ndarray, np.ndarray, float], bool], name: str) -> DataFrame:
        """The pairs ``(x, y)`` that ``judge`` keeps by the ``form`` of both sets."""

        def forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [form(x) for x in shingle_sets(batch.column("text"), words)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "h"])

        def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column("p"), batch.column("q"), strict=True)
                keep = [judge(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), similarity) for pair in both]
                yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        wanted = stored(pairs.select(F.col("x").alias("node")).unionAll(pairs.select("y")).distinct(), "wanted", 2 * pairs.count())
        formed = stored(texts.join(wanted, "node", "left_semi").select("node", "text").mapInArrow(forms, "node long, h binary"), name)
        whole = pairs.join(formed.select(F.col("node").alias("x"), F.col("h").alias("p")), "x").join(formed.select(F.col("node").alias("y"), F.col("h").alias("q")), "y")
        found = stored(whole.select("x", "y", "p", "q").mapInArrow(kept, "x long, y long"), f"{name}-kept")
        drop_stored(formed)
        return found

    def verified(pairs: DataFrame) -> DataFrame:
        likely = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "likely")
        close = judged(likely, parities, may_be_similar, "parities")
        return judged(close, np.ndarray.tobytes, are_similar, "shingle-sets").select(F.col("x").alias("a"), F.col("y").alias("b"))

    def near(sides: DataFrame) -> DataFrame:
        return sides.where(can_reach(similarity, F.col("xn"), F.col("xat"), F.col("yn"), F.col("yat"))).select("x", "y")

    def side(entries: DataFrame, name: str) -> DataFrame:
        return entries.select(*[c for c in entries.columns if c not in ("node", "n", "at", "root")], F.col("node").alias(name), *[F.col(c).alias(name + c) for c in ("n", "at", "root") if c in entries.columns])

    postings = stored(texts.select("node", "text").mapInArrow(post, "key long, node long, n int, at int"), "postings")
    front = most(similarity, F.col("n"), F.col("at")) >= F.col("n")
    lists = stored(postings.groupBy("key").agg(F.count("*").alias("size"), F.max(front).alias("open")).where("size > 1 AND open").drop("open"), "keys")
    met = stored(postings.join(lists, "key"), "lists")
    drop_stored(postings)
    short, long = met.where(F.col("size") <= LIST_LIMIT).drop("size"), met.where(F.col("size") > LIST_LIMIT).drop("size")
    links = verified(near(side(short, "x").join(side(short, "y"), "key").where("x < y")))
    links = links.unionAll(alike) if alike is not None else links

    first = stored(long.groupBy("key").agg(F.min(F.struct("at", "node", "n")).alias("l")).select("key", F.col("l.node").alias("x"), F.col("l.n").alias("xn"), F.col("l.at").alias("xat")), "first")
    links = stored(links.unionAll(verified(near(side(long, "y").join(first, "key").where("x <> y")))), "links")
    few = links.count()
    settled = stored(components(links, few), "settled", few)
    rooted = stored(long.join(settled, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("front", front), "rooted")
    # Of unlike entries of a list at most one is in its largest group; the others meet all that have a size they can be similar to, a piece of the list at a time.
    groups = rooted.groupBy("key", "root").agg(F.count("*").alias("c"))
    groups = groups.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c")).where("m.c < c")
    groups = stored(groups.select("key", F.col("m.root").alias("most")), "groups")
    mixed = rooted.join(groups, "key").withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    bands = stored(mixed.groupBy("key", "front", "band").agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")), "bands")
    pieces = bands.select("key", "front", "band", "low", "high", F.ceil(F.col("c") / LIST_LIMIT).cast("int").alias("pieces"))
    spread = mixed.join(pieces.select("key", "front", "band", "pieces"), ["key", "front", "band"]).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).drop("pieces", "most")
    others = mixed.where("root <> most").drop("band", "most").withColumn("top", most(similarity, F.col("n"), F.col("at"))).withColumnRenamed("front", "ahead")
    asked = others.join(pieces, "key").where((F.col("ahead") | F.col("front")) & (F.col("low") <= F.col("top")) & (F.col("high") >= F.col("n") * similarity - EPSILON))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("low", "high", "pieces", "top", "ahead")
    rest = verified(near(side(asked, "x").join(side(spread, "y"), ["key", "front", "band", "piece"]).where("xroot <> yroot")))
    every = rest.unionAll(settled.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(every, every.count())
    rooted = texts.select("a", "b", "first", "node").join(roots, "node", "left").select("a", "b", "first", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(rooted.select("a", "b", "root").join(ids, "root").select("a", "b", "root", "component_id"), "classes")
    drop_stored(texts)
    return rows.select("doc_id", "a", "b").join(of, ["a", "b"], "left")

"""Approximate nearest neighbours by cosine: inverted lists of coarse centroids with product-quantised residuals.

Unit vectors are assigned to the nearest of about the root of their number of centroids; what is left of each, over its list's scale, is coded in ``PARTS`` parts
of 256 codewords, so that a list of near copies is coded as finely, for its size, as any other. A query goes through two rounds:

1. its ``NEAR`` nearest lists are searched; the score of the ``k + 1``-th best found there is a score to beat;
2. so are all other lists that can hold a better one. A list can if its centroid's score and as much of its spread as one of
   ``n`` normal values is above, but for ``MISSED`` of the nearest on average (a bound; measured far less), reach the score to beat: few lists where vectors have clusters, most where they have none.

Searching a list scores its codes with a table of the query's products with all codewords (asymmetric distances), and then exactly, on the original vectors, the entries whose
approximate score comes within ``SURE`` standard errors of the score to beat. What a code leaves out is kept as its product with the centroid, which corrects the approximate score, and
its length: times the query's distance from the centroid, over the root of the dimensions, that is the error. So it shrinks with the square of a list's scale, as differences of scores do.
The score to beat rises as better entries are found. Nothing is capped: of a group that codes cannot tell apart every member is scored.

Centroids and codewords are fitted on about ``MAX_TRAINED`` vectors, chosen by hash; every vector is indexed. Rows with equal vectors share an index entry, which carries their ``k + 1`` smallest ids: no other row of theirs can be among the nearest, as ties
go to smaller ids. Equal query vectors are searched once. Lists are packed into, or cut into, cells of about ``CELL`` entries, and a query goes once to each cell that holds a list of its; a cell's
queries come in blocks of ``BLOCK``. So the memory of a task is bounded whatever the size of a list, and a vector that is sent meets thousands of others.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not the most
common (a cosine needs equal lengths); an id counts once per distinct vector it has; a query finds fewer than ``k`` where there are fewer other ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored, table

K = 5
MAX_TRAINED = 1 << 16
MAX_LISTS = 2048
PARTS = 32
ROUNDS = 10
NEAR = 0.1
MISSED = 1.2
SURE = 4
#: Against rounding of approximate scores; only ever lets more entries through to be scored exactly.
MARGIN = 1e-6
#: Numbers in one array of scores, or of gathered vectors.
GATHERED = 1 << 22
#: Entries of a cell, from least to most; there are about CELLS of them between the two.
CELL, CELLS = (1024, 16384), 48
BLOCK = 4096


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    size = (c * c).sum(axis=1)
    return np.concatenate([(size - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[:k]], axis=0)
    for _ in range(ROUNDS):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    centroids: np.ndarray
    scales: np.ndarray  # root mean square of the distances of a list's vectors from its centroid
    along: np.ndarray  # the same of their products with it
    bounds: list[tuple[int, int]]
    words: list[np.ndarray]  # of each part
    total: int  # vectors indexed

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, total: int) -> Index:
        centroids = kmeans(x, lists)
        own = _nearest(x, centroids)
        rest = x - centroids[own]
        n = np.bincount(own, minlength=len(centroids))
        mean_root = lambda squares: np.sqrt(np.bincount(own, squares, minlength=len(centroids)) / np.maximum(n, 1))
        scales, along = mean_root((rest * rest).sum(axis=1)) + 1e-9, mean_root((rest * centroids[own]).sum(axis=1) ** 2)
        rest /= scales[own][:, None]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        bounds = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        return cls(centroids, scales, along, bounds, [kmeans(np.ascontiguousarray(rest[:, a:b]), 256, i) for i, (a, b) in enumerate(bounds)], total)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List and code of each unit vector; of what the code leaves out the product with the centroid, and the length."""
        own = _nearest(x, self.centroids)
        rest = (x - self.centroids[own]) / self.scales[own][:, None]
        codes = np.stack([_nearest(rest[:, a:b], w) for (a, b), w in zip(self.bounds, self.words)], axis=1).astype(np.uint8)
        left = rest - np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        left *= self.scales[own][:, None]
        return own, codes, (left * self.centroids[own]).sum(axis=1), np.sqrt((left * left).sum(axis=1))

    def away(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries from centroids."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ self.centroids.T + (self.centroids * self.centroids).sum(axis=1), 0))

    def near(self, q: np.ndarray) -> np.ndarray:
        """Whether a list is among the nearest of a unit query: queries x lists."""
        score = q @ self.centroids.T - (self.centroids * self.centroids).sum(axis=1) / 2
        take = max(1, int(np.ceil(NEAR * len(self.centroids))))
        out = np.zeros(score.shape, bool)
        np.put_along_axis(out, np.argsort(-score, axis=1, kind="stable")[:, :take], True, axis=1)
        return out

    def wanted(self, q: np.ndarray, least: np.ndarray | None, k: int) -> np.ndarray:
        """The lists that a unit query searches: queries x lists. In the first round, without a score to beat, the nearest; then all others that can hold better ones."""
        if least is None:
            return self.near(q)
        far = NormalDist().inv_cdf(1 - min(0.5, MISSED * k / self.total))
        spread = np.minimum(far * np.sqrt(self.away(q) ** 2 * self.scales**2 / q.shape[1] + self.along**2), 2)
        return ~self.near(q) & (q @ self.centroids.T + spread >= least[:, None])

    def adc(self, q: np.ndarray, own: np.ndarray, codes: np.ndarray, shift: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Approximate products of unit queries with coded vectors, each of its own list, and how far they may be off."""
        out = np.zeros((len(q), len(codes)), np.float32)
        for i, ((a, b), w) in enumerate(zip(self.bounds, self.words)):
            out += np.take((q[:, a:b] @ w.T).astype(np.float32), codes[:, i], axis=1)
        off = self.away(q)[:, own] * (left * min(1, SURE / np.sqrt(q.shape[1])))
        return out * self.scales[own] + (q @ self.centroids.T)[:, own] + shift, off


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of vectors along the last axis; the same for equal ones, wherever they stand."""
    return (x * q).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((x * x).sum(axis=-1)))


def reach(index: Index, q: np.ndarray, least: np.ndarray | None, x: np.ndarray, own: np.ndarray, codes: np.ndarray, shift: np.ndarray, left: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some queries at a time, the places of queries and entries that can be among the ``k`` best, and their exact scores."""
    here, at = np.unique(own, return_inverse=True)
    units, step = _unit(q), max(1, GATHERED // len(x))
    piece = max(1, GATHERED // x.shape[1])
    for i in range(0, len(q), step):
        u, some = units[i : i + step], q[i : i + step]
        beat = np.full(len(u), -np.inf) if least is None else least[i : i + step].copy()
        asked = index.wanted(u, None if least is None else beat, k)[:, here][:, at]
        near, off = index.adc(u, own, codes, shift, left)
        near[~asked] = -np.inf
        if len(x) > k:  # the best by approximation raise the score to beat
            first = np.argpartition(-near, k - 1, axis=1)[:, :k]
            found = np.where(np.take_along_axis(asked, first, axis=1), cosines(some[:, None, :], x[first]), -np.inf)
            beat = np.maximum(beat, found.min(axis=1))
        a, b = np.nonzero(asked & (near + off >= beat[:, None] - MARGIN))
        exact = np.concatenate([np.zeros(0)] + [cosines(some[a[j : j + piece]], x[b[j : j + piece]]) for j in range(0, len(a), piece)])
        high = exact >= beat[a]
        yield i + a[high], b[high], exact[high]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    fine = "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.where(F.expr(fine)).where(F.col("vec_id").isNotNull())
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def _cells(sizes: dict[int, int], lists: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its first cell and how many pieces it has, a cell each; lists in one piece may share a cell."""
    most = min(CELL[1], max(CELL[0], total // CELLS))
    first, pieces, cell, held = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for i in range(lists):
        n = sizes.get(i, 0)
        if held and held + n > most:
            cell, held = cell + 1, 0
        pieces[i] = max(1, -(-n // most))
        first[i], held = cell, held + n
        if pieces[i] > 1:
            cell, held = cell + int(pieces[i]), 0
    return first, pieces


def search(vectors: DataFrame, is_query: F.Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id where ``is_query`` (on ``vec_id``) holds, the ``k`` nearest other ids found."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, vec_id, vector).distinct()
    smallest = W.partitionBy("v").orderBy("vec_id")  # limited before the shuffle, so a common vector costs each task k + 1 rows
    entries = stored(rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    n = entries.count()
    id_kind = dict(rows.dtypes)["vec_id"]
    if not n:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, vec_id {id_kind}, score double")
    sample = entries.select("v").where(F.pmod(F.xxhash64("v"), F.lit(-(-n // MAX_TRAINED))) == 0).toArrow()
    x = _unit(_matrix(sample["v"]))
    x = x[np.lexsort(x.T)]  # any order of rows gives the same index
    index = Index.fit(x, min(MAX_LISTS, max(1, round(n**0.5))), n)
    shared = spark.sparkContext.broadcast(index)  # bounded by MAX_LISTS and 256 codewords a part

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, codes, shift, left = shared.value.encode(_unit(_matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shift), pa.array(left)], ["v", "ids", "list", "code", "shift", "left"])

    kinds = dict(entries.dtypes)
    coded = stored(entries.mapInArrow(encode, f"v {kinds['v']}, ids {kinds['ids']}, list int, code binary, shift double, left double"), "index")
    sizes = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    first, pieces = _cells(sizes, len(index.centroids), n)
    filed = spark.createDataFrame([(i, int(first[i]), int(pieces[i])) for i in sizes], "list int, first long, pieces long")
    coded = coded.join(F.broadcast(filed), "list").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("v"), F.col("pieces"))).drop("first", "pieces")
    cells = [list(range(int(a), int(a + b))) for a, b in zip(first, pieces)]

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                least = b.column("least").to_numpy() if "least" in b.schema.names else None
                wanted = shared.value.wanted(_unit(_matrix(b.column("v"))), least, k + 1)
                to = [sorted({c for i in np.flatnonzero(w) for c in cells[i]}) for w in wanted]
                yield b.take(pa.array(np.repeat(np.arange(len(b)), [len(t) for t in to]))).append_column("cell", pa.array([c for t in to for c in t], pa.int64()))

    def meet(have: pa.Table, asking: pa.Table) -> pa.Table:
        kind = pa.schema([("q", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("vec_id", have.schema.field("ids").type.value_type), ("score", pa.float64())])
        if not len(have) or not len(asking):
            return kind.empty_table()
        x, q = _matrix(have["v"]), _matrix(asking["v"])
        own, shift, left, ids = have["list"].to_numpy(), have["shift"].to_numpy(), have["left"].to_numpy(), have["ids"].to_pylist()
        codes = np.frombuffer(b"".join(have["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        least = asking["least"].to_numpy() if "least" in asking.column_names else None
        at, found, scores = [], [], []
        for a, b, exact in reach(shared.value, q, least, x, own, codes, shift, left, k + 1):
            order = np.lexsort((-exact, a))
            a, b, exact = a[order], b[order], exact[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)  # of a score among its query's
            tied = exact >= exact[np.minimum(np.searchsorted(a, a) + k, np.searchsorted(a, a, "right") - 1)] if len(a) else np.zeros(0, bool)
            for i, j, s in zip(a[tied | (place <= k)].tolist(), b[tied | (place <= k)].tolist(), exact[tied | (place <= k)].tolist()):
                for one in ids[j]:
                    at.append(i), found.append(one), scores.append(s)
        return pa.table({"q": asking["q"].combine_chunks().take(pa.array(at, pa.int64())), "vec_id": pa.array(found, kind.field("vec_id").type), "score": pa.array(scores, pa.float64())}).cast(kind)

    def round_of(asked: DataFrame) -> DataFrame:
        """The ``k + 1`` best that each query finds in the lists it wants."""
        sent = stored(asked.mapInArrow(ask, ", ".join(f"`{c}` {t}" for c, t in asked.dtypes) + ", cell long"), "asked")
        blocks = stored(sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")  # a row a cell
        here = coded.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        there = sent.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
        met = here.groupBy("cell", "block").cogroup(there.groupBy("cell", "block")).applyInArrow(meet, f"q struct<a:long,b:long>, vec_id {id_kind}, score double")
        best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return stored(met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "vec_id", "score", "r"), "found")

    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    named = rows.where(is_query).select("vec_id", key.alias("q"), "v")
    asked = stored(named.groupBy("q").agg(F.first("v").alias("v")), "queries")
    one = round_of(asked)
    beat = one.where(F.col("r") == k + 1).select("q", F.col("score").alias("least"))
    two = round_of(asked.join(beat, "q", "left").select("q", "v", F.coalesce("least", F.lit(-2.0)).alias("least")))
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    both = one.unionAll(two).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    pairs = named.select(F.col("vec_id").alias("query_id"), "q").join(both, "q").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)

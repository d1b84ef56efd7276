"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of two kinds of terms: its words, hashed to ``WORDS`` columns, and its shapes (word shapes, pairs of neighbouring ones and immediate repeats), hashed to ``SHAPES``. Their
roots are weighted by inverse document frequency, brought to length 1 within each kind so that neither outweighs the other, and projected on the leading singular vectors of the labelled texts (latent
semantic analysis). At most ``MAX_LABELLED`` labelled vectors, chosen by a hash of the id, are broadcast; every document meets
all of them in blocked cosine products, and its neighbours' labels are averaged with their similarities as weights.

Only the text enters a score. Defined results: null and empty texts score the labelled rows' mean label; a null id is not held out and trains
nothing; null labels are left out, and repeated labels of an id count as their mean; without labelled rows every score is 0.5;
neighbours tied with the last one all vote; repeated rows come back as often as they went in; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MAX_LABELLED = 4096
WORDS, SHAPES = 4096, 1024
#: Columns of each kind.
KINDS = {"words": slice(0, WORDS), "shapes": slice(WORDS, WORDS + SHAPES)}
COMPONENTS = 48
POWERS = 3
NEIGHBOURS = 15

_SHAPE = bytes(
    ord(" ") if chr(b).isspace() and b < 128 else ord("0") if chr(b).isdigit() and b < 128 else ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else b
    for b in range(256)
)
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_RUN = re.compile(rb"([^ ])\1+")


def terms_of(text: str | None) -> dict[int, float]:
    """Hashed counts of a text's terms."""
    raw = (text or "").encode()
    words, shapes = raw.split(), _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()
    counts: Counter = Counter(shapes)
    counts.update(Counter(zip(shapes, shapes[1:])))
    counts[b"=="] = sum(map(bytes.__eq__, words, words[1:]))
    out: Counter = Counter()
    for term, n in counts.items():
        line = b"%b %b" % term if isinstance(term, tuple) else term
        out[WORDS + zlib.crc32(line) % SHAPES] += n
    for term, n in Counter(_WORD.findall(raw.lower())).items():
        out[zlib.crc32(term) % WORDS] += n
    return {k: n for k, n in out.items() if n}


def rows_of(texts: Iterable[str | None]) -> np.ndarray:
    """A row of term weights, before document frequency, for each text."""
    texts = list(texts)
    x = np.zeros((len(texts), WORDS + SHAPES), np.float32)
    for i, t in enumerate(texts):
        found = terms_of(t)
        if found:
            x[i, list(found)] = np.sqrt(np.fromiter(found.values(), np.float32))
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _leading(y: np.ndarray, components: int) -> np.ndarray:
    """The leading right singular vectors of ``y``, by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).normal(size=(y.shape[1], min(components + 16, *y.shape))).astype(np.float32)
    for _ in range(POWERS):
        q = np.linalg.qr(y.T @ (y @ q))[0]
    return q @ np.linalg.svd(y @ q, full_matrices=False)[2].T[:, :components]


@dataclass
class Model:
    weight: np.ndarray  # of terms
    axes: np.ndarray  # terms x components
    vectors: np.ndarray  # labelled x components, of unit length
    labels: np.ndarray
    neighbours: int
    kinds: tuple[str, ...]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, neighbours: int, kinds: tuple[str, ...] = tuple(KINDS)) -> Model:
        seen = (x > 0).sum(axis=0)
        weight = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
        made = cls(weight, np.zeros((x.shape[1], 0), np.float32), np.zeros((0, 0)), labels.astype(np.float64), neighbours, kinds)
        if len(x):
            y = made.weighted(x)
            made.axes = _leading(y, COMPONENTS).astype(np.float32)
            made.vectors = _unit(y @ made.axes)
        return made

    def weighted(self, x: np.ndarray) -> np.ndarray:
        """Rows of unit length within each kind of term that counts; the others are left out."""
        y = np.zeros_like(x)
        for kind in self.kinds:
            y[:, KINDS[kind]] = _unit(x[:, KINDS[kind]] * self.weight[KINDS[kind]])
        return y

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        near = np.maximum(_unit(self.weighted(x) @ self.axes) @ self.vectors.T, 0).round(5).astype(np.float64)
        k = min(self.neighbours, len(self.labels))
        last = np.partition(near, -k, axis=1)[:, -k]
        votes = np.where(near >= last[:, None], near, 0.0)
        total = votes.sum(axis=1)
        return np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1), self.labels.mean()).clip(0, 1)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, neighbours: int = NEIGHBOURS, kinds: tuple[str, ...] = tuple(KINDS)) -> Model:
    """A model from the labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    # Bounded by max_labelled, hence broadcast.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(terms_of(t.as_py()).items()) for t in b.column("text")]
            terms, counts = ([np.array([x[i] for x in r], np.int32).tobytes() for r in rows] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["label", "terms", "counts"])

    found = texts.select("label", "text").mapInArrow(run, "label double, terms binary, counts binary").toArrow()
    found = found.sort_by([(c, "ascending") for c in ("label", "terms", "counts")])
    x = np.zeros((len(found), WORDS + SHAPES), np.float32)
    for i, (terms, counts) in enumerate(zip(found["terms"].to_pylist(), found["counts"].to_pylist())):
        x[i, np.frombuffer(terms, np.int32)] = np.sqrt(np.frombuffer(counts, np.int32))
    return Model.fit(x, found["label"].to_numpy(), neighbours, kinds)


def with_score(docs: DataFrame, model: Model, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column more; it replaces one of that name."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.scores(rows_of(b.column(text).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, score])

    kept = docs.drop(score)
    kinds = [f"`{n}` {t}" for n, t in kept.dtypes] + [f"`{score}` double"]
    return kept.mapInArrow(run, ", ".join(kinds))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

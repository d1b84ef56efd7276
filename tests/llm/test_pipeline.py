"""The pipeline's stages against brute force on their own inputs."""

import os
import random
import time
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from dynspec.llm import linededup, quality, simhash, similar  # noqa: E402
from tests.llm.test_operators import brute_hits, brute_lines, docs, words  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def sf_dir(spark, tmp_path):
    rng = random.Random(12)
    items = [(1, words(rng, 30, 4000)), (2, words(rng, 14, 4000))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = [(i, int(i % 4 > 0), 0) for i in range(200)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), items


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_stage(spark, sf_dir):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 8, 900).capitalize() + "." for _ in range(8)) if i % 4 else " ".join(f"W{rng.randrange(900)}!!" for _ in range(60))) for i in range(300)]
    given = docs(spark, rows)
    out = corpus_pipeline.quality_stage(spark, given, sf_dir[0])
    model = quality.fit(given, spark.read.parquet(f"{sf_dir[0]}/labels.parquet"))
    want = {r.doc_id for r in quality.with_score(given, model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in out.collect()} == want and out.columns == given.columns
    assert {i for i, _ in rows if i % 4} <= want and len(want) < 240


def test_line_stage(spark, sf_dir):
    rng = random.Random(2)
    pool = [f"A line of boilerplate with number {i} on many sites" for i in range(5)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else words(rng, 9, 10**6) for _ in range(3)), f"s{i % 7}") for i in range(90)]
    out = corpus_pipeline.line_stage(spark, docs(spark, rows), sf_dir[0]).collect()
    want = {(i, t) for (i, t, n), _ in brute_lines(rows, linededup.MIN_SITES, linededup.MIN_CHARS).items() if n == 0 or t.strip(" ")}
    assert {(r.doc_id, r.text) for r in out} == want and all(r.n_chars == len(r.text) for r in out)


def test_near_duplicate_stage(spark, sf_dir):
    rng = random.Random(3)
    base = [words(rng, 300, 5000) for _ in range(12)]
    rows = [(10 * g + c, b.replace(" ", f" q{g}{c} ", 1) if c else b) for g, b in enumerate(base) for c in range(3)]
    rows += [(500, base[0]), (501, "alone here"), (501, "alone here"), (502, "alone here"), (None, "no id"), (503, None)]
    out = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), sf_dir[0]).collect()]
    assert Counter(out) == Counter([10 * g for g in range(12)] + [501, None, 503])


def test_decontamination_stage(spark, sf_dir):
    path, items = sf_dir
    rng = random.Random(4)
    rows = [(i, words(rng, 40, 4000) + (" " + items[i % 2][1] if i % 5 == 0 else "")) for i in range(50)]
    out = corpus_pipeline.decontamination_stage(spark, docs(spark, rows), path)
    hit = {d for d, _, n, _ in brute_hits(rows, items) if n}
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - hit and len(hit) == 10


def test_mixing_stage(spark, sf_dir):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 60)), f"s{i % 3}") for i in range(120)]
    out = corpus_pipeline.mixing_stage(spark, docs(spark, rows), sf_dir[0])
    seen = Counter(r.doc_id for r in out.collect())
    assert max(seen.values()) <= 2 and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows_of(out) == rows_of(corpus_pipeline.mixing_stage(spark, docs(spark, rows), sf_dir[0]))


def test_near_duplicate_stage_keeps_each_text_of_an_id(spark, sf_dir):
    rng = random.Random(6)
    rows = [(1, words(rng, 60, 5000)), (1, words(rng, 60, 5000)), (2, words(rng, 60, 5000))]
    out = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), sf_dir[0])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(rows)


def test_near_duplicate_stage_links_by_fingerprints_and_by_similarity(spark, sf_dir):
    rng = random.Random(13)
    rows = []
    for g in range(8):
        line = words(rng, 13, 5000)
        rows += [(100 * g + c, " ".join([line] * 40 + [words(rng, 30, 5000)])) for c in range(3)]  # one fingerprint, unlike sets
        base = words(rng, 300, 5000).split()
        rows += [(100 * g + 10 + c, " ".join(base[: 300 - 50 * (c > 0)] + [f"q{g}w{c}"] * (c > 0))) for c in range(2)]  # similar sets, other fingerprints
        rows.append((100 * g + 20, words(rng, 80, 5000)))
    rows += [(900, "one two"), (901, "two one"), (902, ""), (903, " \n"), (904, None)]
    fps = [simhash.fingerprint(t) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))} for _, t in rows for w in [(t or "").lower().split()]]
    bits = lambda x, y: ((fps[x] ^ fps[y]) & (2**64 - 1)).bit_count() <= 2
    alike = lambda x, y: bool(sets[x]) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    of, kinds = list(range(len(rows))), Counter()
    for x in range(len(rows)):
        for y in range(x):
            kinds[bits(x, y), alike(x, y)] += 1
            if bits(x, y) or alike(x, y):
                of = [of[y] if c == of[x] else c for c in of]
    assert kinds[True, False] >= 24 and kinds[False, True] >= 4
    want = {min(i for (i, _), c in zip(rows, of) if c == k) for k in of}
    out = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), sf_dir[0])
    assert Counter(r.doc_id for r in out.collect()) == Counter(want)


def test_whole_shingle_sets_are_made_for_few_pairs(spark, sf_dir, monkeypatch):
    rng = random.Random(8)
    shared = [words(rng, 180, 5000) for _ in range(20)]
    rows = [(10 * g + c, f"{x} {words(rng, 120, 5000)}") for g, x in enumerate(shared) for c in range(3)]
    rows.append((900, f"{rows[0][1]} and"))
    made, keep = {}, similar.stored

    def counted(df, name, *args):
        out = keep(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similar, "stored", counted)
    out = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), sf_dir[0])
    assert {r.doc_id for r in out.collect()} == {i for i, _ in rows} - {900}
    assert made["likely"] > 10 and made["shingle-sets"] == 2


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(9)
    for n in [1, 2, 5, 31, 64, 65, 100, 127, 130, 500, 1000, 1025, 1200, 5000]:
        for similarity in (0.5, 0.8, 1.0):
            for _ in range(20):
                p = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
                kept = p[rng.random(len(p)) < rng.uniform(0.6, 1)]
                q = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, rng.integers(0, n // 5 + 1), np.uint64)]))
                if len(q) and similar.are_similar(p, q, similarity):
                    assert similar.may_be_similar(*(np.frombuffer(similar.parities(x), np.uint64) for x in (p, q)), similarity)
    unlike = [np.unique(rng.integers(0, 1 << 64, 900, np.uint64)) for _ in range(2)]
    assert not similar.may_be_similar(*(np.frombuffer(similar.parities(x), np.uint64) for x in unlike), 0.8)


def test_near_duplicate_stage_leaves_no_shuffle_files(spark, sf_dir):
    rng = random.Random(10)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = shuffled()
    corpus_pipeline.near_duplicate_stage(spark, docs(spark, [(i, words(rng, 60, 5000)) for i in range(60)]), sf_dir[0])
    for _ in range(50):
        if left := shuffled() - before:
            time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_stages_of_empty_tables_and_clashing_names(spark, sf_dir):
    rng = random.Random(7)
    plain = docs(spark, [(i, f"{words(rng, 30, 4000)}\n{words(rng, 30, 4000)}", f"s{i % 3}") for i in range(30)] + [(None, None, None), (40, "", "s1"), (41, words(rng, 20_000, 4000), "s1")])
    odd = plain.drop("n_chars").selectExpr("*", "1 AS _score", "2 AS n_removed", "3 AS _id", "4 AS _a", "5 AS _b", "6 AS _key", "7 AS h", "8 AS root")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.where("false"), sf_dir[0]).count() == 0
        out = stage(spark, odd, sf_dir[0])
        assert out.columns == odd.columns
        assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in stage(spark, plain, sf_dir[0]).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole_pipeline(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == given.columns and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert 0 < out.select("doc_id").distinct().count() <= given.count()

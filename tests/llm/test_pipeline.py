"""The pipeline stage by stage against plain forms of its decisions."""

import zlib
from collections import Counter
from itertools import combinations

import brute
import pytest

import corpus_pipeline
from cohortflow.llm import quality


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    folder = folder.replace("sf0.001", "sf0.01")  # enough labels to learn from
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / f"{k}-{name}")
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return folder, out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_all_but_the_last_return_documents(stages):
    for before, after in stages[1][:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage(spark, stages):
    folder, out = stages
    before, after = out[0]
    kept = {r["doc_id"] for r in after.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    good = [d for d in held if labels[d] == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert sum(d not in kept for d in held if labels[d] == 0) >= 0.8 * (len(held) - len(good))
    assert after.count() == len(kept) < before.count()
    assert quality.statistics("") == [0.0] * len(quality.FEATURES)


def test_near_copy_stage(stages):
    """One document, the smallest id, stays of each group that fingerprints connect at four or fewer differing bits."""
    before, after = stages[1][1]
    prints = {d: brute.simhash(t) for d, t in rows(before)}
    linked = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    group = brute.components(list(prints), linked)
    assert [d for d, _ in rows(after)] == sorted(d for d, g in group.items() if d == g)


def test_passage_stage(stages):
    before, after = stages[1][2]
    exact, texts = brute.repeats(rows(before)), dict(rows(after))
    assert set(texts) == set(exact)
    for d, text in rows(before):
        size, removed, _, digest = exact[d]
        kept = texts[d].encode()
        assert len(kept) <= size - removed
        if text.isascii():
            import hashlib

            assert hashlib.sha256(kept).hexdigest() == digest
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_mixing_stage(stages):
    before, after = stages[1][3]
    texts, times = dict(rows(before)), Counter(rows(after))
    assert all(texts[d] == t and n <= 3 for (d, t), n in times.items())
    size = lambda t: len(brute.WORDS.findall(t))
    whole, taken = sum(size(t) for t in texts.values()), sum(n * size(t) for (_, t), n in times.items())
    assert abs(taken - whole) < 0.1 * whole


def test_packing_stage(stages):
    before, after = stages[1][4]
    placed = after.collect()
    assert Counter(r["doc_id"] for r in placed if r["piece"] == 0) == Counter(d for d, _ in rows(before))
    used = Counter()
    for r in placed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_stages_keep_empty_tables(spark, stages):
    folder, _ = stages
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0

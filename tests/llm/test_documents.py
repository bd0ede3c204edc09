"""Queries over documents against plain forms, and the defined odd cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortflow.llm import iblt, lattice, mixing, ngram_trie, orc_tokens, packing, quality, simhash_bk, suffix_radix
from cohortflow.llm.queries import QUERIES
from cohortflow.llm.tokens import encoder


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole_ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()


# op1


def test_trie_scores(spark, folder, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_ngram_trie"](spark, folder).collect()}
    base, n = brute.base_scores(docs)
    assert set(got) == set(base)
    for d, (held, tokens, known, score) in base.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, n)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9)
    total = sum(r["score"] for r in got.values())
    fits = {k: brute.pair_scores(docs, k) for k in ngram_trie.DISCOUNTS}
    best = min(fits, key=lambda k: abs(sum(fits[k].values()) - total))
    assert all(abs(fits[best][d] - r["score"]) < 2e-4 * r["n_tokens"] for d, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_elias_fano_access_and_successor():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 1), (5, 5), (400, 1 << 20), (3000, 3001)):
        values = np.sort(rng.integers(0, universe, n))
        size, width, (low, high, before) = ngram_trie.EliasFano.encode(values, universe)
        coded = ngram_trie.EliasFano(size, width, low, high, before)
        assert (coded.get(np.arange(n)) == values).all()
        wanted = rng.integers(0, universe + 1, 200)
        begin = rng.integers(0, n, 200)
        end = np.minimum(begin + rng.integers(0, n + 1, 200), n)
        expected = [b + np.searchsorted(values[b:e], w) for b, e, w in zip(begin, end, wanted)]
        assert (coded.successor(begin, end, wanted) == expected).all()


def test_trie_backs_off():
    logs = np.log10([0.5, 0.3, 0.2])
    trie = ngram_trie.Trie(logs, np.log10([0.5, 1.0, 0.25]), np.array([0, 0, 2]), np.array([0, 2, 1]), np.log10([0.9, 0.05, 0.7]))
    got = 10 ** trie.log10(np.array([0, 0, 0, 1, 2, 2]), np.array([0, 1, 2, 0, 1, 2]))
    trie.close()
    assert np.allclose(got, [0.9, 0.15, 0.05, 0.5, 0.7, 0.05], rtol=1e-3)


def test_trie_odd_cases(odd, odd_rows, spark):
    rows = ngram_trie.score_documents(odd).collect()
    assert len(rows) == len(odd_rows) and all(math.isfinite(r["score"]) for r in rows)
    nothing = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert len(nothing) == 3 and all(r["n_tokens"] == 1 for r in nothing)
    assert ngram_trie.score_documents(odd.limit(0)).count() == 0


# op2


def test_sketches_match_set_differences(spark, folder, docs):
    got = {r["doc_id"]: r for r in QUERIES["op2_invertible_sketch"](spark, folder).collect()}
    order = sorted(docs, reverse=True)
    assert set(got) == {d for d, _ in docs}
    for (d, text), (_, following) in zip(order, order[1:] + order[:1]):
        r = got[d]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (following, r["near_next"])):
            a, b = set(iblt.digests(text).tolist()), set(iblt.digests(other).tolist())
            assert math.isclose(near, len(a & b) / len(a | b))
    by_text = defaultdict(set)
    for d, text in docs:
        by_text[text].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_sketch_recovers_both_sides_after_retries():
    a = np.arange(1, 900, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.concatenate([a[300:], np.arange(5, dtype=np.uint64) + np.uint64(7)])
    (values, sign), (same, _) = iblt.differences([a, a], [b, a])
    assert set(values[sign > 0].tolist()) == set(a[:300].tolist()) and set(values[sign < 0].tolist()) == set(b[-5:].tolist())
    assert len(same) == 0
    one = iblt.Sketches.of([a[:3]], np.array([12]))
    assert iblt.Sketches.from_text(one.to_text(0, 3)).to_text(0, 3) == one.to_text(0, 3)


def test_sketch_odd_cases(odd, odd_rows):
    rows = iblt.version_fingerprints(odd).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    copies = [r for r in rows if r["doc_id"] == 2]
    assert len(copies) == 2 and max(r["near_next"] for r in copies) == 1.0
    single = iblt.version_fingerprints(odd.filter("doc_id = 1")).first()
    assert single["near_next"] == 1.0
    assert iblt.version_fingerprints(odd.limit(0)).count() == 0


def test_ranges_do_not_change_the_next_document(spark, docs):
    some = spark.createDataFrame(docs[:60], "doc_id long, text string")
    wide = {tuple(r) for r in iblt.version_fingerprints(some).collect()}
    assert {tuple(r) for r in iblt.version_fingerprints(some, rows_per_range=7).collect()} == wide


# op3


def test_mix_repeats_rows_by_rate(spark, odd):
    report = mixing.mixing_report(odd)
    taken = Counter(r["doc_id"] for r in mixing.mix(odd).collect())
    expected = Counter()
    for r in report.collect():
        expected[r["doc_id"]] += r["copies"]
        assert r["taken"] <= 3 * r["size"]
    assert {k: v for k, v in taken.items()} == {k: v for k, v in expected.items() if v}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixing_report(odd.limit(0)).count() == 0


def test_targets_fill_up_by_weight(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, None: 700, "d": 0}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_rates(frame).collect()}
    names = ["a", "b", "c", "d", None]
    weights = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    target, free = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {n: left * weights[n] / sum(weights[m] for m in free) for n in free}
        above = {n for n in free if share[n] > 3 * sizes[n]}
        if not above:
            break
        target.update({n: 3 * sizes[n] for n in above})
        free -= above
    target.update(share)
    assert all(math.isclose(got[n], target[n], abs_tol=1e-6) for n in names)


# op4


def test_simhash_components(spark, folder, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash_bk_trees"](spark, folder).collect()}
    assert got == brute.simhash_components(docs)


def test_crowded_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(6)]
    values = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64), np.arange(60, dtype=np.uint64)])).view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = [(r["a"], r["b"]) for r in simhash_bk.links(nodes, crowded=9).collect()]
    unsigned = values.view(np.uint64)
    exact = [(int(values[i]), int(values[j])) for i in range(len(values)) for j in range(i) if int(unsigned[i] ^ unsigned[j]).bit_count() <= 4]
    assert brute.components(values.tolist(), found) == brute.components(values.tolist(), exact)
    assert len(found) < len(exact)


def test_simhash_odd_cases(odd, odd_rows):
    rows = simhash_bk.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows)
    blank = [r for r in rows if r["fp"] == 0]
    assert {r["component_id"] for r in blank} == {3}
    kept = simhash_bk.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and ids.count(None) == 1
    assert simhash_bk.near_duplicates(odd.limit(0)).count() == 0 and simhash_bk.keep_one(odd.limit(0)).count() == 0


# op5


def test_repeats(spark, folder, docs):
    rows = QUERIES["op5_suffix_radix_sort"](spark, folder).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute.repeats(docs)


def planted(rng, n):
    words = [f"{rng.integers(10**6)}" for _ in range(400)]
    passage = " ".join(words[:12])
    out = []
    for d in range(n):
        own = " ".join(str(rng.integers(10**9)) for _ in range(30))
        out.append((d, {0: own + passage, 1: passage[3:] + own, 2: "ab" * 200, 3: own[:20], 4: "é" * 70 + own}[d % 5]))
    return out


@pytest.mark.parametrize("crowded", [2000, 0])
def test_planted_repeats(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_radix, "CROWDED", crowded)
    rows = planted(np.random.default_rng(5), 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_radix.repeat_report(frame).collect()}
    assert got == brute.repeats(rows)


def test_radix_passes_leave_exactly_the_equal_suffixes():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 99, 3000, dtype=np.uint8))
    start = np.arange(0, 3000 - 20)
    key = start % 5
    found, least = suffix_radix.radix_groups(data, np.zeros(len(start), np.uint64), start, key, 20)
    groups = defaultdict(set)
    for s in start:
        groups[data[s : s + 20]].add(int(s % 5))
    expected = {int(s): min(groups[data[s : s + 20]]) for s in start if len(groups[data[s : s + 20]]) > 1}
    assert dict(zip(found.tolist(), least.tolist())) == expected


def test_repeat_odd_cases(odd, odd_rows):
    rows = suffix_radix.repeat_report(odd).collect()
    assert len(rows) == len(odd_rows)
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [len(odd_rows[1][1].encode())] * 2
    cut = suffix_radix.remove_repeats(odd)
    assert cut.columns == odd.columns
    texts = [(r["doc_id"], r["text"], r["n_chars"], r["size"]) for r in cut.collect()]
    assert len(texts) == len(odd_rows) and all(n == len(t) and s == 7 for _, t, n, s in texts)
    assert [t for d, t, *_ in texts if d == 2] == ["", ""]
    assert suffix_radix.repeat_report(odd.limit(0)).count() == 0 and suffix_radix.remove_repeats(odd.limit(0)).count() == 0


# op6


def test_orc_round_trip(spark, folder, docs, tokenizer, tmp_path):
    rows = {r["doc_id"]: r for r in QUERIES["op6_orc_tokens"](spark, folder).collect()}
    start = 0
    for d, text in docs:
        ids = whole_ids(tokenizer, text)
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_orc_lookup_uses_metadata(spark, docs, tokenizer, tmp_path):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    path = orc_tokens.write_tokens(frame, str(tmp_path / "tokens"))
    found = orc_tokens.read_tokens(spark, path, [docs[5][0]])
    assert f"EqualTo(doc_id,{docs[5][0]})" in found._jdf.queryExecution().executedPlan().toString()
    assert np.array(found.first()["ids"], "<u4").tobytes() == whole_ids(tokenizer, docs[5][1])
    order = [r["doc_id"] for r in orc_tokens.read_tokens(spark, path).orderBy("part", "pos").select("doc_id").collect()]
    assert order == sorted(order)


def test_orc_odd_cases(spark, odd, odd_rows, tokenizer, tmp_path):
    path = orc_tokens.write_tokens(odd, str(tmp_path / "odd"))
    rows = orc_tokens.token_index(spark, path).orderBy("start").collect()
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(i) // 4, zlib.crc32(i)) for i in (whole_ids(tokenizer, t) for _, t in odd_rows))
    assert [r["doc_id"] for r in rows][:2] == [None, None]
    empty = orc_tokens.write_tokens(odd.limit(0), str(tmp_path / "empty"))
    assert orc_tokens.token_index(spark, empty).count() == 0


def test_pieces_encode_like_the_tokenizer(docs, tokenizer):
    texts = [t for _, t in docs] + ["", None, " a  b\n\n c\t", "it's 12'll <|endoftext|>", "日本語 ½ ² é́  x y", "\x1c \x1f z"]
    for text, ids in zip(texts, encoder().encode(texts)):
        assert ids + b"\0\0\0\0" == whole_ids(tokenizer, text)


# op7


def test_quality_separates_held_out_labels(spark, duck, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in QUERIES["op7_quality_discriminant"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows.values())
    assert sum((r["predicted"] == y) for y, r in held) / len(held) > 0.95


def test_discriminant_matches_densities(spark):
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    x = [rng.normal(k, 1 + k, d) for k in (0, 1) for _ in range(200)]
    frame = spark.createDataFrame([(v.tolist(), int(i >= 200)) for i, v in enumerate(x)], "x array<double>, y int")
    model = quality.fit(frame)
    x = np.array(x)
    z = (x - x.mean(0)) / x.std(0)
    spread = [np.cov(z[k * 200 : k * 200 + 200].T, bias=True) for k in (0, 1)]
    shrunk = [0.9 * s + 0.1 * (spread[0] + spread[1]) / 2 for s in spread]
    shrunk = [0.98 * s + 0.02 * np.trace(s) / d * np.eye(d) for s in shrunk]
    log = []
    for k in (0, 1):
        away = z - z[k * 200 : k * 200 + 200].mean(0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(shrunk[k]), away) + np.linalg.slogdet(shrunk[k])[1]))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))), atol=1e-9)


def test_quality_odd_cases(spark, odd, odd_rows):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.features(odd)
    model = quality.fit(quality.training_rows(rows, labels))
    scores = [r[0] for r in rows.select(quality.score_vectors(model)("x")).collect()]
    assert len(scores) == len(odd_rows) and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns and quality.keep_good(odd, model, 0.0).count() == len(odd_rows)
    assert quality.fit(quality.training_rows(rows, labels.limit(0))).prior == 0.5
    assert quality.features(odd.limit(0)).count() == 0


# op8


def check_packing(rows, docs, tokenizer):
    ids = [whole_ids(tokenizer, t) for _, t in docs]
    assert sum(r["length"] for r in rows) == sum(len(i) // 4 for i in ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    return len(sequences), -(-total // 2048)


def test_packing(spark, folder, docs, tokenizer):
    rows = QUERIES["op8_best_fit_packing"](spark, folder).collect()
    used, bound = check_packing(rows, docs, tokenizer)
    assert used <= bound + 1 + bound // 50
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for d, text in docs:
        ids, at = whole_ids(tokenizer, text), 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and zlib.crc32(ids[4 * at : 4 * (at + r["length"])]) == r["ids_crc32"]
            assert k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids) // 4


def fewest(lengths, capacity):
    """Exact bin count by search over small instances."""
    lengths = sorted(lengths, reverse=True)

    def fits(bins):
        def put(i, rooms):
            if i == len(lengths):
                return True
            for r in {x for x in rooms if x >= lengths[i]}:
                rest = list(rooms)
                rest.remove(r)
                if put(i + 1, (*rest, r - lengths[i])):
                    return True
            return False

        return put(0, (capacity,) * bins)

    return next(b for b in range(1, len(lengths) + 1) if fits(b))


def test_dominance_keeps_an_optimal_solution_within_reach():
    rng = np.random.default_rng(6)
    for _ in range(40):
        lengths = rng.integers(1, 20, rng.integers(2, 9)).tolist()
        counts = [0] * 21
        for x in lengths:
            counts[x] += 1
        fixed = packing.reduce_by_dominance(counts, 20)
        rest = [x for x in range(21) for _ in range(counts[x])]
        assert sum(t for _, t in fixed) + (fewest(rest, 20) if rest else 0) == fewest(lengths, 20)


def test_solution_places_every_piece_once():
    rng = np.random.default_rng(7)
    histogram = {int(k): int(v) for k, v in zip(range(1, 300), rng.integers(0, 2000, 299))}
    patterns = packing.solve(histogram, 300)
    placed = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= 300
        for length in pattern:
            placed[length] += times
    assert dict(placed) == {k: v for k, v in histogram.items() if v}


def test_packing_odd_cases(odd, odd_rows, tokenizer):
    check_packing(packing.pack(odd).collect(), odd_rows, tokenizer)
    assert packing.pack(odd.limit(0)).count() == 0
    with_ids = packing.pack(odd.filter("doc_id = 1"), with_ids=True).first()
    assert zlib.crc32(with_ids["ids"]) == with_ids["ids_crc32"]


# op10


def test_lattice_neighbours(spark, folder, duck):
    rows = QUERIES["op10_lattice_neighbours"](spark, folder).collect()
    exact = brute.near_vectors(duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall())
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == exact


def test_lattice_recall_on_planted_vectors(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CROWDED", 40)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 24))
    near = [b + rng.normal(0, 0.13, 24) for b in base for _ in range(5)] + [base[0] + rng.normal(0, 0.05, 24) for _ in range(150)]
    vectors = [*base, *near, *base[:4], *(2.0 * base[:2])]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [None] + [1.0] * 23), (1003, [float("nan")] * 24), (1004, [1.0, 2.0]), (1005, [float("inf")] * 24), (1006, [])]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact = brute.near_vectors([r for r in rows if r[0] not in (1004, 1006)])
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= n for i, (n, _) in exact.items())
    assert sum(found[i] for i in exact) >= 0.99 * sum(n for n, _ in exact.values())
    assert all(found[i] == 0 for i in range(1000, 1007)) and len(got) == len(rows)


def test_lattice_decodes_the_nearest_point():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 2, (50, 8))
    points = lattice.nearest_e8(x) / 2
    around = points[:, None, :] + lattice.shortest_vectors()[None] / 2
    own = np.square(x - points).sum(axis=1)
    assert (own <= np.square(x[:, None] - around).sum(axis=2).min(axis=1) + 1e-9).all()
    assert len(lattice.shortest_vectors()) == 240


def test_lattice_empty(spark):
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

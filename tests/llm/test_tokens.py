"""Encoding, alignment and the conversation trie against plain forms, and the defined odd cases."""

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortflow.llm import diagonal_alignment, prefix_trie, speculative_bpe
from cohortflow.llm.queries import QUERIES
from cohortflow.llm.tokens import byte_alphabet, encoder

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
library = lambda file: Tokenizer.from_file(public_tokenizers.path(file))


# op12


def round_trip(words, text):
    ids = words.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False))


def test_every_document_encodes_as_the_library_does(spark, folder, docs):
    words = library(speculative_bpe.TOKENIZER)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_speculative_bpe"](spark, folder).collect()}
    assert got == {d: round_trip(words, t) for d, t in docs}


def test_odd_texts_encode_as_the_library_does(odd, odd_rows):
    words = library(speculative_bpe.TOKENIZER)
    got = speculative_bpe.decode(speculative_bpe.encode(odd)).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    mine = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got), key=key)
    ids = lambda t: words.encode(t or "", add_special_tokens=False).ids
    assert mine == sorted(((d, tuple(ids(t)), words.decode(ids(t), skip_special_tokens=False)) for d, t in odd_rows), key=key)
    assert speculative_bpe.decode(speculative_bpe.encode(odd.limit(0))).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.sampled_from("aeinthos' .,\n!19éßñÅ漢<|>_\x1c\x85　́ΣİA")) | st.text(), max_size=8))
def test_any_texts_encode_as_the_library_does(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    own = speculative_bpe.encoder()
    flat, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])][: len(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_speculation_settles_words_and_exact_merging_the_rest():
    own = speculative_bpe.SpeculativeEncoder()
    texts = ["the quick brown fox reads these common english words and nothing else", "aaaaaaaaaaa " + "ab" * 2000]
    flat, counts = own.encode(texts)
    assert flat.tolist() == [i for t in texts for i in own.library.encode(t, add_special_tokens=False).ids]
    assert 0 < own.merged_words < own.all_words / 2
    assert own.merges.reachable().all()


def test_compatible_is_exact_for_pairs():
    own = speculative_bpe.encoder()
    rng = np.random.default_rng(3)
    short = np.flatnonzero((own.width[: own.merges.size] <= 4) & ~np.array([own.strings[i].endswith("</w>") for i in range(own.merges.size)]))
    left, right = rng.choice(short, 3000), rng.choice(short, 3000)

    def symbols(token):
        rank, halves = own.merges.rank, own.merges.halves
        return [token] if rank[token] < 0 else symbols(halves[0][token]) + symbols(halves[1][token])

    fits = own.merges.compatible(left, right)
    words = [[int(x) for x in symbols(a) + symbols(b)] for a, b in zip(left, right)]
    merged = [own.merges.merge(w) for w in words]
    assert fits.tolist() == [m == [a, b] for m, a, b in zip(merged, left, right)]
    assert own.merges.merge_all(np.concatenate(words), np.array([len(w) for w in words])) == merged
    assert 0 < fits.sum() < len(fits)


# op11


def plain_alignment(text, a_side, b_side, a_bytes, b_bytes):
    """groups as lists of ids, and all overlapping pairs, by comparing byte ranges."""
    a, b = (a_side(" " + text), b_side(text)) if text else ([], [])
    raw = (" " + text).encode() if text else b""
    if b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
        a, b = [], []
    spans = lambda ids, of: [(e - len(of[i]), e) for i, e in zip(ids, np.cumsum([len(of[i]) for i in ids]).tolist())]
    a_spans, b_spans = spans(a, a_bytes), spans(b, b_bytes)
    starts = defaultdict(list)
    links, j = [], 0
    for k, (s, e) in enumerate(a_spans):
        while j and b_spans[j - 1][1] > s:
            j -= 1
        while j < len(b) and b_spans[j][0] < e:
            if b_spans[j][1] > s:
                links.append((a[k], b[j]))
            j += 1
    cuts = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
    for side, ids, where in (("a", a, a_spans), ("b", b, b_spans)):
        for i, (_, e) in zip(ids, where):
            starts[bisect_left(cuts, e), side].append(str(i))
    groups = [f"{','.join(starts[k, 'a'])}|{','.join(starts[k, 'b'])}" for k in range(len(cuts))]
    return a, b, groups, links


def plain_rows(docs):
    a_lib, b_lib = library("byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    byte_of = {c: b for b, c in byte_alphabet().items()}
    a_bytes = {i: bytes(byte_of.get(c, 0) for c in s) for s, i in a_lib.get_vocab().items()}
    b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in range(b_lib.vocab_size())]
    side = lambda t: a_lib.encode(t, add_special_tokens=False).ids
    found = [(d, plain_alignment(t, side, b_lib.encode, a_bytes, b_bytes)) for d, t in docs]
    counts = Counter(link for _, (_, _, _, links) in found for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for d, (a, b, groups, links) in found:
        n_best, total = sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)
        rows.append((d, len(a), len(b), len(groups), len(links), n_best, total, sha(";".join(groups)) if groups else ""))
    return rows


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r))


def test_alignment_of_all_documents(spark, folder, docs):
    got = QUERIES["op11_diagonal_alignment"](spark, folder)
    assert by_id(tuple(r) for r in got.select(*NAMES).collect()) == by_id(plain_rows(docs))


def test_alignment_odd_cases(spark, odd, odd_rows):
    more = spark.createDataFrame([(20, "a▁b"), (21, "é ﬁ ½ <s> </s> <unk> <0x41>"), (22, "x" * 5000), (23, " " * 300), (24, "\x00\x01")], "doc_id long, text string")
    both = odd.unionByName(more, allowMissingColumns=True)
    rows = [*odd_rows, *[(r["doc_id"], r["text"]) for r in more.collect()]]
    got = diagonal_alignment.align(both, with_groups=True).collect()
    assert by_id(tuple(r[n] for n in NAMES) for r in got) == by_id(plain_rows(rows))
    assert all(sha(r["groups"]) == r["groups_sha256"] for r in got if r["n_groups"])
    assert [r for r in got if r["doc_id"] == 20][0]["n_a"] == 0
    sides = {r["doc_id"]: r for r in diagonal_alignment.alignments(both.filter("doc_id is not null and doc_id != 2")).collect()}
    assert all(len(sides[r["doc_id"]]["a_edges"]) == r["n_groups"] for r in got if r["doc_id"] in sides)
    assert diagonal_alignment.align(odd.limit(0)).count() == 0


@settings(deadline=None, max_examples=300)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(61, 70))
def test_run_skipping_finds_every_common_end(a, b, last):
    a, b = sorted(a | {last}), sorted(b | {last})
    i, j = diagonal_alignment.diagonal_groups(np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[x - 1] for x in i] == common == [b[x - 1] for x in j]


def test_two_rank_libraries_agree(docs):
    whole = library("byte_bpe_50k.json")
    for _, text in docs:
        assert encoder().encode_one(text) == np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


# op13


def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows, key=lambda r: r[:2])] for c, rows in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = Counter(node[:-1] for node in members if node)
    rows = []
    for node, convs in members.items():
        leaves = sum(children[v] == 0 for v in below[node])
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below[node] if v)
        ended = [c for c in convs if len(built[c]) == len(node)]
        parent = members[node[:-1]][0] if node else None
        rows.append((convs[0], len(node), parent, len(convs), children[node], leaves, saved, sha(",".join(map(str, ended)))))
    return rows


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns(spark):
    same = [(c, t, "user" if t % 2 else None, f"turn {t} of {'all' if c < 60 else c % 7}") for c in range(40, 90) for t in range(c % 6 + 1)]
    long = [(7, t, "user", f"t{t}") for t in range(300)] + [(8, t, "user", f"t{t}") for t in range(260)] + [(9, t, "user", f"u{t}") for t in range(30)]
    odd = [(None, 1, "user", "no conversation"), (3, None, "user", "first"), (3, 2, None, None), (4, 1, "user", "x"), (4, 1, "user", "x"), (11, 5, "user", ""), (1000, 0, "user", "ü" * 5000)]
    rows = same + long + odd
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "depth", "slot", "band", "h", "pos", "shard")})


@pytest.mark.parametrize("size", [{}, {"band_depth": 16, "shard_rows": 50}])
def test_trie_of_turns(turns, size):
    rows, frame = turns
    got = prefix_trie.node_table(frame, **size).select(*NODE).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_trie(rows), key=lambda r: r[:2])
    assert prefix_trie.node_table(frame.limit(0), **size).count() == 0


def test_trie_of_all_conversations(spark, folder, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = QUERIES["op13_prefix_trie"](spark, folder).select(*NODE).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_trie(rows), key=lambda r: r[:2])


def test_node_table_is_minimal_and_checks_its_slots():
    rng = np.random.default_rng(5)
    high, low = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 4, 5000, dtype=np.uint64)
    table = prefix_trie.NodeTable(high, low)
    assert sorted(table.find(high, low).tolist()) == list(range(5000))
    assert (table.find(high, low + np.uint64(9)) == -1).all()
    assert (prefix_trie.NodeTable(high[:0], low[:0]).find(high[:3], low[:3]) == -1).all()

"""Language-model scores from an Elias-Fano n-gram trie (words and word pairs).

The model is p(w | u) = (c(u w) + K p(w)) / (c(u) + K) over the words and the text end, with add-0.1 word probabilities below. K is
chosen by the leave-one-out likelihood of all training tokens. Counts are summed by shards: every chunk of documents sends
its distinct words, then its distinct word pairs, each to the shard of its hash, and gets the corpus' totals back in order. No
shard holds more than its share, however frequent a word, and nothing whole meets in one place.

A chunk then builds the part of the trie that its documents can reach: level one holds words with their quantised log
probability and back-off and a monotone pointer to their successors; level two holds the successors of all contexts as one
monotone sequence (context-relative: the successors of context i are shifted by i times the universe) with quantised smoothed
log probabilities. Pointers and successors are Elias-Fano coded; levels are written to a file and memory-mapped. A pair is
found by successor search in its context's range; a missing pair backs off.

Defined cases: a null text is the empty text, scored by its end alone; a null id hashes like the empty text; without training
tokens every token has probability one (the unseen class is all there is); rows that repeat an id are scored each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .blobs import by_planes, from_planes, gathered, shard_bits, small_batches, squeeze, unsqueeze

CHUNK_TOKENS = 800_000
ADD = 0.1
FOLDS = 10
DISCOUNTS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 3000.0, 10000.0, 100000.0)  # candidates for K
END = b""  # no word is empty
CODES = 1 << 16
FLOOR = -16.0  # log10 probabilities are quantised between this and 0


class Bits:
    """Fixed-width integers packed bit by bit."""

    @staticmethod
    def pack(values: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(0, np.uint8)
        shifts = np.arange(width, dtype=np.uint64)
        return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")

    @staticmethod
    def get(packed: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
        if not width:
            return np.zeros(len(at), np.int64)
        first = at * width
        byte, out = first >> 3, np.zeros(len(at), np.uint64)
        for k in range((width + 14) // 8):
            out |= packed[np.minimum(byte + k, len(packed) - 1)].astype(np.uint64) << np.uint64(8 * k)
        return ((out >> (first & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a count of ones before each word."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, before: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.before = n, width, low, high, before

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> tuple[int, int, list[np.ndarray]]:
        n = len(values)
        width = max(0, int(universe // max(n, 1)).bit_length() - 1)
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(((int(ones[-1]) if n else 0) // 64 + 1) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype("<i8")
        return n, width, [Bits.pack(values & ((1 << width) - 1), width), high, before]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at many positions: select the position-th one, then add the low bits."""
        word = np.searchsorted(self.before, at, "right") - 1
        left, bits = at - self.before[word], self.high[word]
        place = np.zeros(len(at), np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # halve the word that holds the wanted one
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(part)
            over = ones <= left
            left = np.where(over, left - ones, left)
            place = np.where(over, place + half, place)
        return ((word * 64 + place - at) << self.width) | Bits.get(self.low, self.width, at)

    def successor(self, begin: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """For many ranges the first position whose value is at least the wanted one (end, if none is)."""
        low, high = begin.copy(), end.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.get(middle) < wanted[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        return low


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(log10 / FLOOR, 0, 1) * (CODES - 1)).astype("<u2")


def value_of(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / (CODES - 1) * FLOOR


class Trie:
    """Two levels in one memory-mapped file; words are numbered from 0, pairs given as arrays sorted by (context, word)."""

    def __init__(self, word_log: np.ndarray, backoff_log: np.ndarray, context: np.ndarray, word: np.ndarray, pair_log: np.ndarray) -> None:
        self.words = len(word_log)
        counts = np.bincount(context, minlength=self.words)
        pointers = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        sequences = [EliasFano.encode(pointers, len(context) + 1), EliasFano.encode(context * self.words + word, self.words * self.words + 1)]
        arrays = [quantise(word_log), quantise(backoff_log), quantise(pair_log), *sequences[0][2], *sequences[1][2]]
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        spots, at = [], 0
        with os.fdopen(handle, "wb") as file:
            for a in arrays:
                file.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
                spots.append((at, a.dtype, len(a)))
                at += a.nbytes + -a.nbytes % 8
            file.write(b"\0" * 8)
        level = np.memmap(self.path, np.uint8, "r")
        views = [level[p : p + n * t.itemsize].view(t) for p, t, n in spots]
        self.word_code, self.backoff_code, self.pair_code = views[:3]
        self.pointers = EliasFano(*sequences[0][:2], *views[3:6])
        self.successors = EliasFano(*sequences[1][:2], *views[6:9])

    def close(self) -> None:
        os.unlink(self.path)

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 p(word | context) for many pairs."""
        begin, end = self.pointers.get(context), self.pointers.get(context + 1)
        wanted = context * self.words + word
        at = self.successors.successor(begin, end, wanted)
        found = at < end
        found[found] = self.successors.get(at[found]) == wanted[found]
        out = value_of(self.word_code[word]) + value_of(self.backoff_code[context])
        out[found] = value_of(self.pair_code[at[found]])
        return out


def token_chunks(docs: DataFrame, folds: int = FOLDS, size: int = CHUNK_TOKENS) -> DataFrame:
    """(chunk, n_tokens, words, docs, tokens): documents as numbers into the chunk's own word list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0

        def row():
            ids, held, lengths = docs_held
            tokens = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
            train = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(tokens[train], minlength=len(known)).astype("<i8")
            return pd.DataFrame(
                {
                    "chunk": [(part << 32) + made], "n_tokens": [len(tokens)], "words": [squeeze(b"\n".join(known), by_planes(counts))],
                    "docs": [squeeze(ids, np.array(held, bool), np.array(lengths, np.int64))], "tokens": [squeeze(by_planes(tokens))],
                }
            )

        known, docs_held, pieces, total = {END: 0}, ([], [], []), [], 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII white space
                setdefault = known.setdefault
                pieces.append(np.array([setdefault(w, len(known)) for w in words] + [0], dtype="<u4"))
                docs_held[0].append(None if pd.isna(doc_id) else int(doc_id))
                docs_held[1].append(zlib.crc32(b"" if pd.isna(doc_id) else str(int(doc_id)).encode()) % folds == 0)
                docs_held[2].append(len(words) + 1)
                total += len(words) + 1
                if total >= size:
                    yield row()
                    known, docs_held, pieces, total, made = {END: 0}, ([], [], []), [], 0, made + 1
        if docs_held[0]:
            yield row()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(run, "chunk long, n_tokens long, words binary, docs binary, tokens binary")


def _rows_by_shard(chunk: int, shard: np.ndarray, order: np.ndarray, arrays: list[np.ndarray], extra=None) -> list[tuple]:
    """(chunk, shard, blob) with the arrays' entries of each shard, in the given order (sorted by shard)."""
    ordered = shard[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(order) else [0]
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        rows.append((chunk, int(ordered[a]), squeeze(*[by_planes(np.ascontiguousarray(x[own])) for x in arrays], *([b"\n".join(extra[i] for i in own)] if extra else []))))
    return rows


def _word_shards(words: list[bytes], bits: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64) >> np.uint64(64 - bits)


def ask_words(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, blob in zip(frame["chunk"], frame["words"]):
                words, counts = unsqueeze(blob)
                words = words.split(b"\n")
                shard = _word_shards(words, bits).astype(np.int64)
                rows = _rows_by_shard(chunk, shard, np.argsort(shard, kind="stable"), [from_planes(counts, "<i8")], words)
                yield pd.DataFrame(rows, columns=["chunk", "shard", "blob"])

    return run


def total_words(bits: int):
    """Shard task: each word's number (frequent words first, unique over shards) and training count; the shard's sums as chunk -1."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sent = [(words.split(b"\n"), from_planes(counts, "<i8")) for counts, words in map(unsqueeze, group["blob"])]
        totals: dict[bytes, int] = {}
        for words, counts in sent:
            for w, c in zip(words, counts.tolist()):
                totals[w] = totals.get(w, 0) + c
        shard = int(group["shard"].iat[0])
        number = {w: (k << bits) + shard for k, w in enumerate(sorted(totals, key=lambda w: (-totals[w], w)))}
        rows = []
        for chunk, (words, _) in zip(group["chunk"], sent):
            rows.append((chunk, shard, squeeze(by_planes(np.array([number[w] for w in words], "<u8")), by_planes(np.array([totals[w] for w in words], "<i8"))), 0, 0))
        rows.append((-1, shard, None, sum(totals.values()), sum(c > 0 for c in totals.values())))
        return pd.DataFrame(rows, columns=["chunk", "shard", "answer", "tokens", "distinct"])

    return run


def _vocabulary(n: int, shards: np.ndarray, answers) -> tuple[np.ndarray, np.ndarray]:
    """(number, count) of the chunk's words, put together from the shards' answers."""
    order = np.argsort(shards, kind="stable")
    ordered = shards[order]
    number, count = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for a in answers:
        own = order[np.searchsorted(ordered, a["shard"], "left") : np.searchsorted(ordered, a["shard"], "right")]
        numbers, counts = unsqueeze(a["answer"])
        number[own], count[own] = from_planes(numbers, "<u8"), from_planes(counts, "<i8")
    return number, count


def _pairs(tokens: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, word) pairs of the chunk, sorted, and which one each token is. A text starts after an end."""
    previous = np.concatenate([[0], tokens[:-1]]).astype(np.int64)
    previous[np.cumsum(lengths) - lengths] = 0
    code, which = np.unique(previous * words + tokens, return_inverse=True)
    return code // words, code % words, which


def _pair_shards(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _chunk_state(row, bits: int):
    """What both later passes start from: documents, tokens, vocabulary and pairs of a chunk."""
    words = unsqueeze(row["words"])[0].split(b"\n")
    ids, held, lengths = unsqueeze(row["docs"])
    tokens = from_planes(unsqueeze(row["tokens"])[0], "<u4").astype(np.int64)
    number, count = _vocabulary(len(words), _word_shards(words, bits).astype(np.int64), row["vocabulary"])
    return ids, held, lengths, tokens, number, count, *_pairs(tokens, lengths, len(words))


def _pair_order(number: np.ndarray, context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shard = _pair_shards(number[context], number[word], bits)
    return shard, np.lexsort((number[word], number[context], shard))


def ask_pairs(bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, held, lengths, tokens, number, count, context, word, which = _chunk_state(row, bits)
                own = np.bincount(which, np.repeat(~held, lengths), len(context)).astype("<i8")
                shard, order = _pair_order(number, context, word, bits)
                arrays = [number[context], number[word], own, count[context], count[word]]
                yield pd.DataFrame(_rows_by_shard(row["chunk"], shard, order, arrays), columns=["chunk", "shard", "blob"])

    return run


def word_probability(count: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return (count + ADD) / (tokens + ADD * (distinct + 1))


def total_pairs(tokens: int, distinct: int, discounts: tuple = DISCOUNTS):
    """Shard task: the training count of each pair asked for; as chunk -1 the leave-one-out log likelihood for every K."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sent = [[from_planes(p, t) for p, t in zip(unsqueeze(b), ("<u8", "<u8", "<i8", "<i8", "<i8"))] for b in group["blob"]]
        first, second, own, context_count, word_count = (np.concatenate([s[k] for s in sent]) for k in range(5))
        order = np.lexsort((second, first))
        new = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])])
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(own[order], heads)
        total = np.empty(len(order), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        n, cu, cw = sums, context_count[order][heads], word_count[order][heads]
        n, cu, cw = n[n > 0], cu[n > 0], cw[n > 0]
        below = word_probability(cw - 1, tokens - 1, distinct)
        likelihood = [float((n * np.log10((n - 1 + k * below) / (cu - 1 + k))).sum()) for k in discounts]
        shard = int(group["shard"].iat[0])
        edges = np.cumsum([0] + [len(s[0]) for s in sent])
        rows = [(c, shard, squeeze(by_planes(total[a:b].astype("<u4"))), None) for c, a, b in zip(group["chunk"], edges[:-1], edges[1:])]
        rows.append((-1, shard, None, likelihood))
        return pd.DataFrame(rows, columns=["chunk", "shard", "answer", "likelihood"])

    return run


def score_chunks(bits: int, tokens_in_all: int, distinct: int, discount: float):
    """Chunk task: build the trie, look the pairs up, add up by document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, held, lengths, tokens, number, count, context, word, which = _chunk_state(row, bits)
                shard, order = _pair_order(number, context, word, bits)
                ordered, total = shard[order], np.zeros(len(context), np.int64)
                for a in row["pairs"]:
                    own = order[np.searchsorted(ordered, a["shard"], "left") : np.searchsorted(ordered, a["shard"], "right")]
                    total[own] = from_planes(unsqueeze(a["answer"])[0], "<u4")
                below = word_probability(count, tokens_in_all, distinct)
                seen = total > 0
                smoothed = (total + discount * below[word]) / (count[context] + discount)
                trie = Trie(np.log10(below), np.log10(discount / (count + discount)), context[seen], word[seen], np.log10(smoothed[seen]))
                try:
                    pair_log = trie.log10(context, word)
                finally:
                    trie.close()
                starts = np.cumsum(lengths) - lengths
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(ids, dtype="Int64"), "held_out": held, "n_tokens": lengths,
                        "n_known": np.add.reduceat((count[tokens] > 0).astype(np.int64), starts), "train_tokens": tokens_in_all,
                        "base_score": np.add.reduceat(np.log10(below)[tokens], starts), "score": np.add.reduceat(pair_log[which], starts),
                    }
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Scores of every row of docs (doc_id, text) under the model learnt from the rows whose id hash is not 0 modulo folds."""
    small_batches(docs.sparkSession)
    held = cut_lineage(token_chunks(docs, folds))
    bits = shard_bits(3 * (held.agg(F.sum("n_tokens")).first()[0] or 0) // 2)
    words = held.select("chunk", "words").mapInPandas(ask_words(bits), "chunk long, shard long, blob binary")
    told = cut_lineage(words.groupBy("shard").applyInPandas(total_words(bits), "chunk long, shard long, answer binary, tokens long, distinct long"))
    sums = told.filter("chunk < 0").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = sums["tokens"] or 0, sums["distinct"] or 0
    with_words = held.join(gathered(told.filter("chunk >= 0"), "vocabulary"), "chunk")
    asked = with_words.mapInPandas(ask_pairs(bits), "chunk long, shard long, blob binary")
    answer = "chunk long, shard long, answer binary, likelihood array<double>"
    counted = cut_lineage(asked.groupBy("shard").applyInPandas(total_pairs(tokens, distinct), answer))
    fits = counted.filter("chunk < 0").agg(*[F.sum(F.col("likelihood")[i]) for i in range(len(DISCOUNTS))]).first()
    discount = max(zip((f if f is not None else 0.0 for f in fits), DISCOUNTS))[1]
    ready = with_words.join(gathered(counted.filter("chunk >= 0"), "pairs"), "chunk")
    return ready.mapInPandas(score_chunks(bits, tokens, distinct, discount), SCORES)

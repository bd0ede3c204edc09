"""Byte-pair encoding by speculation and verification, and decoding.

A batch's distinct words are encoded once. Greedy longest match proposes their tokens, all words in one pass of an automaton.
A proposal is the exact encoding if and only if every two neighbours are compatible: replayed together, no merge reaches over
the edge between them before the merges that made them. That test runs on arrays, for all distinct neighbours at once. Only
words with a failing edge (or with symbols that the vocabulary lacks) go through exact merging.

The vocabulary is a tokenizer file with byte-level symbols and a word-end suffix. The file's own normalizer and pattern
cut the words; white space always ends a word, so texts are cut there first.

Defined cases: null and empty texts have no tokens and decode to the empty text; a null id and repeated rows are kept as they
are; strings of special tokens become those tokens, as the library does by default; an empty table gives no rows; extra columns are
left out. A text, however long, is handled whole; memory follows 4 MB of text, or a single longer text.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import slices, spread

TOKENIZER = "word_bpe_49k.json"
# what a tokenizer file's pattern calls white space: the White_Space property of Unicode
SPACE = re.compile(r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LAST = 0xE000  # a word's last symbol is moved here, so that it is one character like the others
NEVER = np.iinfo(np.int64).max
WIDE = 32
KNOWN = 200_000  # chunks whose tokens a worker keeps: bounds its memory


class Merges:
    """The merge rules as arrays: the rank that made a token (-1: a symbol), its two halves, and the ranks of pairs by search."""

    def __init__(self, vocabulary: dict[str, int], rules: list[tuple[str, str]]) -> None:
        self.size = max(vocabulary.values(), default=0) + 1
        self.rank = np.full(self.size, -1, np.int64)
        self.halves = np.zeros((2, self.size), np.int64)
        pairs = np.array([(vocabulary[a], vocabulary[b]) for a, b in rules], np.int64).reshape(-1, 2)
        made = np.array([vocabulary[a + b] for a, b in rules], np.int64)
        self.rank[made[::-1]] = np.arange(len(rules))[::-1]  # the earliest rule that makes a token is the one that does
        self.halves[:, made[::-1]] = pairs[::-1].T
        codes = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = np.append(codes[order], NEVER), np.append(order, NEVER)
        self.made = made
        self.by_pair = {(a, b): (k, t) for k, (a, b, t) in reversed(list(enumerate(zip(*pairs.T.tolist(), made.tolist()))))} if rules else {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.searchsorted(self.codes, code)
        return np.where((self.codes[at] == code) & (right >= 0), self.ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joined symbols of both tokens, by rules ranked below limit, leaves exactly these two.

        The merges of both are undone from the last to the first. At each moment the two tokens at the edge must have no rule
        that comes before the next of those merges; among equal ranks the one further left comes first.
        """
        x, y = np.array(left, np.int64), np.array(right, np.int64)
        limit = np.full(len(x), NEVER) if limit is None else np.array(limit, np.int64)
        fits, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            crossing = self.pair_rank(x, y) < limit
            fits[at[crossing]] = False
            undo_left = self.rank[x] > self.rank[y]
            last = np.where(undo_left, self.rank[x], self.rank[y])
            go = ~crossing & (last >= 0)
            at, undo_left, last = at[go], undo_left[go], last[go]
            x = np.where(undo_left, self.halves[1][x[go]], x[go])
            y = np.where(undo_left, y[go], self.halves[0][y[go]])
            limit = np.where(undo_left, last, last + 1)
        return fits

    def reachable(self) -> np.ndarray:
        """Tokens that merging their own symbols leads to."""
        out = self.rank < 0
        made = np.flatnonzero(~out)
        made = made[np.argsort(self.rank[made])]
        fits = self.compatible(*self.halves[:, made], limit=self.rank[made])
        for token, fit, a, b in zip(made.tolist(), fits.tolist(), *self.halves[:, made].tolist()):
            out[token] = fit and out[a] and out[b]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the lowest rank first, among equals the one furthest left; n log n in the word's length."""
        token, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(token) and (found := self.by_pair.get((token[i], token[j]))):
                heapq.heappush(queue, (found[0], i, token[i], token[j], found[1]))

        for i in range(len(token) - 1):
            offer(i)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i] if token[i] == a else len(token)
            if j >= len(token) or token[j] != b:
                continue  # one of the two has been merged meanwhile
            token[i], token[j], after[i] = made, -1, after[j]
            if after[i] < len(token):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]

    def merge_all(self, symbols: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """merge() of many words given one after another. Words of up to WIDE symbols merge side by side, a merge of each per round."""
        starts = np.cumsum(lengths) - lengths
        out: list[list[int]] = [[]] * len(lengths)
        for k in np.flatnonzero(lengths > WIDE):
            out[k] = self.merge(symbols[starts[k] : starts[k] + lengths[k]].tolist())
        words = np.flatnonzero(lengths <= WIDE)
        token = np.full((len(words), WIDE + 1), -1, np.int64)
        token[np.repeat(np.arange(len(words)), lengths[words]), spread(np.zeros(len(words), np.int64), lengths[words])] = symbols[spread(starts[words], lengths[words])]
        rank = self.pair_rank(token[:, :-1], token[:, 1:])
        column = np.arange(WIDE)
        while len(words):
            at = rank.argmin(axis=1)  # the first of equal ranks
            best = rank[np.arange(len(words)), at]
            for k in np.flatnonzero(best == NEVER):
                out[words[k]] = token[k][token[k] >= 0].tolist()
            go = best < NEVER
            words, at, best, token, rank = words[go], at[go], best[go], token[go], rank[go]
            row, behind = np.arange(len(words)), column > at[:, None]
            token[row, at] = self.made[best]
            token[:, :-1] = np.where(behind, token[:, 1:], token[:, :-1])
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[row, at] = self.pair_rank(token[row, at], token[row, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair_rank(token[left, at[left] - 1], token[left, at[left]])
        return out


class SpeculativeEncoder:
    def __init__(self, file: str = TOKENIZER) -> None:
        path = public_tokenizers.path(file)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            model = json.load(handle)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        rules = [tuple(r if isinstance(r, list) else r.split(" ")) for r in model["merges"]]
        self.merges = Merges(vocabulary, rules)
        added = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.strings = {i: t.content for i, t in added.items()} | {i: s for s, i in vocabulary.items()}
        self.table = pa.array([self.strings.get(i, "") for i in range(max(self.strings) + 1)])
        self.symbols = np.full(LAST + 512, -1, np.int64)  # tokens of one character, by that character as match() sees it
        self.automaton = ahocorasick.Automaton()
        reachable = self.merges.reachable()
        self.width = np.zeros(self.merges.size, np.int64)
        for text, token in vocabulary.items():
            form = self.mark_last(text[: -len(self.suffix)]) if self.suffix and text.endswith(self.suffix) and text != self.suffix else text
            self.width[token] = len(form)
            if len(form) == 1:
                self.symbols[ord(form)] = token
            if reachable[token]:
                self.automaton.add_word(form, token)
        self.automaton.make_automaton()
        self.merged_words = self.all_words = 0
        self.forget()

    def mark_last(self, word: str) -> str:
        return word[:-1] + chr(LAST + ord(word[-1]))

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of marked words: tokens, the word of each, and which words are not covered by theirs."""
        found = np.array([x for pair in self.automaton.iter_long("".join(words)) for x in pair], np.int64).reshape(-1, 2)
        ends, tokens = found[:, 0] + 1, found[:, 1]
        word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        owner = np.searchsorted(word_ends, ends, "left")
        covered = np.bincount(owner, weights=self.width[tokens], minlength=len(words))
        return tokens, owner, covered != np.diff(word_ends, prepend=0)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words of byte-level symbols, one word after another, and how many each has."""
        marked = [self.mark_last(w) for w in words]
        tokens, owner, failed = self.match(marked)
        beside = owner[1:] == owner[:-1]
        codes, place = np.unique(tokens[:-1][beside] * self.merges.size + tokens[1:][beside], return_inverse=True)
        fits = self.merges.compatible(codes // self.merges.size, codes % self.merges.size)
        failed[owner[1:][beside][~fits[place]]] = True
        self.all_words += len(words)
        self.merged_words += int(failed.sum())
        left = [marked[k] for k in np.flatnonzero(failed)]
        symbols = self.symbols[np.frombuffer("".join(left).encode("utf-32-le"), np.uint32)]
        exact = self.merges.merge_all(symbols, np.fromiter(map(len, left), np.int64, len(left)))
        keep = ~failed[owner]
        counts = np.bincount(owner[keep], minlength=len(words))
        counts[failed] = [len(e) for e in exact]
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        flat[spread(starts[~failed], counts[~failed])] = tokens[keep]
        flat[spread(starts[failed], counts[failed])] = [t for e in exact for t in e]
        return flat, counts

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts without white space, one after another, and how many each has."""
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = self.library.normalizer.normalize_str("\n".join(chunks))
        edges = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        found = self.library.pre_tokenizer.pre_tokenize_str(line)
        index: dict[str, int] = {}
        word = np.array([index.setdefault(w, len(index)) for w, _ in found], np.int64)
        chunk = np.searchsorted(edges, np.array([span[0] for _, span in found], np.int64))
        flat, counts = self.encode_words(list(index))
        starts = np.cumsum(counts) - counts
        return flat[spread(starts[word], counts[word])], np.bincount(chunk, weights=counts[word], minlength=len(chunks)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, one after another, and how many each text has. Known chunks are kept, up to KNOWN of them."""
        if len(self.index) > KNOWN:
            self.forget()
        index, known = self.index, len(self.index)
        parts: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            for piece in self.special_cut.split(text) if text and "<|" in text else [text or ""]:
                if piece in self.special:
                    parts.append(index[piece + " "])  # no chunk holds a space
                else:
                    parts.extend([index.setdefault(c, len(index)) for c in SPACE.sub(" ", piece).split(" ")])
            ends[k + 1] = len(parts)
        flat, counts = self.encode_chunks(list(itertools.islice(index, known, None)))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
        self.flat, self.counts = np.append(self.flat, flat), np.append(self.counts, counts)
        order = np.array(parts, np.int64)
        totals = np.concatenate([[0], np.cumsum(self.counts[order])])
        return self.flat[spread(self.starts[order], self.counts[order])], np.diff(totals[ends])

    def forget(self) -> None:
        """Keep no chunks but the empty one and the special tokens."""
        self.index = {"": 0} | {text + " ": k + 1 for k, text in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.counts = np.array([0] + [1] * len(self.special), np.int64)
        self.starts = np.array([0, *range(len(self.special))], np.int64)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' strings joined by a space, as the library does for a file that names no decoder."""
        strings = self.table.take(pc.fill_null(ids.flatten(), 0))
        offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")


@functools.cache
def encoder(file: str = TOKENIZER) -> SpeculativeEncoder:
    """One encoder for each worker process."""
    return SpeculativeEncoder(file)


def _encoded(batch: pa.RecordBatch, tokenizer: str) -> tuple[pa.Array, pa.ListArray]:
    flat, counts = encoder(tokenizer).encode(batch.column("text").to_pylist())
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            yield pa.RecordBatch.from_arrays([*_encoded(batch, tokenizer)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids and the text that the ids decode to; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("doc_id"), batch.column("ids"), encoder(tokenizer).decode(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """decode(encode(docs)) in one worker instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            doc_id, ids = _encoded(batch, tokenizer)
            yield pa.RecordBatch.from_arrays([doc_id, ids, encoder(tokenizer).decode(ids)], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")

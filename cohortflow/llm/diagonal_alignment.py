"""Alignment of two tokenizers' tokens by diagonal run skipping, and corpus-wide counts of the id pairs it links.

Both token sequences of a text end at known bytes. Where the same stretch of ends occurs in both, tokens stand one to one at a
constant shift between the two indexes: exponential probing compares stretches of 1, 2, 4, ... ends at once until one differs, halving
steps find where, and the whole run is jumped. At an irregular place the two sequences advance by turns until they end
together, which closes a group and sets the new shift.

A slice of documents (4 MB of text, or one longer document) numbers its distinct id pairs; its documents hold those numbers.
Only a slice's distinct pairs with their counts are added up over the corpus, and the totals go back to the slices that asked.

Defined cases: a null or empty text, and one whose joined token bytes of either side are not the text after a space, has no
tokens and zeros; null ids and repeated rows are kept as they are; an empty table gives no rows; extra columns are left out.
Strings of special tokens are plain text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import slices, spread
from .tokens import TOKENIZER, encoder

PIECES = "piece_bpe_32k.model"
SEGMENT = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+")
OTHER_SPACE = re.compile(r"[\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # a text with one stays whole
KNOWN = 200_000  # segments whose ids a worker keeps: bounds its memory
SIDES = "doc_id long, a_ids array<int>, b_ids array<int>, a_edges array<int>, b_edges array<int>"
PARTS = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, spots array<int>, times array<int>, pairs array<long>"


class PieceModel:
    """A sentencepiece file: ids of texts, and the bytes that each id stands for."""

    def __init__(self, file: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.bytes = np.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)], object)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


@functools.cache
def pieces(file: str = PIECES) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(file)


def diagonal_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of each side lie before the end of each group; both sequences of ends rise to the same last value."""
    a_ends, b_ends = np.ascontiguousarray(a_ends, np.int32), np.ascontiguousarray(b_ends, np.int32)
    a, b, n = memoryview(a_ends), memoryview(b_ends), len(a_ends)
    a_raw, b_raw = a_ends.tobytes(), b_ends.tobytes()
    i = j = 0
    firsts, shifts, lengths = [], [], []  # runs of groups that end at tokens first, first + 1, ... of side a
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            run, step = 1, 1
            while i + run + step <= n and a_raw[4 * (i + run) : 4 * (i + run + step)] == b_raw[4 * (j + run) : 4 * (j + run + step)]:
                run += step
                step += step
            while step > 1:
                step >>= 1
                if i + run + step <= n and a_raw[4 * (i + run) : 4 * (i + run + step)] == b_raw[4 * (j + run) : 4 * (j + run + step)]:
                    run += step
            firsts.append(i)
            shifts.append(j - i)
            lengths.append(run)
            i += run
            j += run
        else:
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            firsts.append(i)
            shifts.append(j - i)
            lengths.append(1)
            i += 1
            j += 1
    lengths = np.array(lengths, np.int64)
    ends = spread(np.array(firsts, np.int64), lengths) + 1
    return ends, ends + np.repeat(np.array(shifts, np.int64), lengths)


class Segments:
    """Both sides' ids of stretches of text that no token of either side reaches out of; up to KNOWN of them are kept.

    A stretch ends before white space that follows other characters: the first side's pattern always cuts there, and no entry of
    the second vocabulary has a space behind a character or holds another white-space character beside it.
    """

    def __init__(self, a_file: str, b_file: str) -> None:
        self.a_model, self.b_model = encoder(a_file), pieces(b_file)
        self.a_bytes, self.a_lengths = self.a_model.token_bytes
        model = self.b_model.model
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any(re.search("[^▁]▁|[\t\n].|.[\t\n]", n) for n in names):
            raise ValueError(f"{b_file}: entries reach over white space")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32)] * 2
        self.counts = [np.zeros(0, np.int64)] * 2

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all segments of the texts, each of which begins with a space, and how many each has; their ids are known then."""
        known, index = len(self.index), self.index
        out, lengths = [], []
        for text in texts:
            cut = [text] if text and OTHER_SPACE.search(text) else SEGMENT.findall(text)
            out += [index.setdefault(s, len(index)) for s in cut]
            lengths.append(len(cut))
        new = list(itertools.islice(index, known, None))
        # behind a line break the second side's own leading space is a token of its own
        b_new = [ids[2:] for ids in self.b_model.model.encode(["\n" + s for s in new], num_threads=1)]
        a_new = [self.a_model.plain(s) for s in new]
        raw = [s.encode() for s in new]
        same = [b"".join(map(self.a_bytes.__getitem__, a)) == r == b"".join(map(self.b_model.bytes.__getitem__, b)) for a, b, r in zip(a_new, b_new, raw)]
        self.same = np.append(self.same, np.array(same, bool))
        for side, ids in enumerate((a_new, b_new)):
            self.ids[side] = np.append(self.ids[side], np.fromiter(itertools.chain.from_iterable(ids), np.int32))
            self.counts[side] = np.append(self.counts[side], np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.array(out, np.int64), np.array(lengths, np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, one after another, and how many each text has; none where a side's bytes differ."""
        if len(self.index) > KNOWN:
            self.forget()
        number, lengths = self.numbers([" " + t if t else "" for t in texts])
        row = np.repeat(np.arange(len(texts)), lengths)
        differ = np.bincount(row, weights=~self.same[number], minlength=len(texts)) > 0
        number, row = number[~differ[row]], row[~differ[row]]
        out = []
        for ids, counts in zip(self.ids, self.counts):
            starts, own = np.cumsum(counts) - counts, counts[number]
            out.append((ids[spread(starts[number], own)], np.bincount(row, weights=own, minlength=len(texts)).astype(np.int64)))
        return out


@functools.cache
def segments(a_file: str, b_file: str) -> Segments:
    """One for each worker process."""
    return Segments(a_file, b_file)


class Aligner:
    """Both sides' tokens and their groups for one slice of texts, text after text in flat arrays."""

    def __init__(self, texts: list[str | None], a_file: str, b_file: str) -> None:
        known = segments(a_file, b_file)
        a_lengths, b_lengths = known.a_lengths, known.b_model.lengths
        (self.a, self.n_a), (self.b, self.n_b) = known.encode(texts)
        a_from, b_from = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        edges, self.n_groups = [], np.zeros(len(texts), np.int64)
        a_sizes, b_sizes = a_lengths[self.a], b_lengths[self.b]
        for k in np.flatnonzero(self.n_a):
            i, j = a_from[k], b_from[k]
            cut = diagonal_groups(np.cumsum(a_sizes[i : i + self.n_a[k]]), np.cumsum(b_sizes[j : j + self.n_b[k]]))
            self.n_groups[k] = len(cut[0])
            edges.append((cut[0] + i, cut[1] + j))
        self.a_edges, self.b_edges = np.concatenate([np.zeros((2, 0), np.int64), *map(np.array, edges)], axis=1)
        self.a_sizes, self.b_sizes, self.ids = a_sizes, b_sizes, max(len(a_lengths), len(b_lengths))
        self.a_from, self.b_from, self.group_from = a_from, b_from, np.cumsum(self.n_groups) - self.n_groups

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """a id, b id and group of every overlapping pair: groups of one token each first, then the others."""
        a_size, b_size = np.diff(self.a_edges, prepend=0), np.diff(self.b_edges, prepend=0)
        single = np.flatnonzero((a_size == 1) & (b_size == 1))
        other = np.flatnonzero((a_size > 1) | (b_size > 1))
        # the tokens of irregular groups, moved together: every start of a token on either side begins a link
        i, j = spread(self.a_edges[other] - a_size[other], a_size[other]), spread(self.b_edges[other] - b_size[other], b_size[other])
        a_ends, b_ends = np.cumsum(self.a_sizes[i]), np.cumsum(self.b_sizes[j])
        ends = np.union1d(a_ends, b_ends)
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        groups = np.repeat(other, a_size[other])[at_a]
        return (
            np.concatenate([self.a[self.a_edges[single] - 1], self.a[i[at_a]]]),
            np.concatenate([self.b[self.b_edges[single] - 1], self.b[j[at_b]]]),
            np.concatenate([single, groups]),
        )

    def group_text(self, text: int) -> str:
        """a1,a2|b1;a3|b2,b3 of one text."""
        g = slice(self.group_from[text], self.group_from[text] + self.n_groups[text])
        a_edges, b_edges = self.a_edges[g] - self.a_from[text], self.b_edges[g] - self.b_from[text]
        a = self.a[self.a_from[text] : self.a_from[text] + self.n_a[text]]
        b = self.b[self.b_from[text] : self.b_from[text] + self.n_b[text]]
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[a_edges - 1], b_mark[b_edges - 1] = 1, 2
        # each side's tokens stand behind the other side's tokens of the groups before (first side) or up to theirs (second)
        place_a = np.arange(len(a)) + np.repeat(np.append(0, b_edges[:-1]), np.diff(a_edges, prepend=0))
        place_b = np.arange(len(b)) + np.repeat(a_edges, np.diff(b_edges, prepend=0))
        out = np.empty(len(a) + len(b), object)
        labels = _labels(self.ids)
        out[place_a], out[place_b] = labels[a_mark, a], labels[b_mark, b]
        return "".join(out.tolist())[:-1]


@functools.cache
def _labels(size: int) -> np.ndarray:
    """Decimal ids with the mark that follows them: a comma inside a side, a bar after the first, a semicolon after the second."""
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], object)


def _list(lengths: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat, kind))


def alignments(docs: DataFrame, a_file: str = TOKENIZER, b_file: str = PIECES) -> DataFrame:
    """doc_id, the ids of both sides, and how many tokens of each side lie before the end of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            at = Aligner(batch.column("text").to_pylist(), a_file, b_file)
            own = np.repeat(np.arange(batch.num_rows), at.n_groups)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    _list(at.n_a, at.a, pa.int32()),
                    _list(at.n_b, at.b, pa.int32()),
                    _list(at.n_groups, at.a_edges - at.a_from[own], pa.int32()),
                    _list(at.n_groups, at.b_edges - at.b_from[own], pa.int32()),
                ],
                names=["doc_id", "a_ids", "b_ids", "a_edges", "b_edges"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIDES)


def _slice_rows(a_file: str, b_file: str, with_groups: bool):
    """Rows of documents, with the slice's numbers of their pairs; before them one row with the slice's pairs in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in PARTS.split(", ")]
        schema = pa.schema([pa.field(n, t) for n, t in zip(names, [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())])])
        for batch in (piece for whole in batches for piece in slices(whole)):
            at = Aligner(batch.column("text").to_pylist(), a_file, b_file)
            a, b, group = at.links()
            spot, pairs = pd.factorize(a.astype(np.int64) << 32 | b)
            total = np.bincount(spot, minlength=len(pairs))
            row = np.repeat(np.arange(batch.num_rows), at.n_groups)[group]
            held, times = np.unique(row * len(pairs) + spot, return_counts=True)
            per_row = np.bincount(held // max(len(pairs), 1), minlength=batch.num_rows)
            texts = [at.group_text(k) if n else "" for k, n in enumerate(at.n_groups.tolist())]
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            none = pa.nulls(1, pa.string())
            head = [pa.array([chunk]), pa.nulls(1, pa.int64()), *[pa.array([-1])] * 4, none, none]
            head += [pa.nulls(1, pa.list_(pa.int32())), pa.array([total.tolist()], pa.list_(pa.int32())), pa.array([pairs.tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(head, schema=schema)
            rows = [
                pa.array(np.full(batch.num_rows, chunk)),
                batch.column("doc_id"),
                *[pa.array(n) for n in (at.n_a, at.n_b, at.n_groups, np.bincount(row, minlength=batch.num_rows))],
                pa.array(texts, pa.string()) if with_groups else pa.nulls(batch.num_rows, pa.string()),
                pa.array(digests, pa.string()),
                _list(per_row, held % max(len(pairs), 1), pa.int32()),
                _list(per_row, times, pa.int32()),
                pa.nulls(batch.num_rows, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)
            chunk += 1

    return run


def link_counts(pairs: DataFrame) -> DataFrame:
    """pair (a id << 32 | b id), total and whether it is the most frequent of its b id, ties included, from rows (pair, n)."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # one row per id of the second vocabulary: a bound that the vocabulary file sets
    most = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    return totals.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str = TOKENIZER, b_file: str = PIECES, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if asked for) of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = cut_lineage(slim.mapInArrow(_slice_rows(a_file, b_file, with_groups), PARTS))
    own = parts.filter("n_a < 0").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("spot", "x"))
    own = own.select("chunk", "spot", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    answers = own.join(cut_lineage(link_counts(own)), "pair").select(F.col("chunk").alias("asked"), "spot", "total", "best")
    rows = parts.filter("n_a >= 0").drop("pairs")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"

    def score(documents: pa.Table, counts: pa.Table) -> pa.Table:
        total, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        spot = counts.column("spot").to_numpy()
        total[spot], best[spot] = counts.column("total").to_numpy(), counts.column("best").to_numpy()
        spots, times = documents.column("spots").combine_chunks(), documents.column("times").combine_chunks()
        held, weight = spots.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(spots.value_lengths().to_numpy())])
        sums = [np.diff(np.concatenate([[0], np.cumsum(v[held] * weight)])[ends]) for v in (best, total)]
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[documents.column(n) for n in names], *map(pa.array, sums), documents.column("groups_sha256"), documents.column("groups")], names=[*names, "n_best", "count_sum", "groups_sha256", "groups"])

    scored = rows.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(score, out)
    return scored if with_groups else scored.drop("groups")

"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index.

Terms are all words of the labelled examples. A term weighs its inverse
document frequency, counted over all documents, times how much it goes with the
label among the examples; none is left out. Weights of unit vectors are cut to
multiples of 2**-12, so sums of their products, which are 1 at most, are exact
in single precision: a cosine, and which examples are nearest, don't depend on
the order of sums or on the rows that happen to be scored together.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LETTER, WHOLE, numbered, pretokens, release, slices, small_batches, spread, stage

#: Labelled rows that fit the classifier, at most: those with the least hashes of their ids.
MAX_EXAMPLES = 20_000
PLACES = 1 << 24
#: A term's weight beside its frequency is FLOOR + c / (c + HALF), with c its chi-square if it goes with the label, else 0.
FLOOR, HALF = 0.02, 50.0
NEIGHBOURS, PRIOR_WEIGHT = 32, 1.0
#: Examples of an index block at most, and documents scored at a time.
BLOCK, QUERIES = 4096, 256
#: Postings that are added up at a time, and bytes of text and vectors that are in hand.
AT_ONCE, HAND_BYTES, HAND_ROWS = 1 << 19, 1 << 20, 1024
#: Terms that more than one in so many examples of a block have are kept as rows of numbers, not as postings.
COMMON = 8
#: Terms by which examples are sorted into blocks.
SORTING = 64
GRAIN = 1 << 12
WORDS = re.compile(r"[^\W\d_]+")
#: Distinct terms that a task counts before it hands the counts on.
HELD = 1_000_000


def words_of(text: bytes) -> Counter:
    return Counter(WORDS.findall(text.decode("utf-8", "replace").lower()))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    toxic: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([toxic[t] for t in seen], pa.int64())], ["term", "n", "n_toxic"])

    for batch, texts in slices(batches):
        for label, text in zip(batch.column("label").to_pylist(), texts.to_pylist()):
            found = words_of(text).keys()
            seen.update(found)
            if label:
                toxic.update(found)
            if len(seen) > HELD:
                yield out()
                seen, toxic = Counter(), Counter()
    if seen:
        yield out()


class Words:
    """The vocabulary: words in order. They are found by hash and then compared, which takes less memory than a table of objects."""

    def __init__(self, words: pa.Array):
        self.words = words.cast(pa.large_binary())

    def __len__(self) -> int:
        return len(self.words)

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, part.to_pylist()), np.uint64, len(part)) for part in (self.words.slice(lo, 1 << 15) for lo in range(0, len(self), 1 << 15))])
        order = np.argsort(own, kind="stable")
        return own[order], order.astype(np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each of these words the place, or -1."""
        if not len(self):
            return np.full(len(words), -1, np.int64)
        known, order = self.hashes
        asked = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
        place = order[np.minimum(np.searchsorted(known, asked), len(known) - 1)]
        return np.where(pc.equal(self.words.take(pa.array(place)), words).to_numpy(zero_copy_only=False), place, -1)

    def __getstate__(self) -> bytes:
        sizes = pc.binary_length(self.words).to_numpy().astype(np.uint32)
        return zstandard.ZstdCompressor(level=3).compress(struct.pack("<Q", len(sizes)) + sizes.tobytes() + b"".join(self.words.to_pylist()))

    def __setstate__(self, state: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(state)
        n = struct.unpack_from("<Q", raw)[0]
        ends = np.append(0, np.cumsum(np.frombuffer(raw, np.uint32, n, 8), dtype=np.int64))
        self.words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[8 + 4 * n :])])


def vectors(texts: pa.Array, vocabulary: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' terms by text and place: places, how often the text has each, and where each text begins (one more than texts).

    Words of plain letters are cut out and looked up in bulk, distinct ones once; words with others are split one by one.
    """
    pieces, first, kind = pretokens(texts)
    coded = pc.dictionary_encode(pieces)
    which, place = coded.indices.to_numpy(), vocabulary.places(coded.dictionary)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    plain = (kind == LETTER) & (place[which] >= 0)
    keys = [text[plain] * len(vocabulary) + place[which[plain]]]
    if (odd := np.flatnonzero(kind == WHOLE)).size:
        own, at = np.unique(which[odd], return_inverse=True)
        lists = [[w.encode() for w in WORDS.findall(x.decode("utf-8", "replace").lower())] for x in coded.dictionary.take(pa.array(own)).to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = vocabulary.places(pa.array([w for words in lists for w in words], pa.large_binary()))
        odd_places = flat[spread((np.cumsum(sizes) - sizes)[at], sizes[at])]
        keys.append((np.repeat(text[odd], sizes[at]) * len(vocabulary) + odd_places)[odd_places >= 0])
    found, n = np.unique(np.concatenate(keys), return_counts=True)
    size = max(1, len(vocabulary))
    return found % size, n, np.searchsorted(found, np.arange(len(texts) + 1) * size)


def _vectors(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most=HAND_BYTES):
            at, n, begins = vectors(texts, vocabulary.value)
            offsets = pa.array(begins, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], ["doc_id", "label", "at", "n"])

    return run


def _document_counts(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        n, counts = 0, np.zeros(len(known), np.int64)
        for _, texts in slices(batches, most=HAND_BYTES):
            n += len(texts)
            counts += np.bincount(vectors(texts, known)[0], minlength=len(known))
        release()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], n))], ["at", "n"])

    return run


def leaves(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows' places in parts of ``most`` at most, cut again and again where they differ most."""
    parts, out = [np.arange(len(rows))], []
    while parts:
        part = parts.pop()
        if len(part) <= most:
            out.append(part)
            continue
        centred = rows[part] - rows[part].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1] if centred.shape[1] else np.zeros(0)
        along = centred @ axis
        order, cut = np.argsort(along, kind="stable"), int((along < 0).sum())
        if not len(part) // 16 < cut < len(part) - len(part) // 16:
            cut = len(part) // 2
        parts += [part[order[cut:]], part[order[:cut]]]
    return out


@dataclass
class Block:
    """Examples that are alike: an inverted index of their terms. Terms that many of them have are kept as rows of numbers instead."""

    dense: np.ndarray  # examples x common terms
    starts: np.ndarray  # of the other terms' postings, one more than terms
    examples: np.ndarray  # of the postings
    weights: np.ndarray

    def cosines(self, query: np.ndarray, place: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """queries x examples. A query's weight of a term: of the common one at ``place``, or, below zero, of the other one at ``-1 - place``."""
        n, is_common = len(self.dense), place >= 0
        asked = np.zeros((queries, self.dense.shape[1]), np.float32)
        asked[query[is_common], place[is_common]] = weight[is_common]
        query, weight, term = query[~is_common], weight[~is_common], -1 - place[~is_common]
        sizes = self.starts[term + 1] - self.starts[term]
        out, ends = (asked @ self.dense.T).astype(float), np.cumsum(sizes)
        lo = 0
        while lo < len(term):  # rows are in order; about AT_ONCE postings are added up at a time
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + AT_ONCE, side="right")))
            posts, first, last = spread(self.starts[term[lo:hi]], sizes[lo:hi]), query[lo], query[hi - 1]
            cells = np.repeat((query[lo:hi] - first) * n, sizes[lo:hi]) + self.examples[posts]
            out[first : last + 1] += np.bincount(cells, np.repeat(weight[lo:hi], sizes[lo:hi]) * self.weights[posts], (last - first + 1) * n).reshape(-1, n)
            lo = hi
        return out


@dataclass
class Index:
    """An inverted index of the examples in blocks, with each term's largest weight in each block.

    A term has an entry for each block that holds it: the block, the largest
    weight in it, and the term's place there. The bound on the cosines of a
    block is the sum of a query's weights times these maxima; a query's best
    block by bound is looked at first, then those that can reach its worst
    neighbour so far. So the neighbours are exactly the nearest.
    """

    labels: np.ndarray
    ids: np.ndarray
    blocks: list[Block]
    begins: np.ndarray  # first example of each block
    first_entry: np.ndarray  # by term, one more than terms
    entry_block: np.ndarray
    entry_max: np.ndarray
    entry_place: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray, terms: int, block: int = BLOCK, common: int = COMMON) -> Index:
        """Of each example, the number of its terms; then all places of terms and their weights on end."""
        n, at = len(sizes), np.append(0, np.cumsum(sizes))
        often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:SORTING]
        column = np.full(terms, -1, np.int16)
        column[often] = np.arange(len(often))
        dense, there = np.zeros((n, len(often)), np.float32), np.flatnonzero(column[term] >= 0)
        dense[np.searchsorted(at, there, side="right") - 1, column[term[there]]] = weight[there]
        parts, blocks, entries = leaves(dense, block), [], []
        del dense, column, there
        for number, part in enumerate(parts):
            flat = spread(at[:-1][part], sizes[part])
            own, value, example = term[flat], weight[flat], np.repeat(np.arange(len(part), dtype=np.int32), sizes[part])
            order = np.argsort(own, kind="stable")
            own, value, example = own[order], value[order].astype(np.float32), example[order]
            start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            counts = np.diff(np.append(start, len(own)))
            is_common = counts * common > len(part)
            place = np.where(is_common, np.cumsum(is_common) - 1, -np.cumsum(~is_common))
            numbers, all_common = np.zeros((len(part), int(is_common.sum())), np.float32), np.repeat(is_common, counts)
            numbers[example[all_common], np.repeat(place, counts)[all_common]] = value[all_common]
            blocks.append(Block(numbers, np.append(0, np.cumsum(counts[~is_common])).astype(np.int32), example[~all_common].astype(np.int16 if len(part) < 1 << 15 else np.int32), value[~all_common]))
            entries.append((own[start].astype(np.int32), np.full(len(start), number, np.int16), np.maximum.reduceat(value, start) if len(start) else value, place.astype(np.int32)))
        own, number, top, place = (np.concatenate(x) for x in zip(*entries)) if entries else (np.zeros(0, np.int32),) * 4
        order = np.argsort(own, kind="stable")
        members = np.concatenate([*parts, np.zeros(0, np.int64)])
        return cls(labels[members], ids[members], blocks, np.append(0, np.cumsum([len(x) for x in parts])), np.searchsorted(own[order], np.arange(terms + 1)).astype(np.int32), number[order], top[order], place[order])

    def nearest(self, at: np.ndarray, weights: np.ndarray, begins: np.ndarray, k: int = NEIGHBOURS, own: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cosines and places of the k nearest examples of each query, and of all that tie with the last of them: larger cosines first.

        Queries are places of terms and weights on end; each begins at ``begins`` (one more than queries). Examples
        without a term in common don't count. own: of each query, the id of an example that doesn't count.
        """
        n, blocks = len(begins) - 1, len(self.blocks)
        if not blocks:
            return [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(n)]
        counts = self.first_entry[at + 1] - self.first_entry[at]
        entry = spread(self.first_entry[at], counts)
        query, weight = np.repeat(np.repeat(np.arange(n), np.diff(begins)), counts), np.repeat(weights, counts)
        number = self.entry_block[entry].astype(np.int64)
        bounds = np.bincount(query * blocks + number, weight * self.entry_max[entry], n * blocks).reshape(n, blocks)
        by_block = np.argsort(number, kind="stable")
        query, weight, place = query[by_block], weight[by_block], self.entry_place[entry[by_block]]
        cut = np.searchsorted(number[by_block], np.arange(blocks + 1))
        best, first, found = np.zeros((n, k)), bounds.argmax(axis=1), []
        for later in (False, True):
            for b in range(blocks):
                asks = np.flatnonzero((bounds[:, b] > 0) & ((first != b) & (bounds[:, b] >= best.min(axis=1)) if later else first == b))
                if not len(asks):
                    continue
                local = np.full(n, -1)
                local[asks] = np.arange(len(asks))
                mine = slice(cut[b], cut[b + 1])
                row = local[query[mine]]
                cosines = self.blocks[b].cosines(row[row >= 0], place[mine][row >= 0], weight[mine][row >= 0], len(asks))
                if own is not None:
                    cosines[self.ids[None, self.begins[b] : self.begins[b + 1]] == np.array(own)[asks, None]] = 0
                top = np.partition(cosines, -k, axis=1)[:, -k:] if cosines.shape[1] > k else cosines
                best[asks] = np.partition(np.append(best[asks], top, axis=1), -k, axis=1)[:, -k:]
                least = best[asks].min(axis=1)
                i, j = np.nonzero((cosines >= least[:, None]) & (cosines > 0))
                found.append((asks[i], cosines[i, j], self.begins[b] + j))
        row, cosines, places = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        order = np.lexsort((self.ids[places], -cosines, row))
        cuts = np.searchsorted(row[order], np.arange(n + 1))
        near = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        near = [x[: np.searchsorted(-cosines[x], -cosines[x[k - 1]], side="right")] if len(x) > k else x for x in near]
        return [(cosines[x], places[x]) for x in near]


def shared_places(cosines: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Falling cosines as votes of k neighbours: those equal to the k-th have the places between them that are left."""
    if len(cosines) <= k:
        return cosines
    tied = cosines == cosines[k - 1]
    return np.where(tied, cosines * ((k - (~tied).sum()) / tied.sum()), cosines)


def units(at: np.ndarray, n: np.ndarray, begins: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (1 + log n) times the terms' own, as unit vectors; in multiples of 1 / GRAIN, cut so that none is longer than 1."""
    own = (1 + np.log(n)) * weight[at]
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    size = np.sqrt(np.bincount(row, own * own, len(begins) - 1))
    return np.floor(own / size[row] * GRAIN) / GRAIN


class Model:
    """The examples as vectors. Pickled, they are packed; the index is made where it is used, once for each Python worker."""

    def __init__(self, words: Words, weight: np.ndarray, rate: float, examples: pa.Table):
        """weight: of each term. rate: toxic share of the examples, which are doc_id, label, at and grains."""
        self.words, self.weight, self.rate = words, weight, rate
        flat = [pc.list_flatten(examples.column(c)).to_numpy() for c in ("at", "grains")]
        self.parts = [np.asarray(x) for x in (examples.column("label").to_numpy().astype(float), examples.column("doc_id").to_numpy(), pc.list_value_length(examples.column("at")).to_numpy())] + [self.packed(np.diff(flat[0], prepend=np.int32(0))), self.packed(flat[1])]

    @staticmethod
    def packed(values: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())

    @cached_property
    def index(self) -> Index:
        unpack = zstandard.ZstdDecompressor().decompress
        labels, ids, sizes, steps, grains = self.parts
        term = np.cumsum(np.frombuffer(unpack(steps), np.int32), dtype=np.int32)
        index = Index.of(sizes, term, np.frombuffer(unpack(grains), np.int16) / np.float32(GRAIN), labels, ids, len(self.weight))
        del term
        release()
        return index

    def __getstate__(self) -> tuple:
        return self.words, self.weight, self.rate, self.parts

    def __setstate__(self, state: tuple) -> None:
        self.words, self.weight, self.rate, self.parts = state

    def votes(self, at: np.ndarray, n: np.ndarray, begins: np.ndarray, own: list[int] | None = None, prior_weight: float = PRIOR_WEIGHT) -> tuple[np.ndarray, list[np.ndarray]]:
        """Toxic share of each text's neighbours, by cosine, with the examples' rate as a prior; and the neighbours' ids.

        Examples that tie for the last places share them, so nothing hangs on their order or ids.
        """
        values, found = units(at, n, begins, self.weight), []
        for lo in range(0, len(begins) - 1, QUERIES):
            some = begins[lo : lo + QUERIES + 1]
            found += self.index.nearest(at[some[0] : some[-1]], values[some[0] : some[-1]], some - some[0], own=own[lo : lo + QUERIES] if own else None)
        weighed = [(shared_places(c), p) for c, p in found]
        shares = [(math.fsum(c * self.index.labels[p]) + prior_weight * self.rate) / (math.fsum(c) + prior_weight) for c, p in weighed]
        return np.array(shares), [self.index.ids[p] for _, p in found]


@dataclass
class Classifier:
    """A model that all tasks can reach, and the calibration of its votes."""

    model: Broadcast
    slope: float = 1.0
    shift: float = 0.0

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        p = np.clip(votes, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log-odds that fit the labels best, with a little weight on leaving them alone."""
    p = np.clip(votes, 1e-6, 1 - 1e-6)
    x, w = np.log(p / (1 - p)), np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (mu - labels) + (w - [1.0, 0.0])
        step = np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]) + np.eye(2), gradient)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def training_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic", most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, label) that learning may see: crc32 of the id as text isn't a multiple of 5; at most ``most`` rows, by hash."""
    ids = F.col(doc_id).cast("long").alias("doc_id")
    rows = labels.select(ids, F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    one = stage(rows.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(PLACES))), "training")
    # Only the first few places are ordered; they hold about four times the rows that are taken.
    n = max(1, one.count())
    near = one.where(F.col("place") < min(PLACES, math.ceil(PLACES * 4 * most / n)))
    return near.orderBy("place", "doc_id").limit(most).select("doc_id", "label")


def association(n: np.ndarray, toxic: np.ndarray, all_n: int, all_toxic: int) -> np.ndarray:
    """Chi-square of each term with the label among the examples, for terms that toxic ones have more often; else 0."""
    n, toxic = n.astype(float), toxic.astype(float)
    apart = np.maximum(toxic * all_n - n * all_toxic, 0.0)
    room = n * (all_n - n) * (all_toxic * float(all_n - all_toxic))
    return np.divide(apart * apart * all_n, room, out=np.zeros_like(apart), where=room > 0)


def _unit_vectors(weight: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, HAND_ROWS) for b in batches for lo in range(0, b.num_rows, HAND_ROWS)):
            lengths = pc.list_value_length(batch.column("at")).to_numpy()
            begins = np.append(0, np.cumsum(lengths))
            values = units(*(batch.column(c).flatten().to_numpy() for c in ("at", "n")), begins, weight.value)
            grains = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array((values * GRAIN).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "label", "at")] + [grains], ["doc_id", "label", "at", "grains"])

    return run


def _own_votes(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, HAND_ROWS) for b in batches for lo in range(0, b.num_rows, HAND_ROWS)):
            at, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "n"))
            begins = np.append(0, np.cumsum(pc.list_value_length(batch.column("at")).to_numpy()))
            votes, _ = model.value.votes(at, n, begins, own=batch.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(votes, pa.float64())], ["doc_id", "label", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_EXAMPLES) -> Classifier:
    """Learn from at most ``most`` labelled documents; document frequencies are counted over all of ``docs``.

    Rows that repeat a labelled text are one example, with the smallest id and
    the largest label. The driver gets the examples' words and vectors, whose
    number ``most`` bounds. No labels at all give a model that scores everything 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chosen = stage(training_labels(labels, doc_id, label, most), "labels")  # at most ``most`` rows
    seen = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    examples = stage(seen, "examples")
    n, n_toxic = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    terms = examples.mapInArrow(_term_counts, "term string, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).toArrow().sort_by("term")
    words = Words(terms.column("term").combine_chunks())
    shared = spark.sparkContext.broadcast(words)
    counted = texts.select("text").mapInArrow(_document_counts(shared), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms) + 1)  # the last place is the number of documents
    counts[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    counts, total = counts[:-1], counts[-1]
    chi2 = association(terms.column("n").to_numpy(), terms.column("n_toxic").to_numpy(), n, n_toxic)
    weight = (np.log((1 + total) / (1 + counts)) + 1) * (FLOOR + chi2 / (chi2 + HALF))
    described = stage(examples.mapInArrow(_vectors(shared), "doc_id long, label int, at array<int>, n array<int>"), "vectors")
    shared.destroy()
    given = spark.sparkContext.broadcast(weight)
    rows = described.mapInArrow(_unit_vectors(given), "doc_id long, label int, at array<int>, grains array<short>").toArrow().sort_by("doc_id").combine_chunks()
    given.destroy()
    fitted = Classifier(spark.sparkContext.broadcast(Model(words, weight, n_toxic / n if n else 0.0, rows)))
    del rows, terms, counted
    if n:
        # Votes of the others on each example.
        own = described.mapInArrow(_own_votes(fitted.model), "doc_id long, label int, vote double").toArrow().sort_by("doc_id")
        fitted.slope, fitted.shift = platt(own.column("vote").to_numpy(), own.column("label").to_numpy().astype(float))
    return fitted


def _scored(fitted: Classifier, text: str, evidence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted.model.value
        for batch, texts in slices(batches, text, HAND_BYTES):
            votes, near = model.votes(*vectors(texts, model.words))
            batch = batch.append_column("score", pa.array(fitted.calibrated(votes), pa.float64()))
            yield batch.append_column("evidence", pa.array([x[:evidence] for x in near], pa.list_(pa.int64()))) if evidence else batch
        release()

    return run


def scored(docs: DataFrame, fitted: Classifier, text: str = "text", evidence: int = 0, names: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """``docs`` with a score (0 to 1), and with ids of the nearest examples, if asked for, in columns of these new names. No shuffle.

    Null and empty texts, like all without a word of the examples, get the
    examples' rate, calibrated. Equal texts have equal scores, whatever stands
    beside them. A very long text counts whole.
    """
    rows, (own,) = numbered(docs, text)
    fields = [*rows.schema.fields, T.StructField("score", T.DoubleType()), *([T.StructField("evidence", T.ArrayType(T.LongType()))] if evidence else [])]
    return rows.mapInArrow(_scored(fitted, own, evidence), T.StructType(fields)).toDF(*docs.columns, names[0], *([names[1]] if evidence else []))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs``; only the text is scored.

    A null id isn't held out. Repeated rows stay repeated; an empty table gives
    an empty result. Columns of ``docs`` other than the two named ones aren't looked at.
    """
    fitted = fit(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored(rows, fitted).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without those that score 0.5 or more; all columns stay, whatever their names."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    fitted = fit(rows, labels.select(F.col(doc_id).alias(own_id), label), own_id, own_text, label)
    return scored(rows, fitted, own_text).where(F.col("score") < 0.5).drop("score").toDF(*docs.columns)

"""Ranked lexical search: posting lists in blocks of similar documents, with coordinatewise-maximum summaries.

A task indexes its documents a shard at a time. A term's posting list is cut into
blocks of documents that are alike, and a block's summary holds the largest
impact of each term in it. A query goes through the lists from the weightiest
term on; a block is skipped only if its summary, weighed by the query, can't
reach the query's worst answer so far, so the answers are exactly the best. What
is left is scored in whole from the documents' vectors. A first look at some
documents of each query's weightiest terms, everywhere, tells what its answers reach at least. Vectors hold the terms
that the queries ask for; document counts and lengths are those of all terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, byte_class, bytes_of, numbered, release, slices, small_batches, spread, stage, word_hashes, words_in

IS_TERM = byte_class(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
BEST = 10
#: Queries, and bytes of their texts, that are asked at a time.
QUERIES, QUERY_BYTES = 4096, 1 << 23
#: Documents and postings of a shard, and documents of a block on average.
SHARD_ROWS, SHARD_POSTINGS, BLOCK = 8192, 1 << 20, 32
#: Documents of a shard that a first look scores for a query, and then stops.
GLANCE = 64
#: Blocks of a list that are looked at before the others are judged again.
FIRST_BLOCKS = 8
#: Numbers that stand for a document where alike ones are sought.
SKETCH = 32
#: Above all impacts.
MOST_IMPACT = 1 << 20
NO_ID = -(1 << 63)
VECTORS = "doc_id long, n long, at array<int>, tf array<int>"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in lower case, each term's start and end, and each text's first term (one more than texts)."""
    data, begins = bytes_of(texts)
    return LOWER[data], *words_in(data, begins, IS_TERM)


@dataclass
class Queries:
    """Distinct terms of some queries by hash, and each query's terms by place."""

    ids: list[int | None]
    hashes: np.ndarray
    sizes: np.ndarray  # bytes of each term: beside 62 bits of hash, a match must have as many
    terms: list[np.ndarray]

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array) -> Queries:
        data, starts, ends, first = terms_of(texts)
        hashes, at = np.unique(word_hashes(data, starts, ends), return_index=True)
        place = np.searchsorted(hashes, word_hashes(data, starts, ends))
        return cls(ids, hashes, (ends - starts)[at], [np.unique(place[a:b]) for a, b in zip(first, first[1:])])

    def found(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word the place of its term, or -1."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        own = word_hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        return np.where((self.hashes[place] == own) & (self.sizes[place] == ends - starts), place, -1)


def _vectors(queries: Queries):
    size = max(1, len(queries.hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            data, starts, ends, first = terms_of(texts)
            place = queries.found(data, starts, ends)
            text = np.repeat(np.arange(len(texts)), np.diff(first))
            keys, tf = np.unique(text[place >= 0] * size + place[place >= 0], return_counts=True)
            cuts = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * size), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (keys % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), *lists], ["doc_id", "n", "at", "tf"])
        release()

    return run


def _counts(size: int):
    """Documents with each term; at ``size`` those with any, after it the length of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            counts[:size] += np.bincount(batch.column("at").flatten().to_numpy(), minlength=size)
            counts[size:] += [(n > 0).sum(), n.sum()]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["at", "count"])

    return run


@dataclass
class Weighing:
    """What the whole collection says: its size and length, and the weight of each of the queries' terms."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Weighing:
        *df, documents, length = (int(x) for x in counts)
        return cls(documents, length, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df], np.int64))

    def impacts(self, n: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each posting; n: of each document with ``sizes`` postings."""
        if 90 * self.documents * int(n.max(initial=0)) < 1 << 63:
            m = 10 + 90 * n * self.documents // max(1, self.length)
        else:
            m = np.array([10 + 90 * int(x) * self.documents // self.length for x in n], np.int64)
        tf = tf.astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))


@dataclass
class Blocks:
    """One posting list, cut."""

    docs: np.ndarray  # by block
    begins: np.ndarray  # of the blocks' documents, one more than blocks
    summary_begins: np.ndarray
    summary_terms: np.ndarray
    summary_most: np.ndarray


@dataclass
class Shard:
    """Some documents' vectors, and their posting lists."""

    ids: np.ndarray
    sizes: np.ndarray
    at: np.ndarray
    impact: np.ndarray
    terms: int
    block: int = BLOCK
    lists: dict[int, Blocks] = field(default_factory=dict)
    looked_at: int = 0
    skipped: int = 0

    def __post_init__(self):
        self.begins = np.append(0, np.cumsum(self.sizes))
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.argsort(self.at, kind="stable")
        self.post_docs = doc[order]
        self.list_begins = np.searchsorted(self.at[order], np.arange(self.terms + 1))
        held = np.flatnonzero(np.diff(self.list_begins))
        self.most = np.zeros(self.terms, np.int64)
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact[order], self.list_begins[held])

    @cached_property
    def sketches(self) -> np.ndarray:
        """Unit vectors of few numbers whose products are about the documents' cosines: terms are dealt to the numbers with a sign."""
        dealt = np.random.default_rng(13).integers(0, 2 * SKETCH, self.terms)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        value = np.where(dealt & 1, 1.0, -1.0)[self.at] * self.impact / np.sqrt(1 + np.diff(self.list_begins))[self.at]
        out = np.bincount(doc * SKETCH + dealt[self.at] // 2, value, len(self.ids) * SKETCH).reshape(-1, SKETCH)
        return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]).astype(np.float32)

    def blocks(self, term: int) -> Blocks:
        """The term's list in blocks: each document goes to the most similar of some that stand evenly in the list."""
        if term not in self.lists:
            docs = self.post_docs[self.list_begins[term] : self.list_begins[term + 1]]
            count = -(-len(docs) // self.block)
            if count > 1:
                near = np.argmax(self.sketches[docs] @ self.sketches[docs[:: self.block]].T, axis=1)
                order = np.argsort(near, kind="stable")
                docs, near = docs[order], near[order]
                label = np.cumsum(np.append(0, near[1:] != near[:-1]))
            else:
                label = np.zeros(len(docs), np.int64)
            begins = np.append(np.flatnonzero(np.append(True, label[1:] != label[:-1])), len(docs))
            flat = spread(self.begins[docs], self.sizes[docs])
            cells = (np.repeat(label * self.terms, self.sizes[docs]) + self.at[flat]) * MOST_IMPACT + self.impact[flat]
            cells.sort()  # by block, term and impact: the last of a term is its largest
            key = cells // MOST_IMPACT
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            block, own = np.divmod(key[last], self.terms)
            self.lists[term] = Blocks(docs, begins, np.searchsorted(block, np.arange(len(begins) - 1)), own.astype(np.int32), (cells[last] % MOST_IMPACT).astype(np.int32))
        return self.lists[term]

    def scores(self, docs: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """In whole; all of these documents have postings."""
        flat = spread(self.begins[docs], self.sizes[docs])
        return np.add.reduceat(whole[self.at[flat]] * self.impact[flat], np.cumsum(self.sizes[docs]) - self.sizes[docs])

    def glance(self, terms: np.ndarray, weights: np.ndarray, whole: np.ndarray, best: Best, most: int = GLANCE) -> None:
        """``best`` takes in some documents of the lists that reach furthest."""
        order, docs = np.argsort(-np.maximum(weights, 0) * self.most[terms], kind="stable"), np.zeros(0, np.int32)
        for term in terms[order[weights[order] > 0]]:
            docs = np.append(docs, self.post_docs[self.list_begins[term] : self.list_begins[term + 1]])
            if len(docs) >= most:
                break
        whole[terms] = weights
        if len(docs := np.unique(docs)):
            best.take(self.scores(docs, whole), self.ids[docs])
        whole[terms] = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, whole: np.ndarray, best: Best) -> None:
        """``best`` takes in this shard's answers. weights: of these terms; whole: zeros, as many as there are terms."""
        terms, weights = terms[self.most[terms] > 0], weights[self.most[terms] > 0]
        reach = np.maximum(weights, 0) * self.most[terms]
        order = np.argsort(-reach, kind="stable")
        left = int(reach.sum())  # no document that is only in the lists from here on scores more
        done = np.zeros(len(self.ids), bool)
        whole[terms] = weights
        for i in order:
            if left <= 0 or left < best.least:
                break
            left -= int(reach[i])
            blocks = self.blocks(int(terms[i]))
            bound = np.add.reduceat(np.maximum(whole[blocks.summary_terms], 0) * blocks.summary_most, blocks.summary_begins)
            asked, lo, step = np.argsort(-bound, kind="stable")[: int((bound > 0).sum())], 0, FIRST_BLOCKS
            while lo < len(asked) and bound[asked[lo]] >= best.least:  # the most promising first, then four times as many of what they leave
                some = asked[lo : lo + step]
                some = some[bound[some] >= best.least]
                docs = blocks.docs[spread(blocks.begins[some], np.diff(blocks.begins)[some])]
                docs = docs[~done[docs]]
                if len(docs):
                    done[docs] = True
                    best.take(self.scores(docs, whole), self.ids[docs])
                lo, step, self.looked_at = lo + step, 4 * step, self.looked_at + len(some)
            self.skipped += max(0, len(bound) - lo)
        whole[terms] = 0


class Best:
    """A query's best answers so far: larger scores first, then smaller ids. floor: as many as are asked for are known to reach it."""

    def __init__(self, k: int, floor: int = 0):
        self.k, self.floor, self.scores, self.ids = k, floor, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores > 0) & (scores >= self.least)
        scores, ids = np.append(self.scores, scores[some]), np.append(self.ids, ids[some])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _answers(queries: Queries, weighing: Weighing, k: int, rows: int, postings: int, block: int, floors: np.ndarray | None = None):
    """floors: of each query, for the search; without them, a first look."""
    size = len(queries.hashes)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held, n = [], 0

        def made() -> Shard:
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(4)]
            sizes = columns[2].value_lengths().to_numpy()
            impact = weighing.impacts(columns[1].to_numpy(), columns[3].flatten().to_numpy(), sizes)
            return Shard(columns[0].fill_null(NO_ID).to_numpy(), sizes, columns[2].flatten().to_numpy(), impact, size, block)

        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("at")), 0))  # others have no term of any query
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                held.append(part)
                n += len(part.column("at").flatten())
                if n >= postings or sum(b.num_rows for b in held) >= rows:
                    yield made()
                    held, n = [], 0
        if held:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, whole = [Best(k, int(floors[i]) if floors is not None else 0) for i in range(len(queries.ids))], np.zeros(size, np.int64)
        for shard in shards(batches):
            for terms, one in zip(queries.terms, best):
                if len(terms):
                    (shard.glance if floors is None else shard.search)(terms, weighing.weights[terms], whole, one)
        sizes = [len(b.scores) for b in best]
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), pa.array(queries.ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(best)), sizes))),
            pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best]) if best else ids, pa.int64()),
        ], ["query", "item_id", "doc_id", "score"])
        release()

    return run


def _block_of_queries(docs: DataFrame, ids: list[int | None], texts: pa.Array, k: int, rows: int, postings: int, block: int) -> DataFrame:
    queries = Queries.of(ids, texts)
    vectors = stage(docs.mapInArrow(_vectors(queries), VECTORS), "vectors")
    counted = vectors.mapInArrow(_counts(len(queries.hashes)), "at long, count long").groupBy("at").agg(F.sum("count").alias("count")).toArrow()  # a row for each of the queries' terms
    counts = np.zeros(len(queries.hashes) + 2, np.int64)
    counts[counted.column("at").to_numpy()] = counted.column("count").to_numpy()
    weighing, schema = Weighing.of(counts), "query int, item_id long, doc_id long, score long"
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    seen = ranked(vectors.mapInArrow(_answers(queries, weighing, k, rows, postings, block), schema)).where(F.col("rank") == k).select("query", "score").toArrow()  # a row for each query at most
    floors = np.zeros(len(ids), np.int64)
    floors[seen.column("query").to_numpy()] = seen.column("score").to_numpy()
    return ranked(vectors.mapInArrow(_answers(queries, weighing, k, rows, postings, block, floors), schema)).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", k: int = BEST, queries: int = QUERIES, rows: int = SHARD_ROWS, postings: int = SHARD_POSTINGS, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item, over all documents.

    Null and empty texts have no terms: such documents are never found, such
    items find nothing. Equal scores go by ascending id, null ids first; rows of
    equal ids are documents, or items, of their own. Items are asked in blocks of
    ``queries`` rows or 8 MB of text, each a scan of the documents; documents of
    any number go through as shards, very long ones whole. Empty tables give an
    empty result. Columns other than the named ones, whatever their names, aren't looked at.
    """
    small_batches(docs.sparkSession)
    own, (own_id, own_text) = numbered(docs, doc_id, text)
    own = own.select(F.col(own_id).cast("long").alias("doc_id"), F.col(own_text).cast("string").alias("text"))
    asked, (item, item_text) = numbered(items, item_id, text)
    asked = asked.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // queries), -(-size // QUERY_BYTES))
    asked = stage(asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "queries") if parts > 1 else asked.withColumn("part", F.lit(0))
    out = []
    for part in range(parts):  # bounded, each
        held = asked.where(F.col("part") == part).select("item_id", "text").toArrow()
        out.append(_block_of_queries(own, held.column("item_id").to_pylist(), held.column("text").combine_chunks().cast(pa.large_binary()), k, rows, postings, block))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def search_sql(k: int = BEST) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with docs as (select doc_id, {terms} as words from documents), items as (select item_id, unnest(list_distinct({terms})) as term from benchmark),
    sums as (select count(*)::bigint as documents, sum(len(words))::bigint as length from docs where len(words) > 0),
    tfs as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, len(words)::bigint as n, unnest(words) as term from docs) where term in (select term from items) group by all),
    weights as (select term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)::double))::bigint as w from tfs, sums group by term),
    scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length))))::bigint as score from items join tfs using (term) join weights using (term), sums group by item_id, doc_id),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
    select item_id, rank, doc_id, score from ranked where rank <= {k}"""

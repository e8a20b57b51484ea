"""Near copies by exact Jaccard similarity of shingle sets, beside those whose fingerprints are near.

Shingles are ordered by how often a sample of texts has them, rare ones first, then by hash: one order for
all sets, whatever the sample, and boilerplate comes last in it. A set of s shingles shares at least 4/5 s of them
with any set at a similarity of 0.8 or more, so two such sets share one of
their first s - ceil(4/5 s) + 1 shingles: no pair is lost by looking at these
only. Of the pairs found so, those are out whose parity sketches (a bit for each
residue: whether an odd number of shingles has it) differ in more bits than the
sets may differ in shingles. A first sketch has 512 bits, of a sample of a large
set's shingles; it lets any similar pair through but for one in 10**9 or fewer.
A second has as many bits as the set has shingles, and loses none. All other
pairs are compared as whole sets.

A shingle that very many prefixes hold is compared in tiles, pairs of groups of
its sets, so no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BROADCAST_ROWS, mixed, numbered, partitions, release, slices, small, small_batches, stage
from .simhash import fingerprint_links, fingerprints_of, grouped, shingle_hashes

#: Sets of one shingle that are compared with all others of it at a time, and that make a group of a tile.
ROWS, TILE = 256, 2048
#: Bits of the first sketch, and shingles of its sample at most, as expected.
SKETCH, SAMPLE = 512, 256
#: Partners of a set at a shingle in the first round; the second compares all pairs that aren't joined by then.
FIRST = 2
#: Texts of the sample, about, and how many of them have a shingle that counts as frequent. It orders, and decides nothing else.
ORDERING_TEXTS, FREQUENT = 8192, 4
INFO = "doc_id long, fp long, text_hash long, key long, size int, sketch binary, large binary, prefix array<long>"


def prefix_size(size: int) -> int:
    return size - (4 * size + 4) // 5 + 1 if size else 0


def _lists(each: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, each)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64)))


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def _sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch with as many bits as shingles, rounded up to a power of two, 64 at least."""
    bits = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def levels(size: np.ndarray) -> np.ndarray:
    """How often a set must be halved for a sample."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / SAMPLE))).astype(np.int64)


def sampled(shingles: np.ndarray) -> bytes:
    """The first sketches: of the sample of the set's own level, and of the next one's, as a similar set may be that much larger."""
    values, level, out = mixed(shingles), int(levels(np.array([len(shingles)]))[0]), []
    for halved in (level, level + 1):
        some = values[values & np.uint64((1 << halved) - 1) == 0]
        out.append(np.packbits(np.bincount((some >> np.uint64(55)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1))
    return np.concatenate(out).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch with ``size`` bytes: residues of the smaller power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size))


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            each = [np.unique(np.array(shingle_hashes(t, n), np.uint64)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*each, np.zeros(0, np.uint64)]).view(np.int64))], ["token"])

    return run


def frequent_shingles(texts: DataFrame, n: int, most: int = BROADCAST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, in order, and how many do; the ``most`` most frequent ones."""
    share = min(1.0, ORDERING_TEXTS / max(1, texts.count()))
    sample = texts.where(F.pmod("text_hash", F.lit(1 << 24)) < int(share * (1 << 24))).dropDuplicates(["text_hash"])
    counts = sample.select("text").mapInArrow(_shingles(n), "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    got = counts.orderBy(F.desc("count"), "token").limit(most).toArrow()
    tokens, count = got.column("token").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], count[order]


def rare_first(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set, which is in order of hashes, in that of its prefix."""
    tokens, count = frequent
    if not len(tokens):
        return shingles
    at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
    return shingles[np.argsort(np.where(tokens[at] == shingles, count[at], 0), kind="stable")]


def _described(n: int, frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            each = [np.array(shingle_hashes(t, n), np.uint64) for t in texts.to_pylist()]
            fp = fingerprints_of(np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))).view(np.int64)
            sets = [np.unique(x) for x in each]
            keys = np.array([_key(x) for x in sets], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(fp), batch.column("text_hash"), pa.array(keys), pa.array([len(x) for x in sets], pa.int32()), pa.array([sampled(x) for x in sets], pa.binary()), pa.array([_sketch(x) for x in sets], pa.binary()), _lists([rare_first(x, frequent.value)[: prefix_size(len(x))] for x in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash", "key", "size", "sketch", "large", "prefix"])
        release()

    return run


def _whole(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            sets = [np.unique(np.array(shingle_hashes(t, n), np.uint64)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_key(x) for x in sets], np.uint64).view(np.int64)), _lists(sets)], ["key", "shingles"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal keys; the rows come in order of these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _starts(batch, *keys)
        if held and all(batch.column(k)[batch.num_rows - 1] == held[0].column(k)[0] for k in keys):
            held.append(batch)
            continue
        if held or new[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
        held = [batch.slice(new[-1])]
    if held:
        yield pa.Table.from_batches(held)


def _starts(rows: pa.RecordBatch | pa.Table, *keys: str) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for k in keys:
        values = rows.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def pairs_in(size: np.ndarray, label: np.ndarray, group: np.ndarray, sketch: np.ndarray, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (later, earlier) of the sets that may be similar and have different labels; first: so many of each later one's.

    Where there are two groups, only pairs of sets of both count. sketch: two, as numbers, of each set.
    """
    later, earlier, level, two = [], [], levels(size), (group != group[0]).any()
    for lo in range(0, len(size), ROWS):
        hi = min(lo + ROWS, len(size))
        room = size[lo:hi, None] + size[None, :hi]
        may = (9 * np.minimum(size[lo:hi, None], size[None, :hi]) >= 4 * room) & (label[lo:hi, None] != label[None, :hi])
        may &= np.arange(lo, hi)[:, None] > np.arange(hi)[None, :]
        if two:
            may &= group[lo:hi, None] != group[None, :hi]
        i, j = np.nonzero(may)
        for a in range(0, len(i), 1 << 17):
            x, y = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
            at = np.maximum(level[lo + x], level[y])
            apart = np.bitwise_count(sketch[lo + x, at - level[lo + x]] ^ sketch[y, at - level[y]]).sum(axis=1, dtype=np.int64)
            most = room[x, y] / 9 / (1 << at)  # shingles of the sample that may differ, as expected
            may[x, y] = apart <= most + np.where(at > 0, 6 * np.sqrt(most) + 10, 0)
        if first is not None:
            may &= np.cumsum(may, axis=1) <= first
        i, j = np.nonzero(may)
        later.append(lo + i)
        earlier.append(j)
    return np.concatenate(later), np.concatenate(earlier)


def _candidates(first: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "token", "i", "j"):
            key, fp, size, label, group = (rows.column(c).to_numpy() for c in ("key", "fp", "size", "root", "own"))
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(key), 2, -1)
            starts = _starts(rows, "token", "i", "j")
            for a, b in zip(starts, np.append(starts[1:], len(key))):
                if (label[a:b] != label[a]).any():
                    i, j = pairs_in(size[a:b].astype(np.int64), label[a:b], group[a:b], sketch[a:b], first)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[a + i], key[a + j], fp[a + i], fp[a + j])], ["a", "b", "u", "v"])
        release()

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that differ in no more bits of their large sketches than their sets may in shingles."""
    for batch in batches:
        sizes = batch.column("sa").to_numpy() + batch.column("sb").to_numpy()
        keep = []
        for x, y, size in zip(batch.column("la").to_pylist(), batch.column("lb").to_pylist(), sizes.tolist()):
            n = min(len(x), len(y))
            keep.append(9 * int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum(dtype=np.int64)) <= size)
        yield batch.select(["a", "b", "u", "v"]).filter(pa.array(keep, pa.bool_()))


def similar_links(texts: DataFrame, info: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Links (u, v) of fingerprints: ``links``, and such that join all sets with a similarity of 0.8 or more.

    ``info`` describes each distinct set once. Two rounds, so that many copies of
    one text don't give all their pairs: each set is first compared with FIRST
    partners at a shingle, then with all that it isn't joined with by then.
    """
    to = partitions(texts.sparkSession)
    postings = info.select("key", F.explode("prefix").alias("token")).select("token", "key")
    held = postings.groupBy("token").count().where("count > 1").select("token", F.when(F.col("count") > TILE, F.ceil(F.col("count") / TILE).cast("int")).alias("groups"))
    shared = stage(postings.join(held, "token"), "shared-shingles")
    named = stage(shared.join(info.select("key", "fp", "size", "sketch"), "key"), "shared-sets")
    own, every = F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"), F.sequence(F.lit(0), F.col("groups") - 1)
    tiles = F.when(F.col("groups").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(every, lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))))
    for first in (FIRST, None):
        roots = components(links).select(F.col("node").alias("fp"), "root")
        rows = named.join(roots, "fp", "left").select("token", "key", "fp", "size", "sketch", "groups", F.coalesce("root", "fp").alias("root"), F.coalesce(own, F.lit(0)).alias("own"))
        tiled = rows.select("token", "key", "fp", "size", "sketch", "root", "own", F.explode(tiles).alias("tile")).select("*", "tile.i", "tile.j").drop("tile")
        dealt = tiled.repartition(to, "token", "i", "j").sortWithinPartitions("token", "i", "j", "key")
        found = dealt.mapInArrow(_candidates(first), "a long, b long, u long, v long").distinct()
        sketches = [info.select(F.col("key").alias(x), F.col("size").alias(f"s{x}"), F.col("large").alias(f"l{x}")) for x in "ab"]
        pairs = stage(found.join(sketches[0], "a").join(sketches[1], "b").mapInArrow(_near, "a long, b long, u long, v long"), "candidates")
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        wanted = stage(info.join(keys, "key", "left_semi").select("text_hash"), "candidate-texts")
        asked = texts.join(small(wanted, wanted.count()), "text_hash", "left_semi").select("text").mapInArrow(_whole(n), "key long, shingles array<long>")
        sets = stage(asked, "candidate-sets").groupBy("key").agg(F.first("shingles").alias("s"))
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("t")), "b")
        alike = 9 * F.size(F.array_intersect("s", "t")) >= 4 * (F.size("s") + F.size("t"))
        links = stage(links.unionByName(both.where(alike).select("u", "v")), "links")
    return links


def similar_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every row, as by ``simhash.near_copies``; texts with a Jaccard similarity of 0.8 or more are linked, too.

    The similarity is that of the sets of n-word shingles, words being what
    blanks part, in lower case (ASCII); fewer words are one shingle. Very long
    texts count whole. Null and empty texts are one class, by their fingerprint.
    Ties don't arise: the smallest id of a component names it. Repeated rows stay
    repeated; an empty table gives an empty result. Other columns aren't looked at.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, n))
    rows = stage(texts.mapInArrow(_described(n, frequent), INFO), "described")
    frequent.destroy()
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    info = stage(rows.where("size > 0").dropDuplicates(["key"]).select("key", "fp", "text_hash", "size", "sketch", "large", "prefix"), "sets")
    # One set has several fingerprints where its shingles repeat differently.
    equal = rows.select("key", F.col("fp").alias("v")).distinct().join(info.select("key", F.col("fp").alias("u")), "key").where("u <> v").select("u", "v")
    links = stage(fingerprint_links(classes.select("fp"), bits).unionByName(equal), "links")
    return grouped(rows.select("doc_id", "fp"), classes, similar_links(texts, info, links, n))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, bits: int = 4) -> DataFrame:
    """``docs`` without the documents that a smaller id stands for. Rows with a null id stay; rows that repeat an id count as one document."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    found = similar_copies(rows, own_id, own_text, n, bits)
    lost = stage(found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("lost")).distinct(), "copies")
    return rows.join(lost, F.col(own_id).cast("long") == F.col("lost"), "left_anti").toDF(*docs.columns)

"""SimHash near-dedup: fingerprints within a few bits, found at the anchors of a covering code.

With three blocks of 21 or 22 bits, two fingerprints that differ in at most 4
bits differ in at most one bit of some block. The anchors of a block are the
words of a covering code: the perfect Hamming code of length 15 next to the
block's other bits as they are. Every block value lies within the covering
radius, 1, of one anchor, its home; values one bit apart therefore both lie
within radius plus 1 of either one's home. A fingerprint goes to every anchor
that near, and is compared there with those at home.

What meets at an anchor grows with the corpus, so very many fingerprints take
longer keys: of six blocks, some three together differ in at most one bit, and
their 32 bits take the Hamming code of length 31. That is 20 keys and about
330 anchors for a fingerprint, where the short keys give 45, but 2**27 anchors
a key instead of 2**17 or 2**18.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import numbered, partitions, slices, small, stage

SEED = 42
#: Fingerprints of one anchor that a comparison handles as one piece; larger anchors are cut into tiles.
TILE = 4096
#: From so many distinct fingerprints on, keys are of three blocks (for 3 bits or more).
LONG_KEYS = 200_000_000


def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of the n-word shingles, repeats included; fewer words are one shingle, none is none."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(joined, SEED)]
    return [h(joined[a:b], SEED) for a, b in zip(starts[: 1 - n].tolist() if n > 1 else starts.tolist(), ends[n - 1 :].tolist())]


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint of each run of ``counts`` hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not some.size:
        return out
    n, begins = counts[some], np.cumsum(counts)[some] - counts[some]
    most = int(n.max())
    if most < 65536:  # four counters of 16 bits in a number
        lanes = np.uint64(0x0001000100010001)
        for b in range(16):
            sums = np.add.reduceat((hashes >> np.uint64(b)) & lanes, begins)
            for lane in range(4):
                over = 2 * ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64) > n
                out[some] |= over.astype(np.uint64) << np.uint64(16 * lane + b)
    else:
        for b in range(64):
            over = 2 * np.add.reduceat((hashes >> np.uint64(b)) & np.uint64(1), begins).astype(np.int64) > n
            out[some] |= over.astype(np.uint64) << np.uint64(b)
    return out


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            each = [shingle_hashes(t, n) for t in texts.to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            hashes = np.fromiter((h for x in each for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(hashes, counts).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprints(n), "doc_id long, fp long")


def keys(bits: int, together: int = 1) -> list[list[tuple[int, int]]]:
    """The keys as lists of (first bit, bits): of the fewest blocks, all choices of 1 or 3 of them, one of which differs in at most a bit.

    Of one block, 22 bits are enough.
    """
    n = bits // 2 + 1 if together == 1 else bits + 2
    if not 0 <= bits <= 7:
        raise ValueError("the distance may be 0 to 7 bits: blocks need 15 bits each")
    cuts = [round(64 * i / n) for i in range(n + 1)]
    each = [(a, min(b - a, 22)) for a, b in zip(cuts, cuts[1:])]
    return [list(x) for x in combinations(each, together)]


def values_of(fp: np.ndarray, key: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """The key's bits of each fingerprint on end, and how many bits these are."""
    out, at = np.zeros(len(fp), np.int64), 0
    for first, size in key:
        out |= ((fp.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64) << at
        at += size
    return out, at


def _syndromes(code: int) -> list[np.ndarray]:
    """For every 16 bits of a value, the XOR of the places (from 1) of its set bits; together zero for words of the code."""
    out = []
    for first in range(0, code, 16):
        x = np.arange(1 << min(16, code - first))
        out.append(np.bitwise_xor.reduce([np.where(x >> i & 1, first + i + 1, 0) for i in range(min(16, code - first))]))
    return out


def _flips(code: int, rest: int) -> list[np.ndarray]:
    """By syndrome, what to flip in a key (code bits lowest) to reach each anchor within distance 2; the first is home."""
    ones = [1 << (code + i) for i in range(rest)]
    out = []
    for s in range(code + 1):
        if not s:
            out.append([0, *ones, *(a | b for a, b in combinations(ones, 2))])
        else:
            home = 1 << (s - 1)
            pairs = [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, code + 1) if a < a ^ s]
            out.append([home, *(home | o for o in ones), *pairs])
    return [np.array(x, np.int64) for x in out]


def _anchors(bits: int, together: int):
    every = keys(bits, together)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for lo in range(0, len(fp), 4096):
                part = fp[lo : lo + 4096]
                for k, key in enumerate(every):
                    value, size = values_of(part, key)
                    code = 31 if size >= 31 else 15
                    if size not in tables:
                        tables[size] = _syndromes(code), _flips(code, size - code)
                    syndromes, flips = tables[size]
                    s = np.bitwise_xor.reduce([t[(value >> 16 * i) & (len(t) - 1)] for i, t in enumerate(syndromes)])
                    for x in np.unique(s):
                        pick = np.flatnonzero(s == x)
                        anchors = (value[pick][:, None] ^ flips[x][None, :]) | (k << (26 if together == 1 else 40))
                        home = np.zeros(anchors.shape, bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel().astype(np.int32 if together == 1 else np.int64)), pa.array(np.repeat(part[pick], len(flips[x]))), pa.array(home.ravel())], ["anchor", "fp", "home"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels (indexes) after the links a-b join their sets."""
    while True:
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]
        while (labels[labels] != labels).any():
            labels = labels[labels]
        if (labels[a] == labels[b]).all():
            return labels


def links_in(fp: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between those at home and all at an anchor, as (smaller, other) fingerprints."""
    values, at = np.unique(fp, return_inverse=True)
    labels = np.arange(len(values))
    at_home = at[home]
    wide = values.view(np.uint64)
    for lo in range(0, len(at_home), 256):
        part = at_home[lo : lo + 256]
        near = np.bitwise_count(wide[part][:, None] ^ wide[None, :]) <= bits
        i, j = np.nonzero(near)
        i = part[i]
        if (far := labels[i] != labels[j]).any():
            labels = _forest(i[far], j[far], labels)
    tied = np.flatnonzero(labels != np.arange(len(values)))
    return values[labels[tied]], values[tied]


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def flush(parts: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
            key, fp, home = (np.concatenate(x) for x in zip(*parts))
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            out = []
            for a, b in zip(new, np.append(new[1:], len(fp))):
                if b - a > 1 and home[a:b].any():
                    out.append(links_in(fp[a:b], home[a:b], bits))
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "i", "j")], axis=1)
            fp, home = batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
            # The last tile of a batch may go on in the next one.
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if change.size else 0
            if kept and (key[0] != kept[-1][0][-1]).any():
                cut, found = max(cut, 0), flush(kept)
                kept = []
            else:
                found = []
            if cut:
                found += flush([*kept, [key[:cut], fp[:cut], home[:cut]]])
                kept = []
            kept.append([key[cut:], fp[cut:], home[cut:]])
            if found and sum(len(u) for u, _ in found):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u for u, _ in found])), pa.array(np.concatenate([v for _, v in found]))], ["u", "v"])
        if kept and (found := flush(kept)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u for u, _ in found])), pa.array(np.concatenate([v for _, v in found]))], ["u", "v"])

    return run


def fingerprint_links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Links (u, v) that connect the same fingerprints as all pairs within ``bits`` do.

    ``distinct`` has distinct fingerprints, fp. At each anchor a spanning forest
    stands for all pairs there, so many near copies give no more links than
    fingerprints. An anchor with over TILE fingerprints is cut into groups of
    about that size; each pair of groups is compared by itself.
    """
    together = 3 if bits >= 3 and distinct.count() >= LONG_KEYS else 1
    rows = distinct.mapInArrow(_anchors(bits, together), f"anchor {'int' if together == 1 else 'long'}, fp long, home boolean")
    large = stage(rows.groupBy("anchor").count().where(F.col("count") > TILE).select("anchor", F.ceil(F.col("count") / TILE).cast("int").alias("k")), "large-anchors")
    cut = rows.join(small(large, large.count()), "anchor", "left")
    group = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    others = F.transform(every, lambda x: F.struct(x.alias("i"), group.alias("j"), F.lit(False).alias("home")))
    own = F.transform(every, lambda x: F.struct(group.alias("i"), x.alias("j"), F.lit(True).alias("home")))
    tiles = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home")))).when(F.col("home"), F.concat(others, own)).otherwise(others)
    tiled = cut.select("anchor", "fp", F.explode(tiles).alias("t")).select("anchor", "t.i", "t.j", "fp", "t.home")
    dealt = tiled.repartition(partitions(distinct.sparkSession), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(_compare(bits), "u long, v long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Equal fingerprints are one class before anything is compared, so exact
    copies cost a sum each. Null and empty texts have fingerprint zero. A null
    id gets its class's component; where a component has no other ids, null.
    Repeated rows stay repeated. Very long texts count whole, shingle by shingle.
    An empty table gives an empty result. Other columns aren't looked at.
    """
    rows = stage(fingerprints(docs, doc_id, text, n), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    return grouped(rows, classes, fingerprint_links(classes.select("fp"), bits))


def grouped(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of ``rows`` (doc_id, fp); ``classes`` has the least id of each fingerprint."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, bits: int = 4) -> DataFrame:
    """``docs`` without the documents that a smaller id stands for. Rows with a null id stay; rows that repeat an id count as one document."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    found = near_copies(rows, own_id, own_text, n, bits)
    lost = stage(found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("lost")).distinct(), "copies")
    return rows.join(lost, F.col(own_id).cast("long") == F.col("lost"), "left_anti").toDF(*docs.columns)

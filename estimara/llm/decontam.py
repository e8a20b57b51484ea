"""Benchmark decontamination by winnowing: k-gram minima shared with test items, extended to exact windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, byte_class, bytes_of, gram_hashes, numbered, release, slices, small, small_batches, stage, word_hashes, words_in

WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
WINDOW, GRAM = 10, 5
#: Benchmark fingerprints that one pass over the documents compares; more are compared in several passes.
BLOCK = 1_000_000
WINDOWS = "item_id string, span int, print long, digest binary"
FOUND = "row_id long, doc_id long, text_hash long, n_words long, hits array<struct<digest:binary,span:int,at:array<int>>>"


def window_prints(words: np.ndarray, span: int, gram: int) -> np.ndarray:
    """The winnowed fingerprint of each window of ``span`` words: its least k-gram hash."""
    k = min(gram, span)
    grams = gram_hashes(words, k)
    n = max(0, len(words) - span + 1)
    out = grams[:n]
    for i in range(1, span - k + 1):
        out = np.minimum(out, grams[i : n + i])
    return out


def _split(texts: pa.Array):
    raw, begins = bytes_of(texts)
    data = LOWER[raw]
    starts, ends, first = words_in(data, begins, WORD)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, span: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(data[a:b].tobytes() for a, b in zip(starts[at : at + span], ends[at : at + span])))


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most=1 << 18):
            data, starts, ends, first, words = _split(texts)
            out: list[tuple] = []
            for item, a, b in zip(batch.column("item_id").to_pylist(), first, first[1:]):
                span = min(window, int(b - a))
                if span:
                    prints = window_prints(words[a:b], span, gram).view(np.int64)
                    out += [(item, span, p, _digest(data, starts, ends, a + i, span)) for i, p in enumerate(prints.tolist())]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["item_id", "span", "print", "digest"])

    return run


def _candidates(prints, gram: int):
    """prints: a broadcast of {span: ordered fingerprints}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prints.value
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("span", pa.int32()), ("at", pa.list_(pa.int32()))]))
        for batch, texts in slices(batches, most=1 << 20):
            data, starts, ends, first, words = _split(texts)
            hits: list[list[dict]] = [[] for _ in range(len(texts))]
            for span, wanted in known.items():
                found = window_prints(words, span, gram)
                if not len(found) or not len(wanted):
                    continue
                place = np.searchsorted(wanted, found)
                at = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == found)
                doc = np.searchsorted(first, at, side="right") - 1
                inside = at + span <= first[doc + 1]
                per: dict[tuple[int, bytes], list[int]] = {}
                for d, i in zip(doc[inside].tolist(), at[inside].tolist()):
                    per.setdefault((d, _digest(data, starts, ends, i, span)), []).append(i - int(first[d]))
                for (d, digest), where in per.items():
                    hits[d].append({"digest": digest, "span": span, "at": where})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "text_hash")), pa.array(np.diff(first), pa.int64()), pa.array(hits, kind)], ["row_id", "doc_id", "text_hash", "n_words", "hits"])
        release()

    return run


def _contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """As ``contamination``, with the XXH64 of each text beside its id."""
    spark = docs.sparkSession
    small_batches(spark)
    tests = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("item_id").isNotNull())
    windows = stage(tests.mapInArrow(_item_windows(window, gram), WINDOWS), "benchmark")
    prints = stage(windows.select("span", "print").distinct(), "benchmark-prints")
    total = prints.count()
    n_blocks = max(1, -(-total // BLOCK))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    if n_blocks > 1:  # all passes must give a row the same number
        rows = stage(rows, "numbered")
    passes = []
    for block in range(n_blocks):
        part: dict[int, list[int]] = {}
        for span, value in prints.where(F.pmod(F.xxhash64("print"), F.lit(n_blocks)) == block).collect():
            part.setdefault(span, []).append(value)
        known = spark.sparkContext.broadcast({span: np.sort(np.array(v, np.int64).view(np.uint64)) for span, v in part.items()})
        passes.append(stage(rows.mapInArrow(_candidates(known, gram), FOUND), "candidates"))
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    holders = stage(windows.select("digest", "span", F.col("item_id").alias("holder")).distinct(), "benchmark-windows")
    hits = found.select("row_id", F.explode("hits").alias("hit")).select("row_id", "hit.digest", "hit.span", "hit.at")
    matched = stage(hits.join(small(holders, holders.count()), ["digest", "span"]), "matched")
    words = F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("span") - 1)))
    # A document's hits are its own words at most; a window that many items hold counts once for its words.
    at_words = matched.select("row_id", "digest", "span", words.alias("words")).dropDuplicates(["row_id", "digest", "span"]).groupBy("row_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("hit_words"))
    held_by = matched.select("row_id", "holder").distinct().groupBy("row_id").agg(F.array_sort(F.collect_list("holder")).alias("held"))
    per_row = at_words.join(held_by, "row_id")
    base = passes[0].select("row_id", "doc_id", "text_hash", "n_words")
    n_hit, held = F.coalesce("hit_words", F.lit(0)).cast("long"), F.coalesce("held", F.array().cast("array<string>"))
    return base.join(per_row, "row_id", "left").select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), held.alias("items"), (n_hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ordered ids as text) and contaminated, a row for each row of ``docs``.

    A shared window has the same least k-gram hash on both sides, so looking
    only at winnowed fingerprints loses no window of ``window`` words; fingerprints
    that agree are extended to the whole window, which 128-bit digests compare
    in a join. Items of fewer words are one window of their own length.

    Benchmark fingerprints go to all tasks in ordered blocks of a million (8 MB)
    at most, with a pass over the documents for each. Null and empty texts have no words.
    Items with a null id are left out. Repeated rows of ``docs`` stay repeated;
    repeated items count once. Other columns aren't looked at.

    Very long texts count whole. An empty table of either kind gives an empty
    result, or one without hits.
    """
    return _contamination(docs, items, doc_id, text, item_id, item_text, window, gram).drop("text_hash")


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item. Rows are told by id and text, so others that repeat an id stay, and rows with a null id are judged, too."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    found = _contamination(rows, items, own_id, own_text, item_id, item_text)
    lost = stage(found.where("contaminated").select(F.col("doc_id").alias("lost"), "text_hash").distinct(), "contaminated")
    on = F.col(own_id).cast("long").eqNullSafe(F.col("lost")) & (F.xxhash64(F.col(own_text).cast("string")) == F.col("text_hash"))
    return rows.join(small(lost, lost.count()), on, "left_anti").toDF(*docs.columns)

"""Line dedup: lines that several documents share stay in the first of them only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import numbered, partitions, release, slices, stage

#: Code points that a key must have.
MIN_CHARS = 10
BITMAPS = "doc_id long, text_hash long, n_lines long, n_dropped long, keep_bitmap binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A to Z in lower case."""
    return line.strip().lower()


def _keys(min_chars: int):
    def long_enough(key: bytes) -> bool:
        return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out: list[tuple] = []
            for doc, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts.to_pylist()):
                lines = text.split(b"\n")
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if long_enough(key := line_key(line)):
                        at.setdefault(key, []).append(i)
                for key, where in at.items():
                    h = xxhash.xxh3_128_intdigest(key)
                    out.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), doc, text_hash, len(lines), where))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.list_(pa.int32()))], ["hi", "lo", "doc_id", "text_hash", "n_lines", "lines"])
        release()

    return run


#: later: an earlier document of this partition has the line. open: no earlier one of this partition has it, but the line is the partition's first.
LATER, OPEN, ENDS = 0, 1, 2


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key and document. What lasts between batches is one key and its first document."""
    part = TaskContext.get().partitionId()
    names = ["kind", "part", "hi", "lo", "last_hi", "last_lo", "doc_id", "text_hash", "n_lines", "lines"]
    lead, key, first = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(c).to_numpy() for c in ("hi", "lo", "doc_id"))
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        new[0] = key != (hi[0], lo[0])
        lead = (hi[0], lo[0]) if lead is None else lead
        group = np.cumsum(new) - 1
        firsts = np.append(doc[new], 0)[group] if new[0] else np.append(first, doc[new])[group + 1]
        later, opening = doc != firsts, (doc == firsts) & (hi == lead[0]) & (lo == lead[1])
        key, first = (hi[-1], lo[-1]), firsts[-1]
        if (pick := np.flatnonzero(later | opening)).size:
            rows = batch.take(pa.array(pick))
            n = len(pick)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(later[pick], LATER, OPEN), pa.int32()), pa.array(np.full(n, part), pa.int32()), *(rows.column(c) for c in ("hi", "lo", "hi", "lo", "doc_id", "text_hash", "n_lines", "lines"))], names)
    if lead is not None:
        yield pa.RecordBatch.from_arrays([pa.array([ENDS], pa.int32()), pa.array([part], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (*lead, *key, 0, 0, 0)), pa.array([[]], pa.list_(pa.int32()))], names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        maps, dropped = [], []
        for n, lines in zip(batch.column("n_lines").to_pylist(), batch.column("lines").to_pylist()):
            keep = np.ones(n, bool)
            keep[np.fromiter((i for part in lines for i in part), np.int64)] = False
            maps.append(pack.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "n_lines")), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_hash", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Of each document that loses lines, a zstandard-compressed bitmap of the lines that it keeps.

    Key hashes are dealt by range over (key, document), so a line that most
    documents hold spans many partitions. A partition knows of each of its keys
    the first document, but for its first key, which may have begun in the one
    before; the partitions' ends, a row for each, settle that.

    Documents are told apart by ``doc_id``; the bitmap of one is also tied to the
    XXH64 of its text, so rows that repeat an id with other texts keep apart.
    Null ids take no part and keep all lines; null and empty texts have one
    empty line.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("doc_id").isNotNull())
    keys = stage(rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_keys(min_chars), "hi long, lo long, doc_id long, text_hash long, n_lines long, lines array<int>"), "line-keys")
    ordered = keys.repartitionByRange(partitions(docs.sparkSession), "hi", "lo", "doc_id").sortWithinPartitions("hi", "lo", "doc_id", "text_hash")
    found = stage(ordered.mapInArrow(_stream, "kind int, part int, hi long, lo long, last_hi long, last_lo long, doc_id long, text_hash long, n_lines long, lines array<int>"), "line-first")
    ends = sorted(found.where(F.col("kind") == ENDS).select("part", "hi", "lo", "last_hi", "last_lo").collect())  # a row for each partition
    goes_on = [int(b["part"]) for a, b in zip(ends, ends[1:]) if (a["last_hi"], a["last_lo"]) == (b["hi"], b["lo"])]
    drops = found.where((F.col("kind") == LATER) | ((F.col("kind") == OPEN) & F.col("part").isin(goes_on)))
    # A text that repeats under one id gives its lines twice; the bitmap takes them once.
    return drops.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_list("lines").alias("lines")).mapInArrow(_bitmaps, BITMAPS)


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[bytes, int, int]:
    """Text of the kept lines, lines before, and lines dropped."""
    lines = text.split(b"\n")
    if bitmap is None:
        return text, len(lines), 0
    keep = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap), np.uint8), count=len(lines)).astype(bool)
    return b"\n".join(x for x, k in zip(lines, keep) if k), len(lines), int((~keep).sum())


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, with columns c0, c1, ..., and one more, ``keep`` (null: all lines stay)."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    keys = bitmaps.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("keep_bitmap").alias("keep"))
    on = (F.col(own_id).cast("long") == F.col("id")) & (F.xxhash64(F.coalesce(F.col(own_text).cast("string"), F.lit(""))) == F.col("hash"))
    return rows.join(keys, on, "left").drop("id", "hash")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "c1"):
        out = [kept_text(t, m) for t, m in zip(texts.to_pylist(), batch.column("keep").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("c0"), pa.array([n for _, n, _ in out], pa.int64()), pa.array([d for *_, d in out], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t, *_ in out])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines, dropped lines and SHA-256 of the kept text, a row for each row of ``docs``; very long texts count whole, an empty table gives an empty result."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_bitmaps(rows, keep_bitmaps(rows, min_chars=min_chars)).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _texts(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column):
            kept = [None if null else kept_text(t, m)[0] for t, m, null in zip(texts.to_pylist(), batch.column("keep").to_pylist(), batch.column(column).is_null().to_pylist())]
            i = batch.schema.get_field_index(column)
            yield batch.set_column(i, column, pa.array(kept, pa.binary()).cast(pa.string())).drop_columns(["keep"])
        release()

    return run


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the shared lines taken out of its texts; all rows and columns stay, null texts too."""
    rows, (own_id, own_text) = numbered(docs, doc_id, text)
    rows = rows.withColumn(own_text, F.col(own_text).cast("string"))
    return with_bitmaps(rows, keep_bitmaps(rows, own_id, own_text, min_chars), own_id, own_text).mapInArrow(_texts(own_text), rows.schema).toDF(*docs.columns)

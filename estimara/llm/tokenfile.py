"""Token files: fixed-size blocks of ids, split into byte or bit planes that are compressed one by one, with an index.

A token file is a folder of Parquet that Spark's committer writes, so a task
that is lost or runs twice leaves no half shard. Its parts, by ``kind``:

* block: shard, block, n (ids; all blocks of a shard but the last have as many),
  plane_bytes (compressed bytes of each plane) and payload (the planes on end);
* doc: shard, row (order in the shard), doc_id, start (ids before it in the shard) and n.

The shards, in order, hold ascending doc_ids. Parquet keeps the index columns
apart from the payloads, so the index is read without them.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import KINDS, SPACE, partitions, pretokens, slices, small, stage

BLOCK_IDS = 1 << 16
#: Pieces whose ids a Python worker remembers: twice as many at most, for one task after the other.
MEMO = 200_000
PARTS = "kind string, shard int, block int, row int, doc_id long, start long, n int, plane_bytes array<int>, payload binary"
# The normaliser and the splitter of tokenizer files whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: A pre-token as the model may take it: lower-case letters of ASCII and Latin-1, a digit, or ASCII punctuation but for the apostrophe.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
def byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class Memo(dict):
    """What ``make`` gave for the latest keys: of two generations of ``most`` keys, the older one goes when the newer is full."""

    def __init__(self, make, most: int = MEMO):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        value = self[key] = self.make(key) if found is None else found
        return value


class WordCoder:
    """A tokenizer file's ids of whole texts, from the ids of pieces where these don't depend on their neighbours.

    That is so for a tokenizer that drops white space, never joins what white
    space parts, and has no added token with white space in it or around it.
    Distinct pieces are encoded once then: the tokenizer's model takes the
    pre-tokens of plain words, which need no Unicode normalisation and split in
    an obvious way; other words go through the whole tokenizer. Any other
    tokenizer gets each text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        with open(path) as f:
            file = json.load(f)
        added = file.get("added_tokens") or []
        alone = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"].split() == [t["content"]] for t in added)
        self.by_piece = alone and file["normalizer"] == NORMALIZER and file["pre_tokenizer"] == SPLITTER and file["model"]["type"] == "BPE" and not file["model"].get("dropout")
        self.literal = re.compile("|".join(re.escape(t["content"]) for t in added).encode()) if added else None
        self.model, self.ids = self.coder.model, Memo(self.piece)

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: bytes) -> bytes:
        """Ids of a piece, little endian."""
        if KINDS[piece[0]] == SPACE:
            return b""
        text = piece.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text) or (self.literal and self.literal.search(piece)):
            return self.whole(text)
        letters = text if text.isascii() else "".join(BYTE_LETTERS[b] for b in piece)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (a large_binary column without nulls)."""
        if not self.by_piece:
            return [np.frombuffer(self.whole(t.decode("utf-8", "replace")), "<u4") for t in texts.to_pylist()]
        pieces, first, _ = pretokens(texts, self.literal)
        coded = pc.dictionary_encode(pieces)
        ids = [self.ids[x] for x in coded.dictionary.to_pylist()]
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))[coded.indices.to_numpy()]
        raw = pa.array(ids, pa.large_binary()).take(coded.indices).buffers()[2]
        every = np.frombuffer(raw, "<u4", int(sizes.sum())) if raw else np.zeros(0, "<u4")
        at = np.append(0, np.cumsum(sizes))[first]
        return [every[a:b] for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Compressed planes: of each id's bytes, or of its bits, from the lowest."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(raw.T)
    pack = zstandard.ZstdCompressor(level=3)
    return [pack.compress(p.tobytes()) for p in planes]


def from_planes(payload: bytes, plane_bytes: list[int], n: int) -> np.ndarray:
    unpack, planes, at = zstandard.ZstdDecompressor(), [], 0
    for size in plane_bytes:
        planes.append(np.frombuffer(unpack.decompress(payload[at : at + size]), np.uint8))
        at += size
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel()
    bits = np.unpackbits(np.stack(planes), axis=1, count=n)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()


def _write(path: str, end_id: int, block_ids: int, bits: bool):
    def batch_of(kind: str, shard: int, n: list[int], **own) -> pa.RecordBatch:
        kinds = {"block": pa.int32(), "row": pa.int32(), "doc_id": pa.int64(), "start": pa.int64(), "plane_bytes": pa.list_(pa.int32()), "payload": pa.binary()}
        filled = {k: pa.array(own[k], t) if k in own else pa.nulls(len(n), t) for k, t in kinds.items()}
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array([shard] * len(n), pa.int32()), filled["block"], filled["row"], filled["doc_id"], filled["start"], pa.array(n, pa.int32()), filled["plane_bytes"], filled["payload"]], ["kind", "shard", "block", "row", "doc_id", "start", "n", "plane_bytes", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4")
        coder = word_coder(path)
        held, held_n, block, row, start = [], 0, 0, 0, 0

        def full(last: bool = False):
            nonlocal held, held_n, block
            ids, at = np.concatenate(held), 0
            while len(ids) - at >= block_ids or (last and at < len(ids)):
                part = ids[at : at + block_ids]
                planes = to_planes(part, bits)
                yield batch_of("block", shard, [len(part)], block=[block], plane_bytes=[[len(p) for p in planes]], payload=[b"".join(planes)])
                at, block = at + len(part), block + 1
            held, held_n = [ids[at:]], len(ids) - at

        for part, texts in slices(batches):
            ids = coder(texts)
            sizes = [len(x) + 1 for x in ids]
            starts = start + np.cumsum([0, *sizes[:-1]])
            yield batch_of("doc", shard, sizes, row=list(range(row, row + len(ids))), doc_id=part.column("doc_id").to_pylist(), start=starts.tolist())
            row, start = row + len(ids), start + sum(sizes)
            held += [x for own in ids for x in (own, end)]
            held_n += sum(sizes)
            if held_n >= block_ids:
                yield from full()
        if held_n:
            yield from full(last=True)

    return run


def token_parts(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, bits: bool = False) -> DataFrame:
    """The parts of a token file of ``docs``, for writing; ids are the tokenizers library's, without special tokens of its own.

    Documents are dealt by range of doc_id (null ids first; equal ids in the
    order of their texts' hashes) and encoded where they land, so the range
    sample reads ids, not texts. Null and empty texts hold the end id only. A
    very long text fills blocks as it goes on. Repeated rows stay repeated. An
    empty table gives a file without blocks. Other columns aren't looked at. An
    added token's literal in a text is that token, as by the library's default.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", F.xxhash64("text"))
    return dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(_write(path, end_id, block_ids, bits), PARTS)


def write_tokens(docs: DataFrame, to: str, path: str, **options) -> None:
    token_parts(docs, path, **options).write.partitionBy("kind").option("compression", "none").parquet(to)


def _part(spark: SparkSession, at: str, kind: str) -> DataFrame:
    columns = {"block": "shard int, block int, n int, plane_bytes array<int>, payload binary", "doc": "shard int, row int, doc_id long, start long, n int"}
    return spark.read.schema(columns[kind]).parquet(f"{at}/kind={kind}")


def _cut(digest: bool):
    """Of each block, the ids of its documents; digest: of those with all their ids in it, the CRC-32 instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "block", "n", "plane_bytes", "payload", "spans")}
                raw, spans = memoryview(from_planes(row["payload"], row["plane_bytes"], row["n"]).tobytes()), row["spans"]
                own = [raw[4 * s["lo"] : 4 * s["hi"]] for s in spans]
                done = [digest and s["whole"] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(spans), pa.int32()), pa.array([s["row"] for s in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int32()), pa.array([zlib.crc32(x) if d else None for x, d in zip(own, done)], pa.int64()), pa.array([None if d else bytes(x) for x, d in zip(own, done)], pa.binary())],
                    ["shard", "row", "block", "crc", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, at: str, block_ids: int = BLOCK_IDS, digest: bool = False) -> DataFrame:
    """shard, row, block, crc and ids: each document's ids in each block that holds some, decoded once a block.

    digest: documents within one block have the CRC-32 of their ids in crc, and no ids.
    """
    docs = _part(spark, at, "doc")
    first, last = F.floor(F.col("start") / block_ids), F.floor((F.col("start") + F.col("n") - 1) / block_ids)
    spans = docs.select("shard", "row", "start", "n", F.explode(F.sequence(first, last)).alias("block")).withColumn("block", F.col("block").cast("int"))
    base = F.col("block").cast("long") * block_ids
    own = F.struct("row", F.greatest(F.col("start") - base, F.lit(0)).cast("int").alias("lo"), F.least(F.col("start") + F.col("n") - base, F.lit(block_ids)).cast("int").alias("hi"), (first == last).alias("whole"))
    # A block holds an id of each of its documents, so a group has block_ids rows at most.
    grouped = spans.select("shard", "block", own.alias("span")).groupBy("shard", "block").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    return _part(spark, at, "block").join(grouped, ["shard", "block"]).mapInArrow(_cut(digest), "shard int, row int, block int, crc long, ids binary")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for parts in batch.column("parts").to_pylist():
            c = 0
            for part in parts:
                c = zlib.crc32(part["ids"], c)
            crc.append(c)
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("row"), pa.array(crc, pa.int64())], ["shard", "row", "ids_crc32"])


def token_digests(spark: SparkSession, at: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and CRC-32 of the ids, read from a token file."""
    docs = _part(spark, at, "doc")
    shards = docs.groupBy("shard").agg(F.sum("n").alias("ids"))  # as many rows as the file has shards
    before = shards.select("shard", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pieces = stage(read_tokens(spark, at, block_ids, digest=True), "token-pieces")
    cut = pieces.where("crc is null").groupBy("shard", "row").agg(F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("parts")).mapInArrow(_joined, "shard int, row int, ids_crc32 long")
    crcs = pieces.where("crc is not null").select("shard", "row", F.col("crc").alias("ids_crc32")).unionByName(cut)
    placed = docs.join(small(before, partitions(spark)), "shard")
    return placed.join(crcs, ["shard", "row"]).select("doc_id", (F.col("before") + F.col("start")).cast("long").alias("start"), F.col("n").cast("long").alias("n_tokens"), "ids_crc32")

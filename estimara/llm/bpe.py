"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks that are stitched where their boundaries meet."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, small_batches, stage

#: Characters of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 16384, 512
#: What becomes of some rows' row_id, doc_id and ids, in the task that has encoded them.
Finish = Callable[[pa.Array, pa.Array, list[bytes]], pa.RecordBatch]
IDS = "row_id long, doc_id long, ids binary"
#: Long texts that are put together at a time.
LONG_ROWS = 16


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; special tokens are ordinary text."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(ranks_path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens on end, and where each begins (one more than tokens)."""
    enc = coder(ranks_path, pattern)
    known = {v: k for k, v in enc._mergeable_ranks.items()}
    tokens = [known.get(i, b"") for i in range(enc.max_token_value + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.append(0, np.cumsum([len(t) for t in tokens]))


def encode(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def decode(ids: np.ndarray, tokens: tuple[np.ndarray, np.ndarray]) -> bytes:
    """The tokens' bytes on end."""
    data, begins = tokens
    sizes = (begins[1:] - begins[:-1])[ids]
    if not len(ids):
        return b""
    ends = np.cumsum(sizes)
    return data[np.repeat(begins[:-1][ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


def _ids(row_id: pa.Array, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row_id, doc_id, pa.array(ids, pa.binary())], ["row_id", "doc_id", "ids"])


def _whole(ranks: str, pattern: str, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield finish(part.column("row_id"), part.column("doc_id"), [encode(enc, t or "").tobytes() for t in part.column("text").to_pylist()])
        release()

    return run


def _cut(size: int, overlap: int):
    """Chunks of ``size`` own characters and, but for the last, ``overlap`` of the next one's; a text is walked through once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_id, doc_id, text in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), (t.as_py() for t in batch.column("text"))):
                begins = list(range(0, len(text), size))
                for lo in range(0, len(begins), 256):
                    some = begins[lo : lo + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row_id] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()), pa.array(range(lo, lo + len(some)), pa.int32()), pa.array(some, pa.int32()), pa.array([min(size, len(text) - x) for x in some], pa.int32()), pa.array([x + size + overlap >= len(text) for x in some]), pa.array([text[x : x + size + overlap] for x in some], pa.string())],
                        ["row_id", "doc_id", "chunk", "begin", "own", "last", "text"],
                    )
        release()

    return run


def _boundaries(pattern: str, overlap: int):
    """Where matches of each chunk begin, in its first and its last characters that a neighbour has too (places in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The encoder's white space is Unicode's.
        pat = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        for batch in batches:
            heads, tails = [], []
            for begin, size, last, text in zip(*(batch.column(c).to_pylist() for c in ("begin", "own", "last", "text"))):
                head, tail, at = [], [], 0
                for m in pat.finditer(text):
                    # A match that touches the chunk's end may end there only because the chunk does.
                    if m.end() == len(text) and not last:
                        break
                    if m.start() < overlap:
                        head.append(begin + m.start())
                    if m.start() >= size:
                        tail.append(begin + m.start())
                    at = m.end()
                if at >= size and not last and (not tail or tail[-1] != begin + at):
                    tail.append(begin + at)
                heads.append(head)
                tails.append(tail)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "chunk", "begin")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["row_id", "chunk", "begin", "heads", "tails"])
        release()

    return run


def stitches(chunks: DataFrame, pattern: str, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, chunk, start, stop): of each chunk the piece that begins in it, which starts and ends at matches of the whole text (null: at the chunk's end).

    A chunk's matches are those of the text from the first place where both it
    and the chunk before begin one. Where two neighbours share no such place (a
    match longer than the overlap), start is null. The pattern must decide a match by what it matches and at most
    one character more, as the one given does; a pattern that looks further back
    over white space, such as for line ends after blanks, isn't for this.
    """
    marks = chunks.mapInArrow(_boundaries(pattern, overlap), "row_id long, chunk int, begin int, heads array<int>, tails array<int>")
    by_row = Window.partitionBy("row_id").orderBy("chunk")
    meet = F.array_min(F.array_intersect("heads", F.lag("tails").over(by_row)))
    # The first chunk begins where its text does.
    starts = marks.withColumn("start", F.when(F.lag("chunk").over(by_row).isNull(), F.lit(0)).otherwise(meet))
    return starts.select("row_id", "chunk", "start", F.lead("start").over(by_row).alias("stop"))


def stitched(chunks: DataFrame, pattern: str, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """The chunks and their stitches, none of which is open.

    Neighbours that share no place are one chunk from then on, pre-tokenised
    again from its beginning, which stitches the next boundary or joins one
    chunk more: a chunk grows as long as the match that lies across its
    boundaries, while all other chunks stay as they are.
    """
    cuts = stage(stitches(chunks, pattern, overlap), "stitches")
    while cuts.where("start is null").limit(1).count():
        runs = cuts.withColumn("run", F.count("start").over(Window.partitionBy("row_id").orderBy("chunk")))
        open_ = runs.join(runs.where("start is null").select("row_id", "run").distinct(), ["row_id", "run"], "left_semi")
        parts = chunks.join(open_.select("row_id", "chunk", "run"), ["row_id", "chunk"]).groupBy("row_id", "doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("chunk", "begin", "own", "last", "text"))).alias("p"))
        first, final, rest = F.element_at("p", 1), F.element_at("p", -1), F.slice("p", F.lit(1), F.size("p") - 1)
        own_text = F.array_join(F.transform(rest, lambda x: F.substring(x["text"], F.lit(1), x["own"])), "")
        own_size = F.aggregate("p", F.lit(0), lambda n, x: n + x["own"])
        joined = parts.select("row_id", "doc_id", first["chunk"].alias("chunk"), first["begin"].alias("begin"), own_size.alias("own"), final["last"].alias("last"), F.concat(own_text, final["text"]).alias("text"))
        others = chunks.join(open_.select("row_id", "chunk"), ["row_id", "chunk"], "left_anti").select(*joined.columns)
        texts = open_.select("row_id").distinct()
        chunks = stage(others.unionByName(joined), "chunks")
        again = stitches(chunks.join(texts, "row_id", "left_semi"), pattern, overlap)
        cuts = stage(cuts.join(texts, "row_id", "left_anti").unionByName(again), "stitches")
    return chunks, cuts


def pieces_of(chunks: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row_id, doc_id, start, piece): what lies between two cuts, taken out of the chunk in which it begins; the last one to its chunk's end."""
    at = chunks.join(cuts, ["row_id", "chunk"])
    stop = F.coalesce(F.col("stop"), F.col("begin") + F.col("own"))
    return at.select("row_id", "doc_id", "start", F.substring("text", F.col("start") - F.col("begin") + 1, stop - F.col("start")).alias("piece"))


def _joined(finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, LONG_ROWS):
                part = batch.slice(lo, LONG_ROWS)
                yield finish(part.column("row_id"), part.column("doc_id"), [b"".join(x["ids"] for x in parts) for parts in part.column("parts").to_pylist()])
        release()

    return run


def _pieces(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = coder(ranks, pattern)
        for batch in batches:
            ids = [encode(enc, t).tobytes() for t in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_id", "doc_id", "start")), pa.array(ids, pa.binary())], ["row_id", "doc_id", "start", "ids"])
        release()

    return run


def encoded(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row_id, doc_id and ids (unsigned 32-bit, little endian) of every row.

    Texts within one chunk are encoded as they are read, without a shuffle.
    Longer ones are cut, once, into chunks that may run on any executor; their
    boundaries are shuffled to find the stitches, and the ids of their pieces to
    bring each document together. Null is the empty text. Repeated rows stay
    repeated, told apart by row_id. An empty table gives an empty result. Other
    columns aren't looked at.
    """
    return _finished(docs, ranks, pattern, doc_id, text, size, overlap, _ids, IDS)


def _finished(docs: DataFrame, ranks: str, pattern: str, doc_id: str, text: str, size: int, overlap: int, finish: Finish, schema: str) -> DataFrame:
    """What ``finish`` makes of every row's ids where they come about: a second mapInArrow would keep a second Python worker for each running task, with encoder and batches of its own."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    long = F.char_length("text") > size
    short = rows.where(~long).mapInArrow(_whole(ranks, pattern, finish), schema)
    chunks = stage(rows.where(long).mapInArrow(_cut(size, overlap), "row_id long, doc_id long, chunk int, begin int, own int, last boolean, text string"), "chunks")
    cut_out = pieces_of(*stitched(chunks, pattern, overlap))
    done = cut_out.mapInArrow(_pieces(ranks, pattern), "row_id long, doc_id long, start int, ids binary")
    together = done.groupBy("row_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "ids"))).alias("parts")).mapInArrow(_joined(finish), schema)
    return short.unionByName(together)


def _digests(ranks: str, pattern: str, with_ids: bool) -> Finish:
    def finish(row_id: pa.Array, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        tokens = token_bytes(ranks, pattern)
        decoded = [hashlib.sha256(decode(np.frombuffer(x, "<u4"), tokens)).hexdigest() for x in ids]
        columns = [doc_id, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], [*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(columns, names)

    return finish


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokens, SHA-256 of the ids and of the bytes that the ids decode to, a row for each row of ``docs``; with_ids: the ids, too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return _finished(docs, ranks, pattern, doc_id, text, CHUNK, OVERLAP, _digests(ranks, pattern, with_ids), schema)

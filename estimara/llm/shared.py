"""What the operators share: staged tables, row slices, and words found with NumPy.

Staged tables are written below the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor costs no more than the tasks that it ran.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import clear_staged, folder, shared_folder, stage

__all__ = ["clear_staged", "folder", "shared_folder", "stage"]
#: Bytes of text that one NumPy step handles; a longer text is a step of its own.
SLICE_BYTES = 1 << 21
#: Rows of a batch.
BATCH_ROWS = 1000
#: Rows that a frame may have, by count, for a broadcast to be asked for.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession) -> None:
    """From now on in this session, rows go to Python by 1,000 at most: a task holds whole batches on either side, and rows are texts here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... and the new names of these columns: no name of a table's own can clash or need quotes then."""
    lower = [c.lower() for c in df.columns]
    return df.toDF(*(f"c{i}" for i in range(len(lower)))), [f"c{df.columns.index(x) if x in df.columns else lower.index(x.lower())}" for x in names]


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def release() -> None:
    """Give memory that isn't used any more back to the system: executors count what their Python workers hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about ``most`` bytes of text each, and that text."""
    for batch in batches:
        texts = binary(batch.column(column))
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts on end, and where each text begins (one more than texts)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_class(pattern: str) -> np.ndarray:
    """For each byte, whether the character class ``pattern`` holds it (bytes over 127 count by the pattern, too)."""
    known = re.compile(pattern.encode("latin-1") if "\\x" not in pattern else pattern.encode("ascii"))
    return np.array([known.fullmatch(bytes([b])) is not None for b in range(256)])


def lower_table() -> np.ndarray:
    """Bytes with A to Z in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def words_in(data: np.ndarray, begins: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of the first word of each text (one more than texts)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = begins[:-1]
    before[cut[cut < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = begins[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, begins)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out) if n else out


#: Odd multiplier of the words' rolling hash (any odd number does), and its inverse modulo 2**64.
WORD_BASE = 0xD1342543DE82EF95
WORD_BACK = pow(WORD_BASE, -1, 1 << 64)
#: The bytes' rolling hash is a polynomial in two prime fields; any bases do.
FIELDS = [((1 << 31) - 1, 1_103_515_245), ((1 << 31) - 19, 1_664_525_013)]
BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 30, 256)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolled(values: np.ndarray, base: int, back: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of values; equal runs have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(base, len(values)), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _powers(back, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def field_powers(base: int, prime: int, size: int) -> np.ndarray:
    """base ** i modulo prime, for i below ``size``."""
    out = np.ones(1, np.int64)
    while len(out) < size:
        out = np.append(out, out * pow(base, len(out), prime) % prime)
    return out[:size]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: 62 bits of polynomials over fields, so no words are made to collide by their repetition."""
    sizes = ends - starts
    out = sizes.astype(np.uint64)
    if not len(sizes):
        return out
    begins = np.cumsum(sizes) - sizes
    at = spread(starts, sizes)
    values = BYTE_VALUES[data[at]]
    at -= np.repeat(starts, sizes)  # places in the words
    for prime, base in FIELDS:
        own = np.add.reduceat(values * field_powers(base, prime, int(sizes.max()))[at] % prime, begins) % prime
        out = mixed(out ^ (own.astype(np.uint64) << np.uint64(16)))
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on (those that run over the end are missing)."""
    at = np.arange(max(0, len(words) - n + 1))
    return _rolled(words, WORD_BASE, WORD_BACK, at, at + n)


def totals(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of the flags in each part."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[begins[1:]] - sums[begins[:-1]]


ODD, LETTER, DIGIT, MARK, SPACE, WHOLE = range(6)


def byte_kinds() -> np.ndarray:
    """Of each byte alone; all bytes of what isn't ASCII are odd."""
    text = "".join(map(chr, range(128)))
    own = [SPACE if c in "\t\n\v\f\r " else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK if c.isprintable() and c != "'" else ODD for c in text]
    return np.array(own + [ODD] * 128, np.uint8)


KINDS = byte_kinds()


def pretokens(texts: pa.Array, literal: re.Pattern[bytes] | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All bytes of the texts cut up, the index of each text's first piece (one more than texts), and what kind each piece is.

    A piece is a run of white space, a lower-case pre-token of a plain word, or
    a whole word as it stands: one with other characters, or with a match of ``literal``.
    """
    data, begins = bytes_of(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(begins), np.int64), np.zeros(0, np.uint8)
    kind, low = KINDS[data], LOWER[data]
    lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF, all letters but for the signs at U+00D7 and U+00F7
    lead = lead[lead + 1 < len(data)]
    lead = lead[(data[lead + 1] >> 6 == 2) & ((data[lead + 1] & 0xDF) != 0x97)]
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[data[lead + 1] < 0x9F] + 1
    low[upper] += 32
    for match in literal.finditer(data.tobytes()) if literal else ():
        kind[match.start() : match.end()] = ODD
    if not kind.all():
        starts, ends, _ = words_in(data, begins, KINDS != SPACE)
        odd = totals(kind == ODD, np.append(starts, len(data))) > 0  # only white space stands between two words
        edges = np.zeros(len(data) + 1, np.int8)
        np.add.at(edges, starts[odd], 1)
        np.add.at(edges, ends[odd], -1)
        whole = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
        kind[whole] = WHOLE
        low[whole] = data[whole]
    new = np.empty(len(data), bool)
    new[0] = True
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    new[begins[:-1][begins[:-1] < len(data)]] = True
    cuts = np.append(np.flatnonzero(new), len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(low)]), np.searchsorted(cuts, begins), kind[cuts[:-1]]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)

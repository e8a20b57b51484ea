"""Quality rules: text rules of a document, and verdicts on its host with an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bytes_of, byte_class, gram_hashes, slices, small, stage, totals, word_hashes, words_in

WORD = byte_class(r"[^\x20\x09-\x0D]")
SYMBOL = byte_class(r"[#*$%&|<>]")
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
METRICS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def _repeat_words(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Words of each text inside windows that the text has twice or more."""
    n = np.diff(begins)
    windows = np.maximum(n - WINDOW + 1, 0)
    if not windows.sum():
        return np.zeros(len(n), np.int64)
    doc = np.repeat(np.arange(len(n)), windows)
    at = np.arange(len(doc)) + np.repeat(begins[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    hashes = gram_hashes(words, WINDOW)[at]
    order = np.lexsort((hashes, doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edges = np.zeros(len(words) + 1, np.int64)
    hit = at[order[again]]
    edges[hit] += 1
    edges[hit + WINDOW] -= 1
    return totals(np.cumsum(edges)[:-1] > 0, begins)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        data, begins = bytes_of(texts)
        starts, ends, first = words_in(data, begins, WORD)
        points = WORD[data] & ((data & 0xC0) != 0x80)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("host"), pa.array(np.diff(first), pa.int64()), pa.array(totals(points, begins)), pa.array(totals(SYMBOL[data], begins)),
                pa.array([_dup_lines(t) for t in texts.to_pylist()], pa.int64()), pa.array(_repeat_words(word_hashes(data, starts, ends), first)),
            ],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row of text measures for each row of ``docs``, written once (texts are read once)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    return stage(rows.mapInArrow(_measure, METRICS), "quality").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measures: DataFrame, max_rate: float = MAX_HOST_RATE) -> tuple[DataFrame, int]:
    """Failures by host, shrunk with a beta prior fitted by moments to all hosts, and how many hosts there are.

    With m the overall rate, N documents, k hosts and S the sum of n(p - m)^2, the
    spread between hosts is rho = (S - (k-1) m(1-m)) / (m(1-m) (N - sum n^2 / N - (k-1))),
    the prior's strength 1/rho - 1. Without spread (or with one host) the strength is a million.
    """
    hosts = stage(measures.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    k, n, failed, squares = hosts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()
    mean = failed / n if n else 0.0
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - F.lit(mean), 2))).first()[0] or 0.0
    room = mean * (1 - mean) * (n - squares / n - (k - 1)) if n else 0.0
    rho = (spread - (k - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    strength = 1 / rho - 1 if rho > 1e-6 else 1e6
    strength = max(strength, 1e-6)
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected")), k


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Measures and verdicts, a row for each row of ``docs``.

    A null text counts as an empty one. A row without a host (null) gets no host
    verdict and counts for no host. Repeated rows stay repeated. Columns of
    ``docs`` other than the three named ones aren't looked at. An empty table
    gives an empty result; very long texts count whole. Hot hosts are summed before the shuffle; the verdict
    join is a broadcast up to 200,000 counted hosts and a plain join, which
    adaptive execution splits, beyond.
    """
    measures = measured(docs, doc_id, text, host)
    verdicts, k = host_verdicts(measures, max_rate)
    joined = measures.join(small(verdicts, k), "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("host_rate", 6).alias("host_rate"))

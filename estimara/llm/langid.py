"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; a binary classifier for each bit tells, from the
n-grams of a text's words, the languages with a 1 there from those with a 0. Bits
weigh in the decoding as they have been right for a language (loss-weighted
decoding), the codeword with the least weighted loss wins, and bits that are too
far from it mark the text as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, bytes_of, numbered, release, slices, small_batches

#: Features are n-grams of 1 to ORDERS bytes, dealt to PLACES places.
ORDERS, PLACE_BITS = 4, 17
PLACES = 1 << PLACE_BITS
SPACE = 32
#: Languages for which all ways to part them are bits; more get BITS_EACH * log2(languages) bits, the best of TRIES draws.
ALL_WAYS, BITS_EACH, TRIES = 5, 10, 200
#: Added to every count.
SMOOTHING = 0.1
#: Labelled documents that tell how far each bit can be trusted, about (those with the least hashes of their ids; twice as many at most).
WEIGHING_ROWS = 20_000
#: Places whose features are looked up at a time, and counts that a task holds before it hands them on.
AT_ONCE, HELD = 1 << 18, 1 << 24
UNKNOWN = "und"


def _shape() -> np.ndarray:
    """Of each byte what n-grams see: letters in lower case, bytes of other scripts as they are, all else a space."""
    out = LOWER.copy()
    is_letter = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
    out[~is_letter] = SPACE
    return out


SHAPE = _shape()


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, text) of all n-grams, a part of the texts at a time: n-grams of words with a space before and after them, none across a space."""
    data, begins = bytes_of(texts)
    n = len(texts)
    if not n:
        return
    own = np.full(len(data) + n + ORDERS, SPACE, np.uint8)  # a space before each text
    starts = begins[:-1] + np.arange(n)
    shift = np.repeat(np.arange(1, n + 1), np.diff(begins))
    own[np.arange(len(data)) + shift] = SHAPE[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)) + 1  # of U+00C0 to U+00DE
    own[upper + shift[upper]] += 32
    text = np.repeat(np.arange(n), np.diff(np.append(starts, len(own))))
    is_space = own == SPACE
    keep = ~(is_space & np.append(False, is_space[:-1]))  # one space between words
    own, text = np.append(own[keep], np.full(ORDERS, SPACE, np.uint8)), text[keep]
    for lo in range(0, len(text), AT_ONCE):
        part = own[lo : lo + AT_ONCE + ORDERS]
        m = min(AT_ONCE, len(text) - lo)
        is_space = part == SPACE
        code, inner, reach = np.zeros(m, np.uint32), np.zeros(m, bool), np.minimum(lo + np.arange(m) + is_space[:m], len(text) - 1)
        whose = text[reach]
        for order in range(ORDERS):
            if order > 1:
                inner |= is_space[order - 1 : order - 1 + m]
            code |= part[order : order + m].astype(np.uint32) << np.uint32(8 * order)
            good = ~inner & ~(is_space[:m] & (is_space[1 : m + 1] if order else True))
            yield (code[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - PLACE_BITS), whose[good]


def _language_counts(languages: list[str]):
    number, k = {x: i for i, x in enumerate(languages)}, len(languages)
    dense = k * PLACES <= HELD

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys // PLACES, pa.int32()), pa.array(keys % PLACES, pa.int32()), pa.array(n, pa.int64())], ["language", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * PLACES if dense else 0, np.int64)
        for batch, texts in slices(batches):
            language = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for place, text in features(texts):
                keys = language[text] * PLACES + place
                if dense:
                    total += np.bincount(keys, minlength=len(total))
                else:
                    yield out(*np.unique(keys, return_counts=True))
        if (some := np.flatnonzero(total)).size:
            yield out(some, total[some])
        release()

    return run


def codewords(k: int) -> np.ndarray:
    """-1 or 1 for each of ``k`` languages and each bit; no bit is the same for all of them."""
    if k <= ALL_WAYS:
        ways = np.arange(1, 1 << max(0, k - 1))
        return np.stack([np.where(ways >> (i - 1) & 1 if i else np.zeros_like(ways), 1, -1) for i in range(k)]) if k else np.zeros((0, 0), int)
    random, best, apart = np.random.default_rng(11), None, -1
    size = math.ceil(BITS_EACH * math.log2(k))
    for _ in range(TRIES):
        code = np.where(random.random((k, size)) < 0.5, -1, 1)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        least = least_distance(code)
        if least > apart:
            best, apart = code, least
    return best


def least_distance(code: np.ndarray) -> int:
    """Bits in which the two closest codewords differ."""
    if len(code) < 2:
        return 0
    same = code @ code.T
    return int((code.shape[1] - same[~np.eye(len(code), dtype=bool)].max()) // 2)


@dataclass
class Coder:
    """Languages, their codewords, the bits' classifiers, and how they decode."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # places x bits
    slope: np.ndarray
    shift: np.ndarray
    trust: np.ndarray  # languages x bits, a row sums to 1

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of log-odds by bit, and how many n-grams it has."""
        out, size = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for place, text in features(texts):
            if not len(text):
                continue
            new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))  # texts are in order
            out[text[new]] += np.add.reduceat(self.weights[place], new, axis=0, dtype=np.float64)
            size += np.bincount(text, minlength=len(size))
        return out, size

    def margins(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.slope * sums / np.sqrt(np.maximum(size, 1))[:, None] + self.shift

    def decoded(self, sums: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword by weighted loss, its score, and whether the bits leave it in doubt."""
        z = self.margins(sums, size)
        loss = np.stack([np.logaddexp(0, -z * own) @ trust for own, trust in zip(self.code, self.trust)], axis=1) * self.code.shape[1]
        best = loss.argmin(axis=1)
        score = 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
        wrong = ((z > 0) != (self.code[best] > 0)).sum(axis=1)
        return best, score, (wrong > max(0, least_distance(self.code) - 1) // 2) | (score < 0.5)


def _bits(coder: Coder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            sums, size = coder.sums(texts)
            ends = pa.array(np.arange(len(texts) + 1) * sums.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.ListArray.from_arrays(ends, pa.array(sums.ravel())), pa.array(size)], ["lang", "sums", "size"])
        release()

    return run


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above zero) and shift of the log-odds of y (0 or 1) on x, with a little weight on 1 and 0."""
    w, design = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]) + np.eye(2), design.T @ (mu - y) + (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Coder:
    """Learn from all of ``docs`` (doc_id, text, lang): counts of n-grams by language, then about WEIGHING_ROWS documents' bits.

    The driver gets PLACES numbers a language, and a row for each of these documents.
    """
    rows = docs.where("text is not null and lang is not null")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages, n = sorted(found), sum(found.values())
    k, code = len(languages), codewords(len(languages))
    counts = np.zeros((k, PLACES))
    got = rows.select("lang", "text").mapInArrow(_language_counts(languages), "language int, place int, n long").groupBy("language", "place").agg(F.sum("n").alias("n")).toArrow() if k else None
    if got is not None:
        counts[got.column("language").to_numpy(), got.column("place").to_numpy()] = got.column("n").to_numpy()
    weights = np.zeros((PLACES, code.shape[1]), np.float32)
    known = max(1, int((counts.sum(axis=0) > 0).sum()))
    for b in range(code.shape[1]):
        ones, zeros = (counts[code[:, b] == side].sum(axis=0) + SMOOTHING for side in (1, -1))
        weights[:, b] = np.log(ones / (ones.sum() - SMOOTHING * (PLACES - known))) - np.log(zeros / (zeros.sum() - SMOOTHING * (PLACES - known)))
    weights[counts.sum(axis=0) == 0] = 0
    coder = Coder(languages, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]), np.full(code.shape, 1 / max(1, code.shape[1])))
    if k < 2:
        return coder
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < math.ceil((1 << 24) * min(1.0, WEIGHING_ROWS / n))
    sample = rows.where(share)
    if sample.count() > 2 * WEIGHING_ROWS:  # equal ids
        sample = sample.limit(2 * WEIGHING_ROWS)
    seen = sample.select("lang", "text").mapInArrow(_bits(coder), "lang string, sums array<double>, size double").toArrow()
    if not len(seen):
        return coder
    number = {x: i for i, x in enumerate(languages)}
    own = np.array([number[x] for x in seen.column("lang").to_pylist()])
    size, sums = seen.column("size").to_numpy(), np.concatenate([c.flatten().to_numpy() for c in seen.column("sums").chunks]).reshape(-1, code.shape[1])
    x = sums / np.sqrt(np.maximum(size, 1))[:, None]
    for b in range(code.shape[1]):
        coder.slope[b], coder.shift[b] = _fit_line(x[:, b], (code[own, b] > 0).astype(float))
    right = (coder.margins(sums, size) > 0) == (code[own] > 0)
    hits = np.stack([right[own == i].sum(axis=0) for i in range(k)]) + 1.0
    coder.trust = hits / hits.sum(axis=1, keepdims=True)
    return coder


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _predicted(coder: Coder, column: str):
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, column):
            data, begins = bytes_of(texts)
            letters = np.diff(np.append(0, np.cumsum(ascii_letter[data]))[begins]) > 0
            for i in np.flatnonzero(~letters & (np.diff(begins) > 0)):
                letters[i] = has_letter(texts[int(i)].as_py())
            if coder.languages:
                best, score, doubt = coder.decoded(*coder.sums(texts))
            else:
                best, score, doubt, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts), bool)
            names = [coder.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(np.where(letters, score, 0.0))).append_column("ambiguous", pa.array(doubt | ~letters))
        release()

    return run


def predict(docs: DataFrame, coder: Coder, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with three columns of these new names; no shuffle.

    A text that is null or has no letters is ``und`` with score 0, as all are if
    nothing was learned; with one language only, all others are that one. Equal
    losses go to the language that comes first by name. Long texts count whole.
    """
    small_batches(docs.sparkSession)
    rows, (own,) = numbered(docs, text)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "lang_pred string, score double, ambiguous boolean"])
    return rows.mapInArrow(_predicted(coder, own), schema).toDF(*docs.columns, *names)


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous, a row for each row of ``docs``; only the text is looked at.

    Learned from rows with a lang that aren't held out (a null id is neither
    learned from nor held out). Repeated rows stay repeated and count each; an
    empty table gives an empty result; other columns, whatever their names, aren't looked at.
    """
    small_batches(docs.sparkSession)
    rows, (own_id, own_text, own_lang) = numbered(docs, doc_id, text, lang)
    rows = rows.select(F.col(own_id).cast("long").alias("doc_id"), F.col(own_text).cast("string").alias("text"), F.col(own_lang).cast("string").alias("lang"))
    coder = fit(rows.where(~held_out("doc_id")))
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    return predict(rows.select("doc_id", "text"), coder).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")

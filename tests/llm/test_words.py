"""op2, op7, op9: word and line operators against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from estimara.llm import decontam, linededup, quality, shared


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality(odd, empty):
    want = sorted((r.doc_id or -1, *measures(r.text)) for r in odd.collect())
    got = quality.quality(odd).collect()
    assert sorted((r.doc_id or -1, *r[1:7]) for r in got) == want
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality.quality(empty).count() == 0


def test_word_hashes_tell_repetitive_words_apart():
    """Two words that polynomials modulo a power of two don't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    words = [bytes(97 + b for b in bits), bytes(98 - b for b in bits), b"a" * 1024, b"a" * 1023]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words) * 2, np.uint8)
    starts, stops = np.append(0, ends[:-1]), ends
    h = shared.word_hashes(data, np.append(starts, starts + ends[-1]), np.append(stops, stops + ends[-1])).tolist()
    assert len(set(h[:4])) == 4 and h[:4] == h[4:]


def test_bad_host_rejects_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 10 or i < 900 else "short", "good" if i < 900 else "bad") for i in range(900)] + [(i, "short" if i % 10 else good, "bad") for i in range(900, 1000)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.kept for r in got if r.doc_id < 900} == {True}
    assert {r.kept for r in got if r.doc_id >= 900} == {False}


def words_of(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def contaminated(text, items):
    words, hit, held = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        span = min(10, len(own))
        windows = {tuple(own[i : i + span]) for i in range(len(own) - span + 1)} if span else set()
        for i in range(len(words) - span + 1 if span else 0):
            if tuple(words[i : i + span]) in windows:
                hit |= set(range(i, i + span))
                held.add(str(item))
    return len(words), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_decontamination(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = [(1, "quick brown FOX, jumps over the lazy dog and then it runs!"), (2, "some words"), (30, "word word word word word word word word word word word"), (4, None), (5, ""), (6, "the lazy dog and then it runs far away from here"), (6, "the lazy dog and then it runs far away from here"), (None, "one")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id or -1, *contaminated(r.text, [x for x in items if x[0]])) for r in odd.collect())
    got = decontam.contamination(odd, tests).collect()
    key = lambda r: (r.doc_id or -1, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
    assert sorted(map(key, got)) == want
    assert decontam.contamination(empty, tests).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd, tests.limit(0)).collect())
    named = odd.withColumnsRenamed({"n_words": "__lost", "ids": "c0", "lang": "a `b`"})
    left = decontam.drop_contaminated(named, tests)
    assert left.columns == named.columns
    again = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and then it runs"), (1, "a clean row with the same id"), (None, "some words")], "doc_id long, text string")
    assert [r.text for r in decontam.drop_contaminated(again, tests).collect()] == ["a clean row with the same id"]
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i for i, *_, bad in want if not bad)


def line_dedup(rows):
    def key(line):
        return line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})

    holder = {}
    for i, t in rows:
        for k in map(key, (t or "").split("\n")) if i is not None else []:
            if len(k) >= 10:
                holder[k] = min(i, holder.get(k, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or holder.get(key(x), i) == i]
        out.append((i or -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_line_dedup(spark, odd, empty, parts):
    hot = [(100 + i, f"one very common passage of text\nown {i} line of it\nanother common passage") for i in range(60)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + hot
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted((r.doc_id or -1, *r[1:]) for r in linededup.line_digests(table).collect()) == line_dedup(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert linededup.line_digests(empty).count() == 0
    named = odd.withColumnsRenamed({"n_words": "__keep", "ids": "__hash", "lang": "keep", "source": "c 1`"})
    assert linededup.drop_lines(named).columns == named.columns
    left = linededup.drop_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    texts = sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect())
    assert texts == [(i, h) for i, _, _, h in line_dedup([(r.doc_id, r.text) for r in odd.collect()])]

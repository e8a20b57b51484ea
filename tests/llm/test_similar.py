"""The pipeline's near copies against all pairs by exact Jaccard similarity."""

import random

import numpy as np
import pytest
from test_simhash import fingerprint, groups

import corpus_pipeline
from estimara.llm import similar


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("tile", [similar.TILE, 24])
def test_similar_texts_are_one_group(spark, odd, empty, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    draw = random.Random(4)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rs", "lt", "sh")]
    rows = []
    for n in [7, 12, 30, 80, 200, 700, 3000]:
        for changed in [0, 1, 1, 2, 3, n // 45, n // 30]:
            if not changed:
                base = draw.choices(words, k=n)
            text = list(base)
            for i in draw.sample(range(n), min(changed, n)):
                text[i] = draw.choice(words)
            rows.append((len(rows) + 1000, " ".join(text)))
    base = draw.choices(words, k=60)
    rows += [(2000 + i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 :]])) for i in range(300)]  # one large group
    rows += [(3000, "a b c d e " * 3), (3001, "a b c d e " * 30)]  # one set, other counts
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, fps = {i: shingles(t) for i, t in rows}, {i: fingerprint(t, 5) for i, t in rows}
    ids = sorted(sets)
    alike = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any((fps[a] ^ fps[b]).bit_count() > 4 for a, b in alike)
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    of = groups(alike + near, ids)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [i for i in ids if of[i] == i]
    assert corpus_pipeline.drop_near_copies(spark, odd, "").columns == odd.columns
    assert corpus_pipeline.drop_near_copies(spark, empty, "").count() == 0


def test_no_similar_pair_is_sketched_out():
    draw = np.random.default_rng(2)
    for size in [3, 60, 256, 257, 300, 512, 520, 1100, 5000, 40000]:
        for _ in range(12):
            a = draw.integers(0, 1 << 63, size, dtype=np.uint64)
            gone = draw.integers(0, size // 5 + 1)  # at most a fifth of the larger set goes, or is exchanged for as little
            other = [np.unique(a[gone:]), np.unique(np.append(a[size // 9 :], draw.integers(0, 1 << 63, size // 9, dtype=np.uint64)))]
            for b in other:
                a = np.unique(a)
                both = len(np.intersect1d(a, b))
                sizes = np.array([len(a), len(b)])
                sketch = np.frombuffer(similar.sampled(a) + similar.sampled(b), np.uint64).reshape(2, 2, -1)
                found = similar.pairs_in(sizes, np.arange(2), np.zeros(2, int), sketch, None)[0].size == 1
                assert found or 5 * both < 4 * (sizes.sum() - both)
    far = [similar.sampled(np.unique(draw.integers(0, 1 << 63, 5000, dtype=np.uint64))) for _ in range(40)]
    sketch = np.frombuffer(b"".join(far), np.uint64).reshape(40, 2, -1)
    assert not similar.pairs_in(np.full(40, 5000), np.arange(40), np.zeros(40, int), sketch, None)[0].size

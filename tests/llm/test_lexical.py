import math
import re
from collections import Counter

import numpy as np
import pytest

from estimara.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """As the score is defined, document by document."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(counted, sizes):
            common = [t for t in set(words(text)) if t in c]
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // length))) for t in common)
            if score > 0:
                scores.append((-score, -1 if i is None else i))
        out += [(item, rank + 1, None if i < 0 else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r) for r in lexical.search(docs, items, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"rows": 7, "block": 2}, {"queries": 1, "k": 3}, {"postings": 50, "block": 1}])
def test_given_documents_against_brute_force(spark, how):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = items.limit(6) if "queries" in how else items
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], how.get("k", 10))
    assert found(docs, items, **how) == want


def test_odd_rows(spark, odd, empty):
    asked = [(1, "fox dog the lazy"), (2, None), (3, ""), (4, "fox FOX fox été 漢字かな one"), (None, "word a b"), (4, "fox FOX fox été 漢字かな one"), (5, "nowhere-found"), (6, "x" * 70000)]
    items = spark.createDataFrame([(*a, "clash", 1) for a in asked], "item_id long, text string, doc_id string, SCORE int")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, items) == plain(rows, asked)
    assert found(odd, items, rows=2, block=1, queries=2) == plain(rows, asked)
    assert found(empty, items) == [] and found(odd, items.limit(0)) == []


def test_very_long_documents_weigh_exactly():
    """Where n times the documents passes 64 bits, numbers are still whole."""
    w = lexical.Weighing(10**11, 10**13, np.array([1]))
    n = 3 * 10**9
    assert w.impacts(np.array([n]), np.array([7]), np.array([1])).tolist() == [10**9 * 7 // (7000 + 8 * (10 + 90 * n * 10**11 // 10**13))]


def test_blocks_of_similar_documents_are_skipped():
    """Documents of two kinds share a term; the kind that a query isn't about is skipped by its summaries, and nothing is lost."""
    random, rows = np.random.default_rng(3), []
    for i in range(600):
        kind = i % 7 == 0
        own = np.unique(np.concatenate([[0], 50 - 49 * kind + random.integers(0, 50, 20), [3, 7, 12] if kind else []])).astype(np.int32)
        rows.append((own, random.integers(400_000, 900_000, len(own))))
    shard = lexical.Shard(np.arange(600), np.array([len(a) for a, _ in rows]), np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows]), 101, block=20)
    terms, weights = np.array([0, 3, 7, 12]), np.array([5000, 4900, 4900, 4900])
    best = lexical.Best(10)
    shard.search(terms, weights, np.zeros(101, np.int64), best)
    value = dict(zip(terms.tolist(), weights.tolist()))
    scores = sorted(((-sum(value.get(int(t), 0) * int(q) for t, q in zip(a, b)), i) for i, (a, b) in enumerate(rows)))[:10]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == scores
    assert shard.skipped > 0 and shard.looked_at > 0
    # Floors that are reached change nothing.
    again = lexical.Best(10, int(best.scores[-1]))
    shard.search(terms, weights, np.zeros(101, np.int64), again)
    assert again.scores.tolist() == best.scores.tolist() and again.ids.tolist() == best.ids.tolist()

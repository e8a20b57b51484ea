"""op4 against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from estimara.llm import simhash
from estimara.llm.components import components


def fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_near_copies(odd, empty):
    rows = [(r.doc_id, fingerprint(r.text)) for r in odd.collect()]
    fps = sorted({f for _, f in rows})
    of = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], fps)
    least = {}
    for i, f in rows:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = sorted((i or -1, f, least.get(of[f], -1)) for i, f in rows)
    assert sorted((r.doc_id or -1, r.fp % (1 << 64), r.component_id or -1) for r in simhash.near_copies(odd).collect()) == want
    assert simhash.near_copies(empty).count() == 0
    named = odd.withColumnsRenamed({"n_words": "__lost", "ids": "lost", "lang": "a `b`"})
    assert simhash.drop_near_copies(named).columns == named.columns


@pytest.mark.parametrize("bits", [0, 1, 3, 4, 6])
@pytest.mark.parametrize("tile, long_keys", [(4096, simhash.LONG_KEYS), (16, simhash.LONG_KEYS), (4096, 0)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, bits, tile, long_keys):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "LONG_KEYS", long_keys)
    draw = random.Random(bits)
    fps = set()
    for _ in range(40):
        seed = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 5, 30])):
            x = seed
            for b in draw.sample(range(64), draw.randint(0, bits + 2)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits], fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits)
    got = groups([(r.u % (1 << 64), r.v % (1 << 64)) for r in links.collect()], fps)
    assert got == want


@pytest.mark.parametrize("together", [1, 3])
def test_anchors_cover(together):
    """At some key, of two fingerprints within 4 bits one is at the other's home."""
    draw = random.Random(5)
    run = simhash._anchors(4, together)
    for _ in range(60):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, 4)):
            b ^= 1 << bit
        at = [set(), set()]
        for out, x in zip(at, (a, b)):
            for batch in run(iter([pa.RecordBatch.from_arrays([pa.array(np.array([x], np.uint64).view(np.int64))], ["fp"])])):
                out |= set(zip(batch.column("anchor").to_pylist(), batch.column("home").to_pylist()))
        assert {k for k, home in at[0] if home} & {k for k, _ in at[1]}


def test_long_runs_are_counted_in_wide_counters():
    h = np.array([3] * 70000 + [1] * 10, np.uint64)
    assert simhash.fingerprints_of(h, np.array([0, 70000, 10])).tolist() == [0, 3, 1]


def test_components(spark):
    draw = random.Random(1)
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == groups([p for p in pairs if p[0] != p[1]], nodes)
    assert len(got) == len(nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

"""op1, op6, op10 and the pipeline."""

import math
import pickle
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from estimara.llm import licenses, toxicity, urls
from estimara.llm.queries import RULES


def test_licenses(spark, odd, empty):
    mit = licenses.LICENSES["MIT"]
    texts = [mit, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "\n"), "© 1999 X. All rights reserved.\n" + mit.replace(",", " ,"), mit + " more", mit[:-5], "text\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0", None]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", "MIT", "MIT", None, None, None, None]
    assert (got[5].n_notices, got[5].notices) == (2, "CC-BY-NC-4.0,MIT")
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(empty).count() == 0


def test_url_rules(spark):
    table = [
        ("http://A.example.COM/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.net/es/1#top", "x.net", "/es/1", "net/es/", "block"), ("http://notcom/a", "notcom", "/a", None, "allow"), ("http://x.com", "x.com", "", None, "allow"), ("x.com/a", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("http://y.org?a=http://z.com/b", "y.org", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, row[0], None) for i, row in enumerate(table)], "page_id long, url string, html string")
    got = urls.url_verdicts(pages, RULES).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [row[1:] for row in table]


def brute_rule(host, path, rules):
    fits = [(len(r), r, v) for v, r in rules if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return max(fits)[1:] if fits else (None, None)


@pytest.mark.parametrize("most", [urls.MAX_RULES, 0])
def test_rules_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MAX_RULES", most)
    draw = np.random.default_rng(4)
    labels = ["a", "b", "com", "net", "x", ""]
    host = lambda n: ".".join(draw.choice(labels, draw.integers(1, n)))
    path = lambda: "".join("/" + x for x in draw.choice(["en", "e", "fr"], draw.integers(0, 3)))
    rules = [(str(draw.choice(["allow", "block"])), f"{host(4)}/{path()[1:]}") for _ in range(300)]
    pages = [(i, f"http://{host(6)}{path()}") for i in range(300)] + [(400, "http://com/en"), (401, "http:///en"), (402, "http://" + "a." * 20000 + "com/en/"), (403, None)]
    table = spark.createDataFrame([(i, u, None) for i, u in pages], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(table, rules).collect()}
    for i, u in pages:
        rest = (u or "").partition("://")[2]
        own, _, tail = rest.partition("/")
        tail = "/" + tail if "/" in rest else ""
        rule, verdict = brute_rule(own, tail, rules)
        assert got[i][:3] == (own, tail, rule) and (rule is None or got[i][3] == verdict)


def test_many_rules_are_joined(spark):
    rules = [("block" if i % 2 else "allow", f"h{i}.org/") for i in range(100_000)]
    pages = spark.createDataFrame([(i, f"https://www.h{i * 37}.org/x", None) for i in range(2000)], "page_id long, url string, html string")
    got = urls.url_verdicts(pages, rules).collect()
    assert all(r.rule == f"h{r.page_id * 37}.org/" and r.verdict == ("block" if r.page_id % 2 else "allow") for r in got) and len(got) == 2000


def test_trust_and_distrust_flow(spark):
    link = lambda *hosts: "".join(f'<a class="x" href="https://{h}/p">l</a>' for h in hosts)
    pages = [(1, "http://good.com/a", link("ok.org")), (2, "http://bad.net/es/a", ""), (3, "http://fan.org/", link("bad.net", "BAD.net")), (4, "http://ok.org/", ""), (5, "http://alone.org/", None), (6, "http://half.net/en/", ""), (7, "http://half.net/fr/", "")]
    got = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}
    hosts = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "b", 1.0)]
    ranks = {r.host: r.value for r in urls.propagated(hosts, spark.createDataFrame(edges, "src string, dst string, share double"), rounds=200, tolerance=1e-13).collect()}
    m, names = np.zeros((3, 3)), "abc"
    for s, d, x in edges:
        m[names.index(d), names.index(s)] = x
    want = np.linalg.solve(np.eye(3) - 0.85 * m, 0.15 * np.array([1, 0, 0]))
    assert np.allclose([ranks[n] for n in names], want, atol=1e-9)


def sparse(draw, n, terms, some):
    out = []
    for _ in range(n):
        at = np.flatnonzero(draw.random(terms) < some)
        out.append((at, draw.integers(1, 4, len(at))))
    return out


@pytest.mark.parametrize("common", [2, 16, 1000])
def test_nearest_is_exact_and_ties_stay(monkeypatch, common):
    monkeypatch.setattr(toxicity, "AT_ONCE", 50 * common)
    draw = np.random.default_rng(3)
    rows = sparse(draw, 500, 40, 0.08)
    rows += [rows[i] for i in draw.integers(0, 500, 200)]  # ties
    sizes, term = np.array([len(a) for a, _ in rows]), np.concatenate([a for a, _ in rows])
    begins = np.append(0, np.cumsum(sizes))
    value = toxicity.units(term, np.concatenate([n for _, n in rows]), begins, draw.random(40) + 0.1)
    vectors = [(term[a:b], value[a:b]) for a, b in zip(begins, begins[1:])]
    ids = draw.permutation(700) * 3
    index = toxicity.Index.of(sizes, term, value, draw.integers(0, 2, 700).astype(float), ids, 40, block=16, common=common)
    dense = np.zeros((700, 40))
    for row, (at, w) in zip(dense, vectors):
        row[at] = w
    queries = [*draw.permutation(700)[:80], 5]
    flat = lambda qs: (np.concatenate([vectors[q][0] for q in qs]), np.concatenate([vectors[q][1] for q in qs]), np.append(0, np.cumsum([len(vectors[q][0]) for q in qs])))
    for own in (False, True):
        alone = [index.nearest(*flat([q]), 10, [ids[q]] if own else None)[0] for q in queries]
        together = index.nearest(*flat(queries), 10, [ids[q] for q in queries] if own else None)
        for q, (cosines, places), one in zip(queries, together, alone):
            all_of = dense @ dense[q]
            want = [i for i in np.lexsort((ids, -all_of)) if all_of[i] > 0 and not (own and i == q)]
            want = [i for i in want if len(want) <= 10 or all_of[i] >= all_of[want[9]]]
            assert index.ids[places].tolist() == ids[want].tolist() and cosines.tolist() == all_of[want].tolist()
            assert (one[0] == cosines).all() and (one[1] == places).all()


def test_scores_do_not_depend_on_ids(spark):
    """Many examples tie; the same texts and labels under other ids get the same scores."""
    draw = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta", "idiot"]
    texts = [" ".join(draw.permutation(words)[: 2 + i % 4]) + f" own{i}" for i in range(300)]
    toxic = [int("idiot" in t) if i % 9 else 1 - int("idiot" in t) for i, t in enumerate(texts)]
    learned = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    tables = []
    for ids in (learned[:300], learned[:300][::-1], draw.permutation(learned)[:300].tolist()):
        docs = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts)], "doc_id long, text string")
        labels = spark.createDataFrame([(int(i), v) for i, v in zip(ids, toxic)], "doc_id long, toxic int")
        got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
        tables.append([got[int(i)] for i in ids])
    assert np.abs(np.array(tables) - tables[0]).max() < 1e-12


def test_vectors_count_words():
    parts = ["The", "ÉTÉ", "İx", "naïve_word2x", "漢字かな", "a1b", "don't", "ªb", "Σ", "ΑΣ", "x", "\u3000y", "œuvre", "ß", ""]
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(parts, draw.integers(0, 12))) + str(draw.choice(["", "\n", ".x"])) for _ in range(200)]
    words = sorted({w for t in texts for w in toxicity.WORDS.findall(t.lower())})
    known = {w: i for i, w in enumerate(words[::2])}
    table = pickle.loads(pickle.dumps(toxicity.Words(pa.array(words[::2]))))
    for most in (1, 37, 200):
        for lo in range(0, 200, most):
            part = texts[lo : lo + most]
            at, n, begins = toxicity.vectors(pa.array([t.encode() for t in part], pa.large_binary()), table)
            for t, a, b in zip(part, begins, begins[1:]):
                want = Counter(known[w] for w in toxicity.WORDS.findall(t.lower()) if w in known)
                assert dict(zip(at[a:b].tolist(), n[a:b].tolist())) == want and sorted(want) == at[a:b].tolist()
    assert toxicity.vectors(pa.array([b"\xff\xc3", b"", b"x \xc3"], pa.large_binary()), toxicity.Words(pa.array(["x"])))[0].tolist() == [0]
    assert not len(toxicity.vectors(pa.array([b"", b"x"], pa.large_binary()), pickle.loads(pickle.dumps(toxicity.Words(pa.array([], pa.string())))))[0])


def brute_scores(rows, labels):
    """The whole method in plain Python, for as many labelled rows as there are."""
    label = {}
    for i, v in labels:
        if i is not None and v is not None and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(v, label.get(i, 0))
    words = lambda t: Counter(toxicity.WORDS.findall((t or "").lower()))
    by_text = {}
    for i, t in rows:
        if i in label:
            a, b = by_text.get(t or "", (i, 0))
            by_text[t or ""] = (min(a, i), max(b, label[i]))
    examples = [(i, words(t), v) for t, (i, v) in by_text.items()]
    n, m = len(examples), sum(v for *_, v in examples)
    held = Counter(w for _, x, _ in examples for w in x)
    toxic = Counter(w for _, x, v in examples if v for w in x)
    everywhere = Counter(w for _, t in rows for w in words(t) if w in held)
    weight = {}
    for w, c in held.items():
        apart, room = max(0.0, float(toxic[w] * n - c * m)), float(c * (n - c)) * (m * float(n - m))
        chi2 = apart * apart * n / room if room else 0.0
        weight[w] = (math.log((1 + len(rows)) / (1 + everywhere[w])) + 1) * (toxicity.FLOOR + chi2 / (chi2 + toxicity.HALF))

    def unit(x):
        own = {w: (1 + math.log(c)) * weight[w] for w, c in x.items() if w in weight}
        size = math.sqrt(math.fsum(v * v for v in own.values())) or 1.0
        return {w: math.floor(v / size * toxicity.GRAIN) / toxicity.GRAIN for w, v in own.items()}

    vectors = [(i, unit(x), v) for i, x, v in examples]

    def vote(x, own=None):
        near = sorted(((c, v) for c, v in ((sum(a * y.get(w, 0.0) for w, a in x.items()), v) for i, y, v in vectors if i != own) if c > 0), reverse=True)
        if len(near) > toxicity.NEIGHBOURS:  # those that tie for the last places share them
            last = near[toxicity.NEIGHBOURS - 1][0]
            above, tied = [x for x in near if x[0] > last], [x for x in near if x[0] == last]
            near = above + [(c * (toxicity.NEIGHBOURS - len(above)) / len(tied), v) for c, v in tied]
        return (sum(c * v for c, v in near) + m / n) / (sum(c for c, _ in near) + 1.0)

    votes = np.array([vote(x, i) for i, x, _ in sorted(vectors, key=lambda r: r[0])])
    slope, shift = toxicity.platt(votes, np.array([float(v) for *_, v in sorted(vectors, key=lambda r: r[0])]))
    out = []
    for i, t in rows:
        p = min(max(vote(unit(words(t))), 1e-6), 1 - 1e-6)
        out.append((i, 1 / (1 + math.exp(-(slope * math.log(p / (1 - p)) + shift)))))
    return out


@pytest.mark.parametrize("parts, batch", [(1, 10000), (4, 7), (9, 64)])
def test_toxicity_against_brute_force(spark, parts, batch):
    draw = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("alo", "eri", "umo", "é")] + ["Scum", "moron!", "3rd"]
    rows = [(i, " ".join(draw.choice(words[:28], 12)) + (" " + str(draw.choice(words[28:])) if i % 6 == 0 else "")) for i in range(160)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]  # equal cosines
    rows += [(300, None), (301, ""), (302, "zzz"), (None, rows[6][1]), (303, "moron " * 5000)]
    labels = [(i, int(i % 6 == 0)) for i in range(230)] + [(3, None), (None, 1), (300, 0), (206, 1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = lambda r: (r[0] is None, r[0])
    want = sorted(brute_scores(rows, labels), key=order)
    assert [r.doc_id for r in sorted(got, key=order)] == [i for i, _ in want]
    assert np.allclose([r.score for r in sorted(got, key=order)], [x for _, x in want], rtol=0, atol=1e-9)


def test_toxicity(spark, odd, empty):
    draw = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "eri", "umo", "inta", "osk")]
    rows = [(i, " ".join(draw.choice(words, 60)) + (" you vilething " + " ".join(draw.choice(words, 5)) if i % 8 == 0 else "")) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(700)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.doc_id % 8 == 0) and 0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}
    with_evidence = toxicity.scored(docs, toxicity.fit(docs, labels), evidence=3).where("doc_id = 720").first()
    assert len(with_evidence["evidence"]) == 3 and all(i % 8 == 0 for i in with_evidence["evidence"])
    named = docs.withColumnsRenamed({"text": "score"}).withColumn("a `b`", F.lit(1)).withColumn("__score", F.lit(2))
    left = toxicity.drop_toxic(named, labels, text="score")
    assert left.columns == named.columns and {r.doc_id % 8 == 0 for r in left.collect()} == {False}


@pytest.mark.parametrize("null_ids", [False, True])
def test_pipeline_stages(spark, odd, null_ids, tmp_path):
    import corpus_pipeline

    docs = odd if null_ids else odd.where("doc_id is not null")
    docs = docs.drop("n_words", "ids")
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "another one of its own kind of thing")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        now = spark.read.parquet(f"{tmp_path}/s{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.schema == docs.schema, name
    ids = [r.doc_id for r in now.collect()]
    # Document 2 repeats 1: its only line goes, and it stands for the empty documents then.
    assert {1, 2, 5} <= set(ids) and not {3, 4, 6} & set(ids)
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

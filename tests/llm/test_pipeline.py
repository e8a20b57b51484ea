"""Every stage of the pipeline against brute force on what the stage before kept."""

import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from test_simhash import fingerprint, groups
from test_similar import shingles
from test_words import contaminated

import corpus_pipeline
from estimara.llm import toxicity


def without_shared_lines(rows):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holder = {}
    for i, t in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= 10:
                holder[k] = min(i, holder.get(k, i))
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if holder.get(key(x), i) == i)) for i, t in rows]


def corpus():
    draw = random.Random(9)
    words = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "rs", "lt", "sh")]
    text = lambda n: "\n".join(" ".join(draw.choices(words, k=12)) for _ in range(n))
    rows = [(i, text(draw.choice([1, 3, 8]))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(15)]  # exact copies
    rows += [(220 + i, " ".join(rows[i][1].split()) + " xq") for i in range(30, 40)]  # the words again, in other lines
    rows += [(260 + i, text(2) + " you vilething\n" + text(1)) for i in range(40)]  # toxic
    test = " ".join(draw.choices(words, k=25))
    rows += [(310 + i, text(1) + " " + " ".join(test.split()[i : i + 12]) + " " + text(1)) for i in range(10)]
    rows += [(330, ""), (331, None), (332, " \n"), (333, "one"), (334, "long " * 9000 + "\n" + "x" * 20000)]
    return rows, [(1, test), (2, "zz")]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(260 <= i < 300)) for i, _ in rows if i % 7], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        now = spark.read.parquet(f"{tmp_path}/s{i}")
        got.append(now)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    rejected = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    assert rejected == set(range(260, 300))
    want = sorted((i, t) for i, t in rows if i not in rejected)
    assert texts(got[0]) == want
    want = without_shared_lines(want)
    assert texts(got[1]) == want and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in got[1].collect())
    fps = {i: fingerprint(t, 5) for i, t in want}
    distinct = sorted(set(fps.values()))
    near = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4]
    sets = {i: shingles(t) for i, t in want}
    alike = [(fps[a], fps[b]) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    of = groups([*near, *alike], distinct)
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(of[f], i)
    want = [(i, t) for i, t in want if first[of[fps[i]]] == i]
    assert texts(got[2]) == want and len(want) < len(fps)
    want = [(i, t) for i, t in want if not contaminated(t, items)[-1]]
    assert texts(got[3]) == want and not {i for i, _ in want} & set(range(310, 320))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: enc.encode_ordinary(t or "") for i, t in want}
    for r in got[4].collect():
        raw = b"".join(x.to_bytes(4, "little") for x in ids.pop(r.doc_id))
        assert bytes(r.ids) == raw and r.n_tokens == len(raw) // 4 and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((dict(want)[r.doc_id] or "").encode()).hexdigest()
    assert not ids

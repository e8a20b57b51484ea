"""op3, op5 and op8 against the tokenizer libraries and brute force."""

import base64
import hashlib
import json
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estimara.llm import bpe, tokencount, tokenfile

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("size, overlap", [(bpe.CHUNK, bpe.OVERLAP), (50, 16), (7, 3)])
def test_byte_bpe(odd, empty, size, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = odd.where("doc_id is null or doc_id not in (10, 11, 12)") if size < 100 else odd
    want = sorted((r.doc_id or -1, enc.encode_ordinary(r.text or "")) for r in odd.collect())
    got = bpe.encoded(odd, RANKS, P.PATTERN, size=size, overlap=overlap).collect()
    assert sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0
    if size > 100:
        rows = bpe.round_trip(odd, RANKS, P.PATTERN).collect()
        assert sorted((r.doc_id or -1, r.decoded_sha256) for r in rows) == sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())


def test_ids_are_judged_where_they_come_about(odd):
    """One Python worker a running task: whole short texts, pieces, and long texts put together, each with its digests; and as those of the ids."""
    made = bpe.round_trip(odd, RANKS, P.PATTERN, with_ids=True)
    assert made._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 3
    want = sorted((r.doc_id or -1, bytes(r.ids)) for r in bpe.encoded(odd, RANKS, P.PATTERN).collect())
    rows = made.collect()
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest() for r in rows)


def test_texts_are_encoded_like_the_library_does():
    path = P.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), tokenfile.WordCoder(path)
    assert coder.by_piece
    parts = ["The", "THE", "éèÉ", "ß", "ÿ", "ñandú", "œ", "İ", "e\u0301", "it's", "'ll", "12", "3a", "...", "$$$", "a!b", "x&y", "<b>", "漢字", "🙂", "\u00a0", "\u3000", "ª", "µ", "×", "÷", "`~", "[", "]", "^_", "Σ", "<|endoftext|>", "\x00", "\x1c", "\x7f", "\x85", "don't", "O'Re", "H\u0331", "\u0301", "<|endoftext", "À×Þ", "Æð"]
    texts = [*parts, *(a + b for a in parts for b in parts), *(f"a {a}\n\t{b}  {a}. " for a in parts for b in parts), "", " \n"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1, 7, len(texts)):  # texts stand beside other texts
        for lo in range(0, len(texts), most):
            got = coder(pa.array([t.encode() for t in texts[lo : lo + most]], pa.large_binary()))
            assert [x.tolist() for x in got] == want[lo : lo + most]


def test_a_memo_forgets_the_oldest():
    made = []
    memo = tokenfile.Memo(lambda k: made.append(k) or f"{k}!", most=3)
    for k in "abcdaeabf":
        assert memo[k] == f"{k}!"
    assert len(memo) + len(memo.older) <= 6 and made[:4] == list("abcd") and made.count("a") == 1


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 49407, "content": "of the", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]}])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    with open(P.path("word_bpe_49k.json")) as f:
        file = json.load(f)
    path = f"{tmp_path}/other.json"
    with open(path, "w") as f:
        json.dump(file | change, f)
    library, coder = Tokenizer.from_file(path), tokenfile.WordCoder(path)
    texts = ["The end of the THE É", "of  the", ""]
    assert not coder.by_piece
    assert [x.tolist() for x in coder(pa.array([t.encode() for t in texts], pa.large_binary()))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    ids = np.random.default_rng(1).integers(0, 49408, 1003).astype("<u4")
    planes = tokenfile.to_planes(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (tokenfile.from_planes(b"".join(planes), [len(p) for p in planes], len(ids)) == ids).all()


@pytest.mark.parametrize("block_ids, bits", [(1 << 16, False), (64, True)])
def test_token_file(spark, odd, empty, tmp_path, block_ids, bits):
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = [r for r in odd.collect() if r.doc_id is not None]
    want, start = [], 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    table = odd.where("doc_id is not null").repartition(3)
    tokenfile.write_tokens(table, f"file://{tmp_path}/t", P.path("word_bpe_49k.json"), end_id=1, block_ids=block_ids, bits=bits)
    got = tokenfile.token_digests(spark, f"file://{tmp_path}/t", block_ids)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    tokenfile.write_tokens(empty, f"file://{tmp_path}/e", P.path("word_bpe_49k.json"))


def best(word, scores, byte_score):
    if not word:
        return 0.0, 0
    size = len(word[-1].encode())
    s, n = best(word[:-1], scores, byte_score)
    ways = [(s + size * byte_score, -(n + size))]
    for i in range(len(word)):
        if word[i:] in scores:
            s, n = best(word[:i], scores, byte_score)
            ways.append((s + scores[word[i:]], -(n + 1)))
    return max(ways)[0], -max(ways)[1]


def test_forward_scores_share_prefixes():
    scores = {"▁": -3.0, "▁t": -2.0, "th": -2.5, "▁th": -2.0, "e": -1.0, "r": -1.5, "the": -4.0, "▁the": -2.9, "re": -1.6}
    words = ["▁the", "▁there", "▁t", "▁", "▁thx", "▁é", "▁rr", "▁therex"]
    assert tokencount.terminal_counts(words, scores, -9.0, 4) == {w: best(w, scores, -9.0)[1] for w in words}


def test_states_of_prefixes_last():
    scores = {"▁": -3.0, "▁t": -2.0, "th": -2.5, "▁th": -2.0, "e": -1.0, "r": -1.5, "the": -4.0, "▁the": -2.9, "re": -1.6}
    states = {}
    for words in (["▁there", "▁the"], ["▁therexe", "▁t", "▁thex"], ["▁", "▁rrrrrrrrr", "▁rrrrrrrre"]):
        assert tokencount.terminal_counts(words, scores, -9.0, 4, states) == {w: best(w, scores, -9.0)[1] for w in words}
    assert max(map(len, states)) == tokencount.DEPTH


def test_bytes_that_are_no_utf8(spark):
    table = spark.createDataFrame([(1, b"\xff \xfe a"), (2, b"\xc3")], "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text")
    assert [(r.n_pretokens, r.n_tokens > 0) for r in tokencount.token_counts(table, P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()] == [(3, True), (1, True)]


def test_token_counts(odd, empty):
    path = P.path("piece_bpe_32k.model")
    scores, byte_score, longest = tokencount.pieces(path)
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(odd, path).collect()}
    for r in odd.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        alone = {w: tokencount.terminal_counts(["▁" + w], scores, byte_score, longest)["▁" + w] for w in set(words)}
        assert (r.doc_id, len(words), sum(alone[w] for w in words)) in got
    assert tokencount.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("run", ["x" * 200, " " * 150, "x" * 700, "é" * 333 + " " * 90])
def test_only_failed_stitches_are_untied(spark, run):
    """One long match at the front (or in the middle) leaves all other pieces short, and the ids are the whole text's."""
    pattern, ranks = P.PATTERN, P.path("byte_bpe_multi_50k.tiktoken")
    words = " ".join(f"word{i % 97} and, it's {i}" for i in range(700))
    texts = [run + words, words[:3000] + run + words[3000:], words + run, run, (words[:500] + run) * 4]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("row_id"), "doc_id", "text")
    chunks = rows.mapInArrow(bpe._cut(64, 16), "row_id long, doc_id long, chunk int, begin int, own int, last boolean, text string")
    pieces = bpe.pieces_of(*bpe.stitched(chunks, pattern, 16)).collect()
    for i, t in enumerate(texts):
        own = sorted((p["start"], p["piece"]) for p in pieces if p["doc_id"] == i)
        assert "".join(p for _, p in own) == t and max(len(p) for _, p in own) <= len(run) + 3 * 80
        if i < 3:
            assert len(own) >= (len(words) / 64) * 0.8
    enc = bpe.coder(ranks, pattern)
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(docs, ranks, pattern, size=64, overlap=16).collect()}
    assert all(bytes(got[i]) == bpe.encode(enc, t).tobytes() for i, t in enumerate(texts))

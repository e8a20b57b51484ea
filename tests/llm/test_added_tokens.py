"""op8 against an untouched tokenizer, with literals of its added tokens."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from estimara.llm import queries, tokenfile


def test_literals_of_added_tokens(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "<|endoftext|>'s É\n　x", "plain words", "", "<| endoftext |>"]
    want = [coder.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [637, 49407, 1237]
    assert [x.tolist() for x in tokenfile.word_coder(path)(pa.array([t.encode() for t in texts], pa.large_binary()))] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_token_file(spark, str(tmp_path)).orderBy("doc_id").collect()
    raw = [np.array([*x, 1], "<u4").tobytes() for x in want]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(sum(map(len, raw[:i])) // 4, len(x) // 4, zlib.crc32(x)) for i, x in enumerate(raw)]

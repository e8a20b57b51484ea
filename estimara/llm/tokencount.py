"""Token counts by a unigram model: distinct pre-tokens in a trie, forward scores once per shared prefix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: What stands for the white space before a pre-token.
MARK = "▁"
#: Terminal counts, and states of prefixes up to DEPTH characters, that a task remembers at a time.
MEMO, DEPTH = 500_000, 6


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, float], float, int]:
    """Scores of a model file's pieces, the score of a byte, and the longest piece. The model is taken as it is."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    # A byte is worth less than any piece, so bytes are taken only for characters without one.
    return scores, min(scores.values(), default=0.0) - 1.0, max(map(len, scores), default=1)


def terminal_counts(words: list[str], scores: dict[str, float], byte_score: float, longest: int, known: dict[str, tuple[float, int]] | None = None) -> dict[str, int]:
    """Tokens in the best segmentation of each word: the highest sum of scores, then the fewest tokens.

    Words in order walk the trie of all of them depth first: ``path`` holds the
    states of the current branch, and words that share a prefix share its states.
    known: states of short prefixes, the top of a trie that lasts from call to call.
    """
    out: dict[str, int] = {}
    path: list[tuple[float, int]] = [(0.0, 0)]
    before = ""
    for word in sorted(words):
        shared = 0
        for a, b in zip(word, before):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            if known is not None and end <= DEPTH and (state := known.get(word[:end])):
                path.append(state)
                continue
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score, n = path[end - 1]
            best = (score + size * byte_score, -(n + size))
            for start in range(max(0, end - longest), end):
                if (own := scores.get(word[start:end])) is not None:
                    score, n = path[start]
                    best = max(best, (score + own, -(n + 1)))
            path.append((best[0], -best[1]))
            if known is not None and end <= DEPTH:
                known[word[:end]] = path[end]
        out[word] = path[len(word)][1]
        before = word
    return out


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, byte_score, longest = pieces(path)
        memo: dict[bytes, int] = {}
        states: dict[str, tuple[float, int]] = {}
        for batch, texts in slices(batches):
            each = [Counter(t.split()) for t in texts.to_pylist()]
            new = {w for c in each for w in c if w not in memo}
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = {w for c in each for w in c}
            if len(states) > MEMO:
                states.clear()
            text_of = {w: MARK + w.decode("utf-8", "replace") for w in new}
            counts = terminal_counts(list(set(text_of.values())), scores, byte_score, longest, states)
            memo.update((w, counts[t]) for w, t in text_of.items())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sum(c.values()) for c in each], pa.int64()), pa.array([sum(memo[w] * n for w, n in c.items()) for c in each], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens and n_tokens, a row for each row of ``docs``.

    Pre-tokens are what ASCII white space parts, each with a mark for the white
    space before it. The distinct new pre-tokens of about 2 MB of text at a time
    are one trie, each of whose prefixes is scored once; the states of prefixes
    of up to DEPTH characters, and terminal counts, last for the task, within
    bounds. The table of all pre-tokens of a corpus has no size bound, and
    joining it to every document would shuffle the corpus.

    A model's scores are taken as log-probabilities of pieces. A file of merges
    has ranks in their place: the counts are of the best segmentation by the sum
    of these, not those of the tokenizer that the file was made for.

    Null and empty texts have no tokens. Bytes that aren't UTF-8 count as
    replacement characters. A very long text is a step of its own. Repeated rows
    stay repeated, an empty table gives an empty result, other columns aren't looked at.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_count(path), "doc_id long, n_pretokens long, n_tokens long")

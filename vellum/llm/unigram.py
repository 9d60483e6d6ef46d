"""Token counts of a unigram tokenizer, by dynamic programming over a trie of distinct pre-tokens.

A task's distinct pre-tokens are put in order, which is the order of a depth-first walk of their trie: what two
neighbours share is a path from the root, and its forward scores are kept and not computed again.  A pre-token's
terminal holds the token count of its best segmentation; documents add up the terminals of their pre-tokens.

Pieces are those of a public vocabulary file, with the probability of a Zipf law at their rank, in fixed point so that
sums are exact.  A character that no piece covers costs one byte piece for each of its UTF-8 bytes.  Of equal scores
the segmentation with fewer tokens is taken.

Null texts have no tokens.  Texts and pre-tokens of any length are counted whole.  Repeated rows give equal rows;
empty tables give empty results; only the id and the text are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._support import by_bytes, encoded, map_arrow, span_hashes, words

SPACE = "▁"
#: Terminals that a task remembers between batches; when full they are dropped and computed anew.
REMEMBERED = 400_000


@lru_cache(2)
def pieces(model_path: str | None = None) -> tuple[dict[str, int], int, int]:
    """(cost of each piece, cost of a byte piece, length of the longest piece)."""
    import sentencepiece

    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = sum(1 / (k + 2) for k in range(len(plain)))
    cost = {p: round(1e6 * math.log((k + 2) * total)) for k, p in reversed(list(enumerate(plain)))}
    return cost, round(1e6 * math.log(4 * len(plain) * total)), max(map(len, cost))


def terminal_counts(pretokens: list[str], vocabulary: tuple[dict[str, int], int, int]) -> list[int]:
    """The token count of each of the distinct pre-tokens, which come in order."""
    cost, byte_cost, longest = vocabulary
    best, tokens, before, out = [0], [0], "", []
    for word in pretokens:
        text = SPACE + word
        shared, most = 0, min(len(text), len(before))
        while shared < most and text[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for e in range(shared + 1, len(text) + 1):
            n = len(text[e - 1].encode())
            score, count = best[e - 1] + n * byte_cost, tokens[e - 1] + n
            for s in range(max(0, e - longest), e):
                c = cost.get(text[s:e])
                if c is not None:
                    c += best[s]
                    if c < score or c == score and tokens[s] + 1 < count:
                        score, count = c, tokens[s] + 1
            best.append(score)
            tokens.append(count)
        before = text
        out.append(tokens[-1])
    return out


def token_counts(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_pretokens, n_tokens`` per row of df; no shuffle."""
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches):
        vocabulary, known = pieces(model_path), {}
        for batch in batches:
            texts = encoded(batch.column(1))
            for at, to in by_bytes(texts):
                data, starts, ends, first = words(texts[at:to])
                _, place, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                raw = data.tobytes()
                distinct = [raw[a:b].decode() for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
                new = sorted(w for w in distinct if w not in known)
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, sorted(distinct)
                known.update(zip(new, terminal_counts(new, vocabulary), strict=True))
                counts = np.asarray([known[w] for w in distinct], np.int64)
                sums = np.concatenate([[0], np.cumsum(counts[which])]) if len(distinct) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[first[1:]] - sums[first[:-1]])], names=[id_col, "n_pretokens", "n_tokens"])

    return map_arrow(df.select(id_col, F.col(text_col).cast("binary").alias("t")), count, f"`{id_col}` {id_type}, n_pretokens long, n_tokens long")

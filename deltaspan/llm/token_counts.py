"""Token counts under a unigram model, with forward scores shared by the prefixes of a trie.

A pre-token is a maximal run of anything but the six ASCII blanks, with the space mark before it. The best split of a
pre-token maximises the sum of its pieces' scores; the forward score of a prefix depends on the prefix alone, so the
distinct pre-tokens of a batch are walked as a trie (in sorted order, with the path from the root on a stack), each
shared prefix is scored once, and each terminal keeps its count of tokens. A character that no piece covers is spelt
in bytes, a token each. Of splits with equal scores the one with fewer tokens counts.

The model is a parameter: pieces with their scores, or the path of a sentencepiece file, which is read on the driver and
broadcast, bounded by its file. A unigram file has scores of its own; of other files only the order of the pieces is
used, and the score is minus the logarithm of the rank (Zipf's law). Counts of pre-tokens seen are kept within a task up
to CACHE entries and then forgotten; that changes no count. Nulls and empty texts have no tokens, repeated rows equal
counts, an empty table an empty result, and other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE = 1 << 20
BYTE_SCORE = -25.0


def vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Scores of the pieces of a file that stand for text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    kind = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
    if kind.model_type == kind.UNIGRAM:
        return {model.id_to_piece(i): model.get_score(i) for i in own}
    own.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(own)}


def split_counts(pretokens: Iterable[str], pieces: dict[str, float], longest: int) -> Iterator[tuple[str, int]]:
    """(pre-token, tokens of its best split) of distinct pre-tokens; prefixes that follow one another share scores."""
    score, count = [0.0], [0]
    before = ""
    get = pieces.get
    for word in sorted(pretokens):
        # up to where the path in the trie is the same
        same = 0
        for a, b in zip(before, word):  # noqa: B905
            if a != b:
                break
            same += 1
        del score[same + 1 :], count[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            spelt = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, n = score[end - 1] + BYTE_SCORE * spelt, count[end - 1] + spelt
            for start in range(max(0, end - longest), end):
                if (s := get(word[start:end])) is not None:
                    s += score[start]
                    if s > best or (s == best and count[start] + 1 < n):
                        best, n = s, count[start] + 1
            score.append(best)
            count.append(n)
        before = word
        yield word, count[-1]


def counts(docs: DataFrame, model: str | dict[str, float] = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens and n_tokens for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(model) if isinstance(model, str) else model)
    seen: dict[bytes, int] = {}

    def run(texts: pa.Array) -> pa.Array:
        pieces = sent.value
        longest = max(map(len, pieces), default=1)
        words = [text.encode("utf-8", "surrogatepass").split() if text else [] for text in texts.to_pylist()]
        if len(seen) > CACHE:
            seen.clear()
        new = {MARK + w.decode("utf-8", "surrogatepass"): w for own in words for w in own if w not in seen}
        for word, n in split_counts(new, pieces, longest):
            seen[new[word]] = n
        n = [sum(map(seen.__getitem__, own)) for own in words]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in words], type=pa.int64()), pa.array(n, type=pa.int64())], names=["n_pretokens", "n_tokens"])

    count = F.arrow_udf(run, "struct<n_pretokens:bigint,n_tokens:bigint>").asNondeterministic()
    return docs.select("doc_id", count(F.col("text")).alias("c")).select("doc_id", "c.*")

"""Token counts by unigram segmentation, shared along a trie of pre-tokens.

Pre-tokens are runs of non-white space behind a boundary mark. The distinct
ones of a task are inserted in a trie; a node's forward score is that of the
best unigram segmentation of its prefix, found from the nodes above it, and so
computed once for all pre-tokens that share the prefix. Terminal nodes store
the number of tokens.

The vocabulary is a public one: its pieces' ranks give their probabilities
(Zipf's law), and characters outside it are counted as bytes. Nothing is
trained here.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Pre-tokens whose counts a task keeps.
KEPT = 400_000
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())])


def load_pieces(path: str) -> dict[str, float]:
    """Log probabilities of a sentencepiece vocabulary's normal pieces, from their ranks."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size()) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
    norm = math.log(sum(1 / (k + 2.7) for k in range(len(names))))
    return {name: -math.log(k + 2.7) - norm for k, name in enumerate(names)}


class TrieCounter:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.endings = {p[i:] for p in pieces for i in range(len(p))}
        self.byte = min(pieces.values(), default=-1.0) - 10.0
        self.counts: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        bags = [Counter(t.split()) if t else Counter() for t in texts]
        if len(self.counts) > KEPT:
            self.counts.clear()
        fresh = set().union(*bags) - self.counts.keys() if bags else set()
        self._walk(sorted(fresh))
        counts = self.counts
        return [(sum(n * counts[w] for w, n in bag.items()), sum(bag.values())) for bag in bags]

    def _walk(self, words: list[str]) -> None:
        """Visit the trie of sorted words depth first; only the path to the current node is held.

        ``score[e]`` and ``tokens[e]`` belong to the node of the first e
        characters (the mark included). Equal scores go to fewer tokens.
        """
        pieces, endings, byte = self.pieces, self.endings, self.byte
        score: list[float] = [0.0]
        tokens: list[int] = [0]
        path = ""
        for word in words:
            marked = MARK + word
            shared = 0
            for a, b in zip(path, marked, strict=False):
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                size = len(marked[end - 1].encode("utf-8", "replace"))
                best, fewest = score[end - 1] + byte * size, tokens[end - 1] + size
                start = end - 1
                while start >= 0:
                    piece = marked[start:end]
                    if piece not in endings:
                        break
                    p = pieces.get(piece)
                    if p is not None:
                        s, n = score[start] + p, tokens[start] + 1
                        if s > best or s == best and n < fewest:
                            best, fewest = s, n
                    start -= 1
                score.append(best)
                tokens.append(fewest)
            self.counts[word] = tokens[-1]
            path = marked


def count_column(pieces: dict[str, float], text: Column) -> Column:
    shared: dict[str, TrieCounter] = {}

    @F.pandas_udf(RESULT)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "counter" not in shared:
            shared["counter"] = TrieCounter(pieces)
        for batch in batches:
            texts = list(batch)
            parts = [shared["counter"].count(texts[i : i + 1000]) for i in range(0, len(texts), 1000)]
            yield pd.DataFrame(np.array([x for p in parts for x in p], dtype=np.int64).reshape(-1, 2), columns=["n_tokens", "n_pretokens"])

    return counted.asNondeterministic()(text)


def token_counts(docs: DataFrame, vocabulary: str | dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and n_pretokens of every row's whole text.

    ``vocabulary``: the path of a sentencepiece file (read on the driver; a
    vocabulary's pieces, some tens of thousands, go to the tasks), or pieces
    with log probabilities. Null and empty texts have no tokens; repeated rows
    count alike. There is no shuffle: each task has a trie of its own.
    """
    pieces = load_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary
    out = docs.select(F.col(id_col), count_column(pieces, F.col(text_col)).alias("n"))
    return out.select(id_col, "n.n_tokens", "n.n_pretokens")

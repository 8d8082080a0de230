"""Token counts by a linear longest-match automaton over a word-piece vocabulary.

The vocabulary is a trie. Each node keeps a failure link, the node that stands for what remains once the longest
pieces in front have been taken off, and the number of pieces so taken. Reading a word follows trie edges, and
failure links where there is no edge; the counts met on the way add up to the number of pieces that greedy
longest-match-first segmentation yields, in time linear in the word, with no piece ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import widened
from tarn.llm.words import WordCache, bounded_batches, chunks, distinct_words, sums, tidy

#: Marks the start of a word in the vocabulary.
START = "▁"


class LongestMatch:
    """Counts greedy longest-match pieces; a character that begins no piece counts as its UTF-8 bytes."""

    def __init__(self, pieces: Iterable[str]):
        edges: list[dict[str, int]] = [{}]
        depth, cost = [0], [0]
        for piece in pieces:
            at = 0
            for char in piece:
                to = edges[at].get(char)
                if to is None:
                    to = len(edges)
                    edges[at][char] = to
                    edges.append({})
                    depth.append(depth[at] + 1)
                    cost.append(0)
                at = to
            cost[at] = 1
        for char, node in edges[0].items():
            cost[node] = cost[node] or len(char.encode())
        fail, popped = [0] * len(edges), [0] * len(edges)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for char, node in edges[parent].items():
                    deeper.append(node)
                    if cost[node]:
                        popped[node] = cost[node]
                        continue
                    at, count = fail[parent], popped[parent]
                    while char not in edges[at]:
                        if at == 0:
                            count += len(char.encode())
                            break
                        count += popped[at]
                        at = fail[at]
                    fail[node], popped[node] = edges[at].get(char, 0), count
            level = deeper
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: str) -> int:
        """Pieces of ``word``, which begins with the start mark if the vocabulary has one."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = total = 0
        for char in word:
            to = edges[at].get(char)
            while to is None:
                if at == 0:
                    total += len(char.encode("utf-8", "surrogatepass"))
                    to = 0
                else:
                    total += popped[at]
                    at = fail[at]
                    to = edges[at].get(char)
            at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentence-piece model file; controls, the unknown piece and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(maxsize=2)
def _counter(path: str) -> WordCache:
    automaton = LongestMatch(vocabulary(path))
    return WordCache(lambda words: [automaton.count(START + x) for x in words])


def token_counts(docs: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, n_words and n_tokens (long) of its whole text. No shuffle.

    A word is a run without ASCII white space and is segmented on its own, with the start mark in front. Null and
    empty texts have 0 words and 0 tokens; very long texts are read whole, in one piece; repeated rows each give a
    row; an empty table gives none. Other columns are not read, so their names cannot clash. ``vocab_path`` must
    name a file that every executor has.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{x}`") for x in keep], F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(vocab_path)
        for batch in batches:
            for part in chunks(batch, "_text"):
                names, codes, offsets = distinct_words(part.column("_text"))
                per_word = np.array(counted(names), np.int64)
                n_tokens = sums(per_word[codes], offsets) if len(codes) else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in keep], pa.array(np.diff(offsets)), pa.array(n_tokens)], names=[*keep, "n_words", "n_tokens"]
                )

    return kept.mapInArrow(tidy(run), widened(kept.drop("_text").schema, n_words="long", n_tokens="long"))

"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsift.session import ship_package

CACHED, LONGEST = 250_000, 48
NOWHERE = -1


class LongestMatch:
    """Greedy longest-match piece counts in one pass over the bytes of a word.

    The vocabulary is a trie. Each node has a failure link and the number of pieces popped on following it: the pieces
    that greedy matching settles once no longer one can come, leaving the link's node as the unsettled rest. Pieces
    themselves are never built.
    """

    def __init__(self, vocabulary):
        self.child: dict[int, int] = {}  # node << 8 | byte
        words, parent, byte, order = {0: False}, [0], [0], [0]
        for piece in sorted(set(vocabulary), key=lambda p: (len(p), p)):
            node = 0
            for b in piece:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    words[nxt] = False
                node = nxt
            words[node] = bool(node)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):  # a parent's number is smaller
            depth[v] = depth[parent[v]] + 1
        order = sorted(range(1, len(parent)), key=depth.__getitem__)
        self.fail, self.pops = [NOWHERE] * len(parent), [0] * len(parent)
        for v in order:
            if words[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, k = self.fail[parent[v]], self.pops[parent[v]]
            while z != NOWHERE and (z << 8 | byte[v]) not in self.child:
                k, z = k + self.pops[z], self.fail[z]
            if z != NOWHERE:
                self.fail[v], self.pops[v] = self.child[z << 8 | byte[v]], k

    def count(self, word: bytes) -> int:
        """Pieces of a word; one for a word that the vocabulary cannot spell, none for an empty one."""
        node, n, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for b in word:
            while (nxt := child.get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
                if node == NOWHERE:
                    return 1
            node = nxt
        while node:
            n += pops[node]
            node = fail[node]
            if node == NOWHERE:
                return 1
        return n


class WordCounts(dict):
    """Pieces by word, bounded."""

    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as f:
            self.automaton = LongestMatch(base64.b64decode(line.split()[0]) for line in f if line.strip())

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(self) < CACHED and len(word) <= LONGEST:
            self[word] = n
        return n


@functools.lru_cache(maxsize=1)
def word_counts(ranks_file: str) -> WordCounts:
    return WordCounts(ranks_file)


def count_tokens(docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_tokens`` for whole texts, one row per row.

    Words are runs without ASCII white space; each is a space and its UTF-8 bytes, cut greedily into the longest
    pieces of the vocabulary. A word the vocabulary cannot spell is one token. Null or empty text: zeros. A narrow
    projection: no shuffle, memory bounded by the vocabulary, a cache of fixed size and one text.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        counts = word_counts(ranks_file)
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words[i], n_tokens[i] = len(words), sum(map(counts.__getitem__, words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint")

"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and popped-token counts."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches, split_words

#: Words whose counts a Python worker remembers.
COUNT_CACHE_WORDS = 300_000
#: The automaton is shipped to every executor, so its size is checked; larger vocabularies are refused.
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Greedy longest-match token counts in one pass over the bytes of a word.

    State v stands for the bytes on its trie path.  When no edge fits the next byte, the failure link leaves the
    longest token at the front of those bytes and ``pops[v]`` says how many tokens that takes, so no piece is built
    and no byte is read twice.  Every byte that the vocabulary lacks counts as one token of its own, as with byte
    fallback; so each state has a way on.
    """

    def __init__(self, vocabulary: Iterable[bytes], lead: bytes = b" "):
        self.lead = lead
        tokens = {t for t in vocabulary if t} | {bytes([b]) for b in range(256)}
        if sum(map(len, tokens)) > MAX_VOCABULARY_BYTES:
            raise ValueError("the vocabulary is too large to ship to executors")
        edges: list[dict[int, int]] = [{}]
        ends = [False]
        for token in sorted(tokens):
            at = 0
            for byte in token:
                to = edges[at].get(byte)
                if to is None:
                    to = edges[at][byte] = len(edges)
                    edges.append({})
                    ends.append(False)
                at = to
            ends[at] = True
        self.edges = edges
        self.fail = [0] * len(edges)
        self.pops = [0] * len(edges)
        queue = deque((0, byte, to) for byte, to in edges[0].items())
        while queue:
            parent, byte, v = queue.popleft()
            if ends[v]:
                self.fail[v], self.pops[v] = 0, 1
            else:  # the parent's tokens leave until the byte fits; single bytes are tokens, so the root always fits
                z, n = self.fail[parent], self.pops[parent]
                while byte not in edges[z]:
                    n += self.pops[z]
                    z = self.fail[z]
                self.fail[v], self.pops[v] = edges[z][byte], n
            queue.extend((v, b, to) for b, to in edges[v].items())

    def count(self, data: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        at = n = 0
        for byte in data:
            to = edges[at].get(byte)
            while to is None:
                n += pops[at]
                at = fail[at]
                to = edges[at].get(byte)
            at = to
        while at:
            n += pops[at]
            at = fail[at]
        return n


class WordCounts(dict):
    """Counts of words, each with the lead bytes in front; forgets when full."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= COUNT_CACHE_WORDS:
            self.clear()
        value = self[word] = self.automaton.count(self.automaton.lead + word)
        return value


_counters: dict[str, WordCounts] = {}


def token_counts(docs: DataFrame, vocabulary: Iterable[bytes], *, lead: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words, UTF-8 bytes of words and greedy longest-match tokens of each whole text: id, n_words, n_bytes, n_tokens.

    A word is a run of characters other than ASCII white space; ``lead`` goes in front of each, as in vocabularies
    whose word-initial tokens begin with a blank.  A null text has no words; repeated rows are counted each; a null
    id stays null; a very long text is read whole, by itself; an empty table gives an empty table; other columns are not read.  One narrow pass, no shuffle.
    """
    spark = small_batches(docs.sparkSession)
    vocabulary = sorted(set(vocabulary))
    if sum(map(len, vocabulary)) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to ship to executors")
    shipped = spark.sparkContext.broadcast((vocabulary, lead))
    name = f"{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"  # a worker may outlive a query
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _counters.get(name)
        if counts is None:
            _counters.clear()
            counts = _counters[name] = WordCounts(LongestMatch(*shipped.value))
        for batch in batches:
            out = np.zeros((len(batch), 3), dtype=np.int64)
            for i, text in enumerate(batch["text"]):
                if text:
                    words = split_words(text)
                    out[i] = len(words), sum(map(len, words)), sum(map(counts.__getitem__, words))
            yield pd.DataFrame({"id": batch["id"], "n_words": out[:, 0], "n_bytes": out[:, 1], "n_tokens": out[:, 2]})

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return rows.mapInPandas(count, f"id {kind}, n_words long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)

"""Token counts by dynamic programming over prefixes.

The table of a word holds the exact token count of each of its prefixes (see bpe.Vocabulary.walk); the counts of a
text's prefixes are running sums over its words. Totals, budgets and truncation are read off without encoding again.
"""

from __future__ import annotations

from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, Splitter, Vocabulary, Words, kept_by_worker
from .common import by_bytes, map_arrow, text_bytes


class Counter:
    """Prefix tables of the words of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = Splitter(vocabulary.added)
        self.words = Words(self._tables)

    def _tables(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Of each word its token counts by prefix length in bytes."""
        added = self.vocabulary.added
        found = {word: tuple(count) for word, _, count in self.vocabulary.walk(w.encode() for w in words if w not in added)}
        return {w: (0, 1) if w in added else found[w.encode()] for w in words}

    def totals(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        tables = self.words(split)
        whole = itemgetter(-1)
        return [sum(map(whole, map(tables.__getitem__, words))) for words in split]

    def cut(self, text: str, budget: int) -> tuple[str, int]:
        """The longest prefix within the budget, and its count.

        It ends after a word or, in a word of letters or digits, after a character.
        """
        split = self.split(text)
        words = list(zip(split, map(self.words([split]).__getitem__, split)))
        sums = list(accumulate((t[-1] for _, t in words), initial=0))
        full = int(np.searchsorted(sums, budget, side="right")) - 1
        out, used = "".join(w for w, _ in words[:full]), sums[full]
        if full < len(words) and words[full][0].lstrip(" ").isalnum():
            word, table = words[full]
            ends = list(accumulate((len(c.encode()) for c in word), initial=0))
            fit = max(k for k, e in enumerate(ends) if used + table[e] <= budget)
            if word[:fit].strip(" "):
                out, used = out + word[:fit], used + table[ends[fit]]
        while self.totals([out])[0] != used:  # what follows a cut can change how the words before it are split
            full -= 1
            out, used = "".join(w for w, _ in words[:full]), sums[full]
        return out, used


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; null texts are empty and have no tokens.

    Repeated rows stay; columns other than doc_id and text are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        counter = kept_by_worker(Counter, shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                _, off = text_bytes(batch.column(1))
                totals = counter.totals([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(totals, pa.int64())], schema=schema)

    counted = map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long", keeps="bpe")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def truncate(docs: DataFrame, vocabulary: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): the longest prefix of each text with at most `budget` tokens; null texts are empty."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        counter = kept_by_worker(Counter, shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                cut = [counter.cut(t or "", budget) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in cut], pa.string()), pa.array([c[1] for c in cut], pa.int64())], schema=schema)

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, text string, n_tokens long", keeps="bpe")

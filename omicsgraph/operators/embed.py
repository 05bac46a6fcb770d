"""Sequences to vectors through a function given by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BASES, COMPLEMENTS, pad_or_center_truncate, split_windows
from ..functions.vectors import pool_vectors

_COMPLEMENT = str.maketrans(BASES, COMPLEMENTS)


class TokenTable:
    """The embedder at hand: each letter has a vector; a sequence has their mean, or the first one's (cls).

    A sequence's mean is its counts of letters times the table; letters that the table doesn't have are zeros.
    """

    def __init__(self, table: dict[str, list[float]], pooling: str = "mean"):
        self.dim = len(next(iter(table.values())))
        self.pooling = pooling
        self.vectors = np.vstack([np.zeros((1, self.dim)), np.array([table[c] for c in table], float)])
        self.codes = np.zeros(256, np.int64)
        self.codes[[ord(c) for c in table]] = np.arange(1, len(table) + 1)

    def __call__(self, seqs: list[str]) -> np.ndarray:
        if self.pooling == "cls":
            seqs = [s[:1] for s in seqs]
        sizes = np.array(list(map(len, seqs)), np.int64)
        codes = self.codes[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)]
        k = len(self.vectors)
        counts = np.bincount(np.repeat(np.arange(len(seqs)) * k, sizes) + codes, minlength=len(seqs) * k).reshape(len(seqs), k)
        return counts @ self.vectors / np.maximum(1, sizes)[:, None]


def embed_sequences(
    df: DataFrame,
    embedder: Callable[[list[str]], np.ndarray],
    dim: int,
    keys: list[str],
    mode: str = "fixed",
    short_threshold: int = 6000,
    window_size: int = 6000,
    stride: int = 3000,
    window_pooling: str = "mean",
    strands: str | None = "sum",
    max_length: int | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """(keys, x) for rows (keys, seq[, fixed_len]).

    fixed: sequences are cut or padded to fixed_len. adaptive: those longer than short_threshold are cut into windows,
    whose vectors are pooled. Each piece, cut to max_length, is embedded forwards and as reverse complement, and the
    two are added (sum) or averaged (mean); strands=None takes it forwards only. Empty sequences have zeros.
    """
    seq = F.upper(F.coalesce("seq", F.lit("")))
    if mode == "fixed":
        pieces = F.array(pad_or_center_truncate(F.col("seq"), F.col("fixed_len")))
    else:
        pieces = F.when(F.length(seq) <= short_threshold, F.array(seq)).otherwise(split_windows(F.col("seq"), window_size, stride))
    rows = df.select(*keys, F.posexplode(pieces).alias("pos", "piece"))
    schema = T.StructType([*rows.select(*keys, "pos").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                seqs = [s[:max_length] for s in part["piece"]]
                x = np.asarray(embedder(seqs), float)
                if strands:
                    back = np.asarray(embedder([s.translate(_COMPLEMENT)[::-1] for s in seqs]), float)
                    x = (x + back) / (2 if strands == "mean" else 1)
                x[[not s for s in seqs]] = 0.0
                yield part[[*keys, "pos"]].assign(x=list(x))

    done = rows.mapInPandas(run, schema)
    return done.select(*keys, "x") if mode == "fixed" else pool_vectors(done, keys, "pos", window_pooling)

"""Vectors of texts: encoders are injected functions, with a deterministic one for use without a model."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.words import words_of

#: From a batch of texts to their dense vectors and, for each, the weights of its tokens.
Encoder = Callable[[list[str]], tuple[np.ndarray, list[dict[int, float]]]]
#: Length of the default encoder's dense vectors, and texts that an encoder gets at once.
DIM, BATCH = 64, 64


@lru_cache(1 << 18)
def _hashed(word: str) -> tuple[int, np.ndarray]:
    digest = hashlib.md5(word.encode()).digest()
    return int.from_bytes(digest[:4], "big") >> 4, np.unpackbits(np.frombuffer(digest[8:], np.uint8)).astype(np.float32) * 2 - 1


def hashed_encoder(texts: list[str]) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Signed bits of the words' digests added up to unit length, and 1 + ln(count) by word: no model, no claim to quality."""
    dense, sparse = np.zeros((len(texts), DIM), np.float32), []
    for i, text in enumerate(texts):
        weights: dict[int, float] = {}
        for word, n in Counter(words_of(text)).items():
            token, signs = _hashed(word)
            weight = 1 + float(np.log(n))
            dense[i] += weight * signs
            weights[token] = weights.get(token, 0.0) + weight
        sparse.append(weights)
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    return dense / np.where(norm > 0, norm, 1), sparse


def encode(texts: DataFrame, encoder: Encoder = hashed_encoder) -> DataFrame:
    """(id, vector, indices, values) of texts (id, text); a null text is encoded as an empty one.

    The function is sent to the workers and called in batches; a model that is loaded lazily is
    loaded once per worker. Questions and passages go through the same encoder.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), BATCH):
                part = pdf.iloc[lo : lo + BATCH]
                dense, sparse = encoder(["" if t is None else t for t in part["text"]])
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "vector": [row.astype(np.float32) for row in dense],
                    "indices": [np.array(list(w), np.int32) for w in sparse], "values": [np.array(list(w.values()), np.float32) for w in sparse],
                })

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>, indices array<int>, values array<float>")

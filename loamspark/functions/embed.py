"""Hashed embeddings: signed feature hashing with keyed BLAKE2b, and the interface of other providers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.functions.text import TERM_GROUPS, chunk_fingerprint, lowered, nfkc, text_hash, weighted_text
from loamspark.schemas import VECTORS, VERSIONS, conform

#: The two keys.
SALTS = (b"rag-v1-a", b"rag-v1-b")


@lru_cache(maxsize=200_000)
def _places(token: str) -> tuple[tuple[int, float], ...]:
    out = []
    for salt in SALTS:
        digest = blake2b(token.encode("utf-8", "surrogatepass"), digest_size=16, key=salt).digest()
        out.append((int.from_bytes(digest[:4], "big"), 1.0 if digest[4] % 2 == 0 else -1.0))
    return tuple(out)


def embed_tokens(tokens: list[str], dimension: int) -> np.ndarray:
    """Unit vector of the tokens' counts; distinct tokens are added in order of first occurrence."""
    vector = np.zeros(max(dimension, 0))
    if dimension <= 0:
        return vector
    counts: dict[str, int] = {}
    for token in tokens:
        counts[token] = counts.get(token, 0) + 1
    for token, n in counts.items():
        for index, sign in _places(token):
            vector[index % dimension] += sign * (1.0 + np.log1p(n))
    norm = float(np.sqrt((vector * vector).sum()))
    return vector / norm if norm > 0 else vector


def embed_batch(tokens: pa.ListArray, dimension: int) -> np.ndarray:
    """``embed_tokens`` of every row as one matrix: distinct tokens are hashed once and all sums are one count.

    Entries are added in the order of first occurrence, so that rows are equal to the last bit.
    """
    rows, width = len(tokens), max(dimension, 0)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    words = tokens.flatten().dictionary_encode()
    if not width or not len(words):
        return np.zeros((rows, width))
    owner, codes, size = np.repeat(np.arange(rows), lengths), np.asarray(words.indices), len(words.dictionary)
    keys, first, counts = np.unique(owner * size + codes, return_index=True, return_counts=True)
    order = np.argsort(first)
    keys, weights = keys[order], 1.0 + np.log1p(counts[order])
    places = [_places(w) for w in words.dictionary.to_pylist()]
    index = np.array([[i % width for i, _ in p] for p in places])[keys % size]
    signs = np.array([[s for _, s in p] for p in places])[keys % size]
    at = (keys // size)[:, None] * width + index
    summed = np.bincount(at.ravel(), (signs * weights[:, None]).ravel(), rows * width).reshape(rows, width)
    norms = np.sqrt((summed * summed).sum(axis=1))
    return summed / np.where(norms > 0, norms, 1.0)[:, None]


def embed_counts(rows: np.ndarray, at: np.ndarray, tokens: pa.Array, times: np.ndarray, n: int, dimension: int) -> np.ndarray:
    """``embed_batch`` of ``n`` texts from counts of their tokens, added in the order given."""
    width = max(dimension, 0)
    if not width or not len(rows):
        return np.zeros((n, width))
    places = [_places(w) for w in tokens.to_pylist()]
    index = np.array([[i % width for i, _ in p] for p in places])[at]
    signs = np.array([[s for _, s in p] for p in places])[at]
    summed = np.bincount((rows[:, None] * width + index).ravel(), (signs * (1.0 + np.log1p(times))[:, None]).ravel(), n * width).reshape(n, width)
    norms = np.sqrt((summed * summed).sum(axis=1))
    return summed / np.where(norms > 0, norms, 1.0)[:, None]


def with_hashed_vectors(rows: DataFrame, tokens: Column, dimension: int, name: str = "values") -> DataFrame:
    """rows with the embedding of a column of tokens, an Arrow batch at a time."""
    schema = T.StructType([*rows.drop(name).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = embed_batch(batch.column(batch.num_columns - 1), dimension)
            starts = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
            made = pa.ListArray.from_arrays(pa.array(starts), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=schema.names)

    return rows.drop(name).withColumn("__tokens", tokens).mapInArrow(run, schema)


def with_hash_provider(rows: DataFrame, text: Column, dimension: int, name: str = "values") -> DataFrame:
    """Hashed embeddings of a text's tokens, compatibility forms folded first.

    Tokens are counted for many texts at a time where these are read, and added in the order of
    the tokens, so that equal texts have equal vectors in whatever task they are.
    """
    from loamspark.operators.counted import bounds, token_counts

    schema = T.StructType([*rows.drop(name).schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in bounds(batch.column(batch.num_columns - 1)):
                part = batch.slice(start, stop - start)
                made = embed_counts(*token_counts(part.column(part.num_columns - 1), TERM_GROUPS), len(part), dimension)
                starts = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
                values = pa.ListArray.from_arrays(pa.array(starts), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=schema.names)

    folded = rows.drop(name).withColumn("__folded", nfkc(text))
    return folded.withColumn("__folded", F.coalesce(lowered(F.col("__folded")), F.lit(""))).mapInArrow(run, schema)


#: A provider adds a column ``values`` of vectors to rows, from a text column; others may be registered.
PROVIDERS: dict[str, Callable[[DataFrame, Column, int], DataFrame]] = {"hash": with_hash_provider}


def vector_records(chunks: DataFrame, dimension: int = 384, provider: str = "hash", model: str = "hash", collection_id: str = "default") -> DataFrame:
    """Vector table rows of chunks, with the hashes that say whether they are still right."""
    text = F.col("__text")
    made = chunks.withColumn("__text", weighted_text()).select(
        F.col("id").alias("chunk_id"),
        "document_id",
        "chunk_index",
        F.lit(collection_id).alias("collection_id"),
        F.lit(provider).alias("provider"),
        F.lit(model).alias("model"),
        F.lit(dimension).alias("dimension"),
        chunk_fingerprint().alias("chunk_hash"),
        text_hash(text).alias("embedding_text_hash"),
        *[F.lit(v).alias(k) for k, v in VERSIONS.items()],
        F.current_timestamp().alias("created_at"),
        F.lit(True).alias("is_active"),
        text,
    )
    return conform(PROVIDERS[provider](made, text, dimension), VECTORS)

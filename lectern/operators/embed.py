"""Model calls as columns: vectors and generated text.

A model is given by a ``load`` function that runs once per Python worker and
returns a callable over a list of texts. Without a model, ``hashing_model`` gives
vectors that reflect words only; they carry no meaning beyond shared words.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def hashing_model(dims: int = 384):
    """Loader of a word-hashing model with unit-length output."""

    def load():
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float64)
            for row, text in enumerate(texts):
                words = re.findall(r"[a-z0-9]+", (text or "").lower())
                codes = np.fromiter((zlib.crc32(word.encode("utf-8")) for word in words), np.int64, len(words))
                signs = np.where(codes & 0x80000000, 1.0, -1.0)
                out[row] = np.bincount(codes % dims, signs, dims)
                if words and not out[row].any():
                    # The signs cancel each other out: the words count without them.
                    out[row] = np.bincount(codes % dims, minlength=dims)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

        return run

    return load


def embedder(load: Callable) -> Callable[[Column], Column]:
    """Column function that embeds text in Arrow batches; the model is loaded once per worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            known = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                vectors = model(batch[known].tolist())
                out[known] = pd.Series([v.astype("float32") for v in np.asarray(vectors)], index=batch.index[known])
            yield out

    return embed


def generator(load: Callable, retries: int = 3, wait_seconds: float = 1.0) -> Callable[[Column], Column]:
    """Column function for generated text. A prompt that keeps failing gives null."""

    @F.pandas_udf(StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def answer(prompt: str):
            for attempt in range(retries):
                try:
                    return model([prompt])[0]
                except Exception as failure:  # the model decides how long to wait
                    asked = re.search(r"try again in ([0-9.]+)s", str(failure))
                    if attempt + 1 < retries:
                        time.sleep(float(asked.group(1)) if asked else wait_seconds * 2**attempt)
            return None

        for batch in batches:
            yield batch.map(answer, na_action="ignore")

    return generate


def embed_pending(chunks: DataFrame, stored: DataFrame | None, model: str, version: str, embed) -> DataFrame:
    """Vectors for the chunks that have none yet for this model and version."""
    if stored is not None:
        done = stored.filter((F.col("model") == model) & (F.col("version") == version)).select("chunk_id")
        chunks = chunks.join(done, "chunk_id", "left_anti")
    vectors = chunks.select("chunk_id", embed(F.col("content")).alias("embedding"))
    return vectors.select(
        F.concat(F.lit("emb_"), F.col("chunk_id"), F.lit("_"), F.lit(version)).alias("id"), "chunk_id",
        F.lit(model).alias("model"), F.lit(version).alias("version"), F.size("embedding").alias("dimensions"), "embedding",
    )

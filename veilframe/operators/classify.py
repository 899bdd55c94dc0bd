"""Classifying documents by their embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.probability import (
    exp_scores,
    feature_slice,
    normalise,
    predicted_class,
    sample_variance,
    shannon_entropy,
    top_gap,
    uncertainty,
)
from veilframe.schemas import CLASSIFIER_RESULT
from veilframe.sources.weights import Weights


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """One row of `dims` numbers per vector; what is missing is zero, what is beyond is left out."""
    flat = vectors.flatten()
    lengths = vectors.value_lengths()
    if not vectors.null_count and not flat.null_count and len(flat) == len(vectors) * dims and pc.all(pc.equal(lengths, dims)).as_py() is not False:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    for i, vector in enumerate(vectors.to_pylist()):
        for d, value in enumerate((vector or [])[:dims]):
            out[i, d] = 0.0 if value is None else value
    return out


def _summed(keys: pa.Array, counts: np.ndarray, sums: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Counts and vectors added up for equal keys of a batch, keys in order of appearance."""
    coded = keys.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    return coded.dictionary, np.add.reduceat(counts[order], starts), np.add.reduceat(sums[order], starts, axis=0)


def _row_batch(keys: pa.Array, counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * sums.shape[1])
    vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sums).reshape(-1)))
    return pa.RecordBatch.from_arrays([keys, pa.array(counts), vectors], ["key", "n", "sums"])


def mean_pool(tokens: DataFrame, dims: int, key: str = "doc_id") -> DataFrame:
    """Mean of a document's token vectors, masked tokens left out.

    `tokens` has one row per token: key, mask, vec.  Vectors are added as blocks:
    those of a key within an Arrow batch first, before the shuffle, and then the sums,
    sorted by key, as they come.  Time is linear in the numbers, however wide the
    vectors are, and a key with very many tokens sends one sum per batch.  Numbers that
    a vector lacks count as zero.
    """
    kind = dict(tokens.dtypes)[key]
    schema = f"key {kind}, n double, sums array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mask = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
                yield _row_batch(*_summed(batch.column(0), mask, _matrix(batch.column(2), dims) * mask[:, None]))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts, sums = batch.column(0), batch.column(1).to_numpy(), _matrix(batch.column(2), dims)
            if held is not None:
                keys, counts, sums = pa.concat_arrays([held[0], keys]), np.append(held[1], counts), np.vstack([held[2], sums])
            keys, counts, sums = _summed(keys, counts, sums)
            held = keys[-1:], counts[-1:], sums[-1:]
            if len(keys) > 1:
                yield _row_batch(keys[:-1], counts[:-1], sums[:-1])
        if held is not None:
            yield _row_batch(*held)

    small = tokens.select(F.col(key).alias("key"), F.col("mask").cast("double").alias("mask"), F.col("vec").cast("array<double>").alias("vec"))
    ordered = small.mapInArrow(partial, schema).repartition("key").sortWithinPartitions("key")
    n = F.greatest("n", F.lit(1e-9))
    pooled = ordered.mapInArrow(total, schema).withColumn("n", n)
    return pooled.select(F.col("key").alias(key), F.transform("sums", lambda s: s / F.col("n")).alias("embedding"))


def with_features(df: DataFrame, dims: int = 100) -> DataFrame:
    """Add `features`, the classifier's input, from `embedding`."""
    return df.withColumn("features", feature_slice(F.col("embedding"), dims))


def mlp_forward(df: DataFrame, weights: Weights) -> DataFrame:
    """Add `logits`, the network's output for `features`.

    Matrix products on Arrow batches.  The weights travel with the function:
    their size is set by the model, not by the data, and checked on loading.
    """
    layers = weights.arrays()
    width = weights.input_dim

    def forward(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def normed(x, gain, shift):
            centred = x - x.mean(axis=1, keepdims=True)
            return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5) * gain + shift

        def selu(x):
            # fixed values of the activation
            alpha, scale = 1.6732632423543772, 1.0507009873554805
            return scale * np.where(x > 0, x, alpha * np.expm1(np.minimum(x, 0)))

        for batch in batches:
            known = batch.notna().to_numpy()
            x = np.zeros((len(batch), width))
            if known.any():
                x[known] = np.stack(batch[known].to_numpy())
            for block in layers:
                x = x @ block["weight"].T + block["bias"]
                if "gain" in block:
                    x = selu(normed(x, block["gain"], block["shift"]))
            out = pd.Series(list(x))
            out[~known] = None
            yield out

    return df.withColumn("logits", F.pandas_udf(forward, "array<double>")("features"))


def class_probabilities(df: DataFrame) -> DataFrame:
    """Add `probabilities`, `pii_probability` and `predicted_class` from `logits`."""
    return (
        df.withColumn("_exp", exp_scores(F.col("logits")))
        .withColumn("probabilities", normalise(F.col("_exp")))
        .drop("_exp")
        .withColumn("pii_probability", F.get("probabilities", F.lit(0)))
        .withColumn("predicted_class", predicted_class(F.col("probabilities")))
    )


def with_uncertainty(df: DataFrame) -> DataFrame:
    """Add the three uncertainty measures of `probabilities` as columns."""
    p = F.col("probabilities")
    return (
        df.withColumn("shannon_entropy", shannon_entropy(p))
        .withColumn("uncertainty_principle", top_gap(p))
        .withColumn("probabilistic_variance", sample_variance(p))
    )


def classify_documents(df: DataFrame, weights: Weights) -> DataFrame:
    """Add `quantum_analysis`, the classifier's verdict on `embedding`.

    A row without an embedding gets zeros.
    """
    scored = class_probabilities(mlp_forward(with_features(df, weights.input_dim), weights))
    result = F.struct(
        F.col("pii_probability"),
        F.col("predicted_class"),
        uncertainty(F.col("probabilities")).alias("uncertainty"),
        F.lit("quantum_classification").alias("detection_method"),
    )
    zero = F.lit(0.0)
    nothing = F.struct(
        zero.alias("pii_probability"),
        F.lit(0).alias("predicted_class"),
        F.struct(
            zero.alias("shannon_entropy"), zero.alias("uncertainty_principle"), zero.alias("probabilistic_variance")
        ).alias("uncertainty"),
        F.lit("quantum_classification").alias("detection_method"),
    )
    verdict = F.when(F.col("logits").isNull(), nothing).otherwise(result).cast(CLASSIFIER_RESULT)
    return scored.select(*df.columns, verdict.alias("quantum_analysis"))

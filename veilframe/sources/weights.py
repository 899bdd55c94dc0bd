"""Classifier weights as a table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.schemas import WEIGHTS

MAX_VALUES = 50_000_000


def layer_sizes(input_dim: int = 100, num_classes: int = 10, complexity_level: float = 0.5) -> list[int]:
    """Widths from input to output; the hidden ones scale with the complexity."""
    return [input_dim, int(128 * complexity_level), int(64 * complexity_level), num_classes]


@dataclass
class Weights:
    """Weights of the three linear layers, the first two followed by a norm."""

    blocks: list[dict[str, np.ndarray]]
    complexity_level: float = 0.5

    @property
    def input_dim(self) -> int:
        return self.blocks[0]["weight"].shape[1]

    @property
    def num_classes(self) -> int:
        return self.blocks[-1]["weight"].shape[0]

    def arrays(self) -> list[dict[str, np.ndarray]]:
        return self.blocks

    @classmethod
    def initial(
        cls, input_dim: int = 100, num_classes: int = 10, complexity_level: float = 0.5, seed: int = 0
    ) -> Weights:
        """Untrained weights: uniform within 1/sqrt(inputs), norms at identity."""
        rng = np.random.default_rng(seed)
        sizes = layer_sizes(input_dim, num_classes, complexity_level)
        blocks = []
        for i, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
            bound = 1 / np.sqrt(n_in)
            block = {
                "weight": rng.uniform(-bound, bound, (n_out, n_in)),
                "bias": rng.uniform(-bound, bound, n_out),
            }
            if i < len(sizes) - 2:
                block |= {"gain": np.ones(n_out), "shift": np.zeros(n_out)}
            blocks.append(block)
        return cls(blocks, complexity_level)


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """The weights as rows (layer, name, shape, weights), metadata as layer -1."""
    rows = [(-1, "complexity_level", [1], [float(weights.complexity_level)])]
    for i, block in enumerate(weights.blocks):
        for name, values in block.items():
            rows.append((i, name, list(values.shape), [float(v) for v in values.ravel()]))
    return spark.createDataFrame(rows, WEIGHTS)


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    weights_table(spark, weights).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """Read a saved model; ValueError if it is incomplete or larger than a
    model that may travel with every task."""
    try:
        table = spark.read.schema(WEIGHTS).parquet(path)
        size = table.agg(F.sum(F.size("weights"))).first()[0]
    except Exception as e:
        raise ValueError(f"Model loading failed: {e}") from e
    if not size or size > MAX_VALUES:
        raise ValueError(f"Model loading failed: {size} weights")
    found = {(r["layer"], r["name"]): np.array(r["weights"]).reshape(r["shape"]) for r in table.collect()}
    depth = max(layer for layer, _ in found) + 1
    blocks = []
    for i in range(depth):
        names = ["weight", "bias"] + (["gain", "shift"] if i < depth - 1 else [])
        missing = [name for name in names if (i, name) not in found]
        if missing:
            raise ValueError(f"Model loading failed: layer {i} lacks {', '.join(missing)}")
        blocks.append({name: found[i, name] for name in names})
    if depth != 3 or (-1, "complexity_level") not in found:
        raise ValueError("Model loading failed: layers or metadata missing")
    return Weights(blocks, float(found[-1, "complexity_level"][0]))

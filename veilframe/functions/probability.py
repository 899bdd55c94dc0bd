"""Column functions on vectors, class scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_slice(vector: Column, dims: int = 100) -> Column:
    """The first `dims` values as doubles, filled up with zeros."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    return F.slice(F.concat(vector.cast("array<double>"), zeros), 1, dims)


def _total(values: Column, term=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


def exp_scores(scores: Column) -> Column:
    """exp of each score less the highest one."""
    top = F.array_max(scores)
    return F.transform(scores, lambda x: F.exp(x - top))


def normalise(values: Column) -> Column:
    """Each value over the sum; `values` should be a plain column."""
    total = _total(values)
    return F.transform(values, lambda x: x / total)


def predicted_class(probabilities: Column) -> Column:
    """Index of the highest probability, the first one on ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def shannon_entropy(probabilities: Column) -> Column:
    return -_total(probabilities, lambda p: p * F.log(p + F.lit(1e-10)))


def top_gap(probabilities: Column) -> Column:
    return F.lit(1.0) - F.array_max(probabilities)


def sample_variance(values: Column) -> Column:
    """Variance over n - 1."""
    n = F.size(values)
    mean = _total(values) / n
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.pow(x - mean, F.lit(2.0))) / (n - 1)


def uncertainty(probabilities: Column) -> Column:
    """Three measures of how sure the classifier is."""
    return F.struct(
        shannon_entropy(probabilities).alias("shannon_entropy"),
        top_gap(probabilities).alias("uncertainty_principle"),
        sample_variance(probabilities).alias("probabilistic_variance"),
    )

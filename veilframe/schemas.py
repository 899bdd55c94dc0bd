"""Fixed schemas of the tables that move between operators."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

# One finding as an element of a per-document array.
FINDING = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("matches", T.ArrayType(T.StringType())),
    T.StructField("detection_method", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("location", LOCATION),
    T.StructField("country", T.StringType()),
    T.StructField("description", T.StringType()),
])

# One finding as a row: key, position in the merged order, then the finding.
FINDING_FIELDS = [f.name for f in FINDING.fields]
FINDING_ROW = ["doc_id", "chunk_idx", "method_rank", "ord", *FINDING_FIELDS]

SPANS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

RESPONSES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("response", T.StringType()),
])

WEIGHTS = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("shape", T.ArrayType(T.IntegerType())),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
])

UNCERTAINTY = T.StructType([
    T.StructField("shannon_entropy", T.DoubleType()),
    T.StructField("uncertainty_principle", T.DoubleType()),
    T.StructField("probabilistic_variance", T.DoubleType()),
])

CLASSIFIER_RESULT = T.StructType([
    T.StructField("pii_probability", T.DoubleType()),
    T.StructField("predicted_class", T.IntegerType()),
    T.StructField("uncertainty", UNCERTAINTY),
    T.StructField("detection_method", T.StringType()),
])

# A message between the stages.  `pii_matches` and `quantum` are set on results.
MESSAGE = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("methods", T.StringType()),
    T.StructField("countries", T.StringType()),
    T.StructField("transform_method", T.StringType()),
    T.StructField("pii_matches", T.ArrayType(FINDING)),
    T.StructField("quantum", CLASSIFIER_RESULT),
    T.StructField("seq", T.LongType()),
    T.StructField("submitted_ts", T.TimestampType()),
])

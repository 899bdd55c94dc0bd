"""One query per operator; each takes (spark, sf_dir) and returns a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.fixtures import (
    CHUNK,
    MSG_CHUNK,
    MSG_OVERLAP,
    NONCE,
    OVERLAP,
    SALT,
    SUBMITTED,
    WINDOW,
    Tables,
    rule_weights,
)
from veilframe import catalog
from veilframe.functions import patterns as fp
from veilframe.functions.text import natural_break
from veilframe.functions.tokens import consistent_token
from veilframe.operators import chunking, classify, combine, detection, jobs, responses, routing, spans, transform
from veilframe.operators.steps import spread
from veilframe.plans.detect import detect_documents, detect_jobs, detect_long_documents
from veilframe.plans.service import DetectionService
from veilframe.plans.transform import transform_documents, transform_long_documents
from veilframe.sources import catalogue, documents, long_files, message_log, messages, results, weights
from veilframe.sources.jobs import job_requests
from veilframe.streaming import detect as stream_detect
from veilframe.streaming import jobs as stream_jobs
from veilframe.streaming import state as stream_state
from veilframe.workspace import workspace

QUERIES = {}


def query(fn):
    """Register under the function's name; the query gets its inputs as Tables.

    A trailing underscore keeps the name apart from an imported one.
    """
    QUERIES[fn.__name__.rstrip("_")] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def joined(column, name: str | None = None):
    return F.array_join(column, "|").alias(name or column)


def r6(column, name: str | None = None):
    return F.round(column, 6).alias(name or column)


def flat(df: DataFrame, column: str = "findings") -> DataFrame:
    """One row per finding of an array column."""
    f = spread(df, column, ["doc_id"], item="f")
    return f.select(
        "doc_id", F.col("f.type").alias("type"), joined(F.col("f.matches"), "matches"),
        F.col("f.detection_method").alias("method"), F.col("f.confidence").alias("confidence"),
    )


def rows(df: DataFrame) -> DataFrame:
    """Finding rows in the columns that the oracles give."""
    return df.select("doc_id", "type", joined("matches"), F.col("detection_method").alias("method"), "confidence")


# --- sources and sinks -------------------------------------------------------
@query
def read_text_documents(t):
    path = workspace(t.spark, "texts")
    (t.read("documents").select("lang", "text").write.partitionBy("lang")
     .option("maxRecordsPerFile", 5000).text(path))
    files = documents.read_text_documents(t.spark, path, "*.txt")
    return files.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.length("text")).cast("long").alias("chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("lines"),
    )


@query
def read_chunks(t):
    path = workspace(t.spark, "files")
    crlf = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))
    # one text per language, in parts: no task holds a language
    in_order = t.read("documents").repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    in_order.select("lang", crlf.alias("text")).write.partitionBy("lang").text(path)
    chunks = long_files.read_chunks(t.spark, path, "*.txt", CHUNK, OVERLAP, parts=True)
    lang = F.regexp_extract("path", "lang=([^/]*)$", 1).alias("lang")
    return chunks.select(lang, "chunk_idx", "total_chunks", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query
def job_requests_(t):
    return job_requests(t.jobs()).select(
        "job_id", joined("methods"), joined("countries"), "transform_method", "status", "progress"
    )


def _merged(df: DataFrame) -> DataFrame:
    """A side that grows with its table: Spark takes texts made of short keys for small and would broadcast them."""
    return df.hint("merge")


def task_messages(t: Tables) -> DataFrame:
    """store_text messages of all jobs, chunks of the customer texts."""
    chunks = chunking.chunk_documents(
        job_requests(t.jobs()).join(_merged(t.us().select("doc_id", "text")), "doc_id"), MSG_CHUNK, MSG_OVERLAP
    )
    out = messages.text_messages(chunks)
    return out.withColumn("seq", F.lit(0).cast("long")).withColumn(
        "submitted_ts", F.expr(SUBMITTED["spark"].format(k="cast(substring(job_id, 5) as bigint)"))
    )


def all_messages(t: Tables) -> DataFrame:
    """Texts, reports of both services, repeats and gaps.

    Every fourth job's reports come twice; the first of the two has no findings.
    Every ninth job lacks the text of its last chunk.
    """
    k = F.expr("cast(substring(job_id, 5) as bigint)")
    tasks = task_messages(t)
    texts = tasks.filter((k % 9 != 0) | (F.col("chunk_idx") < F.col("total_chunks") - 1))
    reports = stream_detect.stream_detect_regex(tasks).withColumn("seq", F.lit(1).cast("long"))
    stale = reports.filter(k % 4 == 0).withColumns({
        "pii_matches": F.filter("pii_matches", lambda f: F.lit(False)), "seq": F.lit(0).cast("long")
    })
    wants_ml = routing.asks_for(F.split("methods", ","), catalog.ML_METHODS)
    ml = tasks.filter(wants_ml).withColumns({
        "service": F.lit("ml"), "action": F.lit("results"), "text": F.lit(None).cast("string"),
    })
    out = texts
    for part in (reports, stale, ml):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@query
def message_stream(t):
    base = workspace(t.spark, "messages")
    results.write_results(task_messages(t).repartition(4, "job_id"), f"{base}/in", "json")
    stream = messages.read_message_stream(t.spark, f"{base}/in", max_files=2)
    columns = ["job_id", "service", "action", "chunk_idx", "total_chunks", "text", "methods", "countries"]
    results.write_result_stream(stream.select(columns), f"{base}/out", f"{base}/check", once=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


@query
def write_results(t):
    path = workspace(t.spark, "verdicts")
    found = detect_documents(t.corpus(), CHUNK, OVERLAP, None).drop("text", "chunk_idx")
    results.write_results(found, path)
    return t.spark.read.parquet(path).select(
        "doc_id", "pii_detected", F.size("pii_matches").cast("long").alias("n_findings")
    )


@query
def entity_spans(t):
    path = workspace(t.spark, "spans")
    results.write_results(t.spans("presidio"), path)
    return documents.read_entity_spans(t.spark, path)


@query
def llm_responses(t):
    path = workspace(t.spark, "responses")
    results.write_results(t.responses(), path, "json")
    return documents.read_model_responses(t.spark, path, "json")


@query
def model_weights(t):
    path = workspace(t.spark, "weights")
    weights.save_weights(t.spark, rule_weights(), path)
    loaded = weights.load_weights(t.spark, path)
    scored = classify.class_probabilities(classify.mlp_forward(classify.with_features(t.vectors()), loaded))
    return scored.select(F.col("doc_id").alias("vec_id"), "predicted_class", r6("pii_probability"))


@query
def pattern_catalog(t):
    found = flat(detection.detect_regex(t.corpus())).unionByName(flat(detection.detect_argentina(t.ar())))
    counts = found.groupBy("type").agg(F.count("*").alias("docs"))
    listed = catalogue.pattern_catalog(t.spark)
    return listed.join(counts, listed["name"] == counts["type"], "left").select(
        "ord", "name", "origin", "description", "country", "confidence", "example", "has_context",
        F.coalesce("docs", F.lit(0).cast("long")).alias("docs"),
    )


# --- chunking ----------------------------------------------------------------
@query
def chunk_documents(t):
    return chunking.chunk_documents(t.documents(), CHUNK, OVERLAP)


@query
def single_chunk_rule(t):
    out = chunking.with_chunks(chunking.single_chunk(t.documents(), CHUNK), CHUNK, OVERLAP)
    return out.select("doc_id", "is_single", F.size("chunks").cast("long").alias("total_chunks"))


@query
def natural_break_(t):
    at = t.documents().withColumn("position", F.explode(F.expr(f"sequence(0, length(text), {CHUNK})")))
    return at.select("doc_id", "position", natural_break(F.col("text"), F.col("position"), WINDOW).alias("break_at"))


@query
def chunk_at_breaks(t):
    return chunking.chunk_at_breaks(t.documents(), CHUNK, WINDOW).select("doc_id", "chunk_idx", "text")


@query
def reassemble_chunks(t):
    return chunking.reassemble_chunks(chunking.chunk_documents(t.documents(), CHUNK, OVERLAP), CHUNK, OVERLAP)


# --- pattern detection -------------------------------------------------------
def _hits(df: DataFrame, hits) -> DataFrame:
    return df.select("doc_id", F.posexplode(hits).alias("pos", "hit"))


def _general(spec):
    QUERIES[f"pii_{spec.name}"] = lambda spark, sf: _hits(Tables(spark, sf).corpus(), fp.find_spec(F.col("text"), spec))


def _country(spec):
    name = spec.name.replace("argentina_", "ar_")
    QUERIES[name] = lambda spark, sf: _hits(Tables(spark, sf).ar(), fp.gated_hits(F.col("text"), spec))


for _spec in catalog.general_specs():
    _general(_spec)
for _spec in catalog.argentina_specs():
    _country(_spec)


@query
def context_gate(t):
    spec = catalog.argentina_specs()[-1]
    return t.ar().select(
        "doc_id",
        F.size(fp.find_spec(F.col("text"), spec)).alias("hits"),
        F.size(fp.gated_hits(F.col("text"), spec)).alias("gated_hits"),
    )


def _with_country(df: DataFrame) -> DataFrame:
    f = df.select("doc_id", F.explode("findings").alias("f"))
    return f.select(
        "doc_id", "f.type", joined(F.col("f.matches"), "matches"), F.col("f.detection_method").alias("method"),
        "f.confidence", "f.country", "f.description",
    )


@query
def detect_argentina(t):
    return _with_country(detection.detect_argentina(t.ar()))


@query
def match_pii(t):
    text = F.col("text")
    return t.corpus().select(
        "doc_id", joined(fp.match_pii(text, "email"), "emails"), F.size(fp.match_pii(text, "shoe_size")).alias("unknown")
    )


@query
def validate_pii(t):
    return t.fields().select(
        "doc_id",
        fp.validate_pii(F.col("ssn"), "social_security").alias("ssn_ok"),
        fp.validate_pii(F.concat("ssn", F.lit("0")), "social_security").alias("longer_ok"),
        fp.validate_pii(F.col("mail"), "email").alias("mail_ok"),
        fp.validate_pii(F.col("street"), "email").alias("street_ok"),
        fp.validate_pii(F.col("mail"), "shoe_size").alias("unknown_ok"),
    )


@query
def detect_regex(t):
    return flat(detection.detect_regex(t.corpus(), ["US"]))


@query
def detect_regex_scored(t):
    return flat(detection.detect_regex_scored(t.ar()))


@query
def detect_international(t):
    asked = job_requests(t.jobs()).select("doc_id", "countries").join(_merged(t.ar()), "doc_id")
    return _with_country(detection.detect_international(asked, F.col("countries")))


# --- model-backed detection --------------------------------------------------
def _placed(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "type", joined("matches"), F.col("detection_method").alias("method"), "confidence",
        F.col("location.start").alias("span_start"), F.col("location.end").alias("span_end"),
    )


@query
def detect_presidio(t):
    return _placed(spans.detect_presidio(t.us(), t.spans("presidio")))


@query
def detect_ner(t):
    return _placed(spans.detect_ner(t.us(), t.spans("ner")))


@query
def detect_gliner(t):
    return _placed(spans.detect_gliner(t.us(), t.spans("ner")))


@query
def llm_prompts(t):
    return responses.build_prompts(t.documents()).select("doc_id", "prompt")


@query
def llm_parse(t):
    return rows(responses.parse_responses(t.us(), t.responses()))


@query
def custom_pii_type(t):
    listed = F.array(*[F.lit(x) for x in catalog.PROMPT_TYPES])
    new = F.expr("case when doc_id % 2 = 0 then 'email' else concat('code_', doc_id) end")
    out = responses.with_custom_type(t.us().withColumn("types", listed), "types", new)
    return out.select("doc_id", joined("types"))


@query
def mean_pool(t):
    tokens = t.read("embeddings").select(
        F.col("label").alias("doc_id"), F.expr("case when vec_id % 3 = 0 then 0 else 1 end").alias("mask"), F.col("embedding").alias("vec")
    )
    pooled = classify.mean_pool(tokens, 64)
    return pooled.select("doc_id", F.posexplode("embedding").alias("dim", "v")).select("doc_id", "dim", r6("v"))


@query
def feature_slice(t):
    out = classify.with_features(t.vectors())
    return out.select("doc_id", F.posexplode("features").alias("dim", "v")).select("doc_id", "dim", r6("v"))


def _logits(t):
    return classify.mlp_forward(classify.with_features(t.vectors()), rule_weights())


@query
def mlp_forward(t):
    return _logits(t).select("doc_id", F.posexplode("logits").alias("cls", "v")).select("doc_id", "cls", r6("v"))


@query
def class_probabilities(t):
    out = classify.class_probabilities(_logits(t))
    return out.select("doc_id", r6("pii_probability"), "predicted_class")


@query
def uncertainty(t):
    out = classify.with_uncertainty(classify.class_probabilities(_logits(t)))
    return out.select("doc_id", r6("shannon_entropy"), r6("uncertainty_principle"), r6("probabilistic_variance"))


@query
def classify_documents(t):
    docs = t.read("documents").select("doc_id").join(t.vectors(), "doc_id", "left")
    q = classify.classify_documents(docs, rule_weights())
    return q.select(
        "doc_id", r6("quantum_analysis.pii_probability", "pii_probability"),
        F.col("quantum_analysis.predicted_class").alias("predicted_class"),
        r6("quantum_analysis.uncertainty.shannon_entropy", "shannon_entropy"),
    )


# --- routing -----------------------------------------------------------------
@query
def route_regex(t):
    return routing.route_regex(job_requests(t.jobs())).select("job_id")


@query
def route_ml(t):
    return routing.route_ml(job_requests(t.jobs())).select("job_id")


@query
def method_gates(t):
    out = routing.with_methods_run(job_requests(t.jobs()))
    ner = routing.only_method(out, "ner").select("job_id", F.lit(True).alias("runs_ner"))
    return out.join(ner, "job_id", "left").select(
        "job_id", joined("methods_run"), F.coalesce("runs_ner", F.lit(False)).alias("runs_ner")
    )


@query
def config_merge(t):
    user = t.jobs().select(
        "job_id",
        F.split("methods", ",").alias("detection_methods"),
        F.split("countries", ",").alias("supported_countries"),
        F.expr("case when doc_id % 3 = 0 then 0.8D end").alias("confidence_threshold"),
    )
    return routing.merge_config(user).select(
        "job_id", joined("detection_methods"), joined("supported_countries"), joined("supported_languages"),
        "device", "confidence_threshold",
    )


# --- joins -------------------------------------------------------------------
@query
def docs_x_patterns(t):
    nations = t.read("nation").select(
        F.lower("n_name").alias("name"), F.concat(F.lit(r"(?i)\b"), F.lower("n_name"), F.lit(r"\b")).alias("pattern")
    )
    words = t.read("region").select(
        F.concat(F.lit("size_"), F.col("r_regionkey").cast("string")).alias("name"),
        F.concat(F.lit(r"\b\d{"), (F.col("r_regionkey") + 1).cast("string"), F.lit(r"}\b")).alias("pattern"),
    )
    return flat(detection.docs_x_patterns(t.corpus(), nations.unionByName(words))).select("doc_id", "type", "matches")


@query
def docs_spans(t):
    return spans.span_texts(t.us(), t.spans("ner")).select("doc_id", "ord", "label", "value")


@query
def docs_llm(t):
    return responses.parse_responses(t.us(), t.responses()).select("doc_id", "ord", "type", joined("matches"))


# --- merging -----------------------------------------------------------------
def regex_rows(t):
    return detection.finding_rows(detection.detect_regex(chunking.chunk_documents(t.us().drop("chunk_idx"), MSG_CHUNK, MSG_OVERLAP)))


def all_findings(t):
    us = t.us()
    return combine.union_methods(
        regex_rows(t),
        responses.parse_responses(us, t.responses()),
        spans.detect_presidio(us, t.spans("presidio")),
        spans.detect_ner(us, t.spans("ner")),
        spans.detect_gliner(us, t.spans("ner")),
    )


def classified(t):
    return classify.classify_documents(t.vectors(), rule_weights()).select("doc_id", "quantum_analysis")


@query
def union_methods(t):
    return rows(all_findings(t))


@query
def dedup_findings(t):
    return rows(combine.dedup_findings(all_findings(t)))


@query
def dedup_findings_ci(t):
    mixed = all_findings(t).withColumn(
        "matches", F.when(F.col("detection_method") == "presidio", F.transform("matches", lambda m: F.upper(m))).otherwise(F.col("matches"))
    ).withColumn("type", F.when(F.col("type") == "email_address", "EMAIL").otherwise(F.col("type")))
    return rows(combine.dedup_findings_ci(mixed))


@query
def confidence_filter(t):
    return rows(routing.confidence_filter(all_findings(t), 0.7))


@query
def method_counts(t):
    return combine.method_counts(combine.dedup_findings(all_findings(t)))


@query
def method_avg_confidence(t):
    return combine.method_avg_confidence(combine.dedup_findings(all_findings(t))).select("doc_id", "method", r6("avg_confidence"))


@query
def method_share(t):
    return combine.method_share(combine.dedup_findings(all_findings(t))).select("doc_id", "method", r6("share"))


@query
def quantum_injection(t):
    shares = combine.method_share(combine.dedup_findings(all_findings(t)))
    return combine.with_quantum(shares, classified(t)).select("doc_id", "method", r6("share"))


@query
def final_scores(t):
    unique = combine.dedup_findings(all_findings(t))
    return combine.final_scores(unique, classified(t)).select("doc_id", "method", r6("score"))


@query
def share_scores(t):
    return combine.share_scores(combine.dedup_findings_ci(all_findings(t))).select("doc_id", "method", r6("score"))


@query
def combine_results(t):
    us = t.us()
    out = combine.combine_results(us.select("doc_id"), all_findings(t), classified=classified(t))
    scores = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("confidence_scores")),
            lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])),
        ),
        "|",
    )
    return out.select(
        "doc_id", "pii_detected", F.size("pii_matches").cast("long").alias("n_findings"),
        joined(F.transform("pii_matches", lambda f: f["type"]), "types"), scores.alias("scores"),
        r6("quantum_analysis.pii_probability", "pii_probability"),
    )


@query
def text_with_results(t):
    docs = t.documents()
    unique = combine.dedup_findings(detection.finding_rows(detection.detect_regex(docs)))
    out = combine.verdicts(docs, unique)
    return out.select("doc_id", "text", "pii_detected", joined(F.transform("pii_matches", lambda f: f["type"]), "types"))


@query
def pii_detected(t):
    docs = t.documents()
    found = detection.detect_regex(docs).select("doc_id", (F.size("findings") > 0).alias("pii_detected"))
    return t.read("labels").join(found, "doc_id").select("doc_id", "quality", "toxic", "pii_detected")


@query
def first_chunk_quantum(t):
    chunks = t.read("embeddings").select(
        F.expr("vec_id div 3").alias("doc_id"), F.expr("cast(vec_id % 3 as int)").alias("chunk_idx"), "embedding"
    )
    first = combine.first_chunk_quantum(chunks)
    q = classify.classify_documents(first, rule_weights())
    return q.select("doc_id", r6("quantum_analysis.pii_probability", "pii_probability"))


@query
def type_counts(t):
    return combine.type_counts(combine.dedup_findings(all_findings(t)))


@query
def job_progress(t):
    status = t.read("events").select(
        F.col("user_id").alias("job_id"), F.expr("event_id % 16").alias("chunk_idx"), F.lit(16).alias("total_chunks"),
        (F.col("value") > 99).alias("failed"), "ts",
    )
    return jobs.job_progress(status).select(
        "job_id", "processed_chunks", "total_chunks", "progress", "status", F.round("duration", 3).alias("duration")
    )


# --- transformation ----------------------------------------------------------
def _verdicts(t):
    return detect_documents(t.corpus(), CHUNK, OVERLAP, None)


@query
def consistent_token_(t):
    f = flat(detection.detect_regex(t.corpus()))
    each = f.select("doc_id", "type", F.explode(F.split("matches", r"\|")).alias("value"))
    return each.select("doc_id", "type", "value", consistent_token(SALT, F.col("type"), F.col("value")).alias("token"))


@query
def pseudonymize(t):
    return transform.pseudonymize(_verdicts(t), SALT).select("doc_id", "transformed_text")


@query
def anonymize(t):
    return transform.anonymize(_verdicts(t)).select("doc_id", "transformed_text")


@query
def tokenize(t):
    return transform.tokenize(_verdicts(t), NONCE).select("doc_id", "transformed_text")


@query
def mask(t):
    return transform.mask(_verdicts(t)).select("doc_id", "transformed_text")


@query
def transform_data(t):
    asked = detection.detect_regex(_merged(t.us()).join(t.jobs().select("doc_id", "transform_method"), "doc_id"))
    out = transform.transform_data(
        asked.withColumnRenamed("findings", "pii_matches"), SALT, F.col("transform_method"), NONCE
    )
    return out.select("doc_id", "transform_method", "transformed_text")


@query
def transform_report(t):
    out = transform.transform_report(transform.mask(_verdicts(t)), "mask")
    r = out.select("doc_id", "transformation_report.*")
    counts = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("pii_types_identified")),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        ),
        "|",
    )
    return r.select(
        "doc_id", "transformation_method", "total_pii_instances", counts.alias("pii_types"),
        r6("transformation_impact"), "preserved_context",
    )


# --- streaming and job state -------------------------------------------------
@query
def stream_detect_regex(t):
    base = workspace(t.spark, "tasks")
    results.write_results(task_messages(t).repartition(4, "job_id"), f"{base}/in", "json")
    found = stream_detect.stream_detect_regex(messages.read_message_stream(t.spark, f"{base}/in", max_files=2))
    results.write_result_stream(found, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    f = t.spark.read.parquet(f"{base}/out").select("job_id", "chunk_idx", F.explode("pii_matches").alias("f"))
    general = f.filter(F.col("f.detection_method") == "regex")
    return general.select("job_id", "chunk_idx", "f.type", joined(F.col("f.matches"), "matches"))


@query
def stream_message_log(t):
    """The tasks through the log: a stream writes them, another reads them."""
    base = workspace(t.spark, "log")
    message_log.register_message_log(t.spark)
    results.write_results(task_messages(t).repartition(4, "job_id"), f"{base}/in", "json")
    tasks = messages.as_messages(messages.read_message_stream(t.spark, f"{base}/in", max_files=2))
    into = tasks.writeStream.format("message_log").option("path", f"{base}/log").option("checkpointLocation", f"{base}/in-check")
    into.trigger(availableNow=True).start().awaitTermination()
    logged = t.spark.readStream.format("message_log").option("path", f"{base}/log").load()
    results.write_result_stream(logged, f"{base}/out", f"{base}/out-check", once=True).awaitTermination()
    columns = ["job_id", "service", "action", "chunk_idx", "total_chunks", "text", "methods", "countries"]
    return t.spark.read.parquet(f"{base}/out").select(*columns)


@query
def stream_detect_ml(t):
    base = workspace(t.spark, "tasks")
    vectors = t.vectors().withColumn("job_id", F.concat(F.lit("job-"), F.col("doc_id").cast("string"))).drop("doc_id")
    tasks = task_messages(t).join(vectors, "job_id", "left")
    results.write_results(tasks.repartition(4, "job_id"), f"{base}/in")
    stream = messages.read_message_stream(t.spark, f"{base}/in", "parquet", tasks.schema, 2)
    found = stream_detect.stream_detect_ml(stream, rule_weights())
    results.write_result_stream(found, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").filter(F.col("quantum").isNotNull()).select(
        "job_id", "chunk_idx", r6("quantum.pii_probability", "pii_probability"),
        F.col("quantum.predicted_class").alias("predicted_class"),
    )


#: A batch of the streams by arrival: many small files, as a store by hour and bucket has them.
BATCH_BYTES = 128 << 20


def _store(t, base: str) -> str:
    stored = messages.with_job_bucket(messages.as_messages(all_messages(t)), 8)
    stored.repartition("job_bucket", "job_id").write.partitionBy("job_bucket").parquet(f"{base}/store")
    return f"{base}/store"


def _arrived(t, base: str) -> DataFrame:
    """The messages as a stream of a table by arrival, which is written first."""
    placed = messages.with_job_bucket(messages.with_arrival(messages.as_messages(all_messages(t)), F.col("submitted_ts")), 8)
    placed.repartition("arrival", "job_bucket").write.partitionBy("arrival", "job_bucket").parquet(f"{base}/store")
    return messages.read_message_stream(t.spark, f"{base}/store", "parquet", messages.STORED_BY_ARRIVAL, max_bytes=BATCH_BYTES)


def _complete(t, salt=None) -> str:
    base = workspace(t.spark, "jobs")
    events = stream_state.track_jobs(_arrived(t, base), None)
    stream_jobs.stream_complete_jobs(
        t.spark, events, f"{base}/store", f"{base}/out", f"{base}/check",
        chunk_size=MSG_CHUNK, overlap=MSG_OVERLAP, salt=salt, nonce=NONCE, once=True, buckets=8,
    ).awaitTermination()
    return f"{base}/out"


@query
def stream_track_jobs(t):
    base = workspace(t.spark, "track")
    events = stream_state.track_jobs(_arrived(t, base), None)
    stream_state.write_updates(events, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("job_id", "status", "reports", "expected")


@query
def stream_job_progress(t):
    base = workspace(t.spark, "progress")
    status = t.read("events").select(
        F.col("user_id").alias("job_id"), F.expr("event_id % 16").alias("chunk_idx"), F.lit(16).alias("total_chunks"),
        (F.col("value") > 99).alias("failed"), "ts",
    )
    status.repartition(4, "chunk_idx").write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(status.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    stream_state.write_updates(
        stream_state.stream_job_progress(stream, None), f"{base}/out", f"{base}/check", once=True
    ).awaitTermination()
    rest = ["processed_chunks", "total_chunks", "progress", "status", "duration"]
    last = t.spark.read.parquet(f"{base}/out").groupBy("job_id").agg(F.max_by(F.struct(*rest), "batch").alias("l"))
    return last.select("job_id", *[f"l.{c}" for c in rest[:-1]], F.round("l.duration", 3).alias("duration"))


@query
def stream_complete_jobs(t):
    scores = t.spark.read.parquet(f"{_complete(t)}/scores").drop("batch")
    return scores.select("job_id", "method", r6("score"))


@query
def stream_transform(t):
    texts = t.spark.read.parquet(f"{_complete(t, SALT)}/texts").drop("batch")
    return texts.select(
        "job_id", "transform_method", "transformed_text",
        F.col("transformation_report.total_pii_instances").alias("instances"),
    )


@query
def stream_expire_jobs(t):
    base = workspace(t.spark, "expire")
    store = _store(t, base)
    stream = messages.read_message_stream(t.spark, store, "parquet", messages.STORED)
    late = stream_jobs.stream_expire_jobs(stream, "1 minute")
    with stream_state.rocksdb(t.spark):  # the state of all jobs is on disk
        query = results.write_result_stream(late, f"{base}/out", f"{base}/check", once=True)
    query.awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("job_id", "reports", "expected", "status")


@query
def job_complete(t):
    return jobs.job_complete(all_messages(t))


@query
def latest_chunk_result(t):
    out = jobs.latest_chunk_result(all_messages(t))
    return out.filter(F.col("service") == "regex").select(
        "job_id", "chunk_idx", "seq",
        F.size(F.filter("pii_matches", lambda f: f["detection_method"] == "regex")).cast("long").alias("n_findings"),
    )


# --- end to end --------------------------------------------------------------
@query
def detect_documents_(t):
    out = _verdicts(t)
    return out.select("doc_id", "pii_detected", F.size("pii_matches").cast("long").alias("n_findings"), F.explode_outer("confidence_scores").alias("method", "score")).select(
        "doc_id", "pii_detected", "n_findings", "method", r6("score")
    )


@query
def detect_document_findings(t):
    return flat(_verdicts(t), "pii_matches").drop("confidence")


@query
def detect_jobs_(t):
    vectors = t.vectors()
    asked = job_requests(t.jobs()).select("doc_id", "methods", "countries").join(_merged(t.us().drop("chunk_idx")), "doc_id")
    out = detect_jobs(
        asked.join(vectors, "doc_id", "left"), t.spans("presidio"), t.spans("ner"), t.responses(), rule_weights(), CHUNK, OVERLAP
    )
    return out.select(
        "doc_id", F.size("pii_matches").cast("long").alias("n_findings"), F.explode_outer("confidence_scores").alias("method", "score")
    ).select("doc_id", "n_findings", "method", r6("score"))


@query
def detect_long_documents_(t):
    out = detect_long_documents(t.corpus(), CHUNK, OVERLAP, None)
    return out.select("doc_id", "pii_detected", F.size("pii_matches").cast("long").alias("n_findings"))


@query
def transform_documents_(t):
    out = transform_documents(t.corpus(), SALT, "pseudonymize", chunk_size=CHUNK, overlap=OVERLAP, countries=None)
    return out.select(
        "doc_id", "transformed_text",
        F.col("transformation_report.total_pii_instances").alias("instances"),
        r6("transformation_report.transformation_impact", "impact"),
    )


@query
def transform_long_documents_(t):
    out = transform_long_documents(t.corpus(), SALT, "pseudonymize", chunk_size=CHUNK, overlap=OVERLAP, countries=None)
    return out.select(
        "doc_id", "transformed_text",
        F.col("transformation_report.total_pii_instances").alias("instances"),
        r6("transformation_report.transformation_impact", "impact"),
    )


@query
def detect_service(t):
    service = DetectionService({"detection_methods": ["regex"], "supported_countries": ["US"]})
    out = service.detect_pii(t.corpus(), ["regex"])
    return flat(out, "pii_matches")


@query
def detect_service_models(t):
    service = DetectionService(
        {"supported_countries": ["US"], "detection_methods": ["regex", "presidio", "ner", "llm_semantic"]},
        t.spans("presidio"), t.spans("ner"), t.responses(),
    )
    out = service.detect_pii(t.us().drop("chunk_idx"))
    return out.select("doc_id", F.size("pii_matches").cast("long").alias("n_findings"), F.explode("confidence_scores").alias("method", "score")).select(
        "doc_id", "n_findings", "method", r6("score")
    )


@query
def custom_recognizer(t):
    find = re.compile(r"u\d+@example\.com").finditer

    def predict(text, entities):
        return [{"label": "PERSON", "start": m.start(), "end": m.end(), "score": 0.5} for m in find(text)]

    found = spans.custom_recognizer(t.corpus(), predict)
    return found.select("doc_id", "ord", "label", "span_start", "span_end", "score")


def _mail_tagger():
    find = re.compile(r"u\d+@example\.com").finditer
    return lambda text, entities: ({"label": "PERSON", "start": m.start(), "end": m.end(), "score": 0.5} for m in find(text))


@query
def recognizer_function(t):
    found = spans.recognize(t.corpus(), spans.recognizer_function(_mail_tagger))
    return found.select("doc_id", "ord", "label", "span_start", "span_end", "score")


@query
def mean_pool_wide(t):
    """Vectors of 384 numbers: six of the given ones, each shifted."""
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.transform("embedding", lambda x: x.cast("double") + i)))
    tokens = t.read("embeddings").select(
        F.expr("vec_id % 97").alias("doc_id"), F.expr("case when vec_id % 3 = 0 then 0 else 1 end").alias("mask"), wide.alias("vec")
    )
    pooled = classify.mean_pool(tokens, 384)
    return pooled.select("doc_id", F.posexplode("embedding").alias("dim", "v")).select("doc_id", "dim", r6("v"))


@query
def custom_patterns(t):
    extra = {"tax_id": r"EIN \d{2}-\d{7}", "policy": r"policy \d{3}"}
    merged = catalog.merge_specs(catalog.general_specs(), extra)
    f = detection.detect_regex(t.corpus(), None, merged)
    return flat(f).select("doc_id", "type", "matches")

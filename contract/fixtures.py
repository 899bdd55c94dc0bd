"""Inputs of the registered queries, all derived from the given tables.

Each is one SQL text that both engines understand; only the name of the
formatting function differs (`format_string` / `printf`).  `Tables` reads them
in Spark, `ctes` gives them to DuckDB.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.documents import read_documents
from veilframe.sources.weights import Weights, layer_sizes

K = "c_custkey"
CUSTOMERS_PER_TASK = 10_000

# --- texts with hits for all general patterns, one per customer -------------
PARTS = {
    "ssn": f"FMT('%03d-%02d-%04d', {K}%900+100, {K}%90+10, {K}%9000+1000)",
    "tel": f"FMT('%03d-555-%04d', {K}%800+200, {K}%10000)",
    "card": f"FMT('4111 1111 %04d %04d', {K}%10000, ({K}*7)%10000)",
    "acct": f"FMT('%012d', {K}*7919)",
    "ein": f"FMT('%02d-%07d', {K}%90+10, {K}*31%10000000)",
    "emp": f"concat('AB', FMT('%06d', {K}))",
    "street": f"concat(FMT('%d', {K}), ' Elm Street')",
    "mail": f"concat('u', FMT('%d', {K}), '@example.com')",
    "policy": f"FMT('%03d %02d %04d', {K}%800+100, {K}%90+10, {K}%9000+1000)",
}
TEXT = (
    "concat('SSN ', {ssn}, ', tel ', {tel}, ', card ', {card}, ', acct ', {acct}, ', EIN ', {ein}, ', id ', {emp}, "
    "', ', {street}, ', mail ', {mail}, ', policy ', {policy}, '.')"
).format(**PARTS)

# --- texts with Argentine numbers, with and without their context words -----
_SEP = f"case {K}%3 when 0 then '' when 1 then '-' else '.' end"
AR_PARTS = {
    "dni": (
        f"case when {K}%7=0 then '11111111' else concat(FMT('%02d', {K}%80+10), {_SEP}, "
        f"FMT('%03d', {K}%1000), {_SEP}, FMT('%03d', {K}*3%1000)) end"
    ),
    "cuil": (
        f"concat(case {K}%4 when 0 then '20-' when 1 then '23-' when 2 then '23-' else '27' end, "
        f"FMT('%08d', {K}*13%80000000+20000000), case {K}%4 when 0 then '-5' when 1 then '-9' when 2 then '-5' else '1' end)"
    ),
    "passport": (
        f"concat('AA', chr(cast(65+{K}%26 as int)), case when {K}%6=0 then '123456' "
        f"else FMT('%06d', ({K}*17+200001)%700000+200001) end)"
    ),
}
AR_TEXT = (
    f"concat(case {K}%5 when 0 then 'Ref' when 1 then 'DNI' when 2 then 'pasaporte argentino' else 'DNI, passport' end, "
    "' ', {dni}, ' ; ', {cuil}, ' ; ', {passport}, ' end')"
).format(**AR_PARTS)

US_SQL = f"select {K} as doc_id, 0 as chunk_idx, {TEXT} as text from customer"
AR_SQL = f"select {K} as doc_id, 0 as chunk_idx, {AR_TEXT} as text from customer"
CORPUS_SQL = f"select doc_id, 0 as chunk_idx, text from documents union all select -1 - {K} as doc_id, 0 as chunk_idx, {TEXT} as text from customer"
FIELDS_SQL = f"select {K} as doc_id, {', '.join(f'{sql} as {name}' for name, sql in PARTS.items())}, {TEXT} as text from customer"

# --- what external taggers would have written -------------------------------
TAGGED = {
    "presidio": [
        ("US_SSN", "ssn", 0.95), ("EMAIL_ADDRESS", "mail", 1.0), ("URL", "'example.com'", 0.5),
        ("PHONE_NUMBER", "tel", 0.75), ("US_BANK_ACCOUNT", "acct", 0.4), ("LOCATION", "street", 0.85),
    ],
    "ner": [
        ("CARDINAL", "emp", 1.0), ("ORG", "'Elm Street'", 1.0), ("FAC", "'Elm Street'", 1.0),
        ("GPE", "'Elm'", 1.0), ("PERSON", "mail", 1.0),
    ],
}


def spans_sql(tagger: str) -> str:
    rows = [
        f"select doc_id, 0 as chunk_idx, {i} as ord, '{label}' as label, cast(instr(text, {value}) - 1 as int) as span_start, "
        f"cast(instr(text, {value}) - 1 + length({value}) as int) as span_end, cast({score} as double) as score from fields"
        for i, (label, value, score) in enumerate(TAGGED[tagger])
    ]
    return " union all ".join(rows)


# --- what a language model would have answered ------------------------------
def _item(type_: str, value: str, shift: int = 0, confidence: str = ', "confidence": 0.9') -> str:
    at = f"(instr(text, {value}) - 1 + {shift})"
    return (
        f"concat('{{\"type\": \"{type_}\", \"value\": \"', {value}, '\"{confidence}, \"start_index\": ', "
        f"cast({at} as string), ', \"end_index\": ', cast({at} + length({value}) as string), '}}')"
    )


_PAIR = f"concat('[', {_item('email', 'mail')}, ', ', {_item('social_security_number', 'ssn')}, ']')"
RESPONSES_SQL = (
    "select doc_id, 0 as chunk_idx, case doc_id % 6 "
    f"when 0 then {_PAIR} "
    f"when 1 then concat('Here you go:', chr(10), '```json', chr(10), {_PAIR}, chr(10), '```') "
    f"when 2 then concat('[', {_item('email', 'mail', 3)}, ']') "
    f"when 3 then concat('[', {_item('email', 'mail', 0, '')}, ', ', {_item('phone_number', 'tel')}, ']') "
    f"when 4 then {_item('email', 'mail')} "
    "else 'I found no personal data.' end as response from fields"
)

# --- job requests and messages ----------------------------------------------
JOBS_SQL = f"""select concat('job-', cast({K} as string)) as job_id, {K} as doc_id,
 case when {K}%2=0 then 'detect' else 'transform' end as endpoint,
 case {K}%6 when 0 then null when 1 then 'regex' when 2 then 'regex,international'
  when 3 then 'llm_semantic,quantum_classification' when 4 then 'presidio,ner,gliner'
  else 'regex,gliner,presidio,llm_semantic,quantum_classification,international' end as methods,
 case {K}%4 when 0 then null when 1 then 'US' when 2 then 'US,AR' else 'ARGENTINA' end as countries,
 case {K}%5 when 0 then null when 1 then 'pseudonymize' when 2 then 'anonymize' when 3 then 'tokenize' else 'mask' end as transform_method
 from customer"""

SUBMITTED = {"spark": "timestamp_seconds(1704067200 + {k})", "duckdb": "make_timestamp((1704067200 + {k}) * 1000000)"}

MSG_CHUNK, MSG_OVERLAP = 100, 20
CHUNK, OVERLAP, WINDOW = 1000, 100, 100
SALT, NONCE = "pepper", "run-1"

# --- classifier weights by rule ---------------------------------------------
DIMS, CLASSES = 100, 10


def rule_weights() -> Weights:
    """Weights that SQL can state too: small fractions from the indices."""
    sizes = layer_sizes(DIMS, CLASSES, 0.5)
    blocks = []
    for n, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        row, col = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
        block = {
            "weight": ((col * 31 + row * 17 + n * 7) % 101 - 50) / 500.0,
            "bias": ((np.arange(n_out) * 13 + n * 5) % 23 - 11) / 100.0,
        }
        if n < 2:
            block["gain"] = 1 + ((np.arange(n_out) * 7 + n) % 11 - 5) / 50.0
            block["shift"] = ((np.arange(n_out) * 3 + n) % 7 - 3) / 50.0
        blocks.append(block)
    return Weights(blocks, 0.5)


class Tables:
    """The derived inputs as Spark tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str, *columns: str) -> DataFrame:
        return read_documents(self.spark, f"{self.sf_dir}/{name}.parquet", columns=list(columns))

    def customers(self) -> DataFrame:
        """The keys, few bytes each, of which every row becomes texts, messages and findings."""
        return read_documents(self.spark, f"{self.sf_dir}/customer.parquet", columns=["c_custkey"], rows_per_task=CUSTOMERS_PER_TASK)

    def _sql(self, sql: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(
            _braced(sql.replace("FMT(", "format_string("), tables), **tables
        )

    def us(self) -> DataFrame:
        return self._sql(US_SQL, customer=self.customers())

    def ar(self) -> DataFrame:
        return self._sql(AR_SQL, customer=self.customers())

    def documents(self) -> DataFrame:
        return self.texts("documents", "doc_id", "text")

    def corpus(self) -> DataFrame:
        return self._sql(CORPUS_SQL, customer=self.customers(), documents=self.texts("documents", "doc_id", "text"))

    def fields(self) -> DataFrame:
        return self._sql(FIELDS_SQL, customer=self.customers())

    def spans(self, tagger: str) -> DataFrame:
        return self._sql(spans_sql(tagger), fields=self.fields())

    def responses(self) -> DataFrame:
        return self._sql(RESPONSES_SQL, fields=self.fields())

    def jobs(self) -> DataFrame:
        return self._sql(JOBS_SQL, customer=self.customers())

    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _braced(sql: str, tables) -> str:
    """`from name` / `join name` as parameters of spark.sql."""
    import re

    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", sql)
    return sql

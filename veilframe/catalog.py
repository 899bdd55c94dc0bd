"""Fixed values of the detectors: patterns, label maps, method names, defaults.

Everything here is data.  Patterns are written for Unicode matching; the
functions that use them add the ``(?U)`` flag of ``java.util.regex``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# --- Fixed values: general patterns, in reporting order ---------------------
GENERAL_PATTERNS: dict[str, str] = {
    "social_security": r"\b\d{3}-\d{2}-\d{4}\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
    "driver_license": r"\b[A-Z]{1,2}\d{4,9}\b",
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+\d{1,2}\s?)?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "address": r"(?i)\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr)\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "bank_account": r"\b\d{9,18}\b",
    "tax_id": r"\b\d{2}-\d{7}\b",
    "employee_id": r"\b[A-Z]{2}\d{4,6}\b",
    "medical_record": r"\b[A-Z]{2,3}\d{6,8}\b",
    "insurance_number": r"\b\d{3}\s?\d{2}\s?\d{4}\b",
}

# --- Fixed values: context words that Argentine numbers must appear with ----
DNI_CONTEXT = r"(?i)(?:Argentin(?:[ae]|ian)[\s_]{0,3}(?:National[\s_]{0,3}Id(?:entity)?(?:[\s_]{0,3}(?:[#№]|n(?:[°º˚]|umbers?|o(?:\b|_))))?|DNI)|d(?:\.n\.i|ni(?:\b|_)|ocumento[\s_]{0,3}nacional[\s_]{0,3}de[\s_]{0,3}identidad))(?:[\s_]{0,3}argentin[ao])?"
PASSPORT_CONTEXT = r"\b(?i)(?:pas(?:aporte[\-‐‑‒–—―–\s ]{0,3}(?:arg(?:entino)?|de[\-‐‑‒–—―–\s ]{0,3}la[\-‐‑‒–—―–\s ]{0,3}rep[úuÚ]blica[\-‐‑‒–—―–\s ]{0,3}argentina)|sport(?:[\s_]{0,3}n(?:[°º˚]|umbers?|o(?:\b|_)))?)|argentin(?:a|ian)[\s_]{0,3}(?:passport|travel[\s_]{0,3}document)(?:[\s_]{0,3}n(?:[°º˚]|umbers?|o(?:\b|_)))?|travel[\s_]{0,3}document(?:[\s_]{0,3}n(?:[°º˚]|umbers?|o(?:\b|_)))?)"

# --- Fixed values: Argentine patterns, in reporting order -------------------
ARGENTINA_PATTERNS: dict[str, dict] = {
    "argentina_dni": {
        "pattern": r"(?<![-−―–——@&*$!?%]|\d\.)\b[1-9]\d([-−―–——.·]?)\d{3}\1\d{3}\b(?![-−―–——@&*$!?%]|[\-.]\d)",
        "context": DNI_CONTEXT,
        "description": "Argentinian DNI Number (National ID)",
        "countries": ["AR"],
        "confidence": 0.8,
        "example": "34960099",
    },
    "argentina_dni_dot": {
        "pattern": r"(?<![-−―–——@&*$!?%]|\d\.)\b[1-9]\d\.\d{3}\.\d{3}\b(?![−―–——@&*$%-]|\.\d)",
        "context": DNI_CONTEXT,
        "description": "Argentinian DNI Number with dot separators",
        "countries": ["AR"],
        "confidence": 0.85,
        "example": "22.105.779",
    },
    "argentina_drivers_license": {
        "pattern": r"(?<![-−―–——@&*$!?%]|\d\.)(?!(\d)\1[-−―–——.·]?\1{3}[-−―–——.·]?\1{3}|1(?:0[-−―–——.·]?101[-−―–——.·]?010|2[-−―–——.·]?345[-−―–——.·]?678))\b[1-9]\d([-−―–——.·]?)\d{3}\2\d{3}\b(?![-−―–——@&*$!?%]|[\-.]\d)",
        "context": PASSPORT_CONTEXT,
        "description": "Argentinian Driver's License Number",
        "countries": ["AR"],
        "confidence": 0.75,
        "example": "25-042-095",
    },
    "argentina_cuil": {
        "pattern": r"(?<![\-‐‑‒–—―\.\$@])\b2(?:[047]([\-‐‑‒–—―]?)\d{8}\1\d|3([\-‐‑‒–—―]?)\d{8}\2[349])\b(?![\-‐‑‒–—―\$@]|\.\d)",
        "context": None,
        "description": "Argentinian Employment Identification Number (CUIL)",
        "countries": ["AR"],
        "confidence": 0.85,
        "example": "20-22375732-5",
    },
    "argentina_passport": {
        "pattern": r"(?<![-‐‑‒–—―%*$@])\b(?:(?:A{2}[A-Z]|Z{3})(?!(\d)\1{5}|1(?:23456|01010)|010101)\d{6}|(?!(\d)\2{7}|1(?:2345678|0101010))[1-9]\d{7}N)\b(?![-‐‑‒–—―%@$%*]|\.\d)",
        "context": PASSPORT_CONTEXT,
        "description": "Argentinian Passport Number",
        "countries": ["AR"],
        "confidence": 0.8,
        "example": "AAA732750",
    },
}

# --- Fixed values: names that switch the Argentine patterns on --------------
ARGENTINA_NAMES = ["AR", "ARG", "ARGENTINA"]

# --- Fixed values: detection methods and their order in a merged result -----
REGEX_METHODS = ["regex", "international"]
ML_METHODS = ["llm_semantic", "quantum_classification", "presidio", "ner", "gliner"]
METHOD_RANK = {"regex": 0, "international_regex": 0, "llm_semantic": 1, "presidio": 2, "ner": 3, "gliner": 4}
SERVICE_RANK = {"regex": 0, "international_regex": 1, "presidio": 2, "ner": 3, "llm_semantic": 4}

# --- Fixed values: request and service defaults -----------------------------
DETECT_METHODS = "regex,gliner,presidio,llm_semantic,quantum_classification,international"
TRANSFORM_METHODS = "regex,international"
FORM_METHODS = "regex"
DEFAULT_COUNTRIES = "US,AR"
DEFAULT_TRANSFORM = "pseudonymize"
CHUNK_SIZE = 100000
OVERLAP = 1000
SERVICE_DEFAULTS = {
    "detection_methods": ["regex", "international", "presidio", "ner", "llm_semantic", "quantum_classification"],
    "supported_languages": ["en"],
    "supported_countries": ["US", "AR"],
    "device": "cpu",
    "confidence_threshold": 0.5,
}
REGEX_CONFIDENCE = 0.8
NER_CONFIDENCE = 0.7
GLINER_CONFIDENCE = 0.75
DEFAULT_CONFIDENCE = 0.5

# --- Fixed values: entity labels --------------------------------------------
PRESIDIO_ENTITIES = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "IBAN_CODE",
    "PASSPORT", "DRIVER_LICENSE", "US_BANK_ACCOUNT", "US_ITIN", "IP_ADDRESS",
]
PRESIDIO_SERVICE_ENTITIES = [
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "IBAN_CODE",
    "PASSPORT", "DRIVER_LICENSE",
]
PRESIDIO_INTERNATIONAL_ENTITIES = ["ID_NUMBER", "DOMAIN_NAME", "LOCATION"]
NER_LABELS = {
    "PERSON": "person_name",
    "ORG": "organization",
    "GPE": "location",
    "LOC": "location",
    "MONEY": "financial",
    "CARDINAL": "number",
    "DATE": "date",
}
GLINER_LABELS = {
    "PERSON": "PERSON",
    "ORG": "ORGANIZATION",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "MONEY": "FINANCIAL_INFO",
    "CARDINAL": "NUMBER",
    "DATE": "DATE",
}
GLINER_ENTITIES = ["PERSON", "ORGANIZATION", "LOCATION", "FINANCIAL_INFO", "NUMBER", "DATE"]

# --- Fixed values: language-model prompt ------------------------------------
PROMPT_TYPES = [
    "person_name", "email", "phone_number", "physical_address", "social_security_number",
    "credit_card_number", "passport_number", "tax_id", "financial_account", "driver_license",
    "ip_address",
]
PROMPT_HEAD = """You are a highly skilled PII (Personally Identifiable Information) detection expert. 
Your task is to carefully analyze the following text and identify any instances of sensitive personal information.

Potential PII types to detect: """
PROMPT_GUIDE = """

Detailed Guidelines:
1. Be extremely thorough in detection
2. Consider contextual nuances
3. Provide a comprehensive analysis
4. Minimize false positives
5. Be precise in identifying exact matches

Input Text:
```
"""
PROMPT_TAIL = """
```

Respond ONLY with a JSON-formatted list of detected PII instances. 
Each instance MUST include these exact keys:
- type: The specific type of PII detected
- value: The exact text of the PII
- confidence: A confidence score between 0.0 and 1.0
- start_index: Starting character index in the original text
- end_index: Ending character index in the original text

JSON RESPONSE ONLY. No additional explanation."""
RESPONSE_KEYS = ["type", "value", "confidence", "start_index", "end_index"]

# --- Fixed values: natural break characters, transformation names -----------
BREAK_CHARS = r".!?\n\r\t"
TRANSFORM_NAMES = ["pseudonymize", "anonymize", "tokenize", "mask"]


# Shapes that the text must have somewhere for a pattern to have a hit.  One
# search per shape settles all patterns of that shape for most texts.
_DIGIT_GROUPS = r"\d{3}\D{0,2}\d{2}"
_LETTER_DIGITS = r"[A-Z]\d{4}"
_SHAPES = {
    "social_security": _DIGIT_GROUPS,
    "passport": _LETTER_DIGITS,
    "driver_license": _LETTER_DIGITS,
    "phone": _DIGIT_GROUPS,
    "credit_card": _DIGIT_GROUPS,
    "bank_account": _DIGIT_GROUPS,
    "tax_id": _DIGIT_GROUPS,
    "employee_id": _LETTER_DIGITS,
    "medical_record": _LETTER_DIGITS,
    "insurance_number": _DIGIT_GROUPS,
    "argentina_dni": _DIGIT_GROUPS,
    "argentina_dni_dot": _DIGIT_GROUPS,
    "argentina_drivers_license": _DIGIT_GROUPS,
    "argentina_cuil": _DIGIT_GROUPS,
    "argentina_passport": _DIGIT_GROUPS,
}

# What the first character of a hit can be.  A lookahead for it costs one
# character test per position and keeps the engine away from the far dearer
# Unicode word-boundary test; it is implied by the pattern, so hits are equal.
_LEADS = {
    "social_security": r"\d",
    "passport": r"[A-Z]",
    "driver_license": r"[A-Z]",
    "phone": r"[\d+(]",
    "credit_card": r"\d",
    "bank_account": r"\d",
    "tax_id": r"\d",
    "employee_id": r"[A-Z]",
    "medical_record": r"[A-Z]",
    "insurance_number": r"\d",
    "argentina_dni": r"[1-9]",
    "argentina_dni_dot": r"[1-9]",
    "argentina_drivers_license": r"[1-9]",
    "argentina_cuil": r"2",
    "argentina_passport": r"[AZ1-9]",
}


@dataclass(frozen=True)
class PatternSpec:
    """One pattern of the catalogue and what is reported with its hits."""

    name: str
    pattern: str
    method: str = "regex"
    confidence: float | None = None
    country: str | None = None
    description: str | None = None
    context: str | None = None
    example: str | None = None
    lead: str | None = None
    # a plain string / a shape that stands in every text with a hit, and
    # whether every hit has a digit
    literal: str | None = None
    shape: str | None = None
    has_digit: bool = False


def general_specs(confidence: float | None = None) -> list[PatternSpec]:
    """The twelve general patterns."""
    return [
        PatternSpec(
            name, pattern, confidence=confidence, lead=_LEADS.get(name),
            literal="@" if name == "email" else None, shape=_SHAPES.get(name), has_digit=name != "email",
        )
        for name, pattern in GENERAL_PATTERNS.items()
    ]


def argentina_specs() -> list[PatternSpec]:
    """The five Argentine patterns with context, confidence and country."""
    return [
        PatternSpec(
            name, info["pattern"], method="international_regex", confidence=info["confidence"],
            country=info["countries"][0], description=info["description"], context=info["context"],
            example=info["example"], lead=_LEADS[name], shape=_SHAPES[name], has_digit=True,
        )
        for name, info in ARGENTINA_PATTERNS.items()
    ]


def ungated_argentina_specs(confidence: float = REGEX_CONFIDENCE) -> list[PatternSpec]:
    """Argentine patterns as plain regex patterns: no context, one confidence."""
    return [
        PatternSpec(s.name, s.pattern, confidence=confidence, lead=s.lead, shape=s.shape, has_digit=True)
        for s in argentina_specs()
    ]


def merge_specs(base: list[PatternSpec], extra: Mapping[str, str] | list[PatternSpec]) -> list[PatternSpec]:
    """Add named patterns; a repeated name replaces the earlier one in place."""
    if isinstance(extra, Mapping):
        extra = [PatternSpec(name, pattern) for name, pattern in extra.items()]
    merged = {spec.name: spec for spec in base}
    merged.update({spec.name: spec for spec in extra})
    return list(merged.values())


def lookup(name: str) -> str | None:
    """The general pattern of that name, or None."""
    return GENERAL_PATTERNS.get(name)

"""Finding and removing personal data in large tables and streams of text."""

from veilframe.plans.detect import detect_documents, detect_jobs, detect_long_documents
from veilframe.plans.service import DetectionService, TransformationService
from veilframe.plans.transform import transform_documents

__all__ = [
    "DetectionService",
    "TransformationService",
    "detect_documents",
    "detect_jobs",
    "detect_long_documents",
    "transform_documents",
]

"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from gleaner.llm import queries_dedup as dedup
from gleaner.llm import queries_models as models
from gleaner.llm import queries_native as native

QUERIES = {
    "op1_html_extraction": models.op1_html_extraction,
    "op2_language_id": models.op2_language_id,
    "op3_minhash": dedup.op3_minhash,
    "op4_mixing": native.op4_mixing,
    "op5_warc": native.op5_warc,
    "op6_decontamination": dedup.op6_decontamination,
    "op7_url_filters": native.op7_url_filters,
    "op8_fingerprints": native.op8_fingerprints,
    "op9_quality": models.op9_quality,
    "op10_suffix_dedup": dedup.op10_suffix_dedup,
}
ORACLE_SQL = {
    "op4_mixing": native.OP4_SQL,
    "op7_url_filters": native.OP7_SQL,
    "op8_fingerprints": native.OP8_SQL,
}

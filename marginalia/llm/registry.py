"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate
from marginalia.llm.bpe import op2_bpe_round_trip
from marginalia.llm.decontaminate import op5_decontamination
from marginalia.llm.language import op6_language_id
from marginalia.llm.licences import op7_licence_scan
from marginalia.llm.pages import op4_html_extraction
from marginalia.llm.personal import op3_personal_data
from marginalia.llm.phrases import op8_document_fingerprints
from marginalia.llm.secrets import op1_secret_scan
from marginalia.llm.simhash import op10_simhash
from marginalia.llm.tokencount import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_personal_data": op3_personal_data,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_licence_scan": op7_licence_scan,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
}

#: The others are models, tokenizers and fingerprints; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_decontamination": decontaminate.ORACLE}

"""Queries of the text operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, licenses, oracles, packing, pii, quality, secrets, simhash, substring_dedup, suffix_array_dedup, url_filter, vector_codes, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_suffix_array_dedup": suffix_array_dedup.op2_suffix_array_dedup,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_pii": pii.op5_pii,
    "op6_quality": quality.op6_quality,
    "op7_licenses": licenses.op7_licenses,
    "op8_secrets": secrets.op8_secrets,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_packing": packing.op10_packing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_simhash": simhash.op12_simhash,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES: dict[str, str] = oracles.ORACLES

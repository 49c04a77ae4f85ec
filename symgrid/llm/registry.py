"""Queries of the training-data operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symgrid.llm.bytecnn import op3_quality_classifier
from symgrid.llm.contain import OP6_SQL, op6_benchmark_decontamination
from symgrid.llm.packing import op9_best_fit_packing
from symgrid.llm.secrets import OP7_SQL, op7_secret_scans
from symgrid.llm.simhash import op2_simhash_near_dedup
from symgrid.llm.sitetree import op1_html_extraction
from symgrid.llm.substring import OP10_SQL, op10_substring_dedup
from symgrid.llm.tokenfile import op5_token_id_files
from symgrid.llm.topk import OP8_SQL, op8_exact_topk_search
from symgrid.llm.urlfilter import OP4_SQL, op4_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_token_id_files": op5_token_id_files,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_secret_scans": op7_secret_scans,
    "op8_exact_topk_search": op8_exact_topk_search,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES: dict[str, str] = {
    "op4_url_filters": OP4_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op7_secret_scans": OP7_SQL,
    "op8_exact_topk_search": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
}

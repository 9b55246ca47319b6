"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pipeline
from .chat import OP10_SQL, op10_chat_formatting
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import OP1_SQL, op1_benchmark_decontamination
from .gif import op2_gif_media
from .language import op9_language_id
from .licences import op4_licence_scan
from .packing import op8_hilbert_packing
from .secrets import OP13_SQL, op13_secret_scan
from .simhash import op7_simhash_near_dedup
from .spelling import OP11_SQL, op11_spelling_variants
from .substrings import op6_substring_dedup
from .tokens import op3_token_counts
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": op1_benchmark_decontamination,
        "op2_gif_media": op2_gif_media,
        "op3_token_counts": op3_token_counts,
        "op4_licence_scan": op4_licence_scan,
        "op5_toxicity": op5_toxicity,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_hilbert_packing": op8_hilbert_packing,
        "op9_language_id": op9_language_id,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_collocations": op12_collocations,
        "op13_secret_scan": op13_secret_scan,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_benchmark_decontamination": OP1_SQL,
        "op10_chat_formatting": OP10_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_secret_scan": OP13_SQL,
        "pipeline": pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}

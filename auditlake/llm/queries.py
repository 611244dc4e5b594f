"""Registry of the subpackage's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP10_SQL, op10_tool_calls
from .decontam import op3_decontamination
from .exact import OP5_SQL, op5_exact_dedup
from .html import op7_main_text
from .language import op6_language
from .packing import op4_packing
from .repeats import op9_repeats
from .sharding import op1_hilbert_shards
from .simhash import op8_simhash
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language": op6_language,
    "op7_main_text": op7_main_text,
    "op8_simhash": op8_simhash,
    "op9_repeats": op9_repeats,
    "op10_tool_calls": op10_tool_calls,
}

SQL: dict[str, str] = {"op5_exact_dedup": OP5_SQL, "op10_tool_calls": OP10_SQL}
